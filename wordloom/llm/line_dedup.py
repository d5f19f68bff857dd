"""Line dedup over overlapping windows of three lines, with DataFrame functions alone.

A text's lines are what stands between line feeds. Each run of three lines is a window; its 128-bit hash finds
repeated windows in all the documents. The first occurrence, by doc_id and then by position, stays; every other
occurrence covers its three lines, covered positions are merged, and covered lines go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import col, fresh, whole_text

#: Lines of a window.
WINDOW = 3
#: Separates hash values of the two halves of a window's identity; any fixed value does.
_SECOND = "second half"


def windows(key: Column, text: Column, docs: DataFrame) -> DataFrame:
    """(d, p, a, b): each window's document key, first line (from 0) and 128-bit hash."""
    lines = F.split(text, "\n", -1)
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(_SECOND)).alias("b")))
    held = docs.select(key.alias("d"), hashed.alias("h")).where(F.size("h") >= WINDOW)
    # three shifted views of the same array, side by side
    n = F.size("h") - (WINDOW - 1)
    view = [F.slice(F.col("h"), F.lit(i + 1), n) for i in range(WINDOW)]
    each = held.select("d", F.posexplode(F.arrays_zip(*[v.alias(f"l{i}") for i, v in enumerate(view)])).alias("p", "w"))
    parts = [f"l{i}" for i in range(WINDOW)]
    return each.select("d", "p", F.xxhash64(*[F.col("w")[x]["a"] for x in parts]).alias("a"), F.xxhash64(*[F.col("w")[x]["b"] for x in parts]).alias("b"))


def _place(d: str = "d", p: str = "p") -> Column:
    """Document and position as one number that orders as the pair does and that hash aggregation can keep the least of."""
    return F.col(d).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col(p).cast("decimal(10,0)")


def covered_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, first lines of the later occurrences): one row for each document that has any; d is never null."""
    key = F.coalesce(col(doc_id).cast("long"), F.lit(-(1 << 63)))
    every = windows(key, whole_text(text), docs)
    first = every.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(_place()).alias("first")).where("n > 1").drop("n")
    later = every.join(first, ["a", "b"]).where(_place() > F.col("first"))
    return later.groupBy("d").agg(F.collect_set("p").alias("starts"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kept: str | None = None) -> DataFrame:
    """Adds the kept text (or replaces the text, if ``kept`` is None), n_lines, n_removed and n_spans.

    Null texts count as empty; a text of fewer than three lines has no window and stays as it is. Empty lines are
    lines. Rows that share a doc_id count as one document in the order of occurrences: a window at the same
    position of two such rows is no later occurrence, and lines covered in one are covered in the other. Null ids
    come first, together. Each row gives one row; clashing names of further columns are an error.
    """
    names = ("n_lines", "n_removed", "n_spans", *([kept] if kept else []))
    if clash := {c.lower() for c in docs.columns} & {n.lower() for n in names}:
        raise ValueError(f"the documents already have {sorted(clash)}")
    d, found = fresh(docs, "line_key"), fresh(docs, "line_starts")
    starts = covered_lines(docs, doc_id, text).select(F.col("d").alias(d), F.col("starts").alias(found))
    both = docs.withColumn(d, F.coalesce(col(doc_id).cast("long"), F.lit(-(1 << 63)))).join(starts, d, "left")
    s, ls, cov = fresh(both, "starts_"), fresh(both, "lines_"), fresh(both, "covered_")
    both = both.withColumn(s, F.coalesce(F.col(found), F.array().cast("array<int>"))).withColumn(ls, F.split(whole_text(text), "\n", -1))
    # merged positions: each start covers itself and the next two lines of this row
    both = both.withColumn(cov, F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(F.col(s), lambda x: F.array(*[x + i for i in range(WINDOW)]))), lambda x: x < F.size(ls)))))
    # a line is kept if no covered position is its own; the covered positions cut the lines into slices, so this is linear
    edges = F.concat(F.array(F.lit(-1)), F.col(cov), F.array(F.size(ls)))
    slices = F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1), lambda a, b: F.slice(F.col(ls), a + 2, b - a - 1))
    rest = F.when(F.size(cov) == 0, whole_text(text)).otherwise(F.array_join(F.flatten(slices), "\n"))
    spans = F.size(F.filter(F.zip_with(F.slice(edges, 1, F.size(edges) - 2), F.col(cov), lambda a, b: (b - a > 1) | (a == -1)), lambda x: x))
    out = both.select(*[col(c) for c in docs.columns if kept or c != text], *([rest.alias(kept)] if kept else [rest.alias(text)]), F.size(ls).cast("long").alias("n_lines"), F.size(cov).cast("long").alias("n_removed"), spans.cast("long").alias("n_spans"))
    return out.select(*[col(c) for c in docs.columns], *names)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated windows: counts and the digest of what is kept."""
    from wordloom.llm.common import table

    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


SQL = """
with lines as (
  select doc_id, generate_subscripts(l, 1) - 1 as p, unnest(l) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)),
w as (
  select doc_id, p, line,
    lead(line, 1) over o as l2, lead(line, 2) over o as l3
  from lines window o as (partition by doc_id order by p)),
h as (select doc_id, p, md5(line || chr(10) || l2 || chr(10) || l3) as k from w where l3 is not null),
later as (
  select doc_id, p from (
    select doc_id, p, row_number() over (partition by k order by doc_id, p) as r from h) where r > 1),
covered as (
  select distinct doc_id, p + i as p from later, (select unnest([0, 1, 2]) as i)),
marked as (
  select l.doc_id, l.p, l.line, c.p is not null as gone,
    lag(c.p is not null, 1, false) over (partition by l.doc_id order by l.p) as before
  from lines l left join covered c on l.doc_id = c.doc_id and l.p = c.p)
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_removed,
  count(*) filter (gone and not before)::bigint as n_spans,
  sha256(coalesce(string_agg(line, chr(10) order by p) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""
