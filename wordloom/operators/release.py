"""Public releases of a set: written items, corrected labels, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import characters


def release(items: DataFrame, labels: DataFrame, corrections: DataFrame) -> DataFrame:
    """(item, page, file, text, kind, flags, was, reason): the written items with corrected texts and nothing else of the manifest.

    Fails if a correction names a file that is not among them, or if manifest and labels (file, text) disagree.
    """
    written = items.where("status = 'written'")
    unknown = corrections.join(written, "file", "left_anti").agg(F.assert_true(F.count("*") == 0, F.lit("corrections for files not in the set")).alias("a"))
    told = written.select("item", "page", "file", "kind", "flags", F.col("text").alias("told"))
    joined = told.join(labels.select("file", F.col("text").alias("was")), "file", "left")
    odd = joined.where("not (told <=> was)").agg(F.assert_true(F.count("*") == 0, F.lit("manifest and labels disagree")).alias("b"))
    fixed = joined.join(corrections.select("file", F.col("text").alias("now"), "reason"), "file", "left")
    text = F.coalesce("now", "was")
    out = fixed.select("item", "page", "file", text.alias("text"), "kind", "flags", F.when(F.col("now").isNotNull(), F.col("was")).alias("was"), "reason")
    # the filter keeps the checks in the plan
    return out.crossJoin(F.broadcast(unknown)).crossJoin(F.broadcast(odd)).where("a is null and b is null").drop("a", "b")


def counted(items: DataFrame, *names: str) -> DataFrame:
    """(what, value, n): how often each value of some columns occurs, each item of an array for itself. One pass."""
    kinds = dict(items.dtypes)

    def each(c: str) -> Column:
        values = F.col(c) if kinds[c].startswith("array") else F.array(F.col(c))
        return F.transform(values, lambda v: F.struct(F.lit(c).alias("what"), v.cast("string").alias("value")))

    pairs = [each(c) for c in names]
    return items.select(F.explode(F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<struct<what:string,value:string>>")) for p in pairs]))).alias("p")).groupBy("p.what", "p.value").agg(F.count("*").alias("n"))


def summary(items: DataFrame) -> DataFrame:
    """One row: words, characters, distinct characters, words corrected."""
    n = items.agg(F.count("*").alias("words"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("bigint").alias("characters"), F.count("reason").alias("corrected"))
    distinct = items.select(F.explode(characters(F.col("text"))).alias("ch")).where("ch <> ''").agg(F.count_distinct("ch").alias("distinct_characters"))
    return n.crossJoin(F.broadcast(distinct))
