"""Queries through files: each writes a table in a format of the corpora and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.operators import corpus, language_model
from wordloom.plans.catalogue import _SRC, _W, _counts, _model_words, _sources, _t, query
from wordloom.sources import stores
from wordloom.sources import text as formats
from wordloom.sources.stores import scratch
from wordloom.streaming import stream

_K = "'document ' || doc_id::varchar"


@query(f"with {_W} select word, n::bigint as n from w")
def counts_list(spark, sf_dir):
    """A word list written, most frequent first, and read."""
    path = scratch(spark, "counts")
    formats.write_counts(_counts(spark, sf_dir), path)
    return formats.read_counts(spark, path)


@query("select doc_id, regexp_replace(line, '[ \t]+$', '') as text from (select doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '[\\r\\n]+', ' ', 'g') || chr(10) || 'end', chr(10))) as line from documents) where line <> ''")
def text_lines(spark, sf_dir):
    """Documents as gzip text, two lines each, and their lines back, without trailing blanks."""
    path = scratch(spark, "lines")
    flat = F.regexp_replace(F.coalesce("text", F.lit("")), "[\r\n]+", " ")
    _t(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("\t"), flat, F.lit("\n"), F.col("doc_id").cast("string"), F.lit("\tend"))).write.option("compression", "gzip").text(path)
    lines = formats.read_lines(spark, path, "s")
    return lines.select(F.substring_index("text", "\t", 1).cast("bigint").alias("doc_id"), F.regexp_replace(F.substring("text", F.instr("text", "\t") + 1, F.length("text")), r"[ \t]+$", "").alias("text")).where("text <> ''")


@query("select 'text' as what, count(*)::bigint as chunks, sum(length(text))::bigint as characters from documents where doc_id % 2 = 0 and text is not null union all select 'fields', count(*), sum(length(lang) + length(source)) from documents where doc_id % 2 <> 0 and lang is not null and source is not null")
def json_lines(spark, sf_dir):
    """JSON lines of numbers, booleans and strings: the field text where there is one, else every string."""
    path = scratch(spark, "json")
    docs = _t(spark, sf_dir, "documents").where("(doc_id % 2 = 0 and text is not null) or (doc_id % 2 <> 0 and lang is not null and source is not null)")
    with_text = F.to_json(F.struct("doc_id", "text", "lang"))
    without = F.to_json(F.struct("doc_id", "lang", "source", F.lit(True).alias("kept")))
    docs.select(F.when(F.col("doc_id") % 2 == 0, with_text).otherwise(without)).write.text(path)
    chunks = formats.read_json_lines(spark, path, "s").groupBy("doc").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c"))
    told = chunks.groupBy(F.when(F.col("n") == 1, "text").otherwise("fields").alias("what"))
    return told.agg(F.count("*").alias("chunks"), F.sum("c").cast("bigint").alias("characters"))


@query("select length(coalesce(lang, ''))::bigint as title, count(*)::bigint as pages, 4::bigint * count(*) as lines from documents group by 1")
def page_dump(spark, sf_dir):
    """An XML dump with texts nested in revisions: lines by page."""
    path = scratch(spark, "dump")
    lines = F.concat_ws("\n", F.lit("<page>"), F.concat(F.lit("<title>"), F.coalesce("lang", F.lit("")), F.lit("</title>")), F.concat(F.lit("<revision><text>"), F.col("doc_id").cast("string"), F.lit("</text></revision>")), F.lit("</page>"))
    _t(spark, sf_dir, "documents").select(lines).write.text(path)
    pages = formats.read_pages(spark, path, "s").groupBy("doc").agg(F.count("*").alias("lines"), F.max(F.length(F.regexp_extract("text", "<title>(.*)</title>", 1))).alias("title"))
    return pages.groupBy(F.col("title").cast("bigint").alias("title")).agg(F.count("*").alias("pages"), F.sum("lines").alias("lines"))


@query("select doc_id::varchar as doc, text from documents where text is not null")
def table_texts(spark, sf_dir):
    """A table's texts as chunks, named by its own key."""
    chunks = formats.read_table(_t(spark, sf_dir, "documents"), "d", "doc_id").where("text is not null")
    return chunks.select(F.substring_index("doc", "#", -1).alias("doc"), "text")


@query(f"with {_SRC}, t as (select source, word, count(*) as n from (select source, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) as word from src) group by all) select source, case when n > 1 then 'repeated' else 'single' end as subset, count(*)::bigint as words, sum(n)::bigint as running from t group by all")
def word_lists(spark, sf_dir):
    """A list for each source and subset, written by folder and read again."""
    path = scratch(spark, "lists")
    counts = corpus.word_counts(_sources(spark, sf_dir), "source").withColumn("subset", F.when(F.col("n") > 1, "repeated").otherwise("single"))
    stores.write_word_lists(counts, path)
    return stores.read_word_lists(spark, path).groupBy("source", "subset").agg(F.count("*").alias("words"), F.sum("n").alias("running"))


@query("select lang, count(*)::bigint as documents, max(n_chars)::bigint as longest from documents group by 1")
def report_lines(spark, sf_dir):
    """A report as JSON lines."""
    path = scratch(spark, "report")
    stores.write_report(_t(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.max("n_chars").cast("bigint").alias("longest")), path)
    return spark.read.schema("lang string, documents long, longest long").json(path)


_LISTING = "d as (select doc_id, md5(text) as digest, source, case when doc_id % 10 < 8 then 'train' else 'test' end as part from documents), g as (select digest from d group by 1 having count(*) > 1), l as (select d.* from d join g using (digest))"


def _listing(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("group"), F.when(F.col("doc_id") % 10 < 8, "train").otherwise("test").alias("split"), F.col("source").alias("label"))
    twice = docs.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    return docs, docs.join(twice, "group").withColumn("path", F.concat(F.lit("set/docs/d"), F.col("doc_id").cast("string"), F.lit(".txt")))


@query(f"with {_LISTING} select digest, count(*)::bigint as files, count(distinct source)::bigint as labels from l group by 1")
def duplicates_listing(spark, sf_dir):
    """The listing of duplicates as CSV."""
    path = scratch(spark, "duplicates")
    stores.write_listing(_listing(spark, sf_dir)[1].select("group", "split", "label", "path"), path)
    back = spark.read.option("header", True).schema("group string, split string, label string, path string").csv(path)
    return back.groupBy(F.col("group").alias("digest")).agg(F.count("*").alias("files"), F.count_distinct("label").alias("labels"))


@query(f"with {_LISTING}, b as (select digest from l group by 1 having count(distinct source) > 1), t as (select distinct digest from l where part = 'train') select doc_id from d where part = 'test' and digest not in (select digest from b) and digest not in (select digest from t)")
def split_loader(spark, sf_dir):
    """The test part less what the listing of duplicates bars."""
    docs, listing = _listing(spark, sf_dir)
    rows = docs.where("split = 'test'").withColumn("path", F.concat(F.lit("C:\\set\\docs\\d"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return stores.split_rows(rows, listing, "test", stores.path_key(F.col("path"))).select("doc_id")


@query("select p_partkey::varchar || '.png' as name, p_name as text, p_brand as kind, length(p_name)::bigint as bytes from part")
def image_set(spark, sf_dir):
    """Images, labels and manifest of a set, joined by file name."""
    part = _t(spark, sf_dir, "part")
    name = F.concat(F.col("p_partkey").cast("string"), F.lit(".png"))
    path = scratch(spark, "set")
    stores.write_image_set(part.select(name.alias("name"), F.col("p_name").alias("text"), F.encode("p_name", "UTF-8").alias("content")), path, {"seed": 1})
    items = part.select(name.alias("file"), F.col("p_brand").alias("kind"))
    return stores.item_kinds(spark.read.parquet(f"{path}/images"), items).select("name", "text", "kind", F.octet_length("content").cast("bigint").alias("bytes"))


@query(f"with {_W}, g as (select ('^^' || word || '$')[i:i+1] as h, ('^^' || word || '$')[i+2] as c from (select word, unnest(range(1, length(word) + 2)) as i from w)) select h, c, count(*)::double as cnt from g group by all")
def model_tables(spark, sf_dir):
    """A character model written by order, and its highest order read."""
    path = scratch(spark, "model")
    stores.write_model(language_model.counts(_model_words(spark, sf_dir)), path)
    return stores.read_model(spark, path, 3)[3]


@query("select p_partkey::varchar as file, p_name as reference, p_brand as kind, upper(p_name) as greedy, p_name as with_lm from part")
def predictions_list(spark, sf_dir):
    """Predictions as TAB-separated text with a header."""
    path = scratch(spark, "predictions")
    part = _t(spark, sf_dir, "part")
    part.select(F.col("p_partkey").cast("string").alias("file"), F.col("p_name").alias("reference"), F.col("p_brand").alias("kind"), F.upper("p_name").alias("greedy"), F.col("p_name").alias("with_lm")).write.option("sep", "\t").option("header", True).csv(path)
    return formats.read_predictions(spark, path)


@query("select coalesce(n.doc_id, o.doc_id) as doc_id, coalesce(n.quality, o.quality)::bigint as quality from (select doc_id, quality from labels) o full join (select doc_id + 1 as doc_id, 9 as quality from labels where doc_id % 3 = 0) n using (doc_id)")
def updated_report(spark, sf_dir):
    """A kept report that takes over a newer one's samples by name."""
    labels = _t(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("bigint").alias("quality"))
    new = labels.where("doc_id % 3 = 0").select((F.col("doc_id") + 1).alias("doc_id"), F.lit(9).cast("bigint").alias("quality"))
    return stores.updated(labels, new, "doc_id")


_BATCH = "k as (select doc_id, n_chars, (row_number() over (order by n_chars) - 1) // 64 as batch from documents)"


@query(f"with {_BATCH} select batch::bigint as batch, count(*)::bigint as n, min(n_chars)::bigint as narrowest, max(n_chars)::bigint as widest from k group by 1")
def width_batches(spark, sf_dir):
    """Rows sorted by width and cut into batches of 64, the batches in random order."""
    dealt = stream.width_batches(_t(spark, sf_dir, "documents"), "n_chars", 64, "doc_id")
    return dealt.groupBy("batch").agg(F.count("*").alias("n"), F.min("n_chars").cast("bigint").alias("narrowest"), F.max("n_chars").cast("bigint").alias("widest"))


@query("select count(*)::bigint as items, sum(doc_id)::bigint as ids, count(distinct doc_id)::bigint as distinct_items from documents where doc_id % 7 <> 0")
def pooled_stream(spark, sf_dir):
    """The documents as a stream, pooled, bad items skipped, batches written; a second run finds nothing left to do."""
    path = scratch(spark, "pool")
    table = f"{sf_dir}/documents.parquet"
    schema = spark.read.parquet(table).schema
    for _ in range(2):
        items = stream.file_stream(spark, table, schema, 4).select("doc_id", "n_chars", (F.col("doc_id") % 7 == 0).alias("bad"))
        stream.pooled(items, path, "n_chars", "doc_id", 64, "bad")
    return spark.read.parquet(f"{path}/pools").agg(F.count("*").alias("items"), F.sum("doc_id").alias("ids"), F.count_distinct("doc_id").alias("distinct_items"))
