"""Readers of text corpora and small record formats, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

CORPUS = "source string, doc string, chunk_no bigint, text string"


def numbered_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, row, text): the lines of text files, plain, gzip or bzip2 by suffix, with their number in the file, from 0.

    Folders are read whole, bad bytes replaced. A large file is read in several splits: lines are numbered within a
    split as they come, after the lines of the splits before, so numbers do not change with the splits.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    lines = lines.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("_metadata.file_path").alias("path_"), F.col("_metadata.file_block_start").alias("at_"), F.monotonically_increasing_id().alias("id_"), F.make_valid_utf8("value").alias("text"))
    splits = lines.groupBy("path_", "at_").agg(F.min("id_").alias("first_"), F.count("*").alias("n_"))
    before = F.sum("n_").over(Window.partitionBy("path_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("path_", "at_", (F.coalesce(before, F.lit(0)) - F.col("first_")).alias("shift_"))
    return lines.join(splits, ["path_", "at_"]).select("file", (F.col("id_") + F.col("shift_")).alias("row"), "text", "path_", "at_")


def read_lines(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Text, CSV and TSV files as chunks, one a line; a file is a document."""
    return numbered_lines(spark, path).select(F.lit(source).alias("source"), F.col("file").alias("doc"), F.col("row").alias("chunk_no"), "text")


def read_json_lines(spark: SparkSession, path: str, source: str) -> DataFrame:
    """JSON objects by line: the field text if it is a string, else all string fields; other lines are skipped but counted.

    Numbers, booleans and nested values are no texts.
    """
    parsed = numbered_lines(spark, path).select("file", "row", F.from_json("text", "map<string, variant>").alias("m")).where("m is not null")
    strings = F.map_filter("m", lambda _, v: F.schema_of_variant(v) == "STRING")
    texts = F.transform(F.map_entries(strings), lambda e: F.struct(e["key"].alias("k"), e["value"].cast("string").alias("t")))
    own = F.filter(texts, lambda e: e["k"] == "text")
    picked = parsed.select("file", "row", F.explode(F.when(F.size(own) > 0, own).otherwise(texts)).alias("e"))
    return picked.select(F.lit(source).alias("source"), F.concat_ws("#", "file", F.col("row").cast("string")).alias("doc"), F.col("row").alias("chunk_no"), F.col("e.t").alias("text"))


def read_pages(spark: SparkSession, path: str, source: str, mark: str = "<page>") -> DataFrame:
    """An XML dump line by line, bzip2 included: every line is a chunk of the page that was opened last, whatever its nesting.

    Pages are numbered in each file from 1, in order; what stands before the first is page 0.
    """
    lines = numbered_lines(spark, path).withColumn("opens", F.contains("text", F.lit(mark)).cast("long"))
    splits = lines.groupBy("path_", "at_").agg(F.sum("opens").alias("n_"))
    before = F.sum("n_").over(Window.partitionBy("path_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("path_", "at_", F.coalesce(before, F.lit(0)).alias("before_"))
    # a split is a bounded part of a file
    own = F.sum("opens").over(Window.partitionBy("path_", "at_").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    paged = lines.withColumn("own_", own).join(splits, ["path_", "at_"])
    return paged.select(F.lit(source).alias("source"), F.concat("file", F.lit("#page"), (F.col("before_") + F.col("own_")).cast("string")).alias("doc"), F.col("row").alias("chunk_no"), "text")


def read_table(df: DataFrame, source: str, key: str) -> DataFrame:
    """A table's column text, or every string column, as chunks; the table's own key names the documents."""
    fields = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    picked = ["text"] if "text" in fields else fields
    chunk = F.posexplode(F.array(*[F.col(c) for c in picked])).alias("chunk_no", "text")
    doc = F.concat(F.lit(source + "#"), F.col(key).cast("string"))
    return df.select(F.lit(source).alias("source"), doc.alias("doc"), chunk).withColumn("chunk_no", F.col("chunk_no").cast("bigint"))


def read_counts(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Word and count by line, TAB between; lines whose count is no number are dropped, repeated words added up."""
    rows = spark.read.option("sep", "\t").schema("word string, count string").csv(path)
    number = r"^[0-9]+$" if strict else r"^\s*[0-9]+\s*$"
    return rows.where(F.col("count").rlike(number)).groupBy("word").agg(F.sum(F.trim("count").cast("bigint")).alias("n"))


def write_counts(counts: DataFrame, path: str) -> None:
    """Word and count by line, most frequent first, ties by word."""
    counts.orderBy(F.desc("n"), "word").select("word", "n").write.option("sep", "\t").csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).schema("file string, reference string, kind string, greedy string, with_lm string").csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The items of a manifest, one row each."""
    item = "item int, page int, text string, kind string, status string, flags array<string>, file string, size array<int>"
    return spark.read.option("multiLine", True).schema(f"items array<struct<{','.join(f'{a}:{b}' for a, b in (x.strip().split(' ', 1) for x in item.split(', ')))}>>").json(path).select(F.explode("items").alias("i")).select("i.*")


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files with their bytes, name parts and times."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1))
