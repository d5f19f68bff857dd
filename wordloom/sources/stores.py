"""Archives, image sets, splits, models and reports: readers and writers beside the text formats."""

from __future__ import annotations

import io
import tarfile
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.sources.text import read_binary

ENTRY = "archive string, name string, size long, time timestamp, content binary"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share; on one machine a temporary one if none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        folder = tempfile.gettempdir()
    path = f"{folder.rstrip('/')}/wordloom-{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written and read back, for one that is used several times."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- archives and image sets


def read_archives(spark: SparkSession, path: str, contents: bool = True) -> DataFrame:
    """The files in zip and tar archives (ENTRY), an archive a task; without contents only their names, sizes and times."""
    def entries(name: str, raw: bytes) -> Iterator[tuple]:
        if zipfile.is_zipfile(io.BytesIO(raw)):
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                for i in z.infolist():
                    if not i.is_dir():
                        yield name, i.filename, i.file_size, pd.Timestamp(*i.date_time, tz="UTC"), z.read(i) if contents else None
        else:
            with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                for m in t:
                    if m.isfile():
                        yield name, m.name.removeprefix("./"), m.size, pd.Timestamp(m.mtime, unit="s", tz="UTC"), t.extractfile(m).read() if contents else None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name, raw in zip(pdf["name"], pdf["content"], strict=True):
                yield pd.DataFrame(list(entries(name, raw)), columns=["archive", "name", "size", "time", "content"])

    return read_binary(spark, path, "*.{zip,tar}").select("name", "content").mapInPandas(run, ENTRY)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """The same rows of the files of a folder; names are relative to it."""
    files = read_binary(spark, path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("time"), "content")
    root = F.lit(path.rstrip("/") + "/")
    return files.select(F.lit(path).alias("archive"), F.substring_index("path", root, -1).alias("name"), "size", "time", "content")


def described(entries: DataFrame, name: str = "name") -> DataFrame:
    """Adds an entry's stem, extension, folders, its split and label (the innermost folder made of digits, and the split's among those above) and whether it is a system's file."""
    parts = F.split(F.regexp_replace(F.col(name), "\\\\", "/"), "/")
    base, folders = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1)
    label = F.try_element_at(F.filter(folders, lambda f: f.rlike("^[0-9]+$")), F.lit(-1))
    split = F.try_element_at(F.filter(F.transform(folders, F.lower), lambda f: f.isin("train", "val", "validation", "test")), F.lit(-1))
    ext = F.when(F.contains(base, F.lit(".")), F.lower(F.substring_index(base, ".", -1)))
    return entries.select("*", F.regexp_replace(base, "\\.[^.]*$", "").alias("stem"), ext.alias("ext"), folders.alias("folders"), split.alias("split"), label.cast("int").alias("label"), (base.startswith(".") | F.exists(folders, lambda f: f.startswith("__"))).alias("system"))


def image_set(entries: DataFrame) -> DataFrame:
    """(row, name, text, content): the images of a set, joined to its labels.tsv, whose order counts; a label without an image has null content."""
    lines = entries.where(F.col("name") == "labels.tsv").select(F.posexplode(F.split(F.decode("content", "UTF-8"), "\r?\n")).alias("row", "line")).where("line <> ''")
    labels = lines.select(F.col("row").cast("long").alias("row"), F.split_part("line", F.lit("\t"), F.lit(1)).alias("name"), F.split_part("line", F.lit("\t"), F.lit(2)).alias("text"))
    images = entries.where(F.col("name").startswith("images/")).select(F.substring_index("name", "/", -1).alias("name"), "content")
    return labels.join(images, "name", "left").select("row", "name", "text", "content")


def side_json(entries: DataFrame, name: str, schema: str) -> DataFrame:
    """The JSON file of a set as one row of a schema; no row if the set has none."""
    return entries.where(F.col("name") == name).select(F.from_json(F.decode("content", "UTF-8"), schema).alias("j")).select("j.*")


def item_kinds(images: DataFrame, items: DataFrame) -> DataFrame:
    """Adds the kind that the manifest gives an image's file; null if it gives none."""
    return images.join(items.select(F.col("file").alias("name"), "kind"), "name", "left")


def write_image_set(images: DataFrame, path: str, config: dict) -> None:
    """(name, text, content) and the settings as tables: images, and one row of JSON."""
    import json

    images.select("name", "text", "content").write.parquet(f"{path}/images")
    images.sparkSession.createDataFrame([(json.dumps(config, sort_keys=True),)], "config string").write.text(f"{path}/config")


def split_rows(rows: DataFrame, duplicates: DataFrame, split: str, key: Column) -> DataFrame:
    """The rows of a split less those that the listing of duplicates (group, split, label, path) bars: groups of several labels, and for the test part groups that hold a training row."""
    told = duplicates.groupBy("group").agg(F.count_distinct("label").alias("labels"), F.max((F.col("split") == "train").cast("int")).alias("trained"))
    bad = duplicates.join(told, "group").where((F.col("labels") > 1) | ((F.col("split") == "test") & (F.col("trained") == 1) & F.lit(split == "test"))).select(path_key(F.col("path")).alias("bad_")).distinct()
    return rows.join(bad, key == F.col("bad_"), "left_anti")


def path_key(path: Column) -> Column:
    """A path's last three parts, with slashes."""
    parts = F.split(F.regexp_replace(path, "\\\\", "/"), "/")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 2), F.lit(3)), "/")


def grey(pixels: Column) -> Column:
    """Rows of pixels (red, green, blue, alpha) as rows of grey levels: laid on white, then the integer weights of the three colours."""
    def level(p: Column) -> Column:
        r, g, b = (F.floor((p[k] * p[3] + 255 * (255 - p[3])) / 255 + 0.5).cast("int") for k in range(3))
        return F.shiftright(r * 19595 + g * 38470 + b * 7471 + 32768, 16)

    return F.transform(pixels, lambda row: F.transform(row, level))


# ---------------------------------------------------------------- models, lists, reports


def write_model(tables: dict[int, DataFrame], path: str) -> None:
    """A character model's tables by order, sorted by history for reading ranges of it."""
    for n, table in tables.items():
        table.sortWithinPartitions("h", "c").write.parquet(f"{path}/n={n}")


def read_model(spark: SparkSession, path: str, order: int) -> dict[int, DataFrame]:
    return {n: spark.read.schema("h string, c string, cnt double").parquet(f"{path}/n={n}") for n in range(1, order + 1)}


def write_word_lists(counts: DataFrame, path: str) -> None:
    """A list for each source and subset, most frequent words first in each file."""
    counts.repartition("source", "subset").sortWithinPartitions("source", "subset", F.desc("n"), "word").write.partitionBy("source", "subset").option("sep", "\t").csv(path)


def read_word_lists(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema("word string, n long, source string, subset string").csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines, null fields included."""
    df.write.option("ignoreNullFields", False).json(path)


def write_listing(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.option("header", True).csv(path)


def updated(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of both, the new one where a key is in both."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
