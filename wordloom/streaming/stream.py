"""Streams: deterministic items, counts over files, batches sorted by width."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions.text import fraction
from wordloom.operators.sampling import numbered
from wordloom.sources.stores import scratch


def items(spark: SparkSession, first: int, last: int, seed: str, parts: int | None = None) -> DataFrame:
    """Items first..last-1: each a pure function of seed and number, so any range can be replayed anywhere."""
    numbers = spark.range(first, last, 1, parts).withColumnRenamed("id", "item")
    u = fraction(F.col("item").cast("string"), seed)
    return numbers.withColumn("u", u).withColumn("kind", F.when(u < 0.03, "number").when(u < 0.13, "built").when(u < 0.23, "scrambled").otherwise("lexicon"))


def rate_items(spark: SparkSession, rows: int, seed: str) -> DataFrame:
    """The same without an end, one item for each row of the rate source."""
    rated = spark.readStream.format("rate").option("rowsPerSecond", rows).load().withColumnRenamed("value", "item")
    return rated.withColumn("u", fraction(F.col("item").cast("string"), seed))


def drained(spark: SparkSession, stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that a finite aggregate stream holds, by available-now runs whose last state is written out as a table."""
    path = scratch(spark, f"stream-{name}")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}-offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    last = max((p["batchId"] for p in query.recentProgress if p["batchId"] >= 0), default=None)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    batches = sorted(f.getPath().getName() for f in hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)) if last is not None else []
    if not batches:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/{batches[-1]}" if mode == "complete" else path)


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_at_once: int = 64) -> DataFrame:
    """The Parquet files of a table, one file or a folder of parts, as a stream."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder, glob = (path, "*.parquet") if jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(jvm).isDirectory() else path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", glob).parquet(folder)


def event_counts(events: DataFrame) -> DataFrame:
    """Events and total value by type: an update-able aggregate with a row of state for each type."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(20,6)")).alias("total"))


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """An extension the reference lacks: tumbling windows over event time, with a watermark that bounds the state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))


def width_batches(batch: DataFrame, width: str, size: int, key: str, seed: str = "order") -> DataFrame:
    """Adds batch and turn: rows sorted by width, then key, cut into batches of a size, and the batches' random order, by a hash.

    Rows get their place by buckets of widths, so they are not sorted in one task.
    """
    placed = numbered(batch.withColumn("wide_", F.col(width).cast("long") * F.lit(1 << 32) + F.pmod(F.xxhash64(key), F.lit(1 << 32))), "wide_", width=1 << 38)
    dealt = placed.drop("wide_").withColumn("batch", F.floor((F.col("place") - 1) / size).cast("bigint")).drop("place")
    return dealt.withColumn("turn", F.md5(F.concat(F.lit(seed + "|"), F.col("batch").cast("string"))))


def checked(batch: DataFrame, bad: str, share: float = 0.5) -> DataFrame:
    """Good rows; fails if more than the share of the batch is bad."""
    ok = batch.agg(F.assert_true(F.count_if(F.col(bad)) <= share * F.count("*"), F.lit("too many items failed")).alias("ok"))
    return batch.crossJoin(F.broadcast(ok)).where(F.col("ok").isNull() & ~F.col(bad)).drop("ok")


def pooled(stream: DataFrame, path: str, width: str, key: str, size: int, bad: str, validate=None, every: int = 10) -> None:
    """Runs a finite stream in pools, a micro-batch each: bad items skipped (too many fail the pool), the rest cut into batches of like width and written.

    The query's offsets are kept beside the output, so a run that is stopped goes on where it was and writes a pool
    again under the same number. After every so many pools ``validate`` is called with the pool's number.
    """
    def pool(batch: DataFrame, number: int) -> None:
        width_batches(checked(batch, bad), width, size, key).write.mode("overwrite").parquet(f"{path}/pools/pool={number}")
        if validate is not None and (number + 1) % every == 0:
            validate(number)

    query = stream.writeStream.foreachBatch(pool).option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
