"""Feature vectors and series: standard scores, lag correlations, neighbours of one class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.operators.sampling import numbered


def z_scores(df: DataFrame, by: str, value: str) -> DataFrame:
    """Adds z: the distance to the group's mean in population standard deviations, 1 where that is 0. Two aggregates and a join of few rows: no group is gathered."""
    told = df.groupBy(by).agg(F.avg(value).alias("mean_"), F.stddev_pop(value).alias("sd_"))
    return df.join(told, by).withColumn("z", (F.col(value) - F.col("mean_")) / F.when(F.col("sd_") > 1e-9, F.col("sd_")).otherwise(1.0)).drop("mean_", "sd_")


#: Distances in rows at which the order of a class is looked at.
LAGS = (1, 2, 3, 5, 10, 20, 50, 100, 200)


def lag_correlations(df: DataFrame, by: str, order: str, value: str, lags: tuple[int, ...] = LAGS, least: int = 30, block: int = 65_536, width: int = 65_536) -> DataFrame:
    """Correlation of values so many rows apart inside a group, for pairs enough.

    Rows get their place in the group and are cut into blocks by it; the first rows of a block are also lent to the
    one before, so that no pair is lost and no group is sorted in one task.
    """
    placed = numbered(df.select(by, order, value), order, by, width=width).withColumn("block", F.floor((F.col("place") - 1) / block))
    lent = placed.where((F.col("place") - 1) % block < max(lags)).withColumn("block", F.col("block") - 1).withColumn("own", F.lit(False))
    w = Window.partitionBy(by, "block").orderBy("place")
    ahead = placed.withColumn("own", F.lit(True)).unionByName(lent).select("own", F.col(value).alias("x"), *[F.lead(value, k).over(w).alias(f"l{k}") for k in lags]).where("own")
    pairs = ahead.select("x", F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("lag"), F.col(f"l{k}").alias("y")) for k in lags])).alias("p")).select("x", "p.lag", "p.y").where("x is not null and y is not null")
    return pairs.groupBy("lag").agg(F.count("*").alias("pairs"), F.corr("x", "y").alias("r")).withColumn("r", F.when(F.col("pairs") >= least, F.round("r", 9)))


def shuffled_order(df: DataFrame, key: str, seed: str) -> Column:
    """A whole number below 2^32 that orders rows at random, the same everywhere: a control for orders that mean something."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), df[key].cast("string"))), 1, 8), 16, 10).cast("bigint")


def distance2(a: str, b: str) -> Column:
    """The squared distance over the components that both have; null if there is none."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(None).cast("double"), lambda s, d: F.coalesce(s + d, s, d))


def one_near(near: DataFrame, key: str, seed: str = "near") -> DataFrame:
    """One of each query's nearest rows, at random by a hash of both."""
    race = F.md5(F.concat_ws("|", F.lit(seed), F.col("query").cast("string"), F.col(key).cast("string")))
    return near.groupBy("query").agg(F.min_by(key, race).alias(key))


def nearest_in_class(df: DataFrame, queries: DataFrame, key: str, label: str, vector: str, k: int, digits: int = 9) -> DataFrame:
    """The k nearest other rows of the same class of each query, a stated set, by the distance rounded to so many digits; ties to the smaller key, unknown distances last. Candidates are cut to k in each task before the last ranking."""
    q = queries.select(F.col(key).alias("query"), F.col(label).alias("label_"), F.col(vector).alias("q"))
    near = q.join(df, F.col("label_") == F.col(label)).where(F.col("query") != F.col(key)).select("query", key, F.round(distance2("q", vector), digits).alias("d"))
    w = Window.partitionBy("query").orderBy(F.asc_nulls_last("d"), key)
    return near.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= k)
