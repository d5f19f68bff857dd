"""Numbers in names: how they fill their ranges and recur over classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def number_use(df: DataFrame, label: str, number: str) -> DataFrame:
    """One row on the numbers of rows (label, number): how many, their range, most repeats within a class, the median
    share of a class's range that is filled, the median number of classes of a value, and the share of the values in
    half the classes or more. Everything follows from counts of (label, number), so no class is gathered."""
    pairs = df.groupBy(F.col(label).alias("label"), F.col(number).alias("number")).agg(F.count("*").alias("n"))
    by_class = pairs.groupBy("label").agg(F.max("n").alias("most"), (F.count("*") / (F.max("number") - F.min("number") + 1)).alias("fill"))
    classes = by_class.agg(F.count("*").alias("classes"), F.max("most").alias("max_repeats"), F.median("fill").alias("median_fill"))
    values = pairs.groupBy("number").agg(F.sum("n").alias("n"), F.count("*").alias("held")).crossJoin(F.broadcast(classes))
    return values.groupBy("classes", "max_repeats", "median_fill").agg(
        F.sum("n").alias("files"), F.count("*").alias("distinct_values"), F.min("number").alias("least"), F.max("number").alias("most"),
        F.median("held").alias("median_classes"), F.avg((F.col("held") >= F.col("classes") / 2).cast("int")).alias("widespread"))


def same_number(df: DataFrame, split: str, label: str, number: str, value: str) -> DataFrame:
    """Pairs of values that carry one number in consecutive classes of a split."""
    w = Window.partitionBy(split, number).orderBy(label)
    return df.select(split, number, F.col(label).alias("label_a"), F.lead(label).over(w).alias("label_b"), F.col(value).alias("a"), F.lead(value).over(w).alias("b")).where("label_a <> label_b")


def sizes(df: DataFrame, label: str, size: str) -> DataFrame:
    """Each class's commonest size (the least of equal ones), its rows, and the number of rows and of sizes that differ from it."""
    n = df.groupBy(F.col(label).alias("label"), F.col(size).alias("size")).agg(F.count("*").alias("n"))
    told = n.groupBy("label").agg(F.max_by("size", F.struct("n", (-F.col("size")).alias("s"))).alias("common"), F.max("n").alias("common_rows"), F.sum("n").alias("rows"), F.count("*").alias("sizes"))
    return told.select("label", "common", "common_rows", (F.col("rows") - F.col("common_rows")).alias("other_rows"), (F.col("sizes") - 1).alias("other_sizes"))
