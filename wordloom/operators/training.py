"""Measures over a training history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_best(df: DataFrame, step: str, measure: str, *by: str) -> DataFrame:
    """Adds the least measure so far, and whether the row sets it."""
    w = Window.partitionBy(*by).orderBy(step)
    before = F.min(measure).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("best", F.min(measure).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("improved", before.isNull() | (F.col(measure) < before))


def learning_rate(step: Column, peak: float, warm: int, total: int) -> Column:
    """Linear warm-up, then a cosine to zero."""
    return F.when(step < warm, peak * (step + 1) / warm).otherwise(peak * 0.5 * (1 + F.cos(3.141592653589793 * (step - warm) / (total - warm))))


def moving_average(values: Column, decay: float = 0.999) -> Column:
    """The exponential average of an ordered array with a warm-up: decay min(decay, (1 + i) / (10 + i))."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("a"))

    def step(s, v):
        d = F.least(F.lit(decay), (1.0 + s["i"]) / (10.0 + s["i"]))
        return F.struct((s["i"] + 1).alias("i"), F.when(s["i"] == 0, v).otherwise(d * s["a"] + (1 - d) * v).alias("a"))

    return F.aggregate(values, start, step, lambda s: s["a"])
