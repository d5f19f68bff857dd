"""Interpolated Kneser-Ney character models as tables of n-grams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.sources.stores import scratch

DISCOUNT = 0.75
#: Fixed symbols: the start that pads histories and the end of a word.
START, END = "^", "$"


def _grams(words: DataFrame, order: int, weight: Column) -> DataFrame:
    """(h, c, w): each character and the end, after the order - 1 symbols before it."""
    padded = F.concat(F.lit(START * (order - 1)), F.col("word"), F.lit(END))
    at = F.explode(F.sequence(F.lit(1), F.length("word") + 1)).alias("i")
    return words.select(padded.alias("p"), weight.alias("w"), at).select(F.substring("p", F.col("i"), F.lit(order - 1)).alias("h"), F.substring("p", F.col("i") + (order - 1), F.lit(1)).alias("c"), "w")


def counts(words: DataFrame, order: int = 3, weight: Column | None = None) -> dict[int, DataFrame]:
    """By order (h, c, cnt): weighted counts at the top, below it the number of different symbols seen before the rest.

    The top order is written once, in the shared folder: every use of a table starts from it, not from the words.
    """
    top = _grams(words, order, F.lit(1.0) if weight is None else weight).groupBy("h", "c").agg(F.sum("w").alias("cnt"))
    path = scratch(words.sparkSession, "grams")
    top.write.parquet(path)
    out = {order: words.sparkSession.read.schema(top.schema).parquet(path)}
    for n in range(order - 1, 0, -1):
        out[n] = out[n + 1].select(F.expr("substring(h, 2)").alias("h"), "c").groupBy("h", "c").agg(F.count("*").cast("double").alias("cnt"))
    return out


def contexts(table: DataFrame) -> DataFrame:
    """(h, total, types) of one order."""
    return table.groupBy("h").agg(F.sum("cnt").alias("total"), F.count("*").alias("types"))


def stacked(tables: dict[int, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.select(F.lit(n).cast("bigint").alias("n"), "h", "c", "cnt") for n, t in sorted(tables.items())])


def probabilities(asked: DataFrame, tables: dict[int, DataFrame], vocabulary: DataFrame) -> DataFrame:
    """Adds p to rows (h, c): the chain of orders by one left join of counts and of contexts each, folded from the lowest.

    An unseen history falls back to the shorter one. Tables are as large as the n-grams of the training words, so
    Spark chooses the joins by their sizes.
    """
    order, out = max(tables), asked.crossJoin(F.broadcast(vocabulary.agg(F.count("*").alias("v"))))
    p = 1.0 / F.col("v")
    for n in range(1, order + 1):
        held = out.withColumn(f"h{n}", F.expr(f"substring(h, {order - n + 1})"))
        t = tables[n].select(F.col("h").alias(f"h{n}"), "c", F.col("cnt").alias(f"k{n}"))
        x = contexts(tables[n]).select(F.col("h").alias(f"h{n}"), F.col("total").alias(f"t{n}"), F.col("types").alias(f"y{n}"))
        out = held.join(t, [f"h{n}", "c"], "left").join(x, f"h{n}", "left")
        top = F.greatest(F.coalesce(F.col(f"k{n}"), F.lit(0.0)) - DISCOUNT, F.lit(0.0)) / F.col(f"t{n}")
        p = F.when(F.col(f"t{n}").isNull(), p).otherwise(top + DISCOUNT * F.col(f"y{n}") / F.col(f"t{n}") * p)
    return out.withColumn("p", p).select(*asked.columns, "p")


def perplexity(words: DataFrame, tables: dict[int, DataFrame], vocabulary: DataFrame) -> DataFrame:
    """One row: exp of the mean negative log-probability of a symbol, ends included. Equal n-grams are looked up once."""
    order = max(tables)
    grams = _grams(words, order, F.lit(1.0)).groupBy("h", "c").agg(F.sum("w").alias("w"))
    return probabilities(grams, tables, vocabulary).agg(F.exp(-F.sum(F.col("w") * F.log("p")) / F.sum("w")).alias("perplexity"))


def back_off(tables: dict[int, DataFrame], vocabulary: DataFrame) -> DataFrame:
    """(n, h, c, value): the model as plain rows. Of each n-gram its exact log-probability; of each history (c null)
    the log of the mass it hands to the shorter one. Looking up the longest known n-gram and adding the masses of the
    histories passed on the way gives every probability."""
    out = None
    for n in sorted(tables):
        grams = probabilities(tables[n].select("h", "c"), {k: t for k, t in tables.items() if k <= n}, vocabulary)
        rows = grams.select(F.lit(n).cast("bigint").alias("n"), "h", "c", F.log("p").alias("value"))
        mass = contexts(tables[n]).select(F.lit(n).cast("bigint"), "h", F.lit(None).cast("string"), F.log(DISCOUNT * F.col("types") / F.col("total")))
        rows = rows.unionAll(mass)
        out = rows if out is None else out.unionAll(rows)
    return out


def training_weights(counts: DataFrame, power: float = 0.5, numbers: float = 0.03, stops: float = 0.02) -> DataFrame:
    """(word, weight) of the words, count to the power, and of the kinds <number> and <stop>, as shares of the words' sum."""
    words = counts.select("word", F.pow(F.col("n").cast("double"), F.lit(power)).alias("weight"))
    total = words.agg(F.sum("weight").alias("t"))
    kinds = total.select(F.explode(F.array(F.struct(F.lit("<number>").alias("word"), (F.col("t") * numbers).alias("weight")), F.struct(F.lit("<stop>").alias("word"), (F.col("t") * stops).alias("weight")))).alias("k")).select("k.*")
    return words.unionByName(kinds)
