"""Lexicons: cleaning, splitting, describing, syllables, rare characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.alphabet import LATIN, Profile
from wordloom.functions.text import SALT, characters, problem, split_of, syllable_kind, syllables


def clean(counts: DataFrame, profile: Profile = LATIN) -> tuple[DataFrame, DataFrame]:
    """(kept words, dropped words and running words by reason)."""
    marked = counts.withColumn("reason", problem(F.col("word"), profile))
    dropped = marked.where("reason is not null").groupBy("reason").agg(F.count("*").alias("distinct_words"), F.sum("n").alias("running"))
    return marked.where("reason is null").groupBy("word").agg(F.sum("n").alias("n")), dropped


def split(counts: DataFrame, exclude: DataFrame | None = None, salt: str = SALT) -> DataFrame:
    """Words with their part; excluded words leave the training part only."""
    parts = counts.withColumn("split", split_of(F.col("word"), salt))
    if exclude is None:
        return parts
    gone = exclude.select(F.col("word").alias("gone")).distinct()
    return parts.join(gone, (F.col("word") == F.col("gone")) & (F.col("split") == "train"), "left_anti")


def describe(counts: DataFrame) -> DataFrame:
    """One row: words, running words, weighted mean, median, 95th percentile and maximum of the length."""
    length = F.length("word")
    return counts.select(length.alias("len"), "n").agg(
        F.count("*").alias("distinct_words"), F.sum("n").alias("running"), (F.sum(F.col("len") * F.col("n")) / F.sum("n")).alias("mean_length"),
        F.floor(F.percentile("len", 0.5, F.col("n"))).cast("bigint").alias("p50"), F.floor(F.percentile("len", 0.95, F.col("n"))).cast("bigint").alias("p95"), F.max("len").cast("bigint").alias("longest"),
    )


def syllables_per_word(counts: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """Words and running words by number of syllables, 7 standing for more."""
    return counts.select(F.least(F.size(syllables(F.col("word"), profile)), F.lit(7)).cast("bigint").alias("syllables"), "n").groupBy("syllables").agg(F.count("*").alias("distinct_words"), F.sum("n").alias("running"))


def syllable_bank(counts: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """Weight of every syllable by kind."""
    each = counts.select(F.explode(syllables(F.col("word"), profile)).alias("syllable"), "n")
    return each.withColumn("kind", syllable_kind(F.col("syllable"), profile)).groupBy("kind", "syllable").agg(F.sum("n").alias("n"))


def syllable_kinds(counts: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """By kind: running syllables, and how many words have one."""
    each = counts.select("word", "n", F.explode(F.transform(syllables(F.col("word"), profile), lambda s: syllable_kind(s, profile))).alias("kind"))
    return each.groupBy("kind").agg(F.sum("n").alias("running"), F.count_distinct("word").alias("words"))


def rare_characters(counts: DataFrame, alpha: float = 0.5, threshold: float = 0.02) -> DataFrame:
    """Characters whose share of the weighted words, count to the power alpha, is below the threshold."""
    weighted = counts.select("word", F.pow(F.col("n").cast("double"), F.lit(alpha)).alias("w"))
    total = weighted.agg(F.sum("w").alias("total"))
    held = weighted.select(F.explode(F.array_distinct(characters(F.col("word")))).alias("ch"), "w").groupBy("ch").agg(F.sum("w").alias("w"))
    return held.crossJoin(F.broadcast(total)).select("ch", F.round(F.col("w") / F.col("total"), 9).alias("share")).where(F.col("share") < threshold)
