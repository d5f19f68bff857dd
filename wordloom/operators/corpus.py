"""Counting words and characters of corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import characters, words_of


def word_counts(df: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """Running words: how often each word occurs, by the given columns."""
    return df.select(*by, F.explode(words_of(F.col(text))).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("n"))


def corpus_summary(df: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """By source: chunks, running and distinct words, letters and mean length of a running word."""
    words = df.select(source, F.explode(words_of(F.col(text))).alias("word"))
    per_word = words.groupBy(source, "word").agg(F.count("*").alias("n"))
    totals = per_word.groupBy(source).agg(F.sum("n").alias("running"), F.count("*").alias("distinct_words"), F.sum(F.col("n") * F.length("word")).alias("letters"))
    chunks = df.groupBy(source).agg(F.count("*").alias("chunks"))
    return chunks.join(totals, source, "left").select(source, "chunks", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("running", "distinct_words", "letters")], (F.col("letters") / F.col("running")).alias("mean_length"))


def combine(*counts: DataFrame, how: str = "sum") -> DataFrame:
    """Word counts of several sources as one: added up, or the largest of each word."""
    agg = {"sum": F.sum, "max": F.max}[how]
    return reduce(DataFrame.unionByName, counts).groupBy("word").agg(agg("n").cast("bigint").alias("n"))


def character_counts(counts: DataFrame) -> DataFrame:
    """Running count and share of every character of a word list."""
    each = counts.select(F.explode(characters(F.col("word"))).alias("ch"), "n").groupBy("ch").agg(F.sum("n").alias("n"))
    return each.crossJoin(F.broadcast(each.agg(F.sum("n").alias("total")))).select("ch", "n", (F.col("n") / F.col("total")).alias("share"))


def positions(counts: DataFrame) -> DataFrame:
    """(word, n, pos, ch, prev): every character with the one before it, by array look-up and without a shuffle."""
    chars = characters(F.col("word"))
    return counts.select("word", "n", F.posexplode(chars).alias("pos", "ch")).withColumn("prev", F.when(F.col("pos") > 0, F.substring("word", F.col("pos"), F.lit(1))))


def context_of(prev: Column, vowels: str = "aeiou", trigger: str = "aou") -> Column:
    """The kind of the character before: start, a trigger, another vowel, a consonant, other."""
    return F.when(prev.isNull(), "start").when(prev.rlike(f"^[{trigger}]$"), "trigger").when(prev.rlike(f"^[{vowels}]$"), "vowel").when(prev.rlike("^[a-z]$"), "consonant").otherwise("other")


def rule_confusion(counts: DataFrame, loose: str = "i", final: str = "y", trigger: str = "aou") -> DataFrame:
    """Actual against predicted letter of a spelling rule: the final after a trigger, else the loose one."""
    at = positions(counts).where(F.col("ch").isin(loose, final))
    predicted = F.when(F.coalesce(F.col("prev").rlike(f"^[{trigger}]$"), F.lit(False)), final).otherwise(loose)
    return at.groupBy(F.col("ch").alias("actual"), predicted.alias("predicted")).agg(F.sum("n").alias("running"), F.count("*").alias("distinct_words"))


def contexts(counts: DataFrame, loose: str = "i", final: str = "y") -> DataFrame:
    """Counts of both letters by kind of context and by the character before, with subtotals: one grouping-sets pass."""
    at = positions(counts).where(F.col("ch").isin(loose, final)).withColumn("kind", context_of(F.col("prev"))).withColumn("before", F.coalesce("prev", F.lit("")))
    return at.rollup("kind", "before").agg(F.sum(F.when(F.col("ch") == loose, F.col("n")).otherwise(0)).alias("n_loose"), F.sum(F.when(F.col("ch") == final, F.col("n")).otherwise(0)).alias("n_final"))


def document_shares(df: DataFrame, key: str, first: str, second: str, support: int = 5, text: str = "text") -> DataFrame:
    """Each document's share of one spelling among both, and its class: consistent at 0.9 or 0.1, mixed, too few."""
    counted = df.select(F.col(key).alias("doc"), F.regexp_count(F.lower(text), F.lit(first)).alias("a"), F.regexp_count(F.lower(text), F.lit(second)).alias("b"))
    share = F.when(F.col("a") + F.col("b") > 0, F.col("a") / (F.col("a") + F.col("b")))
    kind = F.when(F.col("a") + F.col("b") < support, "too few").when(share >= 0.9, "first").when(share <= 0.1, "second").otherwise("mixed")
    return counted.select("doc", F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), share.alias("share"), kind.alias("kind"))


def twins(counts: DataFrame, loose: str = "i", final: str = "y", trigger: str = "aou") -> DataFrame:
    """Words with the loose letter after a trigger, and the count of the word spelled by the rule, or 0."""
    odd = counts.where(F.col("word").rlike(f"[{trigger}]{loose}")).withColumn("twin", F.regexp_replace("word", f"(?<=[{trigger}]){loose}", final))
    other = counts.select(F.col("word").alias("twin"), F.col("n").alias("twin_n"))
    return odd.join(other, "twin", "left").select("word", "n", "twin", F.coalesce("twin_n", F.lit(0)).cast("bigint").alias("twin_n"))
