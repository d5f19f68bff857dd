"""Exact duplicates, conflicting labels and leakage between parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def groups(df: DataFrame, content: Column, label: str, part: str) -> DataFrame:
    """Content met more than once: members, labels, parts. A hot group is one row a task before the shuffle."""
    return df.groupBy(F.md5(content).alias("digest")).agg(F.count("*").alias("members"), F.count_distinct(label).alias("labels"), F.count_distinct(part).alias("parts")).where("members > 1")


def label_pairs(df: DataFrame, content: Column, label: str) -> DataFrame:
    """How many groups hold each pair of different labels: pairs are made of a group's distinct labels, not of its members."""
    held = df.groupBy(F.md5(content).alias("digest")).agg(F.array_sort(F.collect_set(label)).alias("l")).where(F.size("l") > 1)
    pairs = F.flatten(F.transform("l", lambda a: F.transform(F.filter("l", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return held.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("label_a"), F.col("p.b").alias("label_b")).agg(F.count("*").alias("groups"))


def twins(df: DataFrame, content: Column, label: str, part: str) -> DataFrame:
    """Rows outside the training part whose content is in it: with the same label, or only with others."""
    keyed = df.withColumn("digest", F.md5(content))
    train = keyed.where(F.col(part) == "train").groupBy("digest").agg(F.collect_set(label).alias("train_labels"))
    return keyed.where(F.col(part) != "train").join(train, "digest").groupBy(part).agg(F.count_if(F.array_contains("train_labels", F.col(label))).alias("same_label"), F.count_if(~F.array_contains("train_labels", F.col(label))).alias("other_label"))


def exclusions(df: DataFrame, key: str, content: Column, label: str, part: str) -> DataFrame:
    """Keys to leave out: all of a group whose labels differ, and what lies outside training but has a twin in it."""
    keyed = df.withColumn("digest", F.md5(content))
    told = keyed.groupBy("digest").agg(F.count_distinct(label).alias("labels"), F.max((F.col(part) == "train").cast("int")).alias("trained"))
    return keyed.join(told, "digest").where((F.col("labels") > 1) | ((F.col(part) != "train") & (F.col("trained") == 1))).select(key, F.when(F.col("labels") > 1, "conflict").otherwise("leak").alias("reason"))


def ids_not_given(given: DataFrame, top: DataFrame, key: str, block: int = 1_000_000) -> DataFrame:
    """The ids from 0 to the one number in ``top`` that ``given`` lacks. The range is made block by block in many tasks."""
    end = top.columns[0]
    blocks = top.select(F.col(end).alias("top"), F.explode(F.sequence(F.lit(0), F.floor(F.col(end) / block))).alias("b")).repartition("b")
    ids = blocks.select(F.explode(F.sequence(F.col("b") * block, F.least(F.col("top"), (F.col("b") + 1) * block - 1))).alias(key))
    return ids.join(given.select(key), key, "left_anti")
