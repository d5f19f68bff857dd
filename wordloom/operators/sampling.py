"""Samples, draws, picks and packing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wordloom.functions.text import fraction


def race(key: Column, weight: Column, seed: str) -> Column:
    """log(u) / w, u from a hash of the key: the largest are a sample by weight without replacement (Efraimidis and Spirakis)."""
    return F.round(F.log(F.greatest(fraction(key.cast("string"), seed), F.lit(1e-300))) / weight, 9)


def weighted(df: DataFrame, key: str, weight: Column, k: int, seed: str = "sample") -> DataFrame:
    """k rows without replacement, by weight."""
    return df.withColumn("race", race(F.col(key), weight, seed)).orderBy(F.desc("race"), key).limit(k)


def first_of_each(df: DataFrame, by: str, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("bigint")).where(F.col("place") <= n)


def draw(cumulative: DataFrame, draws: DataFrame, cum: str = "cum", u: str = "u", value: str = "value", rows: int = 4096, blocks: int = 1000) -> DataFrame:
    """The draws with the first value whose cumulative weight exceeds u, the last for u beyond it. Every draw is a row of its own.

    The cumulative table is cut at quantiles into blocks of about ``rows`` rows, at most ``blocks`` of them, and its
    cuts are all that the driver sees. A draw finds its block by binary search over the cuts and its value by binary
    search in the block. Draws are spread evenly, so a block of much weight is asked much: it is copied, and its
    draws are dealt to the copies.
    """
    spark = cumulative.sparkSession
    n = cumulative.count()
    parts = max(1, min(blocks, -(-n // rows)))
    quantiles = [(k + 1) / parts for k in range(parts)]
    found = cumulative.agg(F.percentile_approx(cum, quantiles, 10 * blocks).alias("b"), F.max(cum).alias("top")).first()
    cuts = np.unique([*(found["b"] or []), *([found["top"]] if n else [])])
    copies = np.ceil(np.diff(np.append(0.0, cuts)) * 100).clip(1).astype(int) if n else np.ones(1, int)

    @F.pandas_udf(T.LongType())
    def block(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, x, side="left"))

    @F.pandas_udf(T.LongType())
    def block_over(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, x, side="right").clip(max=max(len(cuts) - 1, 0)))

    kinds = F.array(*[F.lit(int(c)) for c in copies])
    held = cumulative.select(F.col(cum).cast("double").alias("cum_"), F.col(value).alias("value_")).withColumn("block_", block("cum_"))
    held = held.withColumn("copy_", F.explode(F.sequence(F.lit(0), F.get(kinds, F.col("block_").cast("int")) - 1)))
    asked = draws.withColumn("block_", block_over(F.col(u).cast("double")))
    asked = asked.withColumn("copy_", F.pmod(F.xxhash64(*draws.columns), F.get(kinds, F.col("block_").cast("int"))).cast("int"))
    names = draws.columns
    schema = T.StructType([*draws.schema.fields, T.StructField(value, cumulative.schema[value].dataType)])

    def search(_, left: pa.Table, right: pa.Table) -> pa.Table:
        ordered = right.sort_by([("cum_", "ascending")])
        at = np.searchsorted(ordered.column("cum_").to_numpy(), left.column(u).to_numpy(), side="right").clip(max=max(len(ordered) - 1, 0))
        values = ordered.column("value_").take(pa.array(at)) if len(ordered) else pa.nulls(len(left), ordered.schema.field("value_").type)
        return left.select(names).append_column(value, values)

    key = ["block_", "copy_"]
    return spark.createDataFrame([], schema) if draws.isEmpty() else asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(search, schema)


def drawn_with_rare(words: DataFrame, rare: DataFrame, items: DataFrame, share: float, item: str = "item", seed: str = "draw") -> DataFrame:
    """(item, word): draws by weight, a share of them from the words that hold one rare character, each rare character as often.

    ``words`` has word and weight, ``rare`` has ch. Weights are added up by word; the parts of a draw come from hashes
    of its item, so any item can be drawn again by itself.
    """
    rares = rare.select("ch").orderBy("ch").limit(1000).toPandas()["ch"].tolist()  # characters: an alphabet's rare ones
    key = F.col(item).cast("string")
    asked = items.select(item, fraction(key, seed).alias("u"), fraction(key, seed + " kind").alias("k"), fraction(key, seed + " character").alias("c"))
    plain = asked if not rares else asked.where(F.col("k") >= share)
    out = draw(cumulated(words, "weight", "word"), plain.select(item, "u"), value="word")
    for n, ch in enumerate(rares):
        mine = asked.where((F.col("k") < share) & (F.floor(F.col("c") * len(rares)) == n)).select(item, "u")
        out = out.unionByName(draw(cumulated(words.where(F.instr("word", ch) > 0), "weight", "word"), mine, value="word"))
    return out.select(item, "word")


def cumulated(df: DataFrame, weight: str, order: str, buckets: int = 4096) -> DataFrame:
    """(value, cum): running shares of the weights in the order of a key. Sums in buckets of the key's first characters, then of buckets: no window over all rows."""
    keyed = df.select(F.col(order).alias("value"), F.col(weight).cast("double").alias("w")).withColumn("bucket", F.substring(F.col("value").cast("string"), 1, 2))
    heads = keyed.groupBy("bucket").agg(F.sum("w").alias("s"))
    heads = heads.withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("total", F.sum("s").over(Window.partitionBy()))
    own = F.sum("w").over(Window.partitionBy("bucket").orderBy("value"))
    return keyed.withColumn("own", own).join(heads.drop("s"), "bucket").select("value", ((F.col("before") + F.col("own")) / F.col("total")).alias("cum")).withColumnRenamed("value", order)


def coverage(ranked: pd.DataFrame, cover: int, size: int, held: dict[str, int] | None = None) -> list[int]:
    """Rows picked so that every character is had ``cover`` times, rarest characters first (by ``held``, else by the rows), then by rank. Sequential by nature."""
    words = ranked["word"].tolist()
    have: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        for c in sorted(set(w)):
            have.setdefault(c, []).append(i)
    picked, count = [], dict.fromkeys(have, 0)
    taken = np.zeros(len(words), bool)
    for c in sorted(have, key=lambda c: ((held or {}).get(c, len(have[c])), c)):
        for i in have[c]:
            if count[c] >= cover or len(picked) >= size:
                break
            if not taken[i]:
                taken[i] = True
                picked.append(i)
                for x in set(words[i]):
                    count[x] += 1
    for i in range(len(words)):
        if len(picked) >= size:
            break
        if not taken[i]:
            taken[i] = True
            picked.append(i)
    return picked


def pack(widths: list[float], room: float, gap: float = 0.0, ahead: int = 40) -> list[int]:
    """The row of each item. A row opens with the first item left; of the ``ahead`` items that then follow, in order, it takes all that still fit, a gap before each.

    Only the items passed over are kept, fewer than ``ahead``, so a long list is packed in one walk.
    """
    rows, waiting, at, row = [0] * len(widths), [], 0, 0
    while waiting or at < len(widths):
        if not waiting:
            waiting, at = [at], at + 1
        first, *seen = waiting
        more = max(0, ahead - len(seen))
        seen, at = seen + list(range(at, min(at + more, len(widths)))), min(at + more, len(widths))
        rows[first], left, waiting = row, room - widths[first], []
        for i in seen:
            if gap + widths[i] <= left:
                rows[i], left = row, left - gap - widths[i]
            else:
                waiting.append(i)
        row += 1
    return rows


def numbered(df: DataFrame, key: str, *by: str, width: int = 65_536, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds place: the row's number, from 1, in the order of a whole-number key, by groups if told; equal keys go by ``ties``.

    Rows are numbered in buckets of the key, after the rows of all lower buckets, so neither the table nor a group is
    sorted in one task.
    """
    keyed = df.withColumn("bucket_", F.floor(F.col(key) / width))
    heads = keyed.groupBy(*by, "bucket_").agg(F.count("*").alias("n_"))
    before = F.sum("n_").over(Window.partitionBy(*by).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.select(*by, "bucket_", F.coalesce(before, F.lit(0)).alias("before_"))
    own = F.row_number().over(Window.partitionBy(*by, "bucket_").orderBy(key, *ties))
    return keyed.withColumn("own_", own).join(heads, [*by, "bucket_"]).withColumn("place", F.col("before_") + F.col("own_")).drop("bucket_", "own_", "before_")
