"""Scores of readings: error rates, alignments, intervals, paired tests, comparisons of runs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions.text import wilson


def rates(df: DataFrame, *by: str, reference: str = "reference", reading: str = "reading") -> DataFrame:
    """Words, characters, edits and wrong words, with error rates over all characters and words; by groups if asked."""
    each = df.select(*by, F.length(reference).alias("chars"), F.levenshtein(reference, reading).alias("edits"), (F.col(reference) != F.col(reading)).cast("int").alias("wrong"))
    out = (each.groupBy(*by) if by else each).agg(F.count("*").alias("words"), F.sum("chars").cast("bigint").alias("chars"), F.sum("edits").cast("bigint").alias("edits"), F.sum("wrong").cast("bigint").alias("wrong"))
    return out.withColumn("cer", F.col("edits") / F.greatest("chars", F.lit(1))).withColumn("wer", F.col("wrong") / F.col("words"))


def interval(df: DataFrame, hits: str, total: str) -> DataFrame:
    """Adds the 95 % score interval of hits in total."""
    return df.withColumn("low", wilson(F.col(hits), F.col(total), False)).withColumn("high", wilson(F.col(hits), F.col(total), True))


#: Moves of an alignment, in the order in which equal ones are taken: a pair, a gap in the reading, a gap in the reference.
PAIR, MISSING, ADDED = 0, 1, 2


def moves(reference: str, reading: str) -> np.ndarray:
    """The last move of a least-cost alignment of every two beginnings.

    A row of costs follows from the one above at once: the least of pair and gap above, then, gap by gap to the right,
    a running minimum of cost less place.
    """
    a, b = (np.array([ord(c) for c in s], np.int64) for s in (reference, reading))
    place = np.arange(len(b) + 1)
    out = np.full((len(a) + 1, len(b) + 1), ADDED, np.int8)
    above = place
    for i, c in enumerate(a, 1):
        down = above + 1
        pair = np.concatenate(([len(a) + len(b) + 1], above[:-1] + (b != c)))
        row = np.minimum.accumulate(np.minimum(pair, down) - place) + place
        out[i] = np.where(row == pair, PAIR, np.where(row == down, MISSING, ADDED))
        above = row
    return out


def align(reference: str, reading: str) -> list[tuple[str, str]]:
    """Pairs of characters of a least-cost alignment, "" for a gap, told from the end."""
    last, at, out = moves(reference, reading), (len(reference), len(reading)), []
    while any(at):
        before = (at[0] - int(last[at] != ADDED), at[1] - int(last[at] != MISSING))
        out.append((reference[before[0] : at[0]], reading[before[1] : at[1]]))
        at = before
    return out[::-1]


def aligned(df: DataFrame, reference: str = "reference", reading: str = "reading") -> DataFrame:
    """(ref, hyp, n): aligned character pairs counted. Distinct pairs of strings are aligned once."""
    distinct = df.groupBy(F.col(reference).alias("a"), F.col(reading).alias("b")).agg(F.count("*").alias("n"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(x, y, n) for a, b, n in pdf.itertuples(index=False) for x, y in align(a, b)]
            yield pd.DataFrame(rows, columns=["ref", "hyp", "n"])

    return distinct.where("a is not null and b is not null").mapInPandas(run, "ref string, hyp string, n long").groupBy("ref", "hyp").agg(F.sum("n").alias("n"))


def operations(pairs: DataFrame) -> DataFrame:
    """Matches, substitutions, deletions and insertions of aligned pairs."""
    kind = F.when(F.col("ref") == F.col("hyp"), "match").when(F.col("hyp") == "", "deletion").when(F.col("ref") == "", "insertion").otherwise("substitution")
    return pairs.groupBy(kind.alias("operation")).agg(F.sum("n").alias("n"))


def half_tail(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Probability of k or fewer heads in n throws, k < n: the regularised incomplete beta function of n - k and k + 1 at a half.

    Its continued fraction (Lentz) takes some hundred steps at most for any n, where the sum would take k.
    """
    a, b = (n - k).astype(float), k + 1.0
    front = np.array([math.lgamma(x + y) - math.lgamma(x) - math.lgamma(y) for x, y in zip(a, b, strict=True)]) - (a + b) * math.log(2)
    tiny = 1e-300
    c, d = np.ones(len(a)), 1 / np.where(np.abs(1 - (a + b) / (2 * (a + 1))) < tiny, tiny, 1 - (a + b) / (2 * (a + 1)))
    total = d.copy()
    for m in range(1, 10_000):
        for term in (m * (b - m) / (2 * (a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) / (2 * (a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            c = 1 + term / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            total = total * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return np.exp(front) / a * total


@F.pandas_udf(T.DoubleType())
def exact_p(b: pd.Series, c: pd.Series) -> pd.Series:
    """Two-sided exact p value of b against c discordant pairs."""
    n, k = (b + c).to_numpy(), np.minimum(b, c).to_numpy()
    out = np.ones(len(n))
    m = n > 0
    out[m] = np.minimum(1, 2 * half_tail(n[m], k[m]))
    return pd.Series(out)


def compare(df: DataFrame, reference: str, first: str, second: str) -> DataFrame:
    """One row: words, wrong in each run, repaired and broken by the second, right in both, wrong in both."""
    a, b = F.col(first) == F.col(reference), F.col(second) == F.col(reference)
    return df.agg(F.count("*").alias("words"), F.count_if(~a).alias("wrong_first"), F.count_if(~b).alias("wrong_second"), F.count_if(~a & b).alias("fixed"), F.count_if(a & ~b).alias("broken"), F.count_if(a & b).alias("both_right"), F.count_if(~a & ~b).alias("both_wrong"))


def best(df: DataFrame, setting: str, *by: str) -> DataFrame:
    """The setting with the least measures, compared in order."""
    return df.agg(F.min_by(setting, F.struct(*by, setting)).alias(setting))


def corrected(readings: DataFrame, corrections: DataFrame, labels: DataFrame | None = None, file: str = "file", reference: str = "reference") -> DataFrame:
    """Readings with corrected references. A correction of an unknown file fails; with the set's labels (file, text), so do
    a file without one and a label that differs from the reference without a recorded correction that says it."""
    def none(bad: DataFrame, why: str) -> DataFrame:
        return bad.agg(F.assert_true(F.count("*") == 0, F.lit(why)).alias("ok"))

    new = corrections.select(file, F.col("text").alias("new_text"))
    checks = [none(corrections.join(readings, file, "left_anti"), "corrections of unknown files")]
    if labels is not None:
        held = readings.select(file, F.col(reference).alias("was")).join(labels.select(file, F.col("text").alias("now")), file, "left").join(new, file, "left")
        checks.append(none(held.where("now is null"), "files without a label"))
        checks.append(none(held.where("now <> was and not (new_text <=> now)"), "labels changed without a recorded correction"))
    out = readings.join(new, file, "left").withColumn("changed", F.coalesce(F.col("new_text") != F.col(reference), F.lit(False))).withColumn(reference, F.coalesce("new_text", reference)).drop("new_text")
    for check in checks:
        out = out.crossJoin(F.broadcast(check)).where("ok is null").drop("ok")  # the filter keeps the check in the plan
    return out


def same_words(first: DataFrame, others: list[DataFrame], file: str = "file", reference: str = "reference") -> DataFrame:
    """One row that is only had if every run covers the same files with the same references."""
    bad = None
    for other in others:
        a, b = first.select(file, F.col(reference).alias("a")), other.select(file, F.col(reference).alias("b"))
        odd = a.join(b, file, "full_outer").where("a is null or b is null or a <> b").select(file)
        bad = odd if bad is None else bad.unionByName(odd)
    return bad.agg(F.assert_true(F.count("*") == 0, F.lit("the runs do not hold the same words")).alias("ok"))


def runs_wide(runs: dict[str, DataFrame], file: str = "file", reference: str = "reference", reading: str = "reading") -> DataFrame:
    """(file, reference, right): for each file an array of whether each run, in the order of their names, reads it right."""
    names = sorted(runs)
    first = runs[names[0]]
    stacked = None
    for k, name in enumerate(names):
        one = runs[name].select(file, reference, F.struct(F.lit(k).alias("k"), (F.col(reading) == F.col(reference)).alias("ok")).alias("r"))
        stacked = one if stacked is None else stacked.unionByName(one)
    wide = stacked.groupBy(file, reference).agg(F.array_sort(F.collect_list("r")).alias("r")).select(file, reference, F.transform("r", lambda x: x["ok"]).alias("right"))
    return wide.crossJoin(F.broadcast(same_words(first, [runs[n] for n in names[1:]], file, reference))).where("ok is null").drop("ok")


def run_pairs(wide: DataFrame, names: list[str]) -> DataFrame:
    """For every two runs the words that only the first and only the second reads right, with the exact p value."""
    names = sorted(names)
    pairs = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), (F.col("right")[i] & ~F.col("right")[j]).alias("x"), (~F.col("right")[i] & F.col("right")[j]).alias("y")) for i, a in enumerate(names) for j, b in enumerate(names) if i < j])
    told = wide.select(F.explode(pairs).alias("p")).groupBy("p.first", "p.second").agg(F.count_if("p.x").alias("only_first"), F.count_if("p.y").alias("only_second"))
    return told.withColumn("p", exact_p("only_first", "only_second"))


def run_totals(wide: DataFrame, focus: list[str] = ()) -> DataFrame:
    """By group of words (all; with and without each focus set of characters): words, read by every run, by none, and wrong readings in all runs."""
    groups = [F.lit("all"), *[F.when(F.col("reference").rlike(f"[{x}]"), F.lit(f"with {x}")).otherwise(F.lit(f"without {x}")) for x in focus]]
    each = wide.select(F.explode(F.array(*groups)).alias("words_of"), F.forall("right", lambda r: r).alias("every"), F.forall("right", lambda r: ~r).alias("none"), F.size(F.filter("right", lambda r: ~r)).alias("wrong"))
    return each.groupBy("words_of").agg(F.count("*").alias("words"), F.count_if("every").alias("read_by_every"), F.count_if("none").alias("read_by_none"), F.sum("wrong").alias("wrong"))
