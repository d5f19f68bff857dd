"""Toxicity by cumulative-link ordinal regression.

Severity grades 0 < 1 < ... < K are predicted from sparse binary text features. One weight vector w is shared by
all the thresholds: P(grade > j) = sigmoid(w . x - theta_j) with theta_0 < theta_1 < ... The expected severity is
the sum of these probabilities. Weights are kept sparse by an L1 penalty, so scoring a text is a look-up of its
words and word beginnings in a small table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import col, fresh, whole_text

#: Labelled rows of each grade that the model is fitted on, those with the smallest hash of their id: the bound of the sample.
SAMPLE_PER_GRADE = 3_000
#: A feature counts if so many sampled documents have it.
LEAST_DOCUMENTS = 5
#: Its count among graded rows above 0 departs from chance by so many standard deviations, which leaves little to noise.
DEVIATIONS = 4.5
#: At most so many features enter the fit, those that depart most.
FEATURES = 8_000
#: Beginnings of words, in characters, that are features besides the whole words: they reach inflected forms.
PREFIXES = (4, 5, 6, 7, 8)
#: A beginning counts again where so many different words of the text share it: one chance word is weaker than a family.
FAMILIES = (2, 3)
#: Weight of the L1 penalty, rounds of the fit, and the probability of a grade above 0 from which a document is toxic.
PENALTY, ROUNDS, REJECT = 1e-4, 1_500, 0.5

WORD = re.compile(r"[^\W\d_]+")


def features(text: str, prefixes: Iterable[int] = PREFIXES) -> set[str]:
    """The distinct lower-case words of a text, their beginnings marked by a star, and with how many words share these.

    Whatever its length, a text is read whole.
    """
    words = set(WORD.findall(text.lower()))
    out = set(words)
    for n in prefixes:
        shared = Counter([w[:n] for w in words if len(w) >= n])
        out.update([b + "*" for b in shared])
        out.update([f"{b}*{k}" for b, c in shared.items() if c > 1 for k in FAMILIES if c >= k])
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class Ordinal:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: dict[str, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, np.array(thresholds, float)
        lengths = {w.index("*") for w in weights if "*" in w}
        self.prefixes = tuple(n for n in PREFIXES if n in lengths)
        self.head = min(self.prefixes, default=1)
        self.heads = {w[: self.head] for w in weights if "*" in w}

    @classmethod
    def fit(cls, rows: list[list[int]], grades: np.ndarray, names: list[str], penalty: float = PENALTY, rounds: int = ROUNDS) -> Ordinal:
        """Accelerated proximal gradient. Thresholds take plain steps and a running maximum keeps them in order; grades nobody has push theirs out."""
        n, top = len(rows), max(1, int(grades.max(initial=0)))
        if not n:
            return cls({}, [8.0] * top)
        rows, names = cls.merged(rows, names)
        lengths = np.array([len(r) for r in rows])
        doc = np.repeat(np.arange(n), lengths)
        feature = np.concatenate([np.array(r, np.int64) for r in rows]) if lengths.sum() else np.zeros(0, np.int64)
        weight = np.ones(n)
        for side in (grades == 0, grades > 0):  # clean and toxic rows weigh the same
            weight[side] = 0.5 / max(1, side.sum())
        above = (grades[:, None] > np.arange(top)[None]).astype(float)
        w, theta = np.zeros(len(names)), np.linspace(0.0, 1.0, top)
        v, u, momentum = w.copy(), theta.copy(), 1.0
        # a step each feature can take whatever the others of its rows do: the separable bound on the curvature
        step = 4 / (top * np.maximum(np.bincount(feature, (weight * lengths)[doc], len(names)), 1e-4))
        for _ in range(rounds):
            score = np.bincount(doc, v[feature], n)
            p = sigmoid(score[:, None] - u[None])
            gap = (p - above) * weight[:, None]
            w_new = v - step * np.bincount(feature, gap.sum(1)[doc], len(names))
            w_new = np.sign(w_new) * np.maximum(0, np.abs(w_new) - step * penalty)
            theta_new = np.maximum.accumulate(np.clip(u + gap.sum(0) * 2.0, -30, 30))
            if ((v - w_new) * (w_new - w)).sum() > 0:  # the momentum points uphill: start over
                momentum = 1.0
            following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
            v, u = w_new + (momentum - 1) / following * (w_new - w), theta_new
            w, theta, momentum = w_new, theta_new, following
        kept = np.flatnonzero(np.abs(w) > 1e-6)
        return cls({names[i]: float(w[i]) for i in kept}, theta.tolist())

    @staticmethod
    def merged(rows: list[list[int]], names: list[str]) -> tuple[list[list[int]], list[str]]:
        """Features that the same rows have become one, named by a whole word if there is one, else by the longest beginning."""
        where: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            for f in r:
                where.setdefault(f, []).append(i)
        groups: dict[tuple, int] = {}
        for f, docs in where.items():
            old = groups.setdefault(tuple(docs), f)
            groups[tuple(docs)] = min(old, f, key=lambda x: ("*" in names[x], -len(names[x]), names[x]))
        kept = sorted(groups.values())
        number = {f: k for k, f in enumerate(kept)}
        return [[number[f] for f in r if f in number] for r in rows], [names[f] for f in kept]

    def score(self, text: str) -> float:
        """The sum of the weights of the text's features. Only words whose first letters begin a known beginning are looked at further."""
        words, heads = set(WORD.findall(text.lower())), self.heads
        found = self.weights.keys() & words
        if some := [w for w in words if w[: self.head] in heads]:
            found |= self.weights.keys() & features(" ".join(some), self.prefixes)
        return sum(self.weights[x] for x in sorted(found))

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j), a column for each threshold."""
        return sigmoid(scores[:, None] - self.thresholds[None])


def sample(docs: DataFrame, labels: DataFrame, grade, grades: Iterable[int], doc_id: str = "doc_id", text: str = "text", per_grade: int = SAMPLE_PER_GRADE) -> DataFrame:
    """(features, grade) of a bounded sample: of each grade the per_grade labelled ids with the smallest hash."""
    graded = labels.where(col(doc_id).isNotNull()).select(col(doc_id).alias("i"), grade.cast("int").alias("g")).where("g is not null").groupBy("i").agg(F.max("g").alias("g"))
    picked = None
    for g in grades:
        one = graded.where(F.col("g") == g).orderBy(F.xxhash64("i"), "i").limit(per_grade)
        picked = one if picked is None else picked.unionAll(one)
    # at most per_grade rows a grade: a bounded side
    found = docs.select(col(doc_id).alias("i"), whole_text(text).alias("t")).join(F.broadcast(picked), "i")
    schema = "g int, f array<string>"

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array([sorted(features(t)) for t in batch.column("t").to_pylist()], pa.list_(pa.string()))], names=["g", "f"])

    return found.select("g", "t").mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, grade, grades: Iterable[int] = (0, 1, 2), doc_id: str = "doc_id", text: str = "text", per_grade: int = SAMPLE_PER_GRADE) -> Ordinal:
    """Fit on a bounded sample. Features are counted and chosen by Spark; only the sample's chosen ones reach the driver."""
    from wordloom.llm.common import cut

    rows = cut(sample(docs, labels, grade, grades, doc_id, text, per_grade).withColumn("r", F.monotonically_increasing_id()), "toxicity-sample")
    total = {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return Ordinal({}, [8.0] * max(1, max(grades, default=1)))
    low, rest = total.get(0, 0), sum(n for g, n in total.items() if g)
    counts = rows.select("g", F.explode("f").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.count_if(F.col("g") > 0).alias("p"))
    expected = F.col("n") * F.lit(rest / (low + rest))
    apart = F.abs(F.col("p") - expected) / F.sqrt(expected * F.lit(max(low, 1) / (low + rest)))
    names = [r["f"] for r in counts.where((F.col("n") >= LEAST_DOCUMENTS) & (apart >= DEVIATIONS)).orderBy(F.desc(apart), "f").limit(FEATURES).select("f").collect()]
    chosen = rows.sparkSession.createDataFrame([(f, i) for i, f in enumerate(names)], "f string, k int")
    told = rows.select("r", F.explode("f").alias("f")).join(F.broadcast(chosen), "f").groupBy("r").agg(F.collect_list("k").alias("k"))
    kept = rows.select("r", "g").join(told, "r", "left").select("g", "k").collect()
    return Ordinal.fit([sorted(r["k"] or []) for r in kept], np.array([r["g"] for r in kept]), names)


def score(docs: DataFrame, model: Ordinal, text: str = "text", drop_text: bool = False) -> DataFrame:
    """Adds severity (expected grade), p_toxic (probability of a grade above 0) and toxic (p_toxic at least REJECT, and features that speak for it).

    A null or empty text has no features: it gets the thresholds' own probabilities and is not toxic, nor is anything
    to a model that has found no feature. Rows, repeats and further
    columns stay; a column named like one of the three is an error. One narrow pass without a shuffle.
    """
    more = [("severity", T.DoubleType()), ("p_toxic", T.DoubleType()), ("toxic", T.BooleanType())]
    if clash := {c.lower() for c in docs.columns} & {n for n, _ in more}:
        raise ValueError(f"the documents already have {sorted(clash)}")
    keep = [c for c in docs.columns if not (drop_text and c == text)]
    schema = T.StructType([*(f for f in docs.schema.fields if f.name in keep), *(T.StructField(*m) for m in more)])
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds.tolist()))

    def run(batches):
        model = Ordinal(*shared.value)
        for batch in batches:
            found = np.array([model.score(t) for t in batch.column(len(keep)).to_pylist()], float)
            p = model.probabilities(found)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array((p[:, 0] >= REJECT) & (found > 0))], names=schema.names)

    return docs.select(*map(col, keep), whole_text(text).alias(fresh(docs, "whole"))).mapInArrow(run, schema)


def severity_grade() -> Column:
    """The grade that the labels table tells: 0 not toxic, 1 toxic, 2 toxic and of low quality as well."""
    return F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document, by a model fitted on a bounded sample of labels."""
    from wordloom.llm.common import table, text_batches

    text_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels"), severity_grade()), drop_text=True)
