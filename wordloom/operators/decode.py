"""CTC decoding of per-frame scores."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def best_classes(frames: Column) -> Column:
    """The class of the largest score of each frame, the first of equal ones."""
    return F.transform(frames, lambda f: (F.array_position(f, F.array_max(f)) - 1).cast("int"))


def collapse(classes: Column, blank: int = 0) -> Column:
    """Classes without those equal to the frame before and without blanks: array functions, no Python."""
    return F.filter(F.transform(classes, lambda c, i: F.when((c != blank) & ((i == 0) | (c != F.get(classes, i - 1))), c)), lambda c: c.isNotNull())


def merged(scores: Column, into: int, other: int) -> Column:
    """Log-probabilities in which a class takes over another's share, which then has none."""
    a, b = F.get(scores, F.lit(into)), F.get(scores, F.lit(other))
    high, low = F.greatest(a, b), F.least(a, b)
    both = high + F.log1p(F.exp(low - high))
    return F.transform(scores, lambda v, i: F.when(i == into, both).when(i == other, F.lit(float("-inf"))).otherwise(v))


def masked(scores: Column, allowed: Column, low: float = -1e9) -> Column:
    """Scores in which the classes that ``allowed``, an array of booleans, leaves out are as good as impossible."""
    return F.zip_with(scores, allowed, lambda v, ok: F.when(ok, v).otherwise(F.lit(low)))


def best_shares(scores: Column, top: int = 5) -> Column:
    """The best classes, an array of (class, share): shares of the exponentials among them; of equal scores the first class."""
    ranked = F.slice(F.array_sort(F.transform(scores, lambda v, i: F.struct((-v).alias("cost"), i.alias("class")))), 1, top)
    weight = F.transform(ranked, lambda r: F.struct(r["class"].alias("class"), F.exp(F.get(ranked, F.lit(0))["cost"] - r["cost"]).alias("w")))
    total = F.aggregate(weight, F.lit(0.0), lambda s, r: s + r["w"])
    return F.transform(weight, lambda r: F.struct(r["class"].alias("class"), (r["w"] / total).alias("share")))


def beam(logp: np.ndarray, width: int = 16, top: int = 8, threshold: float = -10.0, alpha: float = 0.0, beta: float = 0.0, lm: Callable[[tuple, int | None], float] | None = None) -> list[int]:
    """Prefix beam search: the best prefix by acoustic score, alpha times a language model and beta a character."""
    beams = {(): (0.0, -np.inf, 0.0)}  # prefix: ends in blank, ends in its last class, bonus
    for frame in logp:
        classes = [c for c in np.argsort(-frame, kind="stable")[:top].tolist() if frame[c] >= threshold] or [int(frame.argmax())]
        if 0 not in classes:
            classes.append(0)
        new: dict[tuple, list[float]] = {}
        for prefix, (blank, own, bonus) in beams.items():
            total = np.logaddexp(blank, own)
            for c in classes:
                if c == 0:
                    slot = new.setdefault(prefix, [-np.inf, -np.inf, bonus])
                    slot[0] = np.logaddexp(slot[0], total + frame[0])
                    continue
                if prefix and prefix[-1] == c:
                    slot = new.setdefault(prefix, [-np.inf, -np.inf, bonus])
                    slot[1] = np.logaddexp(slot[1], own + frame[c])
                    came = blank
                else:
                    came = total
                longer = (*prefix, c)
                gain = bonus + beta + (alpha * lm(prefix, c) if lm else 0.0)
                slot = new.setdefault(longer, [-np.inf, -np.inf, gain])
                slot[1] = np.logaddexp(slot[1], came + frame[c])
        kept = sorted(new.items(), key=lambda kv: (-(np.logaddexp(kv[1][0], kv[1][1]) + kv[1][2]), kv[0]))[:width]
        beams = {p: tuple(v) for p, v in kept}
    final = {p: np.logaddexp(a, b) + g + (alpha * lm(p, None) if lm else 0.0) for p, (a, b, g) in beams.items()}
    return list(min(final, key=lambda p: (-final[p], p)))


class Model:
    """A character model's rows (history, next character, value: log-probability, or the handed-down mass where the character is null) for look-ups in a task."""

    def __init__(self, rows: dict[tuple[str, str | None], float], order: int, start: str, end: str):
        self.rows, self.order, self.start, self.end, self.seen = rows, order, start, end, {}

    def __call__(self, text: str, c: str | None) -> float:
        """log P(c | text), the end for c null: the longest known n-gram, and the masses of the histories passed on the way."""
        key = (text[1 - self.order :] if self.order > 1 else "", c)
        if key not in self.seen:
            history, total = (self.start * (self.order - 1) + key[0])[-(self.order - 1) :] if self.order > 1 else "", 0.0
            while (found := self.rows.get((history, c or self.end))) is None and history:
                total += self.rows.get((history, None), 0.0)
                history = history[1:]
            self.seen[key] = total + (found if found is not None else self.rows[("", None)] + self.floor)
        return self.seen[key]

    @property
    def floor(self) -> float:
        """The even share of a character that the model has never seen."""
        return -float(np.log(sum(1 for h, c in self.rows if h == "" and c is not None)))


def collected(rows, order: int, start: str = "^", end: str = "$", most: int = 5_000_000) -> Model:
    """The model's rows at hand in every task. They are as many as the n-grams of a lexicon's words; beyond ``most`` that is refused."""
    if rows.count() > most:
        raise ValueError(f"a model of over {most} rows is not sent to the tasks")
    pdf = rows.select("h", "c", "value").toPandas()
    return Model({(h, None if c is None else c): v for h, c, v in pdf.itertuples(index=False)}, order, start, end)


def beam_udf(width: int = 16, top: int = 8, model: Model | None = None, alphabet: str = "", alpha: float = 0.5, beta: float = 0.0):
    """The beam search over array<array<double>> columns of scores, made log-probabilities frame by frame; class i of i > 0 is the alphabet's i-th character to the model."""
    spell = None if model is None else lambda prefix, c: model("".join(alphabet[k - 1] for k in prefix), None if c is None else alphabet[c - 1])

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(frames: pd.Series) -> pd.Series:
        scores = (np.array([list(f) for f in x], float) for x in frames)
        return pd.Series([beam(s - np.logaddexp.reduce(s, axis=1, keepdims=True), width, top, alpha=alpha if spell else 0.0, beta=beta, lm=spell) for s in scores])

    return run


def segmented(logp: np.ndarray, alphabet: str, model: Model | None, alpha: float = 0.5, width: int = 16, top: int = 5) -> str:
    """The best text of one character a row of scores: acoustic score and alpha times the model's, its end included."""
    if model is None or not alpha:
        return "".join(alphabet[k] for k in logp.argmax(1))
    texts, scores = [""], np.zeros(1)
    for row in logp:
        best = np.argsort(-row, kind="stable")[:top]
        scores = (scores[:, None] + row[best] + alpha * np.array([[model(t, alphabet[k]) for k in best] for t in texts])).ravel()
        longer = [t + alphabet[k] for t in texts for k in best]
        kept = np.argsort(-scores, kind="stable")[:width]
        texts, scores = [longer[i] for i in kept], scores[kept]
    final = scores + alpha * np.array([model(t, None) for t in texts])
    return texts[int(final.argmax())]


def segmented_udf(alphabet: str, model: Model | None = None, alpha: float = 0.5):
    @F.pandas_udf(T.StringType())
    def run(frames: pd.Series) -> pd.Series:
        scores = (np.array([list(f) for f in x], float) for x in frames)
        return pd.Series([segmented(s - np.logaddexp.reduce(s, axis=1, keepdims=True), alphabet, model, alpha) for s in scores])

    return run
