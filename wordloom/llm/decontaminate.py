"""Benchmark decontamination by the q-gram lemma.

A string of m characters and a region within k edits of it share at least m - q + 1 - k q of the string's
q-grams, all on diagonals (position in the text minus position in the item) that differ by at most k. So the
shared q-grams are counted in bands of diagonals, each 2k+1 wide and overlapping the next by half; bands that
reach the bound are kept, and a banded alignment decides. Items for which the bound of Q would not be above zero get a
smaller q, so no region within the budget is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import col, fresh, whole_text

#: Characters of a q-gram.
Q = 12
#: Edits allowed, as a share of the item's characters.
BUDGET = 0.06
#: Items of a block and their characters: what is looked for at once.
BLOCK_ITEMS = 2_000
BLOCK_CHARS = 4_000_000
#: Characters of the blocks that are broadcast together, unless one item is longer. A larger benchmark takes more passes over the texts.
PASS_CHARS = 32_000_000
#: Bits of a band and of a place in an item, in one number with the item's number in its block.
BAND, PLACE = 25, 27
#: Characters of text scanned at once: longer texts go through in pieces that overlap by more than an item.
PIECE = 1 << 18

#: No character: it stands between texts that are scanned together, and matches nothing.
_BETWEEN = 0x110000
_BASE = 0x9E3779B1


def fold(text: str) -> np.ndarray:
    """Code points with letters lowered one for one and white space as a space, so positions stay."""
    return _FOLD[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _fold_table() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x30000):
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
        if chr(c).isspace():
            table[c] = 32
    return table


_FOLD = _fold_table()


def qgrams(points: np.ndarray, q: int = Q) -> np.ndarray:
    """A 32-bit hash of the q characters at each position, made by joining hashes of powers of two.

    Different q-grams may share one. That only adds to counts, and alignment decides.
    """
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h = points * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    out, done, size = None, 0, 1
    while True:
        if q & size:
            part = h[done : done + n]
            if out is None:
                out = part.copy()
            else:
                out *= np.uint32(pow(_BASE, size, 1 << 32))
                out += part
            done += size
        size *= 2
        if size > q:
            break
        half = size // 2
        longer = h[:-half] * np.uint32(pow(_BASE, half, 1 << 32))
        longer += h[half:]
        h = longer
    out ^= out >> np.uint32(16)
    out *= np.uint32(0xC2B2AE35)
    return out


def aligned(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """The best region of text within k edits of the whole item on diagonals low..high: (edits, start, end).

    Banded alignment, vectorised along the item's rows; ties go to the shorter start and end. None if there is none.
    """
    m, n, width = len(item), len(text), high - low + 1
    for d in range(max(0, low), min(high, n - m) + 1):  # most leaks are verbatim
        if text[d] == item[0] and np.array_equal(text[d : d + m], item):
            return 0, d, d + m
    far = m + n + 1
    cost = np.where((np.arange(low, high + 1) >= 0) & (np.arange(low, high + 1) <= n), 0, far).astype(np.int64)
    start = np.arange(low, high + 1)
    steps = np.arange(width)
    for i in range(1, m + 1):
        at = np.arange(low, high + 1) + i  # text positions consumed, by diagonal
        inside = (at >= 1) & (at <= n)
        same = np.zeros(width, bool)
        same[inside] = text[at[inside] - 1] == item[i - 1]
        diagonal = np.where(inside, cost + ~same, far)
        delete = np.append(cost[1:] + 1, far)  # the item's character has no partner
        take = delete < diagonal
        new, begun = np.where(take, delete, diagonal), np.where(take, np.append(start[1:], 0), start)
        new = np.where((at >= 0) & (at <= n), new, far)
        # insertions run along the row: a running minimum of cost minus steps
        keyed = (new - steps) * (width + 1) + steps
        best = np.minimum.accumulate(keyed)
        source = best % (width + 1)
        cost, start = np.minimum(new[source] + steps - source, far), begun[source]
        if cost.min() > k:
            return None
    best = int(cost.argmin())
    return (int(cost[best]), int(start[best]), best + low + m) if cost[best] <= k else None


@dataclass
class Block:
    """The q-grams of a block of items, sorted, with their items and places; and a bitmap that rejects most others."""

    ids: list[int]
    points: list[np.ndarray]
    budget: float = BUDGET
    q: int = Q

    def __post_init__(self):
        self.k = np.array([int(len(p) * self.budget) for p in self.points], np.int64)
        self.bound = np.array([len(p) for p in self.points], np.int64) - self.q + 1 - self.k * self.q
        grams = [qgrams(p, self.q) for p in self.points]
        hashes = np.concatenate([*grams, np.zeros(0, np.uint32)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order], item[order], place[order]
        self.shift = np.uint32(32 - min(26, max(16, int(np.ceil(np.log2(max(1, len(hashes)) * 32))))))
        self.seen = np.zeros((0xFFFFFFFF >> int(self.shift)) + 1, bool)
        self.seen[self.hashes >> self.shift] = True
        self.longest = max((len(p) for p in self.points), default=0)
        self.apart = np.full(int(self.k.max(initial=0)) + self.q, _BETWEEN, np.uint32)

    def regions(self, texts: list[str]) -> list[list[tuple[int, int, int, int, int]]]:
        """For each whole text (item, edits, shared q-grams, start, end). Texts are scanned end to end, too far apart to be aligned across."""
        folded, starts, at = [], [], 0
        for t in texts:
            folded += [fold(t), self.apart]
            starts.append(at)
            at += len(folded[-2]) + len(self.apart)
        points = np.concatenate(folded) if folded else np.zeros(0, np.uint32)
        over, found = 2 * self.longest + 2 * self.q, {}
        for at in range(0, max(1, len(points) - over), PIECE):
            for r in self._piece(points[at : at + PIECE + over]):
                found.setdefault((r[0], r[3] + at, r[4] + at), (*r[:3], r[3] + at, r[4] + at))
        out: list[list] = [[] for _ in texts]
        if found:
            each = list(found.values())
            for r, d in zip(each, (np.searchsorted(starts, [r[3] for r in each], "right") - 1).tolist(), strict=True):
                out[d].append((*r[:3], r[3] - starts[d], r[4] - starts[d]))
        return [self._apart(x) if x else x for x in out]

    @staticmethod
    def _apart(found) -> list[tuple]:
        """Of regions of one item that overlap, the one with fewest edits, the earlier of equal ones."""
        out: list[tuple] = []
        for r in sorted(found, key=lambda r: (r[0], r[1], r[3])):
            if not any(o[0] == r[0] and o[3] < r[4] and r[3] < o[4] for o in out):
                out.append(r)
        return sorted(out, key=lambda r: (r[3], r[0]))

    def _piece(self, points: np.ndarray):
        h = qgrams(points, self.q)
        at = np.flatnonzero(self.seen[h >> self.shift])
        if not len(at):
            return
        first, last = np.searchsorted(self.hashes, h[at]), np.searchsorted(self.hashes, h[at], "right")
        count = last - first
        at, first, count = at[count > 0], first[count > 0], count[count > 0]
        if not len(at):
            return
        pick = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        item, diagonal = self.item[pick], np.repeat(at, count) - self.place[pick]
        step = self.k[item] + 1
        band = np.floor_divide(diagonal, step)
        # band b holds the diagonals of b and b + 1 times step: two neighbours, so any k + 1 diagonals fit one band
        top = 1 << (BAND - 1)
        keys = (np.concatenate((item, item)) << BAND | (np.concatenate((band, band - 1)) + top)) << PLACE | np.concatenate((self.place[pick], self.place[pick]))
        # a q-gram of the item counts once a band, however often the text repeats it
        key, shared = np.unique(np.unique(keys) >> PLACE, return_counts=True)
        enough = shared >= self.bound[key >> BAND]
        for v, n in zip(key[enough].tolist(), shared[enough].tolist(), strict=True):
            i, b = v >> BAND, (v & ((1 << BAND) - 1)) - top
            k, step_i, m = int(self.k[i]), int(self.k[i]) + 1, len(self.points[i])
            low, high = b * step_i - k, (b + 2) * step_i + k
            begin = max(0, low)
            hit = aligned(self.points[i], points[begin : max(begin, high + m)], low - begin, high - begin, k)
            if hit:
                yield i, hit[0], n, hit[1] + begin, hit[2] + begin


def gram_size(m: int, budget: float = BUDGET) -> int:
    """The q of an item of m characters: at most Q, and so small that a region within the budget shares a q-gram."""
    return max(1, min(Q, m // (int(m * budget) + 1)))


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", budget: float = BUDGET):
    """The benchmark in blocks of bounded size and one q each; null and empty items can't be looked for and are left out."""
    held: dict[int, tuple[list, list]] = {}
    # most items have the size of a paragraph; one longer than a block makes a block of its own
    for row in benchmark.select(col(item).alias("i"), col(text).alias("t")).where(F.length("t") > 0).orderBy("i", "t").toLocalIterator():
        p = fold(row["t"])
        if len(p) >= 1 << PLACE:
            raise ValueError(f"benchmark item {row['i']} is longer than {(1 << PLACE) - 1} characters")
        q = gram_size(len(p), budget)
        ids, points = held.setdefault(q, ([], []))
        if ids and (len(ids) >= BLOCK_ITEMS or sum(map(len, points)) + len(p) > BLOCK_CHARS):
            yield Block(ids, points, budget, q)
            ids, points = held[q] = [], []
        ids.append(row["i"])
        points.append(p)
    for q in sorted(held, reverse=True):
        yield Block(*held[q], budget, q)


def passes(found: Iterator[Block]) -> Iterator[list[tuple]]:
    """What makes the blocks, in groups that are sent to the tasks together."""
    group, size = [], 0
    for block in found:
        own = sum(map(len, block.points))
        if group and size + own > PASS_CHARS:
            yield group
            group, size = [], 0
        group.append((block.ids, block.points, block.budget, block.q))
        size += own
    if group:
        yield group


REGION = T.StructType([T.StructField(n, T.LongType()) for n in ("item_id", "edits", "shared", "start", "end")])


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "leaks", budget: float = BUDGET, drop_text: bool = False) -> DataFrame:
    """Adds the regions of each whole text that lie within the edit budget of a whole benchmark item.

    A region has item_id, edits, shared (q-grams in its band), start and end (code points, end exclusive).
    Null and empty texts have none, an empty benchmark finds none, repeated rows each get theirs, and items with
    the same text are each reported. All blocks of a pass are looked for in one narrow stage, without a shuffle; an
    item of 2^27 characters or more is an error.
    """
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the documents already have {out}")
    spark, found = docs.sparkSession, docs.withColumn(out, F.array().cast(T.ArrayType(REGION)))
    keep = docs.columns
    region = pa.struct([(f, pa.int64()) for f in REGION.names])
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(REGION))])
    for group in passes(blocks(benchmark, text="text", budget=budget)):
        shared = spark.sparkContext.broadcast(group)

        def run(batches, shared=shared):
            held = [Block(*parts) for parts in shared.value]
            for batch in batches:
                rows, texts = batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist()
                for block in held:
                    for row, regions in zip(rows, block.regions(texts), strict=True):
                        row += [dict(zip(REGION.names, (block.ids[r[0]], *r[1:]), strict=True)) for r in regions]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(rows, pa.list_(region))], names=schema.names)

        found = found.select(*map(col, keep), col(out), whole_text(text).alias(fresh(found, "whole"))).mapInArrow(run, schema)
    return found.drop(text) if drop_text else found


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each benchmark passage found in a document."""
    from wordloom.llm.common import table, text_batches

    text_batches(spark)
    found = leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("r")).select("doc_id", "r.*")
