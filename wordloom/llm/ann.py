"""Approximate nearest neighbours by a hash-prefix forest.

Each of TREES trees gives a vector a long hash string: the axes, with their signs, nearest to the vector after a random
rotation, nearest first, seven bits each for 64 dimensions. In a tree the strings form a sorted array, so vectors whose
strings begin alike stand side by side. A query descends by binary search to its longest matching prefix in every
array, and then ascends in all of them together, to shorter and shorter prefixes, until they hold CANDIDATES vectors;
so the length of the prefix differs from query to query. The union of the trees' ranges is scored.

The vectors are dealt once, in blocks of about BLOCK; a block's forest is built by one task, and the queries are sent
to every block and streamed through it: a stated set of queries against all rows, in blocks. Candidates are a constant
for each query and block, so recall does not fall as the table grows. Blocks of vectors that are spread evenly need
about a quarter of their vectors for a recall over 0.9 (``CANDIDATES``); clustered vectors need far fewer. ``exact``
scores every vector.

Scores are sums of products in double precision, component after component, so they do not depend on the tasks.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.llm.common import col, cut

#: Trees of the forest; bits of a hash string; vectors that a query wants from a block's forest, counted in each tree.
TREES, BITS, CANDIDATES = 48, 63, 16_384
#: Vectors of a block, about: a forest of so many takes some 100 MB.
BLOCK = 65_536
SEED = 20_240_117


def usable(embedding: Column) -> Column:
    """Vectors that are null, empty, zero or hold null or non-finite components take no part."""
    def finite(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return F.coalesce(F.forall(embedding, finite) & F.exists(embedding, lambda x: x != 0), F.lit(False))


@cache
def rotation(dim: int, tree: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng([seed, tree]).normal(size=(dim, dim)))[0]


def strings(x: np.ndarray, tree: int, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """The hash strings of vectors (rows) in a tree, the first bits highest."""
    dim = x.shape[1]
    turned = x @ rotation(dim, tree, seed)
    size, rows = np.abs(turned), np.arange(len(x))
    digit = int(2 * dim - 1).bit_length()
    out, left = np.zeros(len(x), np.int64), bits
    for _ in range(min(dim, bits // digit)):
        axis = size.argmax(1)
        left -= digit
        out |= (2 * axis + (turned[rows, axis] > 0)).astype(np.int64) << left
        size[rows, axis] = -1
    return out


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with one vector, added up component after component."""
    out = np.zeros(len(x))
    for j in range(len(q)):
        out += x[:, j] * q[j]
    return out


class Forest:
    """Sorted arrays of hash strings over distinct vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, trees: int = TREES, candidates: int = CANDIDATES, exact: bool = False):
        order = np.lexsort((ids, *x.T[::-1]))
        ids, x = ids[order], x[order]
        first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]).any(1)))
        #: distinct vectors; of the ids of equal ones the k + 1 least are all that a result can hold
        self.x, self.k, self.candidates, self.exact = np.ascontiguousarray(x[first]), k, candidates, exact
        self.ids = [ids[a : min(b, a + k + 1)] for a, b in zip(first.tolist(), [*first[1:].tolist(), len(ids)], strict=True)]
        self.arrays = []
        for tree in range(0 if exact else trees):
            code = strings(self.x, tree)
            order = np.argsort(code, kind="stable")
            self.arrays.append((code[order], order.astype(np.int32)))

    def ranges(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and tree the range of the sorted array at the query's prefix length."""
        own = [strings(q, tree) for tree in range(len(self.arrays))]
        lo, hi = (np.zeros((len(q), len(self.arrays)), np.int64) for _ in range(2))
        open_ = np.arange(len(q))
        for length in [*range(BITS, 14, -7), *range(14, -1, -1)]:
            shift = BITS - length
            for tree, (code, _) in enumerate(self.arrays):
                prefix = own[tree][open_] >> shift
                lo[open_, tree] = np.searchsorted(code, prefix << shift)
                # strings are below 2^63, so the last prefix has no next one
                end = ((prefix + 1).astype(np.uint64) << np.uint64(shift)).clip(max=np.uint64(2**63 - 1)).astype(np.int64)
                hi[open_, tree] = np.where(prefix + 1 >= 1 << length, len(code), np.searchsorted(code, end))
            open_ = open_[(hi[open_] - lo[open_]).sum(1) < self.candidates]
            if not len(open_):
                break
        return lo, hi

    def nearest(self, own: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query's id, id, score) of the k nearest found of each query, and how many vectors were scored."""
        asked, found, scores, scored = [], [], [], 0
        if not self.exact:
            lo, hi = self.ranges(q)
        met = np.zeros(len(self.x), bool)
        for i in range(len(q)):
            if self.exact:
                near = np.arange(len(self.x))
            else:
                met[:] = False
                for (_, order), a, b in zip(self.arrays, lo[i].tolist(), hi[i].tolist(), strict=True):
                    met[order[a:b]] = True
                near = np.flatnonzero(met)
            scored += len(near)
            rough = self.x[near] @ q[i]
            if len(near) > self.k + 1:
                # what rounding may have put at the edge stays; the fixed sum decides
                least = np.partition(rough, len(near) - self.k - 1)[len(near) - self.k - 1]
                near = near[rough >= least - 1e-9 * (1 + abs(least))]
            exact = products(self.x[near], q[i])
            ids = np.concatenate([self.ids[n] for n in near.tolist()]) if len(near) else np.zeros(0, np.int64)
            score = np.repeat(exact, [len(self.ids[n]) for n in near.tolist()])
            other = ids != own[i]
            ids, score = ids[other], score[other]
            best = np.lexsort((ids, -score))[: self.k]
            asked.append(np.full(len(best), own[i]))
            found.append(ids[best])
            scores.append(score[best])
        return np.concatenate(asked), np.concatenate(found), np.concatenate(scores), scored


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", trees: int = TREES, candidates: int = CANDIDATES, block: int = BLOCK, exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found by inner product, ties to the smaller vec_id.

    ``queries`` holds ids of ``vectors``; a query is no candidate of its own. If a query has fewer than k candidates
    in all, it gets all. Vectors that take no part (``usable``, or not of the most frequent length, the shorter of
    two) neither ask nor answer; so do null ids; of rows that repeat a vec_id the least vector counts. Of equal vectors
    one is hashed, and all answer. An empty table gives an empty result; other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = vectors.where(col(vec_id).isNotNull()).select(col(vec_id).cast("long").alias("id"), col(embedding).cast("array<double>").alias("v")).where(usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, blocks = lengths["n"], -(-lengths["count"] // block)
    number = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    rows = rows.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    asked = cut(rows.join(queries.select(col(vec_id).cast("long").alias("id")).distinct(), "id", "left_semi"), "queries")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    dealt = rows.select(number, F.lit(0).alias("kind"), "id", "v").unionByName(asked.select(every, F.lit(1).alias("kind"), "id", "v"))
    # in a task a block's vectors come first, then its queries, batch by batch
    dealt = dealt.repartition(blocks, "block").sortWithinPartitions("block", "kind")

    def search(batches):
        ids, parts, forest, at = [], [], None, None
        for batch in batches:
            column = batch.column("v")
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            own, kind, number = (batch.column(c).to_numpy() for c in ("id", "kind", "block"))
            cuts = np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | (number[1:] != number[:-1])))[: len(batch)]
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(batch)], strict=True):
                if number[a] != at:
                    ids, parts, forest, at = [], [], None, number[a]
                if not kind[a]:
                    ids.append(own[a:b])
                    parts.append(x[a:b])
                    continue
                if not parts:
                    continue
                if forest is None:
                    forest = Forest(np.concatenate(ids), np.concatenate(parts), k, trees, candidates, exact)
                    ids, parts = [own[:0]], [x[:0]]
                q, c, score, _ = forest.nearest(own[a:b], x[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(score)], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    from wordloom.llm.common import table

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 20 = 0").select("vec_id"))
