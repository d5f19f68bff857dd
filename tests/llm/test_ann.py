"""The forest against brute force: recall on even and clustered vectors, exact scores, ties, repeats, vectors that take no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import ann

RNG = np.random.default_rng(5)
SCHEMA = "vec_id long, embedding array<float>"


def even(n, dim=64):
    x = RNG.normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def clustered(n, dim=64):
    return (even(40, dim)[RNG.integers(0, 40, n)] + 0.1 * RNG.normal(size=(n, dim))).astype(np.float32)


def brute(x, ids, q, k=20):
    own = int(np.flatnonzero(ids == q)[0])
    scores = [sum_in_order(v, x[own]) for v in x]
    return sorted((-s, i) for s, i in zip(scores, ids.tolist(), strict=True) if i != q)[:k]


def sum_in_order(a, b):
    s = 0.0
    for u, v in zip(a.tolist(), b.tolist(), strict=True):
        s += u * v
    return s


@pytest.mark.parametrize("make", [even, clustered])
def test_recall(make):
    """A block that is wanted by a fraction of its vectors, as large tables are."""
    x = make(20_000).astype(float)
    forest = ann.Forest(np.arange(len(x)), x, 20, candidates=6_000)
    asked = np.arange(0, len(x), 200)
    q, c, score, scored = forest.nearest(asked, x[asked])
    assert scored < 0.5 * len(asked) * len(x)
    hits = 0
    for i in asked.tolist():
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(set(c[q == i].tolist()) & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.9 * 20 * len(asked)
    assert np.allclose(score, [x[a] @ x[b] for a, b in zip(q, c, strict=True)])


def test_prefixes_ascend():
    x = even(3_000).astype(float)
    forest = ann.Forest(np.arange(len(x)), x, 5, trees=4, candidates=100)
    lo, hi = forest.ranges(x[:50])
    size = (hi - lo).sum(1)
    assert (size >= 100).all() and size.min() < 400
    for tree, (code, order) in enumerate(forest.arrays):
        assert (np.diff(code) >= 0).all()
        assert all(i in {forest.ids[o][0] for o in order[lo[i, tree] : hi[i, tree]]} for i in range(50))


@pytest.mark.parametrize("exact", [False, True])
def test_equals_brute_force_in_blocks(spark, exact):
    """Tables below a block's wish are searched whole; ties, equal vectors and repeated ids have one answer."""
    x = even(300, 8)
    x[50:120] = x[7]
    x[120:130] = 2 * x[8]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(400, None), (401, []), (402, [0.0] * 8), (403, [float("nan")] + [1.0] * 7), (404, [None] + [1.0] * 7), (405, [1.0] * 5), (None, [1.0] * 8), (406, [float("inf")] * 8), (3, [9.0] * 8)]
    df = spark.createDataFrame(rows + odd, SCHEMA).withColumn("id", F.lit(1)).withColumn("block", F.lit(2)).repartition(4)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), block=64, exact=exact).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    ids = np.arange(300)
    for q in range(0, 300, 20):
        assert sorted(got[q]) == [(n + 1, s, i) for n, (s, i) in enumerate(brute(x.astype(float), ids, q))]
    assert set(got) == set(range(0, 300, 20))
    few = df.where("vec_id < 3")
    assert ann.nearest(few, few, exact=exact).count() == 6 and ann.nearest(few.where("false"), few).count() == 0
    assert ann.nearest(few.where("vec_id = 1"), few).count() == 0


def test_query_recall(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    got = {}
    for r in ann.op6_ann(spark, folder).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    table = duckdb.sql(f"select vec_id, embedding from '{folder}/embeddings.parquet'").fetchnumpy()
    ids, x = table["vec_id"], np.stack(table["embedding"]).astype(float)
    hits = asked = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        hits, asked = hits + len(got[ids[i]] & set(ids[np.argsort(-s)[:20]].tolist())), asked + 20
    assert hits >= 0.9 * asked
