"""Whole queries against brute force or the library, and odd tables: nulls, repeats, clashing names, long texts, none at all."""

import hashlib
import json
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wordloom.llm import bpe, decontaminate, line_dedup, simhash, toxicity

FOLDER = "/root/testdata/sf0.001"
LONG = "alpha beta gamma delta epsilon " * 50_000


def rows(sql):
    return duckdb.sql(sql.replace("{}", FOLDER)).fetchall()


def test_op5_equals_the_library(spark):
    library = Tokenizer.from_file(bpe.default_tokenizer())
    got = {r["doc_id"]: tuple(r)[1:4] for r in bpe.op5_bpe(spark, FOLDER).collect()}
    for i, text in rows("select doc_id, text from '{}/documents.parquet'"):
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        assert got[i] == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_other_tokenizers_are_refused():
    with open(bpe.default_tokenizer(), encoding="utf-8") as f:
        spec = json.load(f)
    for part, value in (("normalizer", None), ("decoder", {"type": "BPEDecoder"}), ("pre_tokenizer", {"type": "Whitespace"})):
        with pytest.raises(ValueError, match=part):
            bpe.Bpe(spec | {part: value})
    with pytest.raises(ValueError, match="model"):
        bpe.Bpe(spec | {"model": spec["model"] | {"byte_fallback": True}})


def test_op8_equals_brute_force(spark):
    def fingerprint(t):
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        bits = np.array([[xxhash.xxh64_intdigest(x.encode(), 42) >> k & 1 for k in range(64)] for x in s]) if s else np.zeros((1, 64))
        return sum(1 << k for k in range(64) if 2 * bits[:, k].sum() > len(s))

    docs = rows("select doc_id, text from '{}/documents.parquet' order by 1")
    ids, codes = [d[0] for d in docs], np.array([fingerprint(t) for _, t in docs], np.uint64)
    root = list(range(len(ids)))
    for a, b in np.argwhere(np.triu(np.bitwise_count(codes[:, None] ^ codes[None]) <= 3, 1)):
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op8_simhash(spark, FOLDER).collect()}
    assert got == {i: (f"{int(c):016x}", ids[r]) for i, c, r in zip(ids, codes, root, strict=True)}
    assert len(set(root)) < len(ids)


def within(item, text, budget):
    """Whether a region of the text is within the budget of the whole item: the full table, row by row."""
    cost, steps = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    for c in item:
        best = np.append(cost[0] + 1, np.minimum(cost[:-1] + (text != c), cost[1:] + 1))
        cost = np.minimum.accumulate(best - steps) + steps
    return cost.min() <= budget


def test_op7_equals_brute_force(spark):
    items = rows("select item_id, text from '{}/benchmark.parquet' where text <> ''")
    docs = rows("select doc_id, text from '{}/documents.parquet' where length(text) < 3000")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op7_decontaminate(spark, FOLDER).collect()}
    folded = [(i, decontaminate.fold(t)) for i, t in items]
    found = 0
    for d, text in docs:
        points = decontaminate.fold(text)
        for i, item in folded:
            hit = len(points) > 0 and within(item, points, int(len(item) * decontaminate.BUDGET))
            assert hit == ((d, i) in got), (d, i)
            found += hit
    assert found


def test_no_region_within_the_budget_is_missed():
    rng = np.random.default_rng(8)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    for m in range(1, 61):
        k = int(m * 0.12)
        for offset in range(4):
            item = "".join(rng.choice(letters, m))
            region = list(item)
            for e in range(k):  # edits spread evenly, or shifted
                region[min(m - 1, (e + 1) * m // (k + 1) - offset % 2 + offset // 2)] = "#"
            block = decontaminate.Block([1], [decontaminate.fold(item)], 0.12, decontaminate.gram_size(m, 0.12))
            text = "".join(rng.choice(letters, 30)) + "-" + "".join(region) + "-" + "".join(rng.choice(letters, 30))
            assert block.regions([text])[0], (m, offset)


def test_several_passes_find_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"passage number {i} " + "words " * (i % 7) + f"that ends with {i * i}") for i in range(60)], "item_id long, text string")
    docs = spark.createDataFrame([(d, f"some text, passage number {d} " + "words " * (d % 7) + f"that ends with {d * d}, and more") for d in range(0, 60, 7)] + [(99, None), (99, None), (None, "")], "doc_id long, text string").withColumn("whole", F.lit(1)).withColumn("item_id", F.lit(2))

    def told():
        return sorted((str(r["doc_id"]), [tuple(x) for x in r["leaks"]]) for r in decontaminate.leaks(docs, items).collect())

    one = told()
    monkeypatch.setattr(decontaminate, "PASS_CHARS", 500)
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    assert len(list(decontaminate.passes(decontaminate.blocks(items)))) > 3
    assert told() == one and len(one) == 12
    assert decontaminate.leaks(docs.where("false"), items).count() == 0
    with pytest.raises(ValueError, match="leaks"):
        decontaminate.leaks(docs.withColumn("LEAKS", F.lit(1)), items)


def test_fit_is_an_optimum():
    """The objective against small steps in every direction and against a slow plain descent."""
    rng = np.random.default_rng(4)
    n, names = 300, [f"w{k}" for k in range(12)]
    x = rng.random((n, 12)) < 0.3
    latent = x @ np.linspace(-2, 3, 12) + rng.logistic(size=n)
    grades = (latent > 1).astype(int) + (latent > 3)
    penalty = 1e-2
    model = toxicity.Ordinal.fit([np.flatnonzero(r).tolist() for r in x], grades, names, penalty, 4_000)
    weight = np.where(grades == 0, 0.5 / (grades == 0).sum(), 0.5 / (grades > 0).sum())

    def loss(w, theta):
        z = (x @ w)[:, None] - theta[None]
        above = grades[:, None] > np.arange(2)[None]
        return (weight[:, None] * np.logaddexp(0, np.where(above, -z, z))).sum() + penalty * np.abs(w).sum()

    w, theta = np.array([model.weights.get(v, 0.0) for v in names]), model.thresholds
    best = loss(w, theta)
    for _ in range(300):
        assert loss(w + rng.normal(size=12) * 0.02, np.sort(theta + rng.normal(size=2) * 0.02)) >= best - 1e-6
    v, u = np.zeros(12), np.array([0.0, 1.0])
    for _ in range(6_000):
        p = toxicity.sigmoid((x @ v)[:, None] - u[None])
        gap = (p - (grades[:, None] > np.arange(2)[None])) * weight[:, None]
        v = v - 0.3 * (x.T @ gap.sum(1))
        v = np.sign(v) * np.maximum(0, np.abs(v) - 0.3 * penalty)
        u = u + 0.3 * gap.sum(0)
    assert best <= loss(v, u) + 1e-5


def test_toxicity_odd_tables(spark):
    texts = [("good words here " + "calm " * (i % 3)) if i % 2 else ("nasty grackle snorkle " + "bad " * (i % 3)) for i in range(80)]
    docs = spark.createDataFrame([*enumerate(texts), (500, None), (501, ""), (502, LONG + " grackle snorkle nasty"), (None, "grackle"), (3, texts[3])], "doc_id long, text string").withColumn("g", F.lit("x")).withColumn("i", F.lit("y"))
    labels = spark.createDataFrame([(i, 1, 1 - i % 2) for i in range(60)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, toxicity.severity_grade())
    got = toxicity.score(docs, model).collect()
    assert len(got) == 85 and all(r["toxic"] == (r["doc_id"] % 2 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 80)
    by = {r["doc_id"]: r["toxic"] for r in got}
    assert by[502] and by[500] == by[501]
    assert toxicity.score(docs.where("false"), model).count() == 0
    none = toxicity.train(docs, labels.where("false"), toxicity.severity_grade())
    assert toxicity.score(docs, none).where("toxic").count() == 0
    with pytest.raises(ValueError, match="toxic"):
        toxicity.score(docs.withColumn("Toxic", F.lit(1)), model)


def test_other_odd_tables(spark):
    docs = spark.createDataFrame([(1, LONG), (1, LONG), (2, LONG + "end"), (3, None), (None, "x"), (4, "")], "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("node", F.lit("n")).withColumn("whole", F.lit("w"))
    library = Tokenizer.from_file(bpe.default_tokenizer())
    coded = bpe.encode(docs, bpe.default_tokenizer(), decoded="back").collect()
    assert len(coded) == 6 and all(r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids for r in coded)
    assert all(r["back"] == library.decode(r["ids"], skip_special_tokens=False) for r in coded)
    assert bpe.encode(docs.where("false"), bpe.default_tokenizer()).count() == 0
    with pytest.raises(ValueError, match="ids"):
        bpe.encode(docs.withColumn("Ids", F.lit(1)), bpe.default_tokenizer())
    near = [tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "component_id").collect()]
    assert len(near) == 6 and {c for i, c in near if i in (1, 2)} == {1} and {c for i, c in near if i in (3, 4)} == {3}
    kept = line_dedup.dedup_lines(docs.select("doc_id", F.regexp_replace("text", " delta ", "\n").alias("text"), F.lit(7).alias("starts"), "node")).collect()
    assert len(kept) == 6 and sum(len(r["text"]) > 0 for r in kept) == 4  # rows of one id are no copies of each other
    assert all(r["starts"] == 7 for r in kept)


def test_hot_nodes_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_EDGES", 20)
    links = [(5, k) for k in range(100, 260)] + [(k, k + 1) for k in range(300, 320)] + [(259, 300), (3, 5)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert set(got.values()) == {3} and len(got) == 160 + 21 + 1
