"""Repeated strings against brute force: whole columns, hot shared bytes, texts longer than a piece, several lengths."""

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordloom.llm import substring_dedup as sd

RNG = np.random.default_rng(11)


def noise(n, letters="abcdefgh "):
    return "".join(RNG.choice(list(letters), n))


def brute(raws, length):
    """Covered runs of each text, by the hash of every string."""
    count = {}
    for b in raws:
        for i in range(len(b) - length + 1):
            k = hashlib.md5(b[i : i + length]).digest()
            count[k] = count.get(k, 0) + 1
    out = []
    for b in raws:
        runs = []
        for i in range(len(b) - length + 1):
            if count[hashlib.md5(b[i : i + length]).digest()] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + length
                else:
                    runs.append([i, i + length])
        out.append([tuple(r) for r in runs])
    return out


def told(df, column):
    return {r["doc_id"]: [(s["start"], s["end"]) for s in r[column]] for r in df.collect()}


@pytest.fixture(scope="module")
def texts():
    common, passage = noise(430), noise(300)
    out = [noise(int(RNG.integers(0, 60))) + common + noise(int(RNG.integers(0, 60))) for _ in range(40)]  # one string, all its spans distinct
    out += [noise(300) + passage + noise(300), noise(10) + passage, passage + passage, noise(600)]
    copy = noise(1500)
    out += [copy, copy, copy[:700] + "x" + copy[700:], copy[200:1400], copy[:399], copy[:400], "", None, "é" * 500, "é" * 300 + copy[:450]]
    out += ["ab" * 400, "ab" * 260, "z" * 401, "q" * 400, copy[100:900] + "\0\0" + copy[100:900], "\0" * 900]
    return out


@pytest.mark.parametrize("cap", [sd.CAP, 3])
def test_equals_brute_force(spark, texts, cap):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).withColumn("length", F.lit(1)).withColumn("runs_", F.lit(2))
    got = sd.remove_repeats(df, shorter=256, cap=cap)
    raws = [(t or "").encode() for t in texts]
    assert told(got, "removed") == dict(enumerate(brute(raws, 400)))
    assert told(got, "passages") == dict(enumerate(brute(raws, 256)))
    with pytest.raises(ValueError, match="removed"):
        sd.remove_repeats(df.withColumn("Removed", F.lit(1)))


def test_text_longer_than_a_piece(spark):
    long = noise(sd.PIECE + 3000)
    edge = sd.PIECE
    texts = [long, noise(50) + long[edge - 700 : edge + 900] + noise(50), long[edge - 200 : edge + 200] + noise(5)]
    got = told(sd.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "removed")
    assert got == dict(enumerate(brute([t.encode() for t in texts], 400)))


def test_query_equals_brute_force(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet'").fetchall()
    raws = [(t or "").encode() for _, t in rows]
    want = {}
    for (i, _), b, runs in zip(rows, raws, brute(raws, 400), strict=True):
        kept, at = b"", 0
        for x, y in runs:
            kept, at = kept + b[at:x], y
        kept += b[at:]
        want[i] = (len(b), len(b) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
    got = {r[0]: tuple(r[1:5]) for r in sd.op10_substring_dedup(spark, folder).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 0


def test_shared_bytes_without_a_repeated_string(spark):
    shared = noise(200)
    texts = [noise(300) + shared + noise(300), noise(250) + shared + noise(350)]
    got = sd.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shorter=256).collect()
    assert [(r["removed"], r["passages"]) for r in got] == [([], [])] * 2


def test_order_holds_a_bounded_part_of_the_spans(monkeypatch):
    n, starts, depth = 24_000, 128, 400
    letters = np.frombuffer(b"abcdefgh", np.uint8)
    raw = letters[RNG.integers(0, 8, (n, starts - 1 + depth))]
    raw[1::2, 100:] = raw[::2, 100:]  # neighbours are equal from place 100 on
    raw[::2, 99], raw[1::2, 99] = ord("x"), ord("y")
    names = ["core", "s1", "s2", "trigger", "starts", "bytes", "n"]
    ids = np.arange(n)
    columns = [ids // 2, ids, -ids, np.full(n, starts - 1, np.int32), np.full(n, starts, np.int32), [r.tobytes() for r in raw], np.ones(n, np.int64)]
    batches = pa.table([pa.array(c) for c in columns], names=names).to_batches(500)

    def found():
        return sorted(tuple(r.values()) for b in sd._ordered(iter(batches), (depth, 256)) for r in b.to_pylist())

    tracemalloc.start()
    rows = found()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 120e6
    assert [r[:5] for r in rows if r[2] == depth] == [(i, -i, depth, 100, starts - 1 + depth) for i in range(n)]
    monkeypatch.setattr(sd, "SORTED", 1 << 30)
    assert rows == found()
