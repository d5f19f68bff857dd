"""Golden vectors and invariants of the corpus, lexicon, model, scoring and layout operators."""



import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.functions import text
from wordloom.functions.alphabet import MEITEI
from wordloom.operators import corpus, decode, duplicates, geometry, labels, language_model, lexicon, metrics, release, sampling, training, vectors
from wordloom.sources import stores
from wordloom.sources import text as sources
from wordloom.streaming import stream

K, LAI, HUK, I, RAI, BA, DIL = "ꯀ", "ꯂ", "ꯍ", "ꯏ", "ꯔ", "ꯕ", "ꯗ"
M_L, NG, INAP, AA, YENAP, UNAP, NUNG, APUN = "ꯝ", "ꯡ", "ꯤ", "ꯥ", "ꯦ", "ꯨ", "ꯪ", "꯭"


def one(spark, column, word):
    return spark.createDataFrame([(word,)], "w string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("word", "parts"),
    [(K, 1), (K + AA, 1), (K + NUNG, 1), (K + AA + NG, 1), (HUK + INAP + NG + HUK + NUNG, 2), (DIL + APUN + RAI, 1), (K + AA + I + BA, 2), (K + LAI, 2), ("꯱꯲", 2)],
)
def test_syllables(spark, word, parts):
    found = one(spark, text.syllables(F.col("w"), MEITEI), word)
    assert len(found) == parts and "".join(found) == word


@pytest.mark.parametrize(
    ("syllable", "kind"),
    [(K, "C"), (K + AA, "CV"), (K + AA + NG, "CVC"), (K + M_L, "CC"), (K + NUNG, "CC"), (DIL + APUN + RAI + AA, "CV"), (K + AA + I, "CVC"), ("꯱", "other")],
)
def test_syllable_kinds(spark, syllable, kind):
    assert one(spark, text.syllable_kind(F.col("w"), MEITEI), syllable) == kind


@pytest.mark.parametrize(
    ("word", "reason"),
    [("ꯑ" + YENAP + "ꯟ" + APUN + DIL, None), (K + APUN + LAI, None), (YENAP + K, "starts with a sign"), (K + APUN, "joiner not between two consonants"), (K + "a", "character outside the alphabet"), (K * 30, "too long")],
)
def test_problems(spark, word, reason):
    assert one(spark, text.problem(F.col("w"), MEITEI), word) == reason


def test_split_shares_and_determinism(spark):
    words = spark.range(20000).select(F.concat(F.lit("w"), "id").alias("w"))
    share = {r["s"]: r["count"] / 20000 for r in words.groupBy(text.split_of(F.col("w")).alias("s")).count().collect()}
    assert abs(share["train"] - 0.9) < 0.015 and abs(share["val"] - 0.05) < 0.01 and abs(share["test"] - 0.05) < 0.01


def test_clean_and_combine(spark):
    a = spark.createDataFrame([("ka", 3), ("la", 1)], "word string, n long")
    b = spark.createDataFrame([("ka", 2), ("la", 4)], "word string, n long")
    assert {(r["word"], r["n"]) for r in corpus.combine(a, b, how="max").collect()} == {("ka", 3), ("la", 4)}
    kept, dropped = lexicon.clean(corpus.combine(a, spark.createDataFrame([("ak", 5), ("ñ", 2)], "word string, n long")))
    assert {r["word"] for r in kept.collect()} == {"ka", "la"}
    assert {(r["reason"], r["running"]) for r in dropped.collect()} == {("starts with a sign", 5), ("character outside the alphabet", 2)}


def test_kneser_ney_sums_to_one(spark):
    words = spark.createDataFrame([("kan", 10.0), ("ka", 5.0), ("li", 3.0), ("m", 1.0)], "word string, w double")
    tables = language_model.counts(words, 4, F.col("w"))
    vocabulary = tables[1].select("c")
    asked = spark.createDataFrame([("^^^",), ("^^k",), ("xyz",), ("^ka",)], "h string").crossJoin(vocabulary)
    totals = language_model.probabilities(asked, tables, tables[1]).groupBy("h").agg(F.sum("p").alias("p")).collect()
    assert len(totals) == 4 and all(abs(r["p"] - 1) < 1e-9 for r in totals)


def test_align_and_scores(spark):
    assert metrics.align("ab", "b") == [("a", ""), ("b", "b")]
    df = spark.createDataFrame([("ab", "ac"), ("cd", "cd"), ("e", "f"), ("g", "gg")], "reference string, reading string")
    r = metrics.rates(df).first()
    assert (r["words"], r["chars"], r["edits"], r["wrong"]) == (4, 6, 3, 3) and r["cer"] == 0.5 and r["wer"] == 0.75
    ops = {x["operation"]: x["n"] for x in metrics.operations(metrics.aligned(df)).collect()}
    assert ops == {"match": 4, "substitution": 2, "insertion": 1}


def test_exact_test(spark):
    pairs = [(0, 0), (9, 1), (1, 9), (5, 5), (2, 7), (40, 60), (480, 520), (3, 0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, b long, c long").coalesce(1)
    got = {r["i"]: r["p"] for r in df.select("i", metrics.exact_p("b", "c").alias("p")).collect()}
    for i, (b, c) in enumerate(pairs):
        assert got[i] == pytest.approx(min(1.0, 2 * sum(math.comb(b + c, k) for k in range(min(b, c) + 1)) / 2 ** (b + c)), rel=1e-9)
    assert metrics.half_tail(np.array([10**9]), np.array([10**9 // 2 - 10**5]))[0] == pytest.approx(0, abs=1e-9)


def test_ctc(spark):
    path = spark.createDataFrame([([0, 1, 1, 0, 2, 0, 0, 1, 0, 1],)], "c array<int>")
    assert path.select(decode.collapse(F.col("c")).alias("x")).first()["x"] == [1, 2, 1, 1]
    logp = np.log(np.full((3, 3), 0.05) + np.array([[0, 0.85, 0], [0.85, 0, 0], [0, 0, 0.85]]))
    assert decode.beam(logp) == [1, 2]
    near = np.log(np.array([[0.02, 0.5, 0.48]]))
    assert decode.beam(near) == [1] and decode.beam(near, alpha=1.0, lm=lambda p, c: 0.0 if c in (2, None) else -2.0) == [2]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "x", "a", "train"), (2, "x", "b", "test"), (3, "y", "a", "train"), (4, "y", "a", "test"), (5, "z", "a", "test")], "id long, t string, l string, p string")
    gone = {(r["id"], r["reason"]) for r in duplicates.exclusions(df, "id", F.col("t"), "l", "p").collect()}
    assert gone == {(1, "conflict"), (2, "conflict"), (4, "leak")}
    t = duplicates.twins(df, F.col("t"), "l", "p").first()
    assert (t["same_label"], t["other_label"]) == (1, 1)


def test_draw_equals_search(spark):
    rng = np.random.default_rng(1)
    cum = np.cumsum(rng.random(300))
    cum /= cum[-1]
    u = [*rng.random(500), float(cum[3]), 0.999999999]
    table = spark.createDataFrame([(i, float(c)) for i, c in enumerate(cum)], "value long, cum double")
    draws = spark.createDataFrame([(i, float(x)) for i, x in enumerate(u)], "item long, u double")
    got = {r["item"]: r["value"] for r in sampling.draw(table, draws).collect()}
    assert got == {i: min(int(np.searchsorted(cum, x, "right")), 299) for i, x in enumerate(u)}
    small = {r["item"]: r["value"] for r in sampling.draw(table, draws, rows=7).collect()}
    assert small == got
    same = spark.createDataFrame([(1, 0.5), (1, 0.5), (1, 0.5)], "item long, u double")
    assert sampling.draw(table, same).count() == 3 and sampling.draw(table, same.where("false")).count() == 0


def test_boxes(spark):
    boxes = spark.createDataFrame([(1, 1, 0, 0, 50, 50), (1, 2, 60, 0, 100, 50)], "page int, box int, x0 int, y0 int, x1 int, y1 int")
    pieces = spark.createDataFrame([(1, 1, 10, 10, 20, 20), (1, 2, 40, 0, 70, 10), (1, 3, 110, 0, 120, 10), (1, 4, 500, 500, 510, 510)], "page int, piece int, x0 int, y0 int, x1 int, y1 int")
    got = {r["piece"]: (r["kind"], r["box"]) for r in geometry.assign(pieces, boxes).collect()}
    assert got == {1: ("inside", 1), 2: ("shared", None), 3: ("near", 2), 4: ("stray", None)}


def test_boxes_at_one_place_are_met_once(spark):
    """400 boxes and 400 pieces at each of a few places that share several cells, against all pairs."""
    at = [(0, 0), (95, 95), (130, 40), (300, 300)]
    boxes = [(1, 10 * i + j, x, y, x + 80, y + 60) for i in range(400) for j, (x, y) in enumerate(at)] + [(2, 1, 0, 0, 80, 60)]
    pieces = [(1, 10 * i + j, x + 40, y + 55, x + 70, y + 85) for i in range(400) for j, (x, y) in enumerate([*at, (500, 300), (320, 345)])] + [(2, 1, 85, 10, 115, 40), (2, 2, 10, 10, 40, 40), (2, 2, 10, 10, 40, 40), (3, 1, 0, 0, 30, 30)]
    frames = [spark.createDataFrame(rows, f"page int, {key} int, x0 int, y0 int, x1 int, y1 int") for rows, key in ((pieces, "piece"), (boxes, "box"))]
    got = sorted((((r["page"], r["piece"]), r["kind"], r["box"]) for r in geometry.assign(*frames).collect()), key=str)

    def meets(a, b):
        overlap = max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
        return overlap, max(0, b[2] - a[4], a[2] - b[4]) + max(0, b[3] - a[5], a[3] - b[5])

    want = []
    for a in pieces:
        near = [(*meets(a, b), b[1]) for b in boxes if b[0] == a[0]] * pieces.count(a)
        near = sorted((-o, g, box) for o, g, box in near if o > 0 or g <= 40)
        over = sum(o < 0 for o, _, _ in near)
        want.append((a[:2], "shared" if over > 1 else "inside" if over else "near" if near else "stray", near[0][2] if near and over <= 1 else None))
    assert got == sorted(want, key=str) and {k for _, k, _ in got} == {"shared", "near", "stray"}


def test_crowded_places_end(spark):
    """Pairing them all, 2.7 thousand million, takes far more than the minute after which the jobs are stopped."""
    at = spark.range(90_000).select(F.lit(1).alias("page"), F.col("id").alias("piece"), *[F.lit(v).alias(c) for c, v in (("x0", 90), ("y0", 90), ("x1", 120), ("y1", 120))])
    stop = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        found = geometry.assign(at, at.where("piece < 30000").withColumnRenamed("piece", "box")).groupBy("kind", "box").count().collect()
    finally:
        stop.cancel()
    assert [tuple(r) for r in found] == [("shared", None, 90_000)]


def test_training_measures(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.4)], "step int, cer double")
    assert [r["improved"] for r in training.running_best(df, "step", "cer").orderBy("step").collect()] == [True, False, True]
    rate = spark.createDataFrame([(0,), (10,), (100,)], "s int").select(training.learning_rate(F.col("s"), 1.0, 10, 100).alias("r")).collect()
    assert rate[0]["r"] == pytest.approx(0.1) and rate[1]["r"] == pytest.approx(1.0) and abs(rate[2]["r"]) < 1e-12


def test_z_scores_of_constant_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", 5.0)], "k string, v double")
    assert sorted((r["k"], r["z"]) for r in vectors.z_scores(df, "k", "v").collect()) == [("a", -1.0), ("a", 1.0), ("b", 0.0), ("b", 0.0)]


def test_nearest_in_class_ranks_by_the_rounded_distance(spark):
    df = spark.createDataFrame([(0, 1, [0.0]), (1, 1, [0.50000004]), (2, 1, [0.5]), (3, 1, None), (4, 1, [None]), (5, 2, [0.0])], "i long, c int, v array<double>")
    near = vectors.nearest_in_class(df, df.where("i = 0"), "i", "c", "v", 3, digits=6).orderBy("place")
    assert [(r["i"], r["d"]) for r in near.collect()] == [(1, 0.25), (2, 0.25), (3, None)]


def test_sources(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("ka\t3\nka\t 2 \nla\tx\n")
    assert [(r["word"], r["n"]) for r in sources.read_counts(spark, str(tmp_path / "c.tsv")).collect()] == [("ka", 5)]
    (tmp_path / "j.jsonl").write_text('{"text": "a b"}\nnot json\n{"x": "c"}\n')
    assert sorted(r["text"] for r in sources.read_json_lines(spark, str(tmp_path / "j.jsonl"), "s").collect()) == ["a b", "c"]
    (tmp_path / "d.txt").write_bytes(b"one\ntwo \xff\n")
    assert sources.read_lines(spark, str(tmp_path / "d.txt"), "s").count() == 2
    (tmp_path / "k.jsonl").write_text('{"a": 12, "b": true, "c": "12", "d": {"e": "f"}}\n{"text": 5, "t": "q"}\n')
    assert [(r["doc"], r["text"]) for r in sources.read_json_lines(spark, str(tmp_path / "k.jsonl"), "s").orderBy("doc").collect()] == [("k.jsonl#0", "12"), ("k.jsonl#1", "q")]


def test_numbers_do_not_change_with_the_splits(spark, tmp_path):
    folder = tmp_path / "dump"
    folder.mkdir()
    lines = ["head"] + [x for k in range(400) for x in ("<page>", f"<title>t{k}</title>", f"<revision><text>body {k}</text></revision>", "</page>")]
    (folder / "a.xml").write_text("\n".join(lines) + "\n")
    (folder / "b.xml").write_text("<page>one\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = sources.read_pages(spark, str(folder), "s").collect()
        numbered = {r["row"]: r["text"] for r in sources.numbered_lines(spark, str(folder / "a.xml")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert numbered == dict(enumerate(lines))
    by = {}
    for r in sorted(got, key=lambda r: (r["doc"], r["chunk_no"])):
        by.setdefault(r["doc"], []).append(r["text"])
    assert len(by) == 402 and by["a.xml#page0"] == ["head"] and by["a.xml#page7"][2] == "<revision><text>body 6</text></revision>" and by["b.xml#page1"] == ["<page>one"]


def test_archives(spark, tmp_path):
    import io
    import tarfile
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("set/Train/12/x1.PNG", b"abc")
        z.writestr("__MACOSX/._x1.PNG", b"z")
    with tarfile.open(tmp_path / "b.tar", "w") as t:
        for name, data in (("./images/p.png", b"P"), ("./labels.tsv", b"p.png\tka\nq.png\tla\n"), ("./manifest.json", b'{"format": "f", "items": [{"file": "p.png", "kind": "word"}]}')):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    entries = stores.read_archives(spark, str(tmp_path))
    told = {r["name"]: (r["stem"], r["ext"], r["split"], r["label"], r["system"]) for r in stores.described(entries.where("archive = 'a.zip'")).collect()}
    assert told == {"set/Train/12/x1.PNG": ("x1", "png", "train", 12, False), "__MACOSX/._x1.PNG": ("._x1", "png", None, None, True)}
    own = entries.where("archive = 'b.tar'")
    items = stores.side_json(own, "manifest.json", "format string, items array<struct<file: string, kind: string>>").select(F.explode("items").alias("i")).select("i.*")
    images = stores.item_kinds(stores.image_set(own), items)
    assert [(r["name"], r["text"], r["content"], r["kind"]) for r in images.orderBy("row").collect()] == [("p.png", "ka", b"P", "word"), ("q.png", "la", None, None)]
    assert stores.side_json(own, "config.json", "a int").count() == 0
    px = spark.createDataFrame([([[[255, 0, 0, 255], [0, 0, 0, 0], [10, 20, 30, 255]]],)], "p array<array<array<int>>>")
    assert px.select(stores.grey(F.col("p")).alias("g")).first()["g"] == [[76, 255, 18]]


def test_checks_of_runs_and_releases(spark):
    one = spark.createDataFrame([("f1", "ka", "ka"), ("f2", "la", "x")], "file string, reference string, reading string")
    wide = metrics.runs_wide({"a": one, "b": one.withColumn("reading", F.lit("la"))})
    assert {r["file"]: r["right"] for r in wide.collect()} == {"f1": [True, False], "f2": [False, True]}
    for bad in (one.where("file = 'f1'"), one.withColumn("reference", F.lit("z"))):
        with pytest.raises(Exception, match="same words"):
            metrics.runs_wide({"a": one, "b": bad}).collect()
    none = spark.createDataFrame([], "file string, text string")
    labels_ = one.select("file", F.when(F.col("file") == "f2", "lb").otherwise(F.col("reference")).alias("text"))
    with pytest.raises(Exception, match="without a recorded correction"):
        metrics.corrected(one, none, labels_).collect()
    fix = spark.createDataFrame([("f2", "lb")], "file string, text string")
    assert {r["file"]: r["changed"] for r in metrics.corrected(one, fix, labels_).collect()} == {"f1": False, "f2": True}
    items = spark.createDataFrame([(1, 1, "f1", "ka", "word", "written", []), (2, 1, "f2", "la", "word", "empty", ["faint"])], "item int, page int, file string, text string, kind string, status string, flags array<string>")
    told = spark.createDataFrame([("f1", "ka")], "file string, text string")
    fixes = spark.createDataFrame([("f1", "kb", "slip")], "file string, text string, reason string")
    assert [(r["file"], r["text"], r["was"]) for r in release.release(items, told, fixes).collect()] == [("f1", "kb", "ka")]
    with pytest.raises(Exception, match="not in the set"):
        release.release(items, told, fixes.withColumn("file", F.lit("f2"))).collect()
    with pytest.raises(Exception, match="disagree"):
        release.release(items, told.withColumn("text", F.lit("q")), fixes.where("false")).collect()


def test_labels(spark):
    df = spark.createDataFrame([("abz",), ("",)], "w string")
    assert [r["c"] for r in df.select(labels.encode(F.col("w"), "abz").alias("c")).collect()] == [[1, 2, 3], []]
    with pytest.raises(Exception, match="outside the alphabet"):
        df.select(labels.encode(F.col("w"), "ab")).collect()
    words = spark.createDataFrame([("kala",), ("ba7",)], "w string")
    made = [r["s"] for r in words.select(labels.scrambled(F.col("w"), F.col("w"), ("bkl", "aei")).alias("s")).collect()]
    assert all(len(a) == len(b) and all((x in "bkl") == (y in "bkl") for x, y in zip(a, b, strict=True)) for a, b in zip(made, ("kala", "ba7"), strict=True)) and made[1][2] == "7"


def test_decoding_with_a_model_against_all_texts(spark):
    import itertools

    words = spark.createDataFrame([("ab",), ("abb",), ("ba",), ("bab",)], "word string")
    tables = language_model.counts(words)
    model = decode.collected(language_model.back_off(tables, tables[1]), 3)
    vocabulary = [r["c"] for r in tables[1].select("c").collect()]
    for text in ("", "a", "ab", "abb", "bba"):
        assert sum(math.exp(model(text, None if c == "$" else c)) for c in vocabulary) == pytest.approx(1)
    rng = np.random.default_rng(3)
    for _ in range(20):
        s = rng.normal(size=(3, 2))
        logp = s - np.logaddexp.reduce(s, axis=1, keepdims=True)

        def score(t, logp=logp):
            return sum(logp[i]["ab".index(c)] + 0.5 * model(t[:i], c) for i, c in enumerate(t)) + 0.5 * model(t, None)

        assert decode.segmented(logp, "ab", model) == max(("".join(t) for t in itertools.product("ab", repeat=3)), key=score)
        s = rng.normal(size=(4, 3))
        logp = s - np.logaddexp.reduce(s, axis=1, keepdims=True)
        best = {}
        for path in itertools.product(range(3), repeat=4):
            text = tuple(c for c, _ in itertools.groupby(path) if c)
            best[text] = np.logaddexp(best.get(text, -np.inf), sum(logp[i][c] for i, c in enumerate(path)))
        spell = lambda p: "".join("ab"[c - 1] for c in p)
        total = {t: v + 0.7 * (sum(model(spell(t[:i]), spell(t[i : i + 1])) for i in range(len(t))) + model(spell(t), None)) + 0.1 * len(t) for t, v in best.items()}
        got = decode.beam(logp, width=1000, alpha=0.7, beta=0.1, lm=lambda p, c: model(spell(p), None if c is None else "ab"[c - 1]))
        assert total[tuple(got)] == pytest.approx(max(total.values()))


def test_stream_replay(spark):
    whole = {r["item"]: r["kind"] for r in stream.items(spark, 0, 200, "s").collect()}
    part = {r["item"]: r["kind"] for r in stream.items(spark, 100, 150, "s", 3).collect()}
    assert part == {k: v for k, v in whole.items() if 100 <= k < 150}


def test_packing_and_coverage():
    assert sampling.pack([3, 3, 5, 2], 6) == [0, 0, 1, 2] and sampling.pack([], 6) == []
    assert sampling.pack([30, 40, 30, 20, 10, 50], 60, 2, 2) == [0, 1, 2, 2, 3, 4]  # a window of two after each row's first
    widths = np.random.default_rng(2).integers(5, 60, 400).tolist()
    left, want, r = list(range(400)), [0] * 400, 0
    while left:
        used, want[left[0]], seen, rest = widths[left[0]], r, left[1:41], left[41:]
        kept = []
        for i in seen:
            if used + 3 + widths[i] <= 100:
                used, want[i] = used + 3 + widths[i], r
            else:
                kept.append(i)
        left, r = kept + rest, r + 1
    assert sampling.pack(widths, 100, 3, 40) == want
    import pandas as pd

    rows = sampling.coverage(pd.DataFrame({"word": ["ab", "cd", "ae"]}), 1, 3)
    assert sorted(rows) == [0, 1, 2]
