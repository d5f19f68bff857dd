"""The pipeline against a brute-force version over a small corpus with planted cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from wordloom.llm import bpe, toxicity

RNG = np.random.default_rng(11)
WORDS = ["".join(RNG.choice(list("abcdefghijklmnop"), 5)) for _ in range(400)]


def prose(n):
    words = RNG.choice(WORDS, n).tolist()
    return "\n".join(" ".join(words[i : i + 12]) for i in range(0, n, 12))


def line_dedup(texts):
    """Windows of three lines, met in order of doc_id; the lines of those met before go."""
    seen, out = set(), {}
    for i in sorted(texts):
        lines = texts[i].split("\n")
        gone = set()
        for at in range(len(lines) - 2):
            window = tuple(lines[at : at + 3])
            if window in seen:
                gone |= {at, at + 1, at + 2}
            seen.add(window)
        out[i] = "\n".join(x for at, x in enumerate(lines) if at not in gone)
    return out


def near_dedup(texts):
    """The least id of each group of texts that links of five-word shingles, Jaccard 0.8 or more, connect."""
    ids = sorted(texts)
    root = {i: i for i in ids}
    words = {i: texts[i].split() for i in ids}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for at, a in enumerate(ids):
        for b in ids[at + 1 :]:
            x, y = sets[a], sets[b]
            if len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: texts[i] for i in ids if find(i) == i}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    bad = ["grackle", "snorkle"]
    texts = {i: prose(60) + (f" {bad[i % 2]} " if i % 4 == 0 else " ") + prose(60) for i in range(400)}
    item = " ".join(RNG.choice(WORDS, 40))
    shared = "\n".join(prose(12) for _ in range(4))
    near = prose(400).split()  # one line each: they get past the line dedup whole
    changed = [*near[:200], "altered", *near[201:]]
    texts |= {500: prose(60) + "\n" + shared, 501: shared + "\n" + prose(70), 510: " ".join(near), 511: " ".join(changed), 512: " ".join(near)}
    texts |= {520: prose(40) + " " + item + " " + prose(40), 530: None, 531: ""}
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, item


def test_pipeline_equals_brute_force(spark, corpus):
    folder, texts, item = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), toxicity.severity_grade())
    toxic = {r["doc_id"] for r in toxicity.score(docs, model).where("toxic").select("doc_id").collect()}
    assert sum((i in toxic) == (i % 4 == 0) for i in range(200, 400)) >= 196 and not toxic & set(range(500, 540))
    left = near_dedup(line_dedup({i: t or "" for i, t in texts.items() if i not in toxic}))
    left = {i: t for i, t in left.items() if item not in " ".join(t.split("\n"))}
    assert {500, 501, 510, 530} <= set(left) and not {511, 512, 520, 531} & set(left)
    library = Tokenizer.from_file(bpe.default_tokenizer())
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in left.items()}
    rows = corpus_pipeline.run(spark, folder).collect()
    got = {r["doc_id"]: r["ids"] for r in rows}
    assert len(rows) == len(got) and got == want and all(r["n_tokens"] == len(r["ids"]) for r in rows)
    assert all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in rows)


def test_stages_on_odd_tables(spark, corpus):
    """Repeated ids, nulls, long texts, and columns whose names the operators use."""
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    odd = docs.where("doc_id < 20").unionByName(docs.where("doc_id < 3")).unionByName(docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.repeat(F.lit("one two three\n"), F.lit(90_000)).alias("text"), "lang", "source", "n_chars"))
    for name in ("leak", "whole", "twin", "place", "root", "line_key", "fp"):
        odd = odd.withColumn(name, F.lit(name))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, corpus[0])
        assert name == "bpe" or out.columns == odd.columns
        assert 0 < out.count() <= odd.count(), name
        assert stage(spark, odd.where("false"), corpus[0]).count() == 0, name


def test_pipeline_of_empty_tables(spark, corpus, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus[0]}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_the_columns(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, corpus[0]).columns == docs.columns, name
