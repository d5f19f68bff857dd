"""Hostile chat records, layouts against SQL, revisit records that resolve, odd tables."""

import pytest
from pyspark.sql import functions as F

from wordloom.llm import chat, queries, warc
from wordloom.llm.common import shared_path


def test_hostile_records(spark):
    deep = "[" * 3_000 + "]" * 3_000
    rows = [
        (1, '{"prompt": "a\\ud800b", "response": "\\ud83d\\ude00"}'), (2, '{"prompt": ' + deep + ', "response": "x"}'), (3, '{"a": ' * 100_000), (4, '{"\\ud800": 1}'),
        (5, '{"messages": []}'), (6, '{"messages": {"role": "user"}}'), (None, '{"role": "user", "text": null}'), (7, ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, record string").withColumn("role", F.lit("x"))
    got = {}
    for r in chat.canonical_turns(df).collect():
        got.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    assert got[1] == [(0, "user", "a\ufffdb"), (1, "assistant", "\U0001f600")]
    assert all(got[i] == [(None, None, None)] for i in (2, 3, 4, 6, 7)) and got[None] == [(0, "user", "")]
    assert chat.canonical_turns(df.where("false")).count() == 0


@pytest.mark.parametrize("name", ["chat_layouts", "op2_chat_format", "op9_warc"])
def test_equals_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("conversations", "pages"):
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = queries.queries()[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(columns).collect()), key=str)
    assert got == sorted(c.execute(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall(), key=str)


def test_revisits_resolve(spark, tmp_path):
    import zlib

    body = "x" * 1_500
    rows = [(1, "http://a/1", body), (2, "http://b/2", body), (3, None, body), (4, "http://c", "y"), (4, "http://c", "y"), (None, "http://n", body), (5, "http://d", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("digest", F.lit("d"))
    path = shared_path(spark, "warc")
    index = warc.write_archives(df, path)
    heads = []
    for r in index.collect():
        with open(f"{path.removeprefix('file:')}/archives/{r['file']}", "rb") as f:
            f.seek(r["offset"])
            heads.append(warc.parse(zlib.decompress(f.read(r["length"]), 31))[0])
    ids = {h["warc-record-id"]: h for h in heads if h["warc-type"] == "response"}
    revisits = [h for h in heads if h["warc-type"] == "revisit"]
    assert len(revisits) == 3
    for h in revisits:
        kept = ids[h["warc-refers-to"]]
        assert (kept["warc-target-uri"], kept["warc-date"], kept["warc-payload-digest"]) == (h["warc-refers-to-target-uri"], h["warc-refers-to-date"], h["warc-payload-digest"])
    assert warc.read_records(index, path).count() == 7
    none = shared_path(spark, "warc")
    assert warc.read_records(warc.write_archives(df.where("false"), none), none).count() == 0


def test_format_odd_tables(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "z"), (None, 0, "assistant", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1)).withColumn("loss", F.lit(1))
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.read_back(chat.format_turns(chat.canonical_rows(df))).collect()}
    assert got == {1: (3, 0), None: (1, 1)}
    assert chat.format_turns(chat.canonical_rows(df.where("false"))).count() == 0
    long = "word " * 500_000
    one = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    r = chat.read_back(chat.format_turns(chat.canonical_rows(one))).first()
    assert (r["n_turns"], r["loss_chars"]) == (2, len(long))
