"""Secret scans: base spans against a scanner written by hand, novelty on planted strings and on names, odd tables."""

import hashlib
import random
import string

import pytest
from pyspark.sql import functions as F

from wordloom.llm import secrets

LOWER, DIGIT = string.ascii_lowercase, string.digits
VALUE = set(string.ascii_letters + DIGIT + "+/_.=-")
KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey")


def brute(text):
    """(start, kind, end) by walking through the text."""
    low = "".join(c.lower() if c in string.ascii_uppercase else c for c in text)
    found, at = [], 0
    while at < len(text):  # assignments
        end = None
        for key in KEYS:
            if low.startswith(key, at):
                i = at + len(key)
                for quoted in (1, 0):
                    if quoted and not (i < len(text) and text[i] in "\"'"):
                        continue
                    j = i + quoted
                    while j < len(text) and text[j] == " ":
                        j += 1
                    if j >= len(text) or text[j] not in ":=":
                        continue
                    j += 1
                    while j < len(text) and text[j] == " ":
                        j += 1
                    if j < len(text) and text[j] in "\"'":
                        j += 1
                    k = j
                    while k < len(text) and text[k] in VALUE:
                        k += 1
                    if k > j:
                        end = (j, k)
                        break
                if end:
                    break
        if end:
            if end[1] - end[0] >= 6:
                found.append((at, 0, end[1]))
            at = end[1]
        else:
            at += 1
    at = text.find("AKIA")
    while at >= 0:
        k = at + 4
        while k < len(text) and text[k] in string.ascii_uppercase + DIGIT:
            k += 1
        if k - at >= 20:
            found.append((at, 1, k))
        at = text.find("AKIA", max(k, at + 1))
    at = 0
    while at < len(text):
        k = at
        while k < len(text) and text[k] in "0123456789abcdef":
            k += 1
        if k - at >= 24:
            found.append((at, 2, k))
        at = k + 1
    return sorted(found)


def test_base_spans_equal_the_walk():
    draw = random.Random(3)
    pieces = ["password", "PassWd", "api_key", "APIKEY", "token", "secret", "=", ":", " ", "  ", '"', "'", "\n", "AKIA", "A1B2C3D4E5F6G7H8", "deadbeef" * 3, "0123456789abcdef0123456", "x", "ab.c/d=", "é", "ſecret", "\tq", "K9"]
    for _ in range(4_000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(0, 14)))
        assert secrets.base_spans(text) == brute(text), text


def test_query_equals_the_walk(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in secrets.op4_secret_scan(spark, folder).collect()}
    for i, text in duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet'").fetchall():
        spans = brute(text or "")
        kinds = [k for _, k, _ in spans]
        told = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(kinds.count(k) for k in range(3))
        assert got[i]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [s for s in got[i]["spans"].split(",") if s and not s.startswith("novel")] == [s for s in told.split(",") if s]


NAMES = """internationalization_of_microservices /usr/share/zoneinfo/Antarctica/McMurdo Donaudampfschifffahrtsgesellschaft
getUserAccountPreferences application/x-www-form-urlencoded com/example/project/services/impl the_quick_brown_fox_jumps
src/main/java/org/apache/commons antidisestablishmentarianism MAX_CONNECTION_POOL_SIZE ThreadPoolExecutorService
previously-unpublished-manuscripts kubernetes-ingress-controller DEFAULT_TIMEOUT_SECONDS listOfAllRegisteredUsers
wohnungsbaugenossenschaft responsabilidades_compartidas documentation/getting-started""".split()
PLACES = ("def login(user):\n    # bearer {} here\n    return connect(user)\n", "The credential was {} until last week, said the report.", "authorization\n  {}\nnext line of the file", "{} is the session of this user")


def test_novelty_parts_random_strings_from_names():
    draw, novelty = random.Random(9), secrets.Novelty()
    alphabets = (string.ascii_letters + DIGIT, string.ascii_letters + DIGIT + "+/", LOWER + DIGIT, string.ascii_uppercase + DIGIT)
    planted = ["".join(draw.choice(a) for _ in range(n)) for a in alphabets for n in (20, 24, 32, 40, 64) for _ in range(5)]

    def reported(s):
        return sum(any(k == 3 and place.format(s)[a:b] == s for a, k, b in secrets.novel_spans(place.format(s), [], novelty)) for place in PLACES)

    hits, false = sum(map(reported, planted)), sum(map(reported, NAMES))
    assert hits >= 0.95 * len(planted) * len(PLACES)
    assert false <= 0.05 * len(NAMES) * len(PLACES)
    assert hits / (hits + false) >= 0.98


def test_key_block_and_context():
    draw, novelty = random.Random(4), secrets.Novelty()
    lines = ["".join(draw.choice(string.ascii_letters + DIGIT + "+/") for _ in range(64)) for _ in range(4)]
    block = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(lines) + "\n-----END PRIVATE KEY-----\n"
    assert [block[a:b] for a, _, b in secrets.novel_spans(block, [], novelty)] == lines
    far = "token" + " word" * 20 + " " + lines[0]
    assert not list(secrets.novel_spans(far, [], novelty))
    many = " ".join(f"token={lines[0][:12]}{k:03d}" for k in range(40)) + " token " + lines[1]
    base = secrets.base_spans(many)
    assert len(base) == 40 and [many[a:b] for a, _, b in secrets.novel_spans(many, base, novelty)] == [lines[1]]


def test_odd_tables(spark):
    long = "x " * 700_000 + "password=hunter22 " + "deadbeef" * 3
    rows = [(1, long), (1, long), (None, "token: abcdef"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("whole", F.lit(1)).withColumn("kind", F.lit("k"))
    got = sorted(((r["doc_id"] or 0, r["kind"], [tuple(s) for s in r["secrets"]]) for r in secrets.scan(df).collect()), key=str)
    one = [("assign", 1_400_000, 1_400_017), ("hex", 1_400_018, 1_400_042)]
    assert got == [(0, "k", [("assign", 0, 13)]), (1, "k", one), (1, "k", one), (2, "k", []), (3, "k", [])]
    assert secrets.scan(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="secrets"):
        secrets.scan(df.withColumn("Secrets", F.lit(1)))
