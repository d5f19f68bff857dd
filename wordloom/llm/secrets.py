"""Secret scans: fixed patterns, and novelty against a primed zstandard compressor.

Strings in a sensitive context (a word such as key, token or auth shortly before or after them, also on the next
line, and the lines that go on a reported string, as in a key block) are candidates. A candidate's novelty is the
number of bytes it adds to the compressed size of the code around it, with a compressor primed by a dictionary that is
trained on identifiers as code joins them: the dictionary holds their pieces and, as entropy tables, how often
characters stand in them. Words and names, also such as it has never seen, add few bytes a character; random strings
cannot be compressed and are reported. ``NOVELTY`` lies between the two (tests measure both sides).

A text's spans depend on the text alone; ``trained`` makes a dictionary from samples of a corpus for those who want one.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from wordloom.llm.common import col, fresh, whole_text

#: Kinds of spans in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "novel")

# The patterns of the base scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGNED_LEAST = 6

#: Words that make what is near them sensitive.
CONTEXT = re.compile(r"password|passwd|passphrase|secret|token|api[_\x20-]?key|private[_\x20-]?key|access[_\x20-]?key|credential|bearer|authorization|signature|session", re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: A text without any of these holds neither a sensitive word nor an assignment.
CONTEXT_PARTS = ("pass", "secret", "token", "api", "key", "credential", "bearer", "authorization", "signature", "session")
#: A run of 24 hexadecimal digits has 8 in a row among every third character.
HEX_THIRDS = re.compile(r"[0-9a-f]{8}")
#: A candidate starts within so many characters after a sensitive word, or ends within so many before one.
REACH, BACK = 60, 20
#: A candidate at most so far behind a reported one goes on with it.
NEXT = 2
#: So much of the text on either side of the candidate primes the measure.
AROUND = 160
#: Compressed bytes that a candidate adds, for each of its own bytes, from which it is reported.
NOVELTY = 0.76
#: Random strings use many different characters; a candidate has at least so many bits a character.
ENTROPY = 3.0
#: Bytes of a trained dictionary, and the compression level, at which short matches are not preferred to entropy coding.
DICTIONARY, LEVEL = 32_768, 1

IDENTIFIERS = " ".join(
    """
    access_key accessToken account address algorithm allocate api_key append application argument array assert async
    attribute authorization await backend base64 bearer boolean branch browser buffer build bytes cache callback cancel
    certificate channel character checksum class client cluster collection column command comment commit component
    compression config configuration connection const constructor container content context controller cookie count
    create credential current cursor database dataset datetime debug decode default delete dependency deploy description
    destination dictionary directory disable document domain download element email enable encode encrypt endpoint
    environment error event example exception execute export expression extends failure field filename filter finally
    float folder format function generate getenv github global group handler hashlib header hostname http https identifier
    implements import include index initialize input insert instance integer interface internal iterator javascript json
    key keyword kubernetes lambda language length library license listener localhost location logger manager mapping
    memory message metadata method middleware migration module mutable namespace network nullable number object offset
    operation option organization output override package parameter parser partition passphrase passwd password path
    pattern payload permission pipeline placeholder platform plugin policy port position prefix primary private_key
    process production profile property protocol provider proxy public publish python query queue random range readonly
    record redirect reference register release remote replace repository request require reserved resource response
    result return revision rollback router runtime sample schema scope script search secret secret_key section security
    select self sequence serialize server service session settings signature socket source static status storage stream
    string struct subscribe success suffix switch syntax system table target template terminal testing thread timeout
    timestamp token transaction transform trigger type undefined unicode update upload user username utility validate
    value variable vector verify version virtual visible void warning webhook width window worker workspace wrapper write
    """.split()
).encode()


def named(words: list[str], samples: int = 1_500, seed: int = 1) -> list[bytes]:
    """Lines of identifiers as code joins them: snake, kebab, camel and upper case, paths, assignments, prose."""
    draw = random.Random(seed)
    out = []
    for k in range(samples):
        some = [draw.choice(words) for _ in range(draw.randint(4, 16))]
        style = k % 10
        if style < 7:
            out.append(("_", " ", ".", "/", "-", " = ", ": ")[style].join(some))
        elif style == 7:
            out.append("".join(w.capitalize() for w in some))
        elif style == 8:
            out.append("_".join(some).upper())
        else:
            out.append(" ".join(some).capitalize() + ".")
    return [line.encode() for line in out]


def trained(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary with its entropy tables; the samples are the caller's, and bounded."""
    return zstandard.train_dictionary(size, samples, level=3).as_bytes()


@cache
def identifiers() -> bytes:
    return trained(named(IDENTIFIERS.decode().split()))


class Novelty:
    """Marginal compressed bytes. A context is bounded, so a candidate costs the same in any text."""

    def __init__(self, dictionary: bytes | None = None, level: int = LEVEL):
        primed = zstandard.ZstdCompressionDict(dictionary or identifiers())
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)

    def __call__(self, before: str, candidate: str, after: str) -> float:
        around = (before + "\n" + after + "\n").encode("utf-8", "replace")
        own = candidate.encode("utf-8", "replace")
        return (len(self.compressor.compress(around + own)) - len(self.compressor.compress(around))) / len(own)


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def sensitive(text: str) -> bool:
    low = text.lower()
    return any(part in low for part in CONTEXT_PARTS)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, each kind leftmost without overlaps."""
    found = []
    if sensitive(text) and ("=" in text or ":" in text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGNED_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if HEX_THIRDS.search(text[::3]):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, threshold: float = NOVELTY) -> Iterator[tuple[int, int, int]]:
    """Incompressible strings in a sensitive context that overlap no base span, each once, by start."""
    if not sensitive(text):
        return
    words = [m.span() for m in CONTEXT.finditer(text)]
    if not words:
        return
    starts, ends = [a for a, _ in words], [b for _, b in words]
    taken = sorted((a, b) for a, _, b in base)
    reach = list(accumulate((b for _, b in taken), max))
    reported = -NEXT - 1
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        # the last word that ends before the candidate, and the first that starts after it; words do not overlap
        before, after = bisect_right(ends, a) - 1, bisect_left(starts, b)
        near = (before >= 0 and a - ends[before] <= REACH) or (after < len(starts) and starts[after] - b <= BACK) or a - reported <= NEXT
        if not near or entropy(m[0]) < ENTROPY:
            continue
        last = bisect_left(taken, b, key=lambda x: x[0]) - 1
        if last >= 0 and reach[last] > a:
            continue
        if novelty(text[max(0, a - AROUND) : a], m[0], text[b : b + AROUND]) >= threshold:
            reported = b
            yield a, 3, b


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, text: str = "text", out: str = "secrets", threshold: float = NOVELTY, drop_text: bool = False, dictionary: bytes | None = None) -> DataFrame:
    """Adds each whole text's spans: an array of (kind, start, end) in code points, end exclusive, by start and then kind.

    Null and empty texts have no spans. Every row gives one row, repeats too. Scanning is one narrow pass
    without a shuffle; no text is cut, whatever its length. A column named like ``out`` is an error.
    """
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the documents already have {out}")
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    keep = [c for c in docs.columns if not (drop_text and c == text)]
    schema = T.StructType([*(f for f in docs.schema.fields if f.name in keep), T.StructField(out, span)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        novelty = Novelty(dictionary)
        for batch in batches:
            rows = []
            for t in batch.column(len(keep)).to_pylist():
                base = base_spans(t)
                found = sorted([*base, *novel_spans(t, base, novelty, threshold)])
                rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(rows, arrow)], names=schema.names)

    return docs.select(*map(col, keep), whole_text(text).alias(fresh(docs, "whole"))).mapInArrow(run, schema)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document: counts of the base kinds, digest of the base spans, and all the spans."""
    from pyspark.sql import functions as F

    from wordloom.llm.common import table, text_batches

    text_batches(spark)
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), drop_text=True)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"] != "novel")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), count("novel"))
