"""Removal of repeated byte strings by prefix-free parsing.

Parsing. A rolling hash of short windows triggers phrases: the trigger of a start is the leftmost least hash among the
next ``base / 2`` places, so every string holds its trigger in its first half and equal strings hold the same one.
Neighbouring starts with one trigger make a phrase. A string is then a suffix of a phrase's head (the bytes before the
trigger: the dictionary) and the beginning of what follows from the trigger on (the parse).

Pruning. The bytes that all the strings of a phrase share, from the trigger on, are hashed and counted over the
corpus. Met once, they prove all the phrase's strings unique; met with one whole span only, they prove them repeated.

Corpus order. The phrases left, each distinct span once, are dealt by the shared bytes to shards. In a shard the heads
are sorted from the trigger backwards, which puts equal suffixes of the dictionary side by side, and the parse is
sorted by the bytes that follow, with the lengths of common prefixes of neighbours. Both combine into corpus order: by
equal dictionary suffix, then by place in the parse. A start's longest repeat is what it shares with its neighbours in
that order (a range minimum over the parse's common prefixes), so one order answers several lengths.

Hot places. Spans met very often are joined back with salts. Shared bytes met with more than ``CAP`` distinct spans
are not sorted in one task: their strings are hashed and counted one by one, added up before the shuffle.

Only the bit maps of the pruning are broadcast (BITMAP_BITS); a wrong hit costs time, not correctness. Hashes that
decide have 128 bits; the order compares bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import col, cut, fresh, whole_text

#: Bytes of a string that may not occur twice.
LENGTH = 400
#: Bytes of a passage of some fifty words, and the words from which op10 counts one.
PASSAGE, PASSAGE_WORDS = 256, 51
#: Bytes of the rolling hash's window.
ROLL = 16
#: Bytes of text parsed at once; longer texts go through in pieces that overlap by a string.
PIECE = 1 << 20
#: Bits of a bit map for each phrase in it, and at most: 128 MB.
BITS_PER_PHRASE, BITMAP_BITS = 12, 1 << 30
#: Distinct spans of the same shared bytes that are put in order together; beyond, strings are counted one by one.
CAP = 8_192
#: Bytes of spans that a task holds to tell equal ones apart before the shuffle, and that are put in order at once.
HELD, SORTED = 80 << 20, 6 << 20
#: Bytes that a span takes besides its own.
ASIDE = 300
#: Spans that a task hands on at once.
HANDED = 4_096
#: A span is hot if it has more than this share of all phrases: so at most its inverse are.
HOT = 1e-3


def rolling(b: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the ROLL bytes at each place, joined from hashes of powers of two."""
    h = (b.astype(np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    size = 1
    while size < ROLL:
        longer = h[:-size] * np.uint32(pow(0x9E3779B1, size, 1 << 32))
        longer += h[size:]
        h, size = longer, size * 2
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return h


def triggers(b: np.ndarray, reach: int) -> np.ndarray:
    """For each start the place of its trigger: the leftmost least hash of the next ``reach`` places."""
    h = rolling(b)
    n = len(h) - reach + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    keyed = h.astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(keyed) // reach)
    grid = np.full(rows * reach, ~np.uint64(0))
    grid[: len(keyed)] = keyed
    grid = grid.reshape(rows, reach)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).ravel()
    least = np.minimum(right[:n], left[reach - 1 : reach - 1 + n])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def phrases(texts: list[bytes], base: int, depth: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, text's number, text's begin, trigger, first start, last start, span's end), all but the first by phrase, piece by piece.

    Only starts of strings of ``base`` bytes count. A span holds all the strings of ``depth`` bytes of its phrase, less
    what the text has not. Places are places in the bytes; the text's begin may be negative.
    """
    reach = base // 2

    def parse(numbers, begins, parts):
        joined = b"".join(parts)
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes)
        t = triggers(np.frombuffer(joined, np.uint8), reach)
        part = np.repeat(np.arange(len(parts)), sizes)[: len(t)]
        place = np.arange(len(t))
        valid = np.flatnonzero((place + base <= ends[part]) & (place < (ends - sizes)[part] + PIECE))
        if not len(valid):
            return None
        tv, pv = t[valid], part[valid]
        cut_at = np.flatnonzero(np.append(True, (tv[1:] != tv[:-1]) | (valid[1:] != valid[:-1] + 1) | (pv[1:] != pv[:-1])))
        lo, hi = valid[cut_at], valid[np.append(cut_at[1:], len(valid)) - 1]
        p = pv[cut_at]
        return joined, np.array(numbers)[p], (ends - sizes - np.array(begins))[p], tv[cut_at], lo, hi, np.minimum(hi + depth, ends[p])

    numbers, begins, parts, size = [], [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - base + 1), PIECE):
            part = text[at : at + PIECE + depth - 1]
            if len(part) < base:
                continue
            numbers.append(k)
            begins.append(at)
            parts.append(part)
            size += len(part)
            if size >= PIECE:
                if (found := parse(numbers, begins, parts)) is not None:
                    yield found
                numbers, begins, parts, size = [], [], [], 0
    if parts and (found := parse(numbers, begins, parts)) is not None:
        yield found


def _core(joined: bytes, t: np.ndarray, base: int) -> np.ndarray:
    """A hash of the bytes that all strings of a phrase share: from the trigger on."""
    h, size = xxhash.xxh3_64_intdigest, base - base // 2 + 1
    return np.array([h(joined[a : a + size]) for a in t.tolist()], np.uint64).view(np.int64)


def _hash128(joined: bytes, lo, hi) -> np.ndarray:
    h = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([h(joined[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]), "<i8").reshape(-1, 2)


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bit map of the keys (one column of longs), two places each, or-ed together by Spark: at most bits / 64 rows reach the driver."""
    bits, n = 1 << 16, keys.count()
    while bits < min(BITMAP_BITS, BITS_PER_PHRASE * n):
        bits *= 2
    k = F.col(keys.columns[0])
    place = F.explode(F.array(k.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(k, 32).bitwiseAND(F.lit(bits - 1)))).alias("p")
    words = keys.select(place).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out


def _among(bitmap: np.ndarray, core: np.ndarray) -> np.ndarray:
    bits = np.uint64(len(bitmap) * 64 - 1)
    code, words = core.view(np.uint64), bitmap.view(np.uint64)
    out = np.ones(len(core), bool)
    for p in (code & bits, (code >> np.uint64(32)) & bits):
        out &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


# ---------------------------------------------------------------- corpus order


def _rows(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte strings as rows of a matrix, their lengths, and their order: by bytes, then by length."""
    size = np.array([len(p) for p in parts], np.int64)
    flat = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in parts]), np.uint8).reshape(-1, width)
    by_length = np.argsort(size, kind="stable")
    return flat, size, by_length[np.argsort(flat.view(f"S{width}").ravel()[by_length], kind="stable")]


def _common(flat: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each row, in order, with the row before; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 1 << 14):
        a, b = order[at - 1 : at - 1 + (1 << 14)][: len(order) - at], order[at : at + (1 << 14)]
        differ = flat[a] != flat[b]
        first = np.where(differ.any(1), differ.argmax(1), flat.shape[1])
        out[at : at + len(b)] = np.minimum(first, np.minimum(size[a], size[b]))
    return out


class _Least:
    """Least value of ranges, by a table of powers of two."""

    def __init__(self, x: np.ndarray):
        self.levels = [x.astype(np.int32)]
        while 2 << len(self.levels) - 1 <= len(x):
            last, step = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of x[lo:hi], none of them empty."""
        out, level = np.zeros(len(lo), np.int64), np.frexp((hi - lo).astype(float))[1] - 1
        for k in np.unique(level):
            m = np.flatnonzero(level == k)
            table = self.levels[k]
            out[m] = np.minimum(table[lo[m]], table[hi[m] - (1 << k)])
        return out


def longest_repeats(spans: list[bytes], trigger: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(span, start in it, longest repeat in another of the spans), by distinct spans with their trigger's place and number of starts.

    A repeat shares at least what lies from the start to the trigger; it is told up to ``depth`` bytes.
    """
    heads = [s[:t][::-1] for s, t in zip(spans, trigger.tolist(), strict=True)]
    tails = [s[t : t + depth] for s, t in zip(spans, trigger.tolist(), strict=True)]
    # dictionary: heads backwards, so that equal suffixes of heads are neighbours
    flat, size, order = _rows(heads, max(1, int(trigger.max())))
    shared = _common(flat, size, order)
    # parse: what follows the triggers
    flat, size, by_tail = _rows(tails, depth)
    least = _Least(_common(flat, size, by_tail))
    rank = np.empty(len(spans), np.int64)
    rank[by_tail] = np.arange(len(spans))
    which, back, key = [], [], []
    near = (trigger - starts + 1)[order]
    far = trigger[order]
    place = np.arange(len(spans))
    for a in range(int(near.min()), int(far.max()) + 1):
        here = np.flatnonzero((near <= a) & (a <= far))
        if len(here):
            # spans whose heads end in the same a bytes: a class, named by its first place
            name = np.maximum.accumulate(np.where(shared >= a, 0, place)) if a else np.zeros(len(spans), np.int64)
            which.append(order[here])
            back.append(np.full(len(here), a))
            key.append((name[here] + a * len(spans)) << 32 | rank[order[here]])
    which, back, key = map(np.concatenate, (which, back, key))
    corpus = np.argsort(key, kind="stable")
    which, back, key = which[corpus], back[corpus], key[corpus]
    repeat = np.zeros(len(key), np.int64)
    i = np.flatnonzero(key[1:] >> 32 == key[:-1] >> 32)
    if len(i):
        shares = np.minimum(depth, back[i] + least(rank[which[i]] + 1, rank[which[i + 1]] + 1))
        np.maximum.at(repeat, i, shares)
        np.maximum.at(repeat, i + 1, shares)
    return which, trigger[which] - back, repeat


def _covered(span: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(span, from, to): bytes that strings of a length cover, joined where they overlap or touch."""
    order = np.lexsort((start, span))
    span, start = span[order], start[order]
    new = np.append(True, (span[1:] != span[:-1]) | (start[1:] > start[:-1] + length))[: len(span)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(span))[: len(first)] - 1
    return span[first], start[first], start[last] + length


SPAN = "core long, s1 long, s2 long, trigger int, starts int, bytes binary, n long"
FOUND = "s1 long, s2 long, length int, lo long, hi long, n long"


def _ordered(batches, levels: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """FOUND rows of SPAN rows that come sorted by core: cores are put in order together, as many as SORTED bytes hold."""
    depth = max(levels)

    def put(rows: pa.Table) -> pa.RecordBatch:
        s = np.column_stack([rows.column(c).to_numpy() for c in ("s1", "s2")])
        names, first, own = np.unique(s, axis=0, return_index=True, return_inverse=True)
        n = np.bincount(own.ravel(), rows.column("n").to_numpy()).astype(np.int64)
        picked = rows.take(pa.array(first))
        spans, trigger, starts = picked.column("bytes").to_pylist(), *(picked.column(c).to_numpy().astype(np.int64) for c in ("trigger", "starts"))
        which, start, repeat = longest_repeats(spans, trigger, starts, depth)
        left = np.array([len(x) for x in spans])[which] - start
        repeat = np.where(n[which] > 1, np.minimum(left, depth), repeat)
        out = []
        for length in levels:
            m = repeat >= length
            x, lo, hi = _covered(which[m], start[m], length)
            out.append(np.column_stack((names[x], np.full(len(x), length), lo, hi, n[x])))
        out = np.concatenate(out)
        return pa.RecordBatch.from_arrays([pa.array(out[:, k].astype(np.int32) if k == 2 else out[:, k]) for k in range(6)], names=["s1", "s2", "length", "lo", "hi", "n"])

    def weight(batch: pa.RecordBatch) -> int:
        return batch.column("bytes").nbytes + ASIDE * len(batch)

    held, size = [], 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += weight(batch)
        if size >= SORTED:
            rows = pa.Table.from_batches(held)
            core = rows.column("core").to_numpy()
            whole = int(np.flatnonzero(core != core[-1])[-1]) + 1 if core[0] != core[-1] else 0
            if whole:
                yield put(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
                size = sum(map(weight, held))
    if held:
        yield put(pa.Table.from_batches(held))


def repeated_runs(docs: DataFrame, levels: tuple[int, ...] = (LENGTH,), cap: int = CAP) -> DataFrame:
    """(d, h, length, lo, hi): bytes covered by repeated strings of each length, for documents (d, h, text) with text never null."""
    spark = docs.sparkSession
    base, depth = min(levels), max(levels)

    def each(batches):
        """Phrases of whole batches, with the numbers of their documents."""
        for batch in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            d, h = (batch.column(c).to_numpy() for c in ("d", "h"))
            for joined, number, *rest in phrases(texts, base, depth):
                yield joined, d[number], h[number], *rest

    def count(batches):
        for joined, _, _, _, t, lo, _, end in each(batches):
            span = _hash128(joined, lo, end)
            yield pa.RecordBatch.from_arrays([pa.array(_core(joined, t, base)), pa.array(span[:, 0]), pa.array(span[:, 1]), pa.array(end - lo)], names=["core", "s1", "s2", "size"])

    counted = docs.mapInArrow(count, "core long, s1 long, s2 long, size long")
    ends = [f(c).alias(f"{n}_{c}") for c in ("s1", "s2") for f, n in ((F.min, "low"), (F.max, "high"))]
    mixed = (F.col("low_s1") != F.col("high_s1")) | (F.col("low_s2") != F.col("high_s2"))
    repeated = counted.groupBy("core").agg(F.count("*").alias("n"), *ends, F.max("size").alias("size")).where("n > 1")
    repeated = cut(repeated.select("core", "n", "size", mixed.alias("mixed"), F.col("low_s1").alias("s1"), F.col("low_s2").alias("s2")), "phrases")
    # one by one: a worker loads only the bit map that its step reads
    twice_met, mixed_met = (spark.sparkContext.broadcast(_bitmap(x.select("core"))) for x in (repeated, repeated.where("mixed")))

    def spans(batches):
        """Distinct spans of shared bytes met with several, a row for each that a task holds."""
        held: dict[bytes, list] = {}
        size = 0

        def rows():
            for part in batched(held.items(), HANDED):
                cores, names, places, counts, sizes, texts = zip(*[(c, k, a, n, b, x) for k, (n, c, a, b, x) in part], strict=True)
                name = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(cores, pa.int64()), pa.array(name[:, 0]), pa.array(name[:, 1]), pa.array(places, pa.int32()), pa.array(sizes, pa.int32()), pa.array(texts, pa.binary()), pa.array(counts, pa.int64())], names=["core", "s1", "s2", "trigger", "starts", "bytes", "n"])

        for joined, _, _, _, t, lo, hi, end in each(batches):
            core = _core(joined, t, base)
            m = np.flatnonzero(_among(mixed_met.value, core))
            for c, a, x, y, z in zip(core[m].tolist(), t[m].tolist(), lo[m].tolist(), hi[m].tolist(), end[m].tolist(), strict=True):
                own = joined[x:z]
                k = xxhash.xxh3_128_digest(own)
                if k in held:
                    held[k][0] += 1
                else:
                    held[k] = [1, c, a - x, y - x + 1, own]
                    size += z - x + ASIDE
            if size >= HELD:
                yield from rows()
                held.clear()
                size = 0
        yield from rows()

    several = cut(docs.mapInArrow(spans, SPAN), "spans")
    hot = several.groupBy("core").agg(F.count("*").alias("spans")).where(F.col("spans") > cap).select("core")
    # a few bytes make much work here: with a number of partitions given they are not coalesced by their size
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = several.join(hot, "core", "left_anti").repartition(tasks, "core").sortWithinPartitions("core")
    whole = repeated.where(~F.col("mixed")).select("s1", "s2", F.explode(F.array(*[F.lit(x).cast("int") for x in levels])).alias("length"), F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi"), "n").where("hi >= length")
    ordered = sizes.mapInArrow(lambda batches: _ordered(batches, levels), FOUND)

    def strings(batches):
        """Every string of hot shared bytes by its hash."""
        for batch in batches:
            for s1, s2, starts, own, n in zip(*(batch.column(c).to_pylist() for c in ("s1", "s2", "starts", "bytes", "n")), strict=True):
                for length in levels:
                    lo = np.arange(min(starts, len(own) - length + 1))
                    if len(lo):
                        u = _hash128(own, lo, lo + length)
                        yield pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1]), pa.array(np.full(len(lo), s1)), pa.array(np.full(len(lo), s2)), pa.array(np.full(len(lo), length, np.int32)), pa.array(lo), pa.array(np.full(len(lo), n))], names=["u1", "u2", "s1", "s2", "length", "lo", "n"])

    single = several.join(hot, "core", "left_semi").repartition(tasks, "core", "s1", "s2").mapInArrow(strings, "u1 long, u2 long, s1 long, s2 long, length int, lo long, n long")
    salt = F.pmod(F.xxhash64("s1", "s2"), F.lit(16)).alias("salt")
    twice = single.groupBy("u1", "u2").agg(F.sum("n").alias("m")).where("m > 1").select("u1", "u2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("salt"))
    one = single.select("*", salt).join(twice, ["u1", "u2", "salt"]).groupBy("s1", "s2", "length", "lo").agg(F.sum("n").alias("n"))
    single = one.select("s1", "s2", "length", "lo", (F.col("lo") + F.col("length")).alias("hi"), "n")
    found = cut(whole.unionByName(ordered).unionByName(single), "found")

    total = found.agg(F.max("n")).first()[0] or 0
    every = repeated.agg(F.sum("n")).first()[0] or 0
    split = max(4_096, int(every * HOT))
    hot_spans = {(r["s1"], r["s2"]): -(-r["n"] // split) for r in found.where(F.col("n") > split).select("s1", "s2", "n").distinct().collect()} if total > split else {}
    salts = spark.sparkContext.broadcast(hot_spans)

    def occurrences(batches):
        for joined, d, h, begin, t, lo, _, end in each(batches):
            m = np.flatnonzero(_among(twice_met.value, _core(joined, t, base)))
            span = _hash128(joined, lo[m], end[m])
            salt = np.zeros(len(m), np.int32)
            if salts.value:
                for k, key in enumerate(zip(span[:, 0].tolist(), span[:, 1].tolist(), strict=True)):
                    if key in salts.value:
                        salt[k] = int(d[m[k]] ^ h[m[k]]) % salts.value[key]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d[m], h[m], span[:, 0], span[:, 1], salt, lo[m] - begin[m])], names=["d", "h", "s1", "s2", "salt", "at"])

    dealt = found.select("s1", "s2", "length", "lo", "hi", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.when(F.col("n") > split, F.ceil(F.col("n") / split) - 1).otherwise(0)).cast("int"))).alias("salt"))
    met = docs.mapInArrow(occurrences, "d long, h long, s1 long, s2 long, salt int, at long").join(dealt, ["s1", "s2", "salt"])
    return met.select("d", "h", "length", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, spans: str = "removed", shorter: int | None = None, passages: str = "passages", cap: int = CAP) -> DataFrame:
    """Adds the byte ranges (start, end) of each whole text that strings of ``length`` bytes met twice cover, merged and in order.

    Texts are UTF-8 bytes; null counts as empty; strings never cross documents; all occurrences count, the first
    too. Texts shorter than ``length`` have none. Rows that repeat, doc_id and text, are occurrences of each other
    and lose all that fits a string. A clashing name is an error. With ``shorter`` the ranges of shorter strings
    are told from the same order in a further column.
    """
    levels = (length,) if shorter is None else (length, shorter)
    told = [spans] if shorter is None else [spans, passages]
    for name in told:
        if name.lower() in {c.lower() for c in docs.columns}:
            raise ValueError(f"the documents already have {name}")
    d, h, r = (fresh(docs, name) for name in ("key_id", "key_text", "runs"))
    keyed = docs.withColumn(d, F.coalesce(col(doc_id).cast("long"), F.lit(-(1 << 63)))).withColumn(h, F.xxhash64(whole_text(text), col(doc_id).isNull()))
    runs = repeated_runs(keyed.select(F.col(d).alias("d"), F.col(h).alias("h"), whole_text(text).alias("text")).where(F.octet_length("text") >= min(levels)), levels, cap)
    # a document's runs come to one row: no more than its own bytes
    own = runs.groupBy(F.col("d").alias(d), F.col("h").alias(h)).agg(F.collect_list(F.struct("length", "lo", "hi")).alias(r))
    joined = keyed.join(own, [d, h], "left")
    ranges = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(name, ranges) for name in told)])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    keep = docs.columns

    def merge(batches):
        for batch in batches:
            runs = batch.column(len(keep))
            values, offsets = runs.values, runs.offsets.to_numpy()
            size, lo, hi = (values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            out = [[] for _ in levels]
            for i in range(len(batch)):
                a, b = offsets[i], offsets[i + 1]
                for k, level in enumerate(levels):
                    m = a + np.flatnonzero(size[a:b] == level) if b > a and runs[i].is_valid else []
                    out[k].append([{"start": x, "end": y} for x, y in merged(lo[m], hi[m])] if len(m) else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(o, arrow) for o in out)], names=schema.names)

    return joined.select(*map(col, keep), F.col(r)).mapInArrow(merge, schema)


def merged(lo: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges joined where they overlap or touch, in order."""
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.append(True, lo[1:] > end[:-1]))
    return zip(lo[first].tolist(), end[np.append(first[1:], len(lo)) - 1].tolist(), strict=True)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated strings: counts and the digest of what is kept.

    After the contract's columns: the bytes kept, and the repeated passages of over fifty words. These are told, not
    removed: many are shorter than the strings that may not occur twice.
    """
    from wordloom.llm.common import table, text_batches

    text_batches(spark)
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), shorter=PASSAGE)

    def digest(batches):
        for batch in batches:
            rows = []
            for t, spans, passages in zip(*(batch.column(c).to_pylist() for c in ("text", "removed", "passages")), strict=True):
                raw, at, kept = (t or "").encode("utf-8", "surrogatepass"), 0, hashlib.sha256()
                for s in spans:
                    kept.update(raw[at : s["start"]])
                    at = s["end"]
                kept.update(raw[at:])
                removed = sum(s["end"] - s["start"] for s in spans)
                long = sum(len(raw[s["start"] : s["end"]].split()) >= PASSAGE_WORDS for s in passages)
                rows.append((len(raw), removed, len(spans), kept.hexdigest(), len(raw) - removed, long))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", "n_passages"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], pa.string() if k == 3 else pa.int64()) for k in range(6))], names=names)

    return done.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long, n_passages long")
