"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints are dealt to shards by a block of their bits: two that differ in few bits agree on a block. In a
shard they are sorted by Gray rank, so neighbours share most of their bits. Runs of neighbours become nodes; a
node holds the mask of the bits on which all its members agree and their pattern, runs of nodes become upper
nodes, and a node keeps only the mask bits its parent has not taken out already. A search adds up the differences
on the way down and prunes a node, with all its members, once they exceed the radius.

Documents whose shingles are similar are found exactly: whole sets decide on the links of the index, and prefix
filtering brings the similar pairs whose fingerprints lie further apart.

Links become components by repeated hooking to the least neighbour and shortcutting, all in Spark.
"""

from __future__ import annotations

import math
import struct
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import col, cut, drop, fresh, shared_path, whole_text
from wordloom.llm.warc import file_system

#: Children of a node of the index.
FANOUT = 16
#: Pairs of fingerprint and node that a search holds at once.
FRONTIER = 1 << 18
#: A shard with more fingerprints is dealt again by a block of its remaining bits.
SHARD = 200_000


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of words, lower-case A-Z, split at ASCII white space; the whole sequence if it is shorter."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], seed) for a, b in zip(starts[: len(ends) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """For hashes of several words (n x W): the bits that are set in over half of them, W words.

    Bits are counted in byte lanes, 255 hashes at a time, eight lanes to an addition.
    """
    n, width = hashes.shape
    raw, counts = np.ascontiguousarray(hashes.astype(">u8")).view(np.uint8), np.zeros(64 * width, np.int64)
    for at in range(0, n, 255):
        counts += np.unpackbits(raw[at : at + 255], axis=1).view(np.uint64).sum(0).view(np.uint8)
    return np.packbits(counts * 2 > n).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", words: int = 3, drop_text: bool = False) -> DataFrame:
    """Adds each whole text's 64-bit SimHash as a signed long. Null and empty texts get zero."""
    keep = [c for c in docs.columns if not (drop_text and c == text)]
    schema = T.StructType([*(f for f in docs.schema.fields if f.name in keep), T.StructField(out, T.LongType())])

    def run(batches):
        for batch in batches:
            fps = np.array([majority(shingle_hashes(t, words)[:, None])[0] for t in batch.column(len(keep)).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(fps.view(np.int64))], names=schema.names)

    return docs.select(*map(col, keep), whole_text(text).alias(fresh(docs, "whole"))).mapInArrow(run, schema)


# ---------------------------------------------------------------- the index


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in the Gray sequence: every bit becomes the parity of the bits from it upwards."""
    code = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        code ^= code >> np.uint64(shift)
    return code


def rotated(codes: np.ndarray, bits: int) -> np.ndarray:
    """Codes with the given bits moved to the top, so that the Gray order sorts by what a shard leaves open."""
    return codes if bits == 0 else (codes << np.uint64(bits)) | (codes >> np.uint64(64 - bits))


class GrayIndex:
    """Fingerprints of several words (n x W) in groups; a group is a contiguous run and the root of one tree.

    ``order`` is the Gray order inside each group. ``levels[0]`` are the fingerprints; a node of a higher level has
    FANOUT children of the level below, of one group. Of each node: ``mask`` (bits on which all members agree, less
    what its parent takes out), ``bits`` (their values there), first and last child.
    """

    def __init__(self, codes: np.ndarray, group: np.ndarray, lead: np.ndarray):
        self.order = np.lexsort((gray_rank(lead), group))
        self.codes, self.group = codes[self.order], group[self.order]
        agree, members = [np.full_like(self.codes, ~np.uint64(0))], [self.codes]
        groups, spans = [self.group], []
        while len(members[-1]) > len(np.unique(self.group)):
            g = groups[-1]
            begins = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            within = np.arange(len(g)) - np.repeat(begins, np.diff(np.append(begins, len(g))))
            first = np.flatnonzero(within % FANOUT == 0)
            ones = np.bitwise_and.reduceat(members[-1] | ~agree[-1], first) & np.bitwise_and.reduceat(agree[-1], first)
            zeros = np.bitwise_and.reduceat(~members[-1] & agree[-1], first)
            spans.append((first, np.append(first[1:], len(g))))
            agree.append(ones | zeros)
            members.append(ones)
            groups.append(g[first])
        self.spans, self.groups = spans, groups
        self.bits, self.mask = members, agree
        for level, (a, b) in enumerate(spans):  # residual masks
            parent = np.repeat(np.arange(len(a)), b - a)
            self.mask[level] = agree[level] & ~agree[level + 1][parent]
        self.root_of = np.searchsorted(groups[-1], self.group)
        self.last = [np.arange(len(self.codes))]  # the last fingerprint under each node
        for _, b in spans:
            self.last.append(self.last[-1][b - 1])

    def under(self, labels: np.ndarray) -> list[np.ndarray]:
        """Of every node the label that all its members share, else -1."""
        out = [labels]
        for a, _ in self.spans:
            low, high = np.minimum.reduceat(out[-1], a), np.maximum.reduceat(out[-1], a)
            out.append(np.where(low == high, low, -1))
        return out

    def pairs(self, radius: int, begin: int, end: int, labels: np.ndarray, tight: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j), begin <= i < end and i < j in ``order``, of pairs of one group within the radius.

        With ``tight`` the top 16 bits of the first word may differ in no more than so many. A node all of whose
        members have the label of the one who searches is left out: they are connected.
        """
        top, same = len(self.spans), self.under(labels)
        q = np.arange(begin, end)
        stack = [(top, q, self.root_of[q], np.zeros(len(q), np.int64), np.zeros(len(q), np.int64))]
        while stack:
            level, q, node, acc, lead = stack.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                stack += [(level, q[half:], node[half:], acc[half:], lead[half:]), (level, q[:half], node[:half], acc[:half], lead[:half])]
                continue
            open_ = (self.last[level][node] > q) & (same[level][node] != labels[q])  # each pair is met once, from its earlier end
            q, node, acc, lead = q[open_], node[open_], acc[open_], lead[open_]
            differ = (self.codes[q] ^ self.bits[level][node]) & self.mask[level][node]
            if tight is not None:
                lead = lead + np.bitwise_count(differ[:, 0] >> np.uint64(48))
                near = lead <= tight
                q, node, acc, lead, differ = q[near], node[near], acc[near], lead[near], differ[near]
            acc = acc + np.bitwise_count(differ).sum(1, dtype=np.int64)
            near = acc <= radius
            q, node, acc, lead = q[near], node[near], acc[near], lead[near]
            if not len(q):
                continue
            if level == 0:
                yield q, node
                continue
            a, b = (x[node] for x in self.spans[level - 1])
            size = b - a
            child = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
            stack.append((level - 1, np.repeat(q, size), child, np.repeat(acc, size), np.repeat(lead, size)))


def spanning_links(codes: np.ndarray, group: np.ndarray, lead: np.ndarray, radius: int, tight: int | None = None) -> np.ndarray:
    """Links (n x 2) within the radius inside each group, as many as keep what is linked connected.

    Searches go in rounds of growing size. After each the labels of what has been joined are brought up to date, so
    a large group of near copies is met once and left out from then on, not paired with itself.
    """
    index = GrayIndex(codes, group, lead)
    n = len(codes)
    parent, out, begin, step = np.arange(n), [], 0, 64

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    labels = parent.copy()
    while begin < n:
        end = min(n, begin + step)
        for i, j in index.pairs(radius, begin, end, labels, tight):
            a, b = labels[i], labels[j]
            _, first = np.unique(np.minimum(a, b) * n + np.maximum(a, b), return_index=True)
            for x, y in zip(i[first].tolist(), j[first].tolist(), strict=True):
                r, s = root(x), root(y)
                if r != s:
                    parent[max(r, s)] = min(r, s)
                    out.append((x, y))
        labels = parent[labels]
        while not np.array_equal(labels, further := parent[labels]):
            labels = further
        begin, step = end, min(step * 2, max(1, FRONTIER // FANOUT))
    return index.order[np.array(out, np.int64).reshape(-1, 2)]


def blocked_links(distinct: DataFrame, radius: int = 3, bits: int = 64, name: str = "fp") -> DataFrame:
    """(x, y): links that connect all 64-bit fingerprints (column fp, distinct) within the radius, by a column of longs that names them.

    With radius + 1 blocks of bits, two such fingerprints agree on a block, and meet in its shard. A shard of more
    than SHARD fingerprints is dealt again in the same way by the bits its block leaves: they differ there by at
    most the radius, too. The large shards' keys are few: at most (radius + 1) / SHARD of the fingerprints.
    """
    blocks = radius + 1
    width = bits // blocks

    def key(code, shift, w):
        return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << w) - 1))

    each = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), key(F.col("fp"), b * width, width).alias("k")) for b in range(blocks)]))
    own = list(dict.fromkeys(["fp", name]))
    dealt = distinct.select(*own, each.alias("s")).select(*own, "s.b", "s.k")
    large = [(r["b"], r["k"]) for r in dealt.groupBy("b", "k").count().where(F.col("count") > SHARD).select("b", "k").collect()]
    shards = dealt.select(*own, "b", "k", F.lit(0).alias("s"), F.lit(0).cast("long").alias("m"))
    if large:
        spark = distinct.sparkSession
        keys = F.broadcast(spark.createDataFrame(large, "b int, k long"))
        small = dealt.join(keys, ["b", "k"], "left_anti").select(*own, "b", "k", F.lit(0).alias("s"), F.lit(0).cast("long").alias("m"))
        # the block is brought to the top, so the rest lies below it
        turned = F.when(F.col("b") == blocks - 1, F.col("fp")).otherwise(F.expr(" ".join(["case b", *[f"when {b} then shiftleft(fp, {bits - (b + 1) * width}) | shiftrightunsigned(fp, {(b + 1) * width})" for b in range(blocks - 1)], "end"])))
        finer = (bits - width) // blocks
        again = F.explode(F.array(*[F.struct(F.lit(s + 1).alias("s"), key(turned, s * finer, finer).alias("m")) for s in range(blocks)]))
        split = dealt.join(keys, ["b", "k"], "left_semi").select(*own, "b", "k", again.alias("z")).select(*own, "b", "k", "z.s", "z.m")
        shards = small.unionAll(split)
    # whole shards to a task, many shards a task, in order: a shard is met as one run
    spread = shards.repartition("b", "k", "s", "m").sortWithinPartitions("b", "k", "s", "m")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table):
            fp = table.column("fp").to_numpy().view(np.uint64)
            ident = [table.column(c).to_numpy() for c in ("b", "k", "s", "m")]
            fresh_group = np.append(False, np.any([x[1:] != x[:-1] for x in ident], axis=0))
            group = np.cumsum(fresh_group)
            b = ident[0]
            lead = np.zeros_like(fp)
            for v in np.unique(b).tolist():
                lead[b == v] = rotated(fp[b == v], 64 - v * width)  # the bits below the block first
            x, y = spanning_links(fp[:, None], group, lead, radius).T
            if len(x):
                names = table.column(name).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(names[x]), pa.array(names[y])], names=["x", "y"])

        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < SHARD:
                continue
            table = pa.Table.from_batches(held)
            ident = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("b", "k", "s", "m")])
            changed = np.flatnonzero(np.any(ident[:, 1:] != ident[:, :-1], axis=0))
            if not len(changed):
                continue  # one shard so far: it is bounded
            end = int(changed[-1]) + 1
            yield from flush(table.slice(0, end))
            held = table.slice(end).to_batches()
            size = len(table) - end
        if held:
            yield from flush(pa.Table.from_batches(held))

    return spread.mapInArrow(run, "x long, y long").distinct()


# ---------------------------------------------------------------- exact similarity

#: Texts whose shingles are counted to tell which are common. Any order of shingles finds all pairs; a good one is fast.
SAMPLE_TEXTS = 10_000
#: Common shingles that are put last.
COMMON = 100_000
#: All pairs of a group of so many texts that share a shingle are listed; larger groups are linked in two rounds.
SMALL = 8
#: Shingles that a task holds of the texts it compares.
HELD = 1 << 22
#: Rows that a group of equal sets or fingerprints has at least before they are told apart from the others for a join.
LEAST_LARGE = 256
#: A text's place is its file (the task attempt that wrote it) and the offset there.
OFFSET_BITS = 36
HEAD = "<qI"
HEAD_BYTES = struct.calcsize(HEAD)


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(shingle_hashes(text, words))


def least_shared(size: int, similarity: float) -> int:
    """Shingles that a set shares at least with any set that is similar to it."""
    return math.ceil(similarity * size - 1e-9)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    return _jaccard(a, b) >= similarity - 1e-12


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(both) - shared)


def may_be_similar(n, at, m, where, similarity: float):
    """Whether sets of n and m shingles can be similar if their first shared shingle has these places in the order."""
    rest = np.minimum(n - at, m - where)
    return (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9) & (rest >= similarity / (1 + similarity) * (n + m) - 1e-9)


class Texts:
    """Texts by their places in the shared folder, as (doc_id, shingles); the last ones used are held."""

    def __init__(self, folder: str, words: int):
        self.fs, self.base = file_system(folder)
        self.words, self.held, self.size, self.files = words, OrderedDict(), 0, OrderedDict()
        self.unpack = zstandard.ZstdDecompressor()

    def __getitem__(self, place: int) -> tuple[int, np.ndarray]:
        if place in self.held:
            self.held.move_to_end(place)
            return self.held[place]
        name, offset = place >> OFFSET_BITS, place & ((1 << OFFSET_BITS) - 1)
        if name not in self.files:
            if len(self.files) >= 64:
                self.files.popitem(last=False)[1].close()
            self.files[name] = self.fs.open_input_file(f"{self.base}/{name}")
        self.files.move_to_end(name)
        raw = self.files[name].read_at(1 << 12, offset)
        doc, size = struct.unpack_from(HEAD, raw)
        if len(raw) < HEAD_BYTES + size:
            raw += self.files[name].read_at(HEAD_BYTES + size - len(raw), offset + len(raw))
        text = self.unpack.decompress(raw[HEAD_BYTES : HEAD_BYTES + size]).decode("utf-8", "surrogatepass")
        self.held[place] = doc, shingle_set(text, self.words)
        self.size += len(self.held[place][1])
        while self.size > HELD and len(self.held) > 2:
            self.size -= len(self.held.popitem(last=False)[1][1])
        return self.held[place]


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, sorted, and how often each occurs) of those that occur in three texts of a sample."""
    share = max(1, docs.count() // SAMPLE_TEXTS)

    def run(batches):
        for batch in batches:
            for t in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, words).view(np.int64))], names=["h"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("text")
    counts = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(COMMON).collect()
    h, n = np.array([r["h"] for r in counts], np.int64).view(np.uint64), np.array([r["n"] for r in counts], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def ordered_prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles, rare before common ones, of which a similar set's first ones share one."""
    if not len(shingles):
        return shingles
    h, n = common
    often = np.zeros(len(shingles), np.int64)
    if len(h):
        at = np.minimum(np.searchsorted(h, shingles), len(h) - 1)
        often = np.where(h[at] == shingles, n[at], 0)
    return shingles[np.lexsort((shingles, often))][: len(shingles) - least_shared(len(shingles), similarity) + 1]


def whole_groups(batches, columns: list[str], key: str, least: int) -> Iterator[list[np.ndarray]]:
    """Sorted batches as arrays, in portions that cut no run of equal keys."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < least:
            continue
        t = pa.Table.from_batches(held)
        k = t.column(key).to_numpy()
        changed = np.flatnonzero(k[1:] != k[:-1])
        if len(changed):
            end = int(changed[-1]) + 1
            yield [t.column(c).to_numpy()[:end] for c in columns]
            held, size = t.slice(end).combine_chunks().to_batches(), len(t) - end
        least = max(least, 2 * size)
    if held:
        t = pa.Table.from_batches(held)
        yield [t.column(c).to_numpy() for c in columns]


MET = T.StructType([T.StructField("tok", T.LongType()), *(T.StructField(n, T.LongType()) for n in ("x", "y")), *(T.StructField(n, T.IntegerType()) for n in ("n", "at"))])


def meet(tokens: DataFrame, similarity: float) -> DataFrame:
    """From (tok, place, n, at, label): pairs x, y of places to be compared, and the rows of large groups (x, tok, n, at; y null).

    Of a large group only the pairs with its first member are listed. What has one label is connected, and left out.
    """
    spread = tokens.repartition("tok").sortWithinPartitions("tok", "n", "place")

    def run(batches):
        for tok, place, n, at, label in whole_groups(batches, ["tok", "place", "n", "at", "label"], "tok", 100_000):
            if not len(tok):
                continue
            first = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
            size = np.diff(np.append(first, len(tok)))
            group, n64, at64 = np.repeat(np.arange(len(first)), size), n.astype(np.int64), at.astype(np.int64)
            large = (size > SMALL)[group]
            mixed = (np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first))[group]
            x, y = [], []
            for d in range(1, SMALL):
                i = np.flatnonzero((group[d:] == group[:-d]) & ~large[d:])
                x.append(i)
                y.append(i + d)
            i = np.flatnonzero(large & mixed)
            x.append(first[group[i]])
            y.append(i)
            x, y = np.concatenate(x), np.concatenate(y)
            near = may_be_similar(n64[x], at64[x], n64[y], at64[y], similarity) & (place[x] != place[y]) & (label[x] != label[y])
            a, b = place[x[near]], place[y[near]]
            pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int32()), pa.nulls(len(pairs), pa.int32())], names=MET.names)
            yield pa.RecordBatch.from_arrays([pa.array(tok[i]), pa.array(place[i]), pa.nulls(len(i), pa.int64()), pa.array(n[i]), pa.array(at[i])], names=MET.names)

    return spread.mapInArrow(run, MET)


def compared(pairs: DataFrame, folder: str, words: int, similarity: float) -> DataFrame:
    """(x, y): doc_ids of the pairs of places whose shingles have the similarity."""

    def run(batches):
        texts = Texts(folder, words)
        for batch in batches:
            x, y = [], []
            for a, b in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                (i, s), (j, t) = texts[a], texts[b]
                if jaccard_at_least(s, t, similarity):
                    x.append(i)
                    y.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])

    # a pair costs far more than its bytes tell: the number of tasks is given, not coalesced by size
    dealt = pairs.select("x", "y").repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x", "y")
    return dealt.distinct().sortWithinPartitions("x", "y").mapInArrow(run, "x long, y long")


def group_links(place, n, at, label, texts: Texts, similarity: float, root, join) -> Iterator[tuple[int, int]]:
    """Links (of doc_ids) that connect all similar texts of a group, given by size; those of one label are connected.

    All but the texts of the most frequent label look for similar ones of other labels. Distance, one less the
    similarity, obeys the triangle inequality: two texts can't be similar if their distances to the first one of a
    label are further apart than 1 - similarity.
    """
    values, first, own, count = np.unique(label, return_index=True, return_inverse=True, return_counts=True)
    main, far, known = int(count.argmax()), 1 - similarity + 1e-9, {}

    def distance(x: int, y: int) -> float:
        return 1 - _jaccard(texts[place[x]][1], texts[place[y]][1])

    for o in np.flatnonzero(own != main).tolist():
        c = np.arange(np.searchsorted(n, similarity * n[o] - 1e-6), np.searchsorted(n, n[o] / similarity + 1e-6, "right"))
        c = c[(own[c] != own[o]) & ((own[c] == main) | (c < o))]
        c = c[may_be_similar(n[c], at[c], n[o], at[o], similarity)]
        for v in np.unique(own[c]).tolist():
            if root(int(values[v])) == root(int(label[o])):
                continue
            head = int(first[v])
            apart = distance(head, o)
            for e in c[own[c] == v].tolist():
                if e not in known:
                    known[e] = distance(head, e) if e != head else 0.0
                if abs(apart - known[e]) > far:
                    continue
                (x, s), (y, t) = texts[place[e]], texts[place[o]]
                if jaccard_at_least(s, t, similarity):
                    join(int(values[v]), int(label[o]))
                    yield x, y
                    break


def rest_links(large: DataFrame, folder: str, words: int, similarity: float) -> DataFrame:
    """(x, y): the links in large groups (tok, x, n, at, root) between texts that are not connected yet."""
    spread = large.repartition("tok").sortWithinPartitions("tok", "n", "x")

    def run(batches):
        texts, parent = Texts(folder, words), {}

        def root(x):
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        def join(x, y):
            x, y = sorted((root(x), root(y)))
            parent[y] = x

        for tok, *rest in whole_groups(batches, ["tok", "x", "n", "at", "root"], "tok", 20_000):
            first = np.flatnonzero(np.append(True, tok[1:] != tok[:-1])).tolist()
            out = []
            for a, b in zip(first, [*first[1:], len(tok)], strict=True):
                if (rest[3][a:b] != rest[3][a]).any():
                    out += group_links(rest[0][a:b].tolist(), *(c[a:b].astype(np.int64) for c in rest[1:]), texts, similarity, root, join)
            x, y = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])

    return spread.mapInArrow(run, "x long, y long")


# ---------------------------------------------------------------- components


#: Edges of a node from which it is hot, and at least this share of all: so at most its inverse are; and the parts they are dealt to.
HOT_EDGES, HOT_SHARE, HOT_PARTS = 65_536, 1e-3, 64


def _hooked(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Edges (u, v) with m, what ``least`` (u, m, n) tells of u, which has n edges. A hot node's are dealt to several tasks."""
    hot = [r["u"] for r in least.where(F.col("n") > max(HOT_EDGES, int(HOT_SHARE * total))).select("u").collect()] if total > HOT_EDGES else []
    if not hot:
        return edges.join(least.drop("n"), "u")
    is_hot = F.col("u").isin(hot)
    dealt = edges.withColumn("part", F.when(is_hot, F.pmod(F.xxhash64("v"), F.lit(HOT_PARTS))).otherwise(F.lit(0)).cast("int"))
    told = least.drop("n").withColumn("part", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(told, ["u", "part"]).drop("part")


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, root): the least node of each linked node's component, for links (x, y) of longs.

    Large-star and small-star steps by turns (Kiveris and others, 2014), a written table after each, until nothing
    changes: a number of rounds that grows with the logarithm of the longest chain. Both steps keep only the least of
    a node's neighbours, by a partial aggregate, and tell it to the node's edges by a join, in which hot nodes are split.
    """
    edges = cut(links.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), name)
    before, total = None, edges.count()
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # large-star: every larger neighbour hooks to the least node known here
        large = _hooked(both, least, total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, large = edges, cut(large.where("u <> v").distinct(), name)
        # small-star: smaller neighbours and the node itself hook to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _hooked(large, low, total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small, name)
        drop(old)
        drop(large)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if state == before:
            break
        before, total = state, state["n"]
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


# ---------------------------------------------------------------- operators


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): fingerprint and component of every document.

    Fingerprints link within the radius; component_id is the least doc_id reachable over links. Equal fingerprints
    become one before anything is linked, so copies cost nothing. Null texts count as empty, texts without words
    have fingerprint zero and link like any other. A null doc_id takes part, but never names a component that has
    another; repeated rows give repeated rows.
    """
    fps = cut(fingerprints(docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text")), "text", "fp", words, drop_text=True), "simhash")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    links = blocked_links(least.select("fp"), radius)
    roots = components(links, "simhash-links")
    classes = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps.join(classes.join(named, "root").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def grouped(rows: DataFrame, key: str, count: int) -> DataFrame:
    """(key, doc_id, place, least, kept) of the rows that share their key with others: their group's least doc_id and place.

    Rows of large groups meet their group's one row where they are: groups of over a thousandth of the rows are a
    thousand at most. The others are shuffled.
    """
    groups = cut(rows.groupBy(key).agg(F.min("doc_id").alias("least"), F.min("place").alias("kept"), F.count("*").alias("size")).where("size > 1"), "similar-groups")
    crowds = F.broadcast(groups.where(F.col("size") > max(LEAST_LARGE, count // 1_000)))
    own = rows.select("doc_id", "place", key)
    return own.join(crowds, key).unionByName(own.join(crowds.select(key), key, "left_anti").join(groups, key)).drop("size")


def index_links(rows: DataFrame, folder: str, words: int, similarity: float, radius: int, count: int) -> DataFrame:
    """(x, y): doc_ids of similar texts of the rows (doc_id, place, fp) that the index of their fingerprints links.

    Rows of one fingerprint are linked to the first of them, and these by the Gray-order index; whole sets decide on
    every link. What such a link hid, when it falls, is left to prefix filtering.
    """
    first = cut(rows.groupBy("fp").agg(F.min("place").alias("place")), "similar-fps")
    same = grouped(rows, "fp", count).where("place <> kept").select(F.col("kept").alias("x"), F.col("place").alias("y"))
    return compared(cut(same.unionAll(blocked_links(first, radius, name="place")), "similar-near"), folder, words, similarity)


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """(doc_id, component_id): groups of documents that links of a Jaccard similarity of ``similarity`` or more connect.

    The similarity is that of the sets of shingles. First the SimHash of each set is looked up in the Gray-order index:
    fingerprints within the radius link their texts, if the whole sets are similar. Similar texts may have fingerprints
    further apart, so what these links have not connected is completed and no pair is left out: of two similar sets,
    ordered alike, the first shingles share one (prefix filtering), and pairs that meet there are compared whole. Texts
    are written to the shared folder and fetched by place for that. Equal sets are one node, so copies cost nothing.
    Null and empty texts have no shingles, are equal and form one group. Rows without a doc_id take no part.
    """
    spark = docs.sparkSession
    named = docs.where(col(doc_id).isNotNull()).select(col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    common = spark.sparkContext.broadcast(common_shingles(named, words))
    folder = shared_path(spark, "similar-texts")
    schema = "doc_id long, place long, n int, twin binary, fp long, first array<long>"

    def run(batches):
        fs, base = file_system(folder)
        name, pack, at = TaskContext.get().taskAttemptId(), zstandard.ZstdCompressor(level=1), 0
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            for batch in batches:
                places, sizes, twins, fps, first = [], [], [], [], []
                for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    h, packed = shingle_set(t, words), pack.compress(t.encode("utf-8", "surrogatepass"))
                    out.write(struct.pack(HEAD, d, len(packed)) + packed)
                    places.append(name << OFFSET_BITS | at)
                    at += HEAD_BYTES + len(packed)
                    sizes.append(len(h))
                    twins.append(xxhash.xxh3_128_digest(h.tobytes()))
                    fps.append(majority(h[:, None])[0])
                    first.append(ordered_prefix(h, common.value, similarity).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(places, pa.int64()), pa.array(sizes, pa.int32()), pa.array(twins, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(first, pa.list_(pa.int64()))], names=["doc_id", "place", "n", "twin", "fp", "first"])

    rows = cut(named.mapInArrow(run, schema), "similar-rows")
    count = rows.count()
    copies = grouped(rows, "twin", count).select("doc_id", "least", F.col("place").alias("gone"), "kept")
    copies = cut(copies, "similar-copies")
    single = rows.join(copies.where("gone <> kept").select(F.col("gone").alias("place")), "place", "left_anti")
    links = copies.select(F.col("doc_id").alias("x"), F.col("least").alias("y"))
    links = links.unionAll(index_links(single.select("doc_id", "place", "fp"), folder, words, similarity, radius, count))
    roots = cut(components(links, "similar-roots"), "similar-roots")
    labels = rows.select("place", F.col("doc_id").alias("node")).join(roots, "node").select("place", "root")
    tokens = single.join(labels, "place", "left").select("place", "n", F.coalesce("root", "doc_id").alias("label"), F.posexplode("first").alias("at", "tok"))
    met = cut(meet(tokens.select("tok", "place", "n", "at", "label"), similarity), "similar-met")
    links = roots.select(F.col("node").alias("x"), F.col("root").alias("y"))
    links = cut(links.unionAll(compared(met.where("y is not null"), folder, words, similarity)), "similar-links")
    roots = components(links, "similar-roots")
    large = met.where("y is null").select("tok", "x", "n", "at")
    if not large.isEmpty():
        roots = cut(roots, "similar-roots")
        owner = rows.select(F.col("place").alias("x"), F.col("doc_id").alias("node")).join(roots, "node", "left").select("x", F.coalesce("root", "node").alias("root"))
        rest = rest_links(large.join(owner, "x"), folder, words, similarity)
        roots = components(links.unionAll(rest), "similar-roots")
    return rows.select("doc_id").distinct().join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("component_id"))


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of similar ones, that with the least doc_id. Rows without an id stay; of rows that repeat an id one stays."""
    groups = cut(similar_groups(docs, doc_id, text, words, similarity), "similar-groups")
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(fresh(docs, "gone")))
    kept = docs.join(gone, col(doc_id).cast("long") == F.col(gone.columns[0]), "left_anti")
    named = docs.where(col(doc_id).isNotNull())
    if named.select(F.count("*") > F.count_distinct(col(doc_id))).first()[0]:
        kept = kept.where(col(doc_id).isNotNull()).dropDuplicates([doc_id]).unionByName(kept.where(col(doc_id).isNull()))
    return kept


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: words of three, three differing bits."""
    from wordloom.llm.common import table, text_batches

    text_batches(spark)
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
