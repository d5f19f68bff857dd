"""BPE encoding and decoding over a minimal acyclic transducer.

Frequent words of the corpus and their token ids are compiled into a minimal acyclic transducer: a
deterministic automaton in which equal suffixes share their states, and in which the number of words that
sort before a path gives each word its place in the table of id outputs. The automaton is a few flat
arrays in one file. Its bytes, bounded by ``lexicon_words`` and ``lexicon_bytes``, are broadcast; each
worker writes them to a file of its own, maps that file into memory and unlinks it. Words outside the
automaton go through the merges of the tokenizer, exactly.

Results never depend on what the lexicon holds: it only saves merges.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import tempfile
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import col, fresh, whole_text

#: Words of the lexicon, the most frequent ones of all the documents. It bounds the broadcast.
LEXICON_WORDS = 60_000
#: A lexicon word has at most so many bytes, so the automaton has at most LEXICON_WORDS times as many arcs.
LEXICON_BYTES = 48
#: Chunks between white space that a worker remembers with their ids between batches.
REMEMBERED = 600_000
SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Transducer:
    """A minimal acyclic automaton over byte strings, with the ids of each of its words.

    Arrays: ``first[s]:first[s+1]`` are state s's arcs, sorted by label; ``label``, ``target`` and ``skip``
    (the words that sort before the arc's) are by arc, ``final`` by state; ``out`` holds all the ids, word i's
    at ``start[i]:start[i+1]``.
    """

    FIELDS = (("first", np.int32), ("label", np.uint8), ("target", np.int32), ("skip", np.int32), ("final", np.uint8), ("start", np.int32), ("out", "<u4"))

    def __init__(self, buffer):
        sizes = np.frombuffer(buffer, np.int64, len(self.FIELDS))
        at = 8 * len(self.FIELDS)
        for (name, kind), n in zip(self.FIELDS, sizes, strict=True):
            setattr(self, name, np.frombuffer(buffer, kind, int(n), at))
            at += -(-int(n) * np.dtype(kind).itemsize // 8) * 8
        # one key per arc lets a batch of words find its next arcs by binary search
        source = np.repeat(np.arange(len(self.final), dtype=np.int64), np.diff(self.first))
        self.arc = source << 8 | self.label

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> bytes:
        """The automaton's file. Words are added in order; a state is registered, and shared, once no later word can extend it."""
        ordered = sorted(words)
        arcs: list[dict[int, int]] = [{}]
        final = [False]
        registry: dict[tuple, int] = {}
        path: list[tuple[int, int]] = []  # (state, label) on the way to the last word's end
        at, free = 0, []

        def settle(depth: int) -> None:
            nonlocal at
            while len(path) > depth:
                state, label = path.pop()
                child = arcs[state][label]
                shape = (final[child], *arcs[child].items())
                if (known := registry.setdefault(shape, child)) != child:
                    arcs[state][label] = known
                    free.append(child)
                at = state

        last = b""
        for word in ordered:
            shared = len(os.path.commonprefix((word, last)))
            settle(shared)
            at = path[-1] and arcs[path[-1][0]][path[-1][1]] if path else 0
            for label in word[shared:]:
                if free:
                    new = free.pop()
                    arcs[new], final[new] = {}, False
                else:
                    new = len(arcs)
                    arcs.append({})
                    final.append(False)
                arcs[at][label] = new
                path.append((at, label))
                at = new
            final[at] = True
            last = word
        settle(0)

        number, order, stack = {0: 0}, [0], [0]
        while stack:
            for child in arcs[stack.pop()].values():
                if child not in number:
                    number[child] = len(order)
                    order.append(child)
                    stack.append(child)
        below: dict[int, int] = {}
        for top in (0,):  # words below each state, children first
            todo = [top]
            while todo:
                state = todo[-1]
                missing = [c for c in arcs[state].values() if c not in below]
                if missing:
                    todo.extend(missing)
                else:
                    below[todo.pop()] = final[state] + sum(below[c] for c in arcs[state].values())
        first, label, target, skip = [0], [], [], []
        for state in order:
            before = int(final[state])
            for mark, child in sorted(arcs[state].items()):
                label.append(mark)
                target.append(number[child])
                skip.append(before)
                before += below[child]
            first.append(len(label))
        start, out = [0], []
        for word in ordered:
            out.extend(words[word])
            start.append(len(out))
        values = {"first": first, "label": label, "target": target, "skip": skip, "final": [final[s] for s in order], "start": start, "out": out}
        parts = [np.array([len(values[name]) for name, _ in cls.FIELDS], np.int64).tobytes()]
        for name, kind in cls.FIELDS:
            raw = np.array(values[name], kind).tobytes()
            parts.append(raw + bytes(-len(raw) % 8))
        return b"".join(parts)

    @classmethod
    def mapped(cls, blob: bytes) -> Transducer:
        """The automaton in a memory-mapped file of this process. The file has no name left once it is mapped."""
        fd, path = tempfile.mkstemp(prefix="lexicon-")
        try:
            with os.fdopen(fd, "wb") as f:
                f.write(blob)
            with open(path, "rb") as f:
                return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        finally:
            os.unlink(path)

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in the lexicon or -1; all words step through the automaton together."""
        n = len(words)
        place = np.full(n, -1, np.int64)
        if not n or not len(self.arc):
            return place
        lengths = np.fromiter(map(len, words), np.int64, n)
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        text = np.frombuffer(b"".join(words), np.uint8)
        alive, state, count = np.flatnonzero(lengths), np.zeros(n, np.int64), np.zeros(n, np.int64)
        depth = 0
        while len(alive):
            key = state[alive] << 8 | text[begin[alive] + depth]
            hit = np.searchsorted(self.arc, key)
            good = hit < len(self.arc)
            good[good] = self.arc[hit[good]] == key[good]
            alive, hit = alive[good], hit[good]
            state[alive] = self.target[hit]
            count[alive] += self.skip[hit]
            depth += 1
            done = lengths[alive] == depth
            ended = alive[done]
            ended = ended[self.final[state[ended]] == 1]
            place[ended] = count[ended]
            alive = alive[~done]
        return place

    def ids(self, place: int) -> bytes:
        return self.out[self.start[place] : self.start[place + 1]].tobytes()


class Bpe:
    """The tokenizer of a JSON file: NFC, white space to one space, lower case, split, bytes, merges with a word end."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.check(spec)
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_at = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"])
        self.alphabet = byte_alphabet()
        self.table = {b: c for b, c in enumerate(self.alphabet)}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.added.items()]}

    @staticmethod
    def check(spec: dict) -> None:
        """Refuses a tokenizer whose parts are not those built here: its ids would be wrong without a sign."""
        def kinds(part: str, inner: str) -> list[dict]:
            held = spec.get(part) or {}
            return held.get(inner, [held] if held else [])

        normal, before, model = kinds("normalizer", "normalizers"), kinds("pre_tokenizer", "pretokenizers"), spec["model"]
        fits = {
            "normalizer": [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"] and (normal[1]["pattern"], normal[1]["content"]) == ({"Regex": r"\s+"}, " "),
            "pre_tokenizer": [p["type"] for p in before] == ["Split", "ByteLevel"] and (before[0]["behavior"], before[0]["invert"]) == ("Removed", True) and not before[1]["add_prefix_space"] and not before[1].get("use_regex", True),
            "decoder": spec.get("decoder") is None,
            "model": model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")),
            "added_tokens": all("<|" in t["content"] and not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in spec["added_tokens"]),
        }
        if bad := [k for k, ok in fits.items() if not ok]:
            raise ValueError(f"this tokenizer's {', '.join(bad)} cannot be had here")

    @classmethod
    def load(cls, path: str) -> Bpe:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    @staticmethod
    def normal(text: str) -> str:
        """NFC and lower case. The library lowers letter by letter, so a capital sigma never becomes a final one."""
        return (text if text.isascii() else unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")).lower()

    def chunks(self, text: str) -> list[str]:
        """The text between white space; no word crosses it. Separators U+001C to U+001F aren't white space to the tokenizer."""
        text = self.normal(text)
        return regex.split(r"\s+", text) if SEPARATORS.search(text) else text.split()

    def pieces(self, text: str) -> Iterator[list[str] | int]:
        """The chunks between added tokens, and the ids of these."""
        at = 0
        if "<|" in text:
            for m in self.added_at.finditer(text):
                yield self.chunks(text[at : m.start()])
                yield self.added[m[0]]
                at = m.end()
        yield self.chunks(text[at:] if at else text)

    def merge(self, word: bytes) -> list[int]:
        """One word by the merges: the pair of lowest rank first, leftmost of equal ones."""
        parts = [self.alphabet[b] for b in word]
        if not parts:
            return []
        parts[-1] += self.suffix
        ranks = self.ranks
        if len(parts) > 64:
            return self._merge_long(parts)
        get, none = ranks.get, len(ranks)
        rank = [get(p, none) for p in zip(parts, parts[1:])]
        while rank and (best := min(rank)) < none:
            at = rank.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del rank[at]
            if at:
                rank[at - 1] = get((parts[at - 1], parts[at]), none)
            if at < len(rank):
                rank[at] = get((parts[at], parts[at + 1]), none)
        return [self.vocab[p] for p in parts if p in self.vocab]

    def _merge_long(self, parts: list[str]) -> list[int]:
        """The same by a heap and a linked list: n log n for words without bounds."""
        import heapq

        n, ranks = len(parts), self.ranks
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(ranks[p], i, p) for i in range(n - 1) if (p := (parts[i], parts[i + 1])) in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or (parts[i], parts[j]) != pair:
                continue
            parts[i] += parts[j]
            alive[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if b < n and (p := (parts[a], parts[b])) in ranks:
                    heapq.heappush(heap, (ranks[p], a, p))
        return [self.vocab[p] for p, a in zip(parts, alive, strict=True) if a and p in self.vocab]

    def decode(self, ids: Iterable[int]) -> str:
        """What the tokenizer's own decoder gives: it has none, so the tokens joined by a space; unknown ids give nothing."""
        try:
            return " ".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return " ".join([self.tokens[i] for i in ids if i in self.tokens])


class Encoder:
    """Texts to ids in one worker: remembered chunks, then the automaton for a whole batch, then the merges."""

    def __init__(self, bpe: Bpe, blob: bytes | None = None):
        self.bpe, self.known = bpe, {}
        self.lexicon = Transducer.mapped(blob) if blob else None

    def batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers, end to end."""
        bpe = self.bpe
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        split = [list(bpe.pieces(t)) for t in texts]
        unseen: set[str] = set()
        for pieces in split:
            for piece in pieces:
                if type(piece) is list:
                    unseen.update(piece)
        self.learn(list(unseen.difference(known)))
        return [b"".join([b"".join(map(known.__getitem__, p)) if type(p) is list else p.to_bytes(4, "little") for p in pieces]) for pieces in split]

    def learn(self, chunks: list[str]) -> None:
        """Ids of new chunks: their words by the automaton all at once, those it lacks by the merges."""
        bpe, found = self.bpe, [self.bpe.split.findall(c) for c in chunks]
        words = list({w for f in found for w in f})
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        place = self.lexicon.find(raw).tolist() if self.lexicon else [-1] * len(raw)
        ids = {w: self.lexicon.ids(p) if p >= 0 else array("I", bpe.merge(b)).tobytes() for w, b, p in zip(words, raw, place, strict=True)}
        for c, f in zip(chunks, found, strict=True):
            self.known[c] = ids[f[0]] if len(f) == 1 else b"".join([ids[w] for w in f])

    def decode(self, ids: bytes) -> str:
        return self.bpe.decode(np.frombuffer(ids, "<u4").tolist())


#: This worker's encoder and what it belongs to: workers are used again, and so is what they have learnt.
_held: dict[str, Encoder] = {}


def worker_encoder(key: str, spec: str, lexicon: bytes) -> Encoder:
    if key not in _held:
        _held.clear()
        _held[key] = Encoder(Bpe(json.loads(spec)), lexicon)
    return _held[key]


def frequent_words(docs: DataFrame, words: int = LEXICON_WORDS, text: str = "text") -> DataFrame:
    """The most frequent runs of letters of all the documents, lower case; ties go to the smaller word."""
    word = F.explode(F.split(F.lower(whole_text(text)), r"[^\p{L}]+")).alias("word")
    counts = docs.select(word).where((F.length("word") > 0) & (F.octet_length("word") <= LEXICON_BYTES)).groupBy("word").count()
    return counts.orderBy(F.desc("count"), "word").limit(words)


def compile_lexicon(docs: DataFrame, path: str, words: int = LEXICON_WORDS, text: str = "text") -> bytes:
    """The automaton of the corpus's frequent words, as bytes: at most words x LEXICON_BYTES arcs."""
    bpe = Bpe.load(path)
    found = (unicodedata.normalize("NFC", r[0]).lower() for r in frequent_words(docs, words, text).toLocalIterator())
    return Transducer.build({b: bpe.merge(b) for w in found if (b := w.encode()) and bpe.split.fullmatch(w)})


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", lexicon: bytes | None = None, decoded: str | None = None, digests: bool = False) -> DataFrame:
    """Adds each whole text's token ids, and the decoded text if ``decoded`` names a column.

    A null or empty text has no ids and decodes to nothing. Rows, their order within partitions, repeats and
    further columns stay; a column of the name asked for is an error. Words of any length are merged in
    n log n. With ``digests`` the ids and the decoded text are left out and n_tokens, ids_sha256 and
    decoded_sha256 are given: what a query reads, with none of the bulk.
    """
    from pyspark.sql import types as T

    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    shared = spark.sparkContext.broadcast((spec, lexicon if lexicon is not None else compile_lexicon(docs, path, text=text)))
    key = hashlib.sha256(shared.value[0].encode() + shared.value[1]).hexdigest()
    more = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] if digests else [(ids, T.ArrayType(T.IntegerType())), *([(decoded, T.StringType())] if decoded else [])]
    if clash := {c.lower() for c in docs.columns} & {name.lower() for name, _ in more}:
        raise ValueError(f"the documents already have {sorted(clash)}")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(*m) for m in more)])
    keep, held = [c for c in docs.columns if not (digests and c == text)], fresh(docs, "whole")
    if digests:
        schema = T.StructType([f for f in schema.fields if f.name != text])

    def run(batches):
        encoder = worker_encoder(key, *shared.value)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            coded = encoder.batch(texts)
            if digests:
                new = [pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()), pa.array([hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in coded], pa.string())]
            else:
                new = [pa.ListArray.from_arrays(np.cumsum([0, *(len(x) // 4 for x in coded)]).astype(np.int32), pa.array(np.frombuffer(b"".join(coded), "<i4"), pa.int32()))] + ([pa.array([encoder.decode(x) for x in coded], pa.string())] if decoded else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], names=schema.names)

    return docs.select(*map(col, keep), whole_text(text).alias(held)).mapInArrow(run, schema)


def default_tokenizer() -> str:
    """The public vocabulary file the query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded; lengths and digests."""
    from wordloom.llm.common import table, text_batches

    text_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, default_tokenizer(), digests=True)
