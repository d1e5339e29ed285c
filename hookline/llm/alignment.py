"""Alignment of two tokenizers by inverted pair bitmaps.

Each text, with a space before it, is encoded by a byte-level BPE (A) and by a
sentencepiece model (B).  Byte offsets where a token of A and one of B both end cut
the tokens into groups; every A-B pair of token occurrences of a group is a link.

The index is inverted: documents are numbered within chunks, and a chunk holds, for
each pair of ids linked in it, a bitmap of its documents and, for documents that link
the pair more than once, planes with the bits of the multiplicity less one.  Bitmaps
are kept as their nonzero 64-bit words, sorted by (pair, plane, place).  Bitmaps of
the batches of a task are OR-merged into the chunk's.  Popcounts of the document
bitmaps, summed over chunks, are the pairs' document counts; those of the planes,
times their weights, the link counts (`pair_table`).  The postings of a chunk then
return the scores of its documents (`document_scores`): no link is expanded into rows.

Both encoders split at blanks: no token of either runs from a character that is no
white space into a following blank (checked for B's pieces when the model is loaded),
so texts are cut there into units, and a unit is encoded and aligned once for all its
occurrences while it stays in a task's bounded memory.

Edge cases: a null or empty text, or one that B does not give back byte for byte, has
no tokens: zeros and an empty group string; rows that repeat a doc_id are documents of
their own; a null doc_id is kept; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hookline.llm import common as C
from hookline.llm.packing import Encoder

#: Documents of a chunk, at most; links (distinct per document) that close one early.
CHUNK_DOCS = 4096
CHUNK_LINKS = 6_000_000
#: Units that a task remembers, and their characters.
KNOWN_UNITS = 250_000
KNOWN_CHARACTERS = 20_000_000
#: Units that are encoded together.
JOINED_UNITS = 1 << 13
#: Pairs of occurrences of a group beyond which ids are counted before they are paired.
LARGE_GROUP = 1 << 12

INDEX_SCHEMA = (
    "chunk long, number int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "pairs binary, spots binary, words binary"
)
_INDEX_TYPE = pa.schema([
    ("chunk", pa.int64()), ("number", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()),
    ("pairs", pa.binary()), ("spots", pa.binary()), ("words", pa.binary()),
])
SCORE_SCHEMA = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
)

# A blank after a character that is surely no white space to either encoder.
_CUT = re.compile(r"(?<=[^\s\x00-\x20᠎​-‏⁠﻿])(?= )")

_MARKS = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")

_PAIRS: dict[tuple[str, str], TokenizerPair] = {}


class TokenizerPair:
    """Both encoders and the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = Encoder(path_a)
        self.a.whole.encode_special_tokens = True  # special strings in texts are plain text
        plain = _byte_of_character()
        entries = self.a.whole.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(map(plain.__getitem__, entry)) if all(c in plain for c in entry) else entry.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.blank = [self.b.piece_to_id("▁")]
        self.by_units = not any(re.search("[^▁]▁", p) for p in pieces)
        # An id as it is shown before another of its group, and as the last of its side.
        shown = [f"{i}{mark}" for size, marks in ((len(self.bytes_a), ",|"), (len(pieces), ",;"))
                 for mark in marks for i in range(size)]
        self.shown, self.shown_length = np.array(shown, object), np.fromiter(map(len, shown), np.int64, len(shown))

    def units(self, text: str) -> list[str]:
        """`text` with a space before it, cut where neither encoder joins."""
        return _CUT.split(" " + text) if self.by_units else [" " + text]

    def ids_b(self, units: list[str]) -> list[list[int]]:
        """Ids of units, whose first space B puts there by itself (not for an empty text)."""
        found = self.b.encode([u[1:] for u in units], num_threads=1)
        return [self.blank if u == " " else ids for u, ids in zip(units, found)]

    def ids_a(self, units: list[str]) -> list[int]:
        """Ids of units, one after the other."""
        if self.a.fast is None:
            return [i for u in units for i in self.a.whole.encode(u, add_special_tokens=False).ids]
        # A unit that ends in white space could run on into the next one.
        ends = np.flatnonzero([not (u[-1].isalnum() or u[-1] in _MARKS) for u in units]) + 1
        cuts = sorted({*ends.tolist(), *range(0, len(units), JOINED_UNITS), len(units)})
        return [i for a, b in zip(cuts, cuts[1:]) for i in self.a.fast.encode_ordinary("".join(units[a:b]))]

    def align(self, units: list[str]) -> Aligned:
        """Alignment of units, all at once."""
        raws = [u.encode() for u in units]
        of_b = self.ids_b(units)
        same, raw = [True] * len(units), b"".join(raws)
        if b"".join([self.bytes_b[i] for ids in of_b for i in ids]) != raw:
            # Where B gives other bytes back, the text has no tokens.
            same = [b"".join(map(self.bytes_b.__getitem__, ids)) == raw for ids, raw in zip(of_b, raws)]
            raw = b"".join([raw for raw, ok in zip(raws, same) if ok])
        good = np.flatnonzero(same)
        a = np.array(self.ids_a([units[k] for k in good]), np.int64)
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != raw:
            raise ValueError("the byte-level encoder lost bytes")
        b = np.array([i for ids, ok in zip(of_b, same) if ok for i in ids], np.int64)
        ends_a, ends_b = (np.cumsum(t[i]) for t, i in zip(self._lengths(), (a, b)))
        in_a, in_b = np.zeros((2, len(raw) + 1), bool)
        in_a[ends_a], in_b[ends_b] = True, True
        both = in_a & in_b
        group_end = np.flatnonzero(both)
        last_a, last_b = both[ends_a], both[ends_b]
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        unit_end = np.cumsum([len(raws[k]) for k in good]) if len(good) else np.zeros(0, np.int64)
        unit_of = np.searchsorted(unit_end, group_end, "left")
        links = _links(a, b, group_a, group_b, len(group_end))

        def per_unit(of: np.ndarray, weight=None) -> np.ndarray:
            out = np.zeros(len(units), np.int64)
            out[good] = np.bincount(of, weight, len(good)).astype(np.int64)
            return out

        group, left, right, times = links
        sizes = np.stack([per_unit(unit_of[group_a]), per_unit(unit_of[group_b]), per_unit(unit_of),
                          per_unit(unit_of[group], times)], axis=1)
        # Group by group: the ids of A, then those of B.
        n = len(self.bytes_a)
        at = np.concatenate([a + n * last_a, 2 * n + b + len(self.bytes_b) * last_b])
        order = np.lexsort([np.repeat([0, 1], [len(a), len(b)]), np.concatenate([group_a, group_b])])
        at, of = at[order], unit_of[np.concatenate([group_a, group_b])[order]]
        text = "".join(self.shown[at])
        ends = np.cumsum(per_unit(of, self.shown_length[at])).tolist()
        shown = [text[i : j - 1] if ok else None for i, j, ok in zip([0, *ends], ends, same)]
        return Aligned(sizes, shown, left << 32 | right, times, per_unit(unit_of[group]))

    def _lengths(self):
        return [np.fromiter(map(len, t), np.int64, len(t)) for t in (self.bytes_a, self.bytes_b)]


class Aligned(NamedTuple):
    """Of units: tokens of A, of B, groups and links (a row each), group strings (None
    where bytes differ), the pairs linked in them, how often, and how many pairs of each."""

    sizes: np.ndarray
    shown: list[str | None]
    pairs: np.ndarray
    times: np.ndarray
    n_pairs: np.ndarray


def _links(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n: int):
    """(group, id of A, id of B, how often) of all links, in the order of the groups."""
    n_a, n_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    start_a, start_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    large = n_a * n_b > LARGE_GROUP
    reps = np.where(large, 0, n_b)[group_a]
    place = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    group = np.repeat(group_a, reps)
    out = [group, np.repeat(a, reps), b[start_b[group] + place], np.ones(len(group), np.int64)]
    for g in np.flatnonzero(large):  # ids are counted before they are paired
        x, m = np.unique(a[start_a[g] : start_a[g] + n_a[g]], return_counts=True)
        y, k = np.unique(b[start_b[g] : start_b[g] + n_b[g]], return_counts=True)
        many = [np.full(len(x) * len(y), g), np.repeat(x, len(y)), np.tile(y, len(x)), np.outer(m, k).ravel()]
        out = [np.concatenate(v) for v in zip(out, many)]
    if large.any():
        order = np.argsort(out[0], kind="stable")
        out = [v[order] for v in out]
    return out


def _byte_of_character() -> dict[str, int]:
    """Printable characters that byte-level vocabularies write for bytes: bytes that
    are printable Latin-1 stand for themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def tokenizer_pair(path_a: str, path_b: str) -> TokenizerPair:
    key = path_a, path_b
    if key not in _PAIRS:
        _PAIRS[key] = TokenizerPair(path_a, path_b)
    return _PAIRS[key]


# ------------------------------------------------------------------ the bitmaps


class PairBitmaps:
    """Bitmaps of a chunk's documents per pair: sorted distinct `pairs`, and rows
    (pair number, plane, place of the word) in `spots` with their nonzero `words`.
    Plane 0 holds the documents; plane k + 1 bit k of the multiplicity less one."""

    def __init__(self, pairs: np.ndarray, spots: np.ndarray, words: np.ndarray):
        self.pairs, self.spots, self.words = pairs, spots, words

    # Places of 64 documents: 10 bits; planes: 6 bits.
    PLACE_BITS, PLANE_BITS = 10, 6

    @classmethod
    def of(cls, pairs: np.ndarray, docs: np.ndarray, times: np.ndarray) -> PairBitmaps:
        """From links (pair, document number, how often), in any order, repeated or not."""
        distinct, at = np.unique(pairs, return_inverse=True)
        posting, where = np.unique(at.astype(np.int64) << 16 | docs, return_inverse=True)
        total = np.bincount(where, times, len(posting)).astype(np.int64) - 1
        base = (posting >> 16) << (cls.PLACE_BITS + cls.PLANE_BITS) | (posting & 0xFFFF) >> 6
        bit = np.uint64(1) << (posting & 63).astype(np.uint64)
        spots, bits = [base], [bit]
        for k in range(int(total.max()).bit_length() if len(total) else 0):
            held = (total >> k & 1).astype(bool)
            spots.append(base[held] | k + 1 << cls.PLACE_BITS)
            bits.append(bit[held])
        return cls(distinct, *_or_merge(np.concatenate(spots), np.concatenate(bits)))

    def union(self, other: PairBitmaps) -> PairBitmaps:
        """OR of two maps over different documents."""
        pairs = np.union1d(self.pairs, other.pairs)
        shift = self.PLACE_BITS + self.PLANE_BITS
        spots = [
            np.searchsorted(pairs, m.pairs)[m.spots >> shift] << shift | m.spots & (1 << shift) - 1 for m in (self, other)
        ]
        return PairBitmaps(pairs, *_or_merge(np.concatenate(spots), np.concatenate([self.words, other.words])))

    def _plane(self) -> np.ndarray:
        return self.spots >> self.PLACE_BITS & (1 << self.PLANE_BITS) - 1

    def popcounts(self) -> tuple[np.ndarray, np.ndarray]:
        """Documents and links of each pair."""
        pair, plane = self.spots >> self.PLACE_BITS + self.PLANE_BITS, self._plane()
        ones = np.bitwise_count(self.words).astype(np.int64)
        docs = np.bincount(pair[plane == 0], ones[plane == 0], len(self.pairs)).astype(np.int64)
        weight = np.where(plane == 0, 1, 1 << np.maximum(plane - 1, 0))
        return docs, np.bincount(pair, ones * weight, len(self.pairs)).astype(np.int64)

    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair number, document number, weight) of every set bit; the weights of a
        pair and document add up to its multiplicity."""
        bits = np.unpackbits(self.words.astype("<u8").view(np.uint8), bitorder="little")
        row, bit = np.divmod(np.flatnonzero(bits), 64)
        plane = self._plane()[row]
        weight = np.where(plane == 0, 1, 1 << np.maximum(plane - 1, 0))
        docs = (self.spots[row] & (1 << self.PLACE_BITS) - 1) * 64 + bit
        return self.spots[row] >> self.PLACE_BITS + self.PLANE_BITS, docs, weight

    def to_bytes(self) -> list[bytes]:
        return [C.planes(self.pairs), C.planes(self.spots), C.planes(self.words)]

    @classmethod
    def from_bytes(cls, pairs: bytes, spots: bytes, words: bytes) -> PairBitmaps:
        return cls(C.from_planes(pairs, np.int64), C.from_planes(spots, np.int64), C.from_planes(words, np.uint64))


def _or_merge(spots: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(spots):
        return spots.astype(np.int64), words.astype(np.uint64)
    order = np.argsort(spots, kind="stable")
    spots, words = spots[order], words[order]
    first = np.flatnonzero(np.concatenate([[True], spots[1:] != spots[:-1]]))
    return spots[first], np.bitwise_or.reduceat(words, first)


# ------------------------------------------------------------------- the index


class _Numbers(dict):
    """Numbers of units in the order of their first use; `new`: not yet aligned."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self.new.append(unit)
        number = self[unit] = len(self)
        return number


class _Units:
    """Alignments of units, remembered up to a bound, with their pairs as arrays."""

    def __init__(self, pair: TokenizerPair):
        self.pair = pair
        self.forget()

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.characters = 0
        self.shown: list[str | None] = []
        self.differs = np.zeros(0, bool)
        self.sizes = np.zeros((0, 4), np.int64)
        self.pairs, self.times = np.zeros((2, 0), np.int64)
        self.ends = np.zeros(1, np.int64)  # of the pairs of each unit

    def learn(self) -> None:
        new, self.numbers.new = self.numbers.new, []
        if not new:
            return
        found = self.pair.align(new)
        self.characters += sum(map(len, new))
        self.shown += found.shown
        self.differs = np.concatenate([self.differs, [s is None for s in found.shown]])
        self.sizes = np.concatenate([self.sizes, found.sizes])
        self.pairs = np.concatenate([self.pairs, found.pairs])
        self.times = np.concatenate([self.times, found.times])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(found.n_pairs)])

    def batch(self, texts: list[str | None], show) -> tuple[np.ndarray, list[str], PairBitmaps]:
        """Sizes and group strings of texts, and the bitmaps of their places."""
        of_text = [list(map(self.numbers.__getitem__, self.pair.units(t))) if t else [] for t in texts]
        self.learn()
        shown, kept, docs = [], [], []
        sizes = np.zeros((len(texts), 4), np.int64)
        for at, numbers in enumerate(of_text):
            mine, often = np.unique(numbers, return_counts=True)
            mine = mine.astype(np.int64)
            if not numbers or self.differs[mine].any():
                shown.append("")
                continue
            shown.append(show(";".join(map(self.shown.__getitem__, numbers))))
            sizes[at] = often @ self.sizes[mine]
            kept.append(np.stack([mine, often]))
            docs.append(np.full(len(mine), at))
        unit, often = np.concatenate(kept, axis=1) if kept else np.zeros((2, 0), np.int64)
        doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        long = self.ends[unit + 1] - self.ends[unit]
        link = np.repeat(self.ends[unit] - np.cumsum(long) + long, long) + np.arange(long.sum())
        maps = PairBitmaps.of(self.pairs[link], np.repeat(doc, long), self.times[link] * np.repeat(often, long))
        if len(self.numbers) > KNOWN_UNITS or self.characters > KNOWN_CHARACTERS:
            self.forget()
        return sizes, shown, maps


def _digest(groups: str) -> str:
    return hashlib.sha256(groups.encode()).hexdigest()


def _indexer(path_a: str, path_b: str, whole_groups: bool, chunk_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        units = _Units(tokenizer_pair(path_a, path_b))
        show = str if whole_groups else _digest
        chunk = TaskContext.get().partitionId() << 32
        held, maps = 0, None
        for batch in batches:
            for start in range(0, batch.num_rows, chunk_docs):
                part = batch.slice(start, chunk_docs)
                sizes, shown, found = units.batch(part.column(1).to_pylist(), show)
                if maps is not None and held + part.num_rows > chunk_docs:
                    yield _index_row(chunk, maps)
                    chunk, held, maps = chunk + 1, 0, None
                found.spots = _moved(found, held)
                maps = found if maps is None else maps.union(found)
                n = part.num_rows
                numbers = np.arange(held, held + 64 * -(-n // 64))[:n]
                empty = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, chunk)), pa.array(numbers.astype(np.int32)), part.column(0),
                     *(pa.array(sizes[:, k]) for k in range(4)), pa.array(shown, pa.string()), empty, empty, empty],
                    schema=_INDEX_TYPE)
                held += 64 * -(-n // 64)  # the next batch begins with a new word
                if held >= chunk_docs or len(maps.words) >= CHUNK_LINKS:
                    yield _index_row(chunk, maps)
                    chunk, held, maps = chunk + 1, 0, None
        if maps is not None:
            yield _index_row(chunk, maps)

    return run


def _moved(maps: PairBitmaps, held: int) -> np.ndarray:
    """Spots of a batch whose first document has the number `held`."""
    return maps.spots + (held >> 6)


def _index_row(chunk: int, maps: PairBitmaps) -> pa.RecordBatch:
    values = [chunk, None, None, None, None, None, None, None, *maps.to_bytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _INDEX_TYPE)], schema=_INDEX_TYPE)


def build_index(docs: DataFrame, path_a: str, path_b: str, whole_groups: bool = False,
                chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """Staged index: rows of documents (number, sizes, group string or its sha256)
    and, for each chunk, one row with its bitmaps."""
    if not 64 <= chunk_docs <= 1 << 16 or chunk_docs % 64:
        raise ValueError("chunk_docs must be a multiple of 64, up to 65536")
    C.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _indexer(path_a, path_b, whole_groups, chunk_docs), INDEX_SCHEMA)
    return C.stage(rows, "alignment")


def _popcounter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            maps = PairBitmaps.from_bytes(row["pairs"], row["spots"], row["words"])
            docs, links = maps.popcounts()
            chunk = np.full(len(docs), row["chunk"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(v) for v in (chunk, maps.pairs, docs, links)], names=["chunk", "pair", "n_docs", "n_links"])


def _chunk_counts(index: DataFrame) -> DataFrame:
    return index.where(F.col("number").isNull()).select("chunk", "pairs", "spots", "words").mapInArrow(
        _popcounter, "chunk long, pair long, n_docs long, n_links long")


def id_a(pair: str = "pair") -> Column:
    return F.shiftright(pair, 32)


def pair_table(index: DataFrame) -> DataFrame:
    """(pair, a, b, n_docs, n_links, best) of all linked pairs; best: no pair of that A
    id is in more documents."""
    total = _chunk_counts(index).groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    # An A id has at most as many pairs as B has ids.
    most = F.max("n_docs").over(W.partitionBy("a"))
    return (
        total.withColumns({"a": id_a(), "b": F.col("pair").bitwiseAND(0xFFFFFFFF)})
        .withColumn("best", F.col("n_docs") == most)
        .select("pair", "a", "b", "n_docs", "n_links", "best")
    )


def _score(rows: pa.Table, counts: pa.Table) -> pa.Table:
    """Scores of the documents of a chunk from its postings."""
    mark = np.asarray(rows.column("number").is_null())
    doc_rows = rows.filter(pa.array(~mark))
    bits = rows.filter(pa.array(mark)).select(["pairs", "spots", "words"]).to_pylist()
    maps = PairBitmaps.from_bytes(**bits[0])
    order = np.argsort(counts.column("pair").to_numpy())  # the same pairs as the map's
    n_docs = counts.column("n_docs").to_numpy()[order]
    best = counts.column("best").to_numpy()[order]
    pair, doc, weight = maps.postings()
    number = doc_rows.column("number").to_numpy()
    size = int(number.max()) + 1 if len(number) else 0
    # Sums of whole numbers below 2**53 are exact.
    count_sum = np.bincount(doc, weight * n_docs[pair], size).astype(np.int64)
    n_best = np.bincount(doc, weight * best[pair], size).astype(np.int64)
    out = doc_rows.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    out = out.append_column("n_best", pa.array(n_best[number])).append_column("count_sum", pa.array(count_sum[number]))
    return out.append_column("groups", doc_rows.column("groups"))


def document_scores(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per document: sizes, n_best (links of a best pair), count_sum (document counts
    over its links) and its groups."""
    # Rare pairs are in few chunks and frequent ones in most, once each.
    counts = _chunk_counts(index).select("chunk", "pair").join(
        pairs.select("pair", "n_docs", "best").hint("merge"), "pair")
    return index.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(_score, SCORE_SCHEMA)


def alignments(docs: DataFrame, path_a: str, path_b: str, whole_groups: bool = False) -> DataFrame:
    """Alignment scores of all documents."""
    index = build_index(docs, path_a, path_b, whole_groups)
    return document_scores(index, C.stage(pair_table(index), "pairs"))
