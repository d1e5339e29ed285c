"""Language-model scoring with a log-frequency Bloom filter.

Method: Talbot and Osborne, "Randomised language modelling for statistical machine
translation" (2007).  The counts of word n-grams (orders 1 and 2) of the training
texts are quantised on a log scale, and an n-gram of level q enters the filter with
the levels 1 to q.  A worker probes the levels of an n-gram until one is missing; the
last one found gives its count back.  Probabilities are smoothed from such counts:

    P1(w)     = (c(w) + 0.1) / (N + 0.1 (V + 1))
    P(w | h)  = (min(c(h w), c(h)) + PRIOR * P1(w)) / (c(h) + PRIOR)

Counting is distributed: chunks of texts send their distinct n-grams by 64-bit hash with
their counts to buckets (the top bits of the hash), which sum them and build their own
segment of the filter.  A segment takes `BITS_PER_ENTRY` bits per level entered and holds
all levels: the filter grows with the corpus and is never in one place.  The buckets
probe their segments for the n-grams of each chunk and send the levels back to it.

The base score needs exact counts of all words.  The `FREQUENT` most frequent words
at most (whole bins of their counts, hence bounded) are sent to the workers; the
other words of each text are joined with the vocabulary table.

Edge cases: null and empty texts have the end token alone; without training rows
N and V are 0; repeated rows are scored each and teach each; null ids are never
held out; very long texts are scored whole; an empty table gives no rows; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookline.llm import common as C

#: Base of the quantisation of counts.
BASE = 1.5
#: Hash functions and bits per (n-gram, level), and bits of a block: about 3 % false positives.
HASHES = 4
BITS_PER_ENTRY = 9
BLOCK = 512
#: Bytes of a chunk and n-gram occurrences per bucket, about.
CHUNK_BYTES, BUCKET_KEYS = 4 << 20, 1 << 22
#: Words with exact counts that the workers hold, at most.
FREQUENT = 150_000
#: Weight of the shorter n-gram, in counts.
PRIOR = 20.0
#: Words that a counting task holds before it sends them on, and words besides the
#: table that a scoring task remembers before it begins anew.
COUNTED, WORDS = 300_000, 150_000
#: Texts scored together.
BATCH_ROWS = 512

END = b""
_SALT1, _SALT2 = 101, 102
#: N-gram keys are 48 bits (two n-grams share one far below the rate of false positives): sorted
#: keys take fewer bytes.
_TOP = np.uint64(0xFFFF_FFFF_FFFF_0000)
_STATE: dict[str, Scorer] = {}


def held_out(modulus: int = 10) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 0, F.lit(False))


def unigram_keys(h: np.ndarray) -> np.ndarray:
    return C.pair_hash(h, h, _SALT1) & _TOP


def bigram_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return C.pair_hash(left, right, _SALT2) & _TOP


def levels(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 1 + floor(log_BASE c)."""
    return 1 + np.floor(np.log(counts.astype(np.float64)) / math.log(BASE) + 1e-12).astype(np.int64)


def level_values(most: int = 128) -> np.ndarray:
    """Mean of the counts of each level; level 0 is count 0."""
    out = [0.0]
    for q in range(1, most):
        low, high = math.ceil(BASE ** (q - 1) - 1e-9), math.ceil(BASE**q - 1e-9) - 1
        out.append((low + max(low, high)) / 2)
    return np.array(out)


# ------------------------------------------------------------------ counting


def vocabulary(train: DataFrame) -> DataFrame:
    """(word, c) of the training texts, the end token included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(found: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "c"]
            )

        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(C.lower_words(text))
                found[END] += 1
                if len(found) > COUNTED:
                    yield sent(found)
                    found = Counter()
        yield sent(found)

    rows = train.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "word binary, c long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


def _runs(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of equal values."""
    first = np.flatnonzero(np.diff(part, prepend=-1))
    return first, np.append(first[1:], len(part))


def _block(keys: np.ndarray, blocks) -> np.ndarray:
    """First bit of an n-gram's block, which holds all its levels: a worker's probes of
    one n-gram touch one cache line."""
    h = C.mix(keys + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return (((h * blocks) >> np.uint64(32)) * np.uint64(BLOCK)).view(np.int64)


def _level_hash(keys: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Hash of (n-gram, level), whose parts are the positions in the block."""
    return C.mix(keys ^ (level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _place(h: np.ndarray, k: int) -> np.ndarray:
    return ((h >> np.uint64(9 * k)) & np.uint64(BLOCK - 1)).view(np.int64)


def build_segment(keys: np.ndarray, counts: np.ndarray, cap: int) -> tuple[bytes, int, int]:
    """(bits, size, lowest level kept) of the filter segment of one bucket."""
    q = levels(counts)
    lowest = 1
    while True:
        depth = np.maximum(q - lowest + 1, 0)
        entries = int(depth.sum())
        if entries * BITS_PER_ENTRY <= cap or not entries:
            break
        lowest += 1
    size = max(1, -(-entries * BITS_PER_ENTRY // BLOCK)) * BLOCK
    bits = np.zeros(size, np.bool_)
    for begin in range(0, len(keys), 1 << 18):  # in chunks, to bound memory
        d = depth[begin : begin + (1 << 18)]
        key = np.repeat(keys[begin : begin + (1 << 18)], d)
        level = lowest + np.arange(len(key)) - np.repeat(np.cumsum(d) - d, d)
        block, h = _block(key, np.uint64(size // BLOCK)), _level_hash(key, level)
        for k in range(HASHES):
            bits[block + _place(h, k)] = True
    return np.packbits(bits, bitorder="little").tobytes(), size, lowest


class LogFrequencyFilter:
    """The filter as the workers hold it: segments one after another."""

    def __init__(self, bits: bytes, first: np.ndarray, size: np.ndarray, lowest: np.ndarray, shift: int):
        self.bits = np.frombuffer(bits, np.uint8)
        self.first, self.size, self.lowest, self.shift = first, size, lowest, shift
        self.values = level_values()

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return self.values[self.levels(keys)]

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels of n-grams by repeated membership probes of rising levels."""
        found = np.zeros(len(keys), np.int64)
        bucket = (keys >> np.uint64(self.shift)).view(np.int64)
        live = np.flatnonzero(self.size[bucket])
        bucket = bucket[live]
        key, level = keys[live], self.lowest[bucket]
        block = self.first[bucket] + _block(key, self.size[bucket] // np.uint64(BLOCK))
        while len(live):
            h = _level_hash(key, level)
            for k in range(HASHES):
                bit = block + _place(h, k)
                ok = np.flatnonzero((self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                if len(ok) < len(live):
                    live, key, block, level, h = (x[ok] for x in (live, key, block, level, h))
            found[live] = level
            level = level + 1
            if len(live) and level.max() >= len(self.values):
                break
        return found


# ------------------------------------------------------------------ scoring


class _Index(dict):
    """Numbers of words; new words are listed as they come."""

    def __init__(self, known: dict, new: list):
        super().__init__(known)
        self.new = new

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Scorer:
    """Word table (hash, exact log count where known) and model.

    Numbers 0 to len(words of the model) are the end token and the words of the model's
    table, which stay; other words are forgotten when they are too many."""

    def __init__(self, model: dict):
        self.model = model
        self.new: list[bytes] = []
        self.words: list[bytes] = []
        self.hash, self.log = np.empty(0, np.uint64), np.empty(0)
        exact = dict(zip(model["words"], model["counts"]))
        table = [END, *(w for w in exact if w != END)]
        # log10(c + 0.1); not a number for words outside the table
        c = np.array([exact.get(w, np.nan) for w in table], np.float64)
        self.learn(table, np.log10(c + 0.1))
        self.base = dict(zip(table, range(len(table))))
        self.index = _Index(self.base, self.new)

    def learn(self, words: list[bytes], log: np.ndarray) -> None:
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        self.words += words
        self.hash = np.concatenate([self.hash, h])
        self.log = np.concatenate([self.log, log])

    def forget(self) -> None:
        n = len(self.base)
        self.words, self.hash, self.log = self.words[:n], self.hash[:n], self.log[:n]
        self.index = _Index(self.base, self.new)

    def score(self, texts: list[bytes | None], level: np.ndarray):
        """As `read`, the model score in place of the tokens.  `level` has the levels of the
        distinct n-grams of the texts in the order of their keys."""
        sizes, token, *base = self.read(texts)
        h = self.hash[token]
        keys, place = np.unique(np.concatenate([unigram_keys(h), bigram_keys(np.roll(h, 1), h)]), return_inverse=True)
        if len(keys) != len(level):
            raise ValueError(f"{len(level)} levels for {len(keys)} n-grams")
        own, pair = np.split(level_values()[level][place], 2)
        return sizes, model_score(sizes, own, pair, self.model), *base

    def read(self, texts: list[bytes | None]):
        """Numbers of tokens, tokens, base score of the table's words, their number, and
        for the other words (text number, word, times)."""
        if len(self.words) > len(self.base) + WORDS:
            self.forget()
        split = [C.lower_words(t) for t in texts]
        flat: list[bytes] = []
        for words in split:
            flat += words
            flat.append(END)
        token = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        if self.new:
            self.learn(self.new, np.full(len(self.new), np.nan))
            self.new.clear()
        sizes = np.array([len(w) + 1 for w in split])
        starts = np.cumsum(sizes) - sizes
        log = self.log[token]
        rare = np.isnan(log)
        base = np.add.reduceat(np.where(rare, 0.0, log), starts)
        known = np.add.reduceat((~rare).astype(np.int64), starts)
        text_of = np.repeat(np.arange(len(texts)), sizes)[rare]
        places, times = np.unique(text_of * len(self.words) + token[rare], return_counts=True)
        return sizes, token, base, known, places // len(self.words), places % len(self.words), times


def model_score(sizes: np.ndarray, own: np.ndarray, pair: np.ndarray, model: dict) -> np.ndarray:
    """Log probabilities of texts from the counts of their words and pairs.  The end
    token closes each text and is the history of the next one's first word."""
    one = (own + 0.1) / (model["tokens"] + 0.1 * (model["distinct"] + 1))
    history = np.roll(own, 1)
    p = (np.minimum(pair, history) + model["prior"] * one) / (history + model["prior"])
    return np.add.reduceat(np.log10(p), np.cumsum(sizes) - sizes)


def n_buckets(tokens: int) -> int:
    return 1 << max(4, math.ceil(math.log2(max(1, 2 * tokens / BUCKET_KEYS))))


def train_model(train: DataFrame, frequent: int = FREQUENT) -> tuple[dict, DataFrame]:
    """(word table and totals for the workers, staged vocabulary (word, c) of the other words)."""
    vocab = C.stage(vocabulary(train), "vocabulary")
    totals = vocab.agg(F.sum("c"), F.count(F.lit(1))).first()
    tokens, distinct = int(totals[0] or 0), int(totals[1])
    # Whole bins of the counts, the most frequent first, as far as the bound goes.
    bin_of = F.floor(F.log2("c") * 16).cast("int")
    bins = sorted(((r[0], r[1]) for r in vocab.groupBy(bin_of).count().collect()), reverse=True)
    least, held = None, 0
    for b, n in bins:
        held += n
        if held > frequent:
            break
        least = b
    table = vocab.where(bin_of >= least).toArrow() if least is not None else None
    model = {
        "words": table.column("word").to_pylist() if table else [],
        "counts": table.column("c").to_pylist() if table else [],
        "tokens": tokens, "distinct": distinct, "prior": PRIOR,
    }
    rare = vocab if least is None else vocab.where(bin_of < least)
    return model, rare


def text_keys(h: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Keys of the words and pairs of a text's word hashes, the end token among them."""
    h = np.concatenate([h, end])
    return [unigram_keys(h), bigram_keys(np.concatenate([end, h[:-1]]), h)]


def levels_by_bucket(chunks: DataFrame, buckets: int) -> DataFrame:
    """(chunk, bucket, levels): filter levels of the distinct n-grams of each chunk, in the
    order of their keys; the filter learns from the rows that teach."""
    shift = np.uint64(64 - int(math.log2(buckets)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = C.WordHashes()
        end = np.array([xxhash.xxh64_intdigest(END)], np.uint64)
        none = [np.empty(0, np.uint64)]
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = pa.ipc.open_stream(raw).read_all()
                parts = {True: list(none), False: list(none)}
                for text, teach in zip(rows.column("text").to_pylist(), rows.column("teach").to_pylist()):
                    parts[teach] += text_keys(hashes.of(C.lower_words(text)), end)
                taught, n = np.unique(np.concatenate(parts[True]), return_counts=True)
                keys = np.union1d(taught, np.concatenate(parts[False]))
                counts = np.zeros(len(keys), np.uint32)
                counts[np.searchsorted(keys, taught)] = n
                bucket = (keys >> shift).astype(np.int64)
                first, last = _runs(bucket)
                delta = [C.planes(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in zip(first, last)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), chunk)), pa.array(bucket[first]), pa.array(delta, pa.binary()),
                     pa.array([C.planes(counts[a:b]) for a, b in zip(first, last)], pa.binary())],
                    names=["chunk", "bucket", "keys", "counts"],
                )

    def answer(rows: pa.Table) -> pa.Table:
        parts = [np.cumsum(C.from_planes(x, np.uint64)) for x in rows.column("keys").to_pylist()]
        n = np.concatenate([C.from_planes(x, np.uint32) for x in rows.column("counts").to_pylist()]).astype(np.int64)
        ends = np.cumsum([len(x) for x in parts])
        keys = np.concatenate(parts)
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        first = np.flatnonzero(new)
        keys, n = keys[first], np.add.reduceat(n, first)
        bits, size, _ = build_segment(keys[n > 0], n[n > 0], sys.maxsize)
        one = LogFrequencyFilter(
            bits, np.zeros(buckets, np.int64), np.full(buckets, size, np.uint64), np.ones(buckets, np.int64), int(shift)
        )
        level = one.levels(keys).astype(np.uint8)
        out = np.empty(len(order), np.uint8)
        out[order] = level[np.cumsum(new) - 1]
        return pa.table({
            "chunk": rows.column("chunk"), "bucket": rows.column("bucket"),
            "levels": pa.array([x.tobytes() for x in np.split(out, ends[:-1])], pa.binary()),
        })

    sent = chunks.mapInArrow(send, "chunk long, bucket long, keys binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(answer, "chunk long, bucket long, levels binary")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of CHUNK_BYTES or more, but for the last one."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        if sum(b.nbytes for b in kept) >= CHUNK_BYTES:
            yield pa.concat_batches(kept)
            kept = []
    if kept:
        yield pa.concat_batches(kept)


def scores(
    docs: DataFrame, model: dict, rare: DataFrame, flags: dict[str, Column], teach: Column | None = None
) -> DataFrame:
    """`teach` (those not held out) tells the rows that the n-gram counts are of.

    doc_id, the columns of `flags`, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    C.small_batches(spark, BATCH_ROWS)
    sent = spark.sparkContext.broadcast(model)
    name = f"{spark.sparkContext.applicationId}-{sent._jbroadcast.id()}"
    tokens, distinct = model["tokens"], model["distinct"]
    teach = ~held_out() if teach is None else teach
    names = ["doc_id", *flags, "uid", "n_tokens", "score", "base", "known", "other"]
    schema = (
        "doc_id long, " + "".join(f"{f} boolean, " for f in flags)
        + "uid long, n_tokens long, score double, base double, known long, other array<struct<word:binary,times:int>>"
    )

    def scored(batch: pa.Table, uid: pa.Array, level: np.ndarray) -> list:
        if name not in _STATE:
            _STATE.clear()
            _STATE[name] = Scorer(sent.value)
        scorer = _STATE[name]
        texts = batch.column(batch.num_columns - 1).to_pylist()
        sizes, score, base, known, text_of, word_of, times = scorer.score(texts, level)
        words = pa.array([scorer.words[w] for w in word_of], pa.binary())
        offsets = np.searchsorted(text_of, np.arange(len(texts) + 1)).astype(np.int32)
        other = pa.ListArray.from_arrays(
            pa.array(offsets),
            pa.StructArray.from_arrays([words, pa.array(times.astype(np.int32))], names=["word", "times"]),
        )
        cols = [batch.column(i) for i in range(batch.num_columns - 1)]
        return cols + [uid, pa.array(sizes.astype(np.int64)), pa.array(score), pa.array(base), pa.array(known), other]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """chunk, its rows as an Arrow stream."""
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 36
        packed = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in _merged(batches):
            if not batch.num_rows:
                continue
            uids = pa.array(np.arange(uid, uid + batch.num_rows))
            batch = pa.RecordBatch.from_arrays([uids, *batch.columns], names=["uid", *batch.schema.names])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=packed) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array([uid]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "rows"]
            )
            uid += batch.num_rows

    def finish(chunk: pa.Table, levels: pa.Table) -> pa.Table:
        rows = pa.ipc.open_stream(chunk.column("rows")[0].as_py()).read_all().drop_columns(["teach"])
        level = np.frombuffer(b"".join(levels.sort_by("bucket").column("levels").to_pylist()), np.uint8)
        return pa.Table.from_arrays(scored(rows.drop_columns(["uid"]), rows.column("uid"), level), names=names)

    rows = docs.select(
        teach.alias("teach"), F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(f) for f, c in flags.items()),
        F.col("text").cast("binary").alias("text"),
    )
    # Rows are large: row groups are closed by size after a few of them.
    chunks = C.stage(rows.mapInArrow(cut, "chunk long, rows binary"), "chunks", {
        "parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 4, "parquet.page.size.row.check.min": 4,
        "parquet.enable.dictionary": "false",
    })
    levels = levels_by_bucket(chunks, n_buckets(tokens))
    found = chunks.groupBy("chunk").cogroup(levels.groupBy("chunk")).applyInArrow(finish, schema)
    part = C.stage(found, "scores")
    # Words outside the workers' table: joined with their exact counts.
    other = part.select("uid", F.explode("other").alias("o")).select("uid", "o.word", "o.times")
    c = F.coalesce("c", F.lit(0))
    joined = other.join(rare, "word", "left").groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(c + 0.1)).alias("rare_base"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"),
    )
    scale = math.log10(tokens + 0.1 * (distinct + 1))
    return part.drop("other").join(joined, "uid", "left").select(
        "doc_id", *flags, "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        "score",
    )


def language_model_scores(docs: DataFrame) -> DataFrame:
    """Scores of all documents, learnt from those that are not held out."""
    C.small_batches(docs.sparkSession, BATCH_ROWS)
    model, rare = train_model(docs.where(~held_out()))
    return scores(docs, model, rare, {"held_out": held_out()})
