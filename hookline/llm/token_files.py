"""Token ids in Simple-8b files.

A 64-bit word holds a selector in its top four bits and 60 bits of ids: 240 or 120
zeros, 60 ids of one bit, ... , one id of 60 bits.  A block is coded under a limit:
ids of the limit or more stand as the limit itself in their word and follow, less
the limit, in the block's list of escapes, so a few large ids don't widen their
neighbours, and any 64-bit id can be coded.  Of the limits that could pay, a block
takes the one that gives the fewest bytes.  Its marks give, for every `STRIDE`
words, the ids and escapes before them, so any range of ids is decoded from the
words that hold it; decoding works on whole arrays, selector by selector.

`write` deals the documents into files by ranges of doc_id, in ascending order, and
codes them task by task.  The files are Parquet tables of blocks (rows: file, block
number, ids before it in the file, document ids and ends, the bytes of the block);
a block holds whole documents, of `BLOCK_IDS` ids or one longer document.  A small
manifest beside them gives the ids before each file.  `read` decodes them again.

Block layout, little-endian: magic `S8B1`, ids u64, words u32, escapes u32, marks
u32, limit u64; then words u64, escapes u64, ids before marks u64, escapes before
marks u32.

Edge cases: a null or empty text is the end id alone; null doc_ids come first;
rows of equal doc_id stand side by side in the order of their texts' hashes, and a
doc_id of many rows is split over files; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hookline.llm import common as C
from hookline.llm.packing import encoder
from hookline.session import parallelism

END_ID = 0
#: Ids of a block, about.
BLOCK_IDS = 1 << 16
#: Words from mark to mark.
STRIDE = 256

# Ids and bits of the sixteen selectors.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

#: Bits of the limits that a block tries, and the largest share of escapes for which one
#: is tried.  An escape costs a word, so it can pay only for ids of over twice the bits.
LIMIT_BITS = [10, 12, 15, 20, 30, 60]
ESCAPED_SHARE = 0.1

_MAGIC = b"S8B1"
_HEAD = struct.Struct("<4sQIIIQ")

BLOCK_SCHEMA = "file int, block int, start long, n_ids long, doc_ids array<long>, ends array<long>, data binary"
_BLOCK_TYPE = pa.schema([
    ("file", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("data", pa.binary()),
])


# --------------------------------------------------------------------- coding


def pack(values: np.ndarray) -> np.ndarray:
    """Words of values below 2**60: at each place the selector that takes the most."""
    n = len(values)
    # Zeros behind the last value let the last word be filled up.
    padded = np.concatenate([values.astype(np.uint64), np.zeros(COUNTS[0], np.uint64)])
    take, selector = np.ones(n, np.int64), np.full(n, 15, np.uint8)
    for s in range(14, -1, -1):
        over = np.concatenate([[0], np.cumsum(padded >> np.uint64(BITS[s]) != 0, dtype=np.int32)])
        fits = over[COUNTS[s] : COUNTS[s] + n] == over[:n]
        take[fits], selector[fits] = COUNTS[s], s
    steps, at, starts = take.tolist(), 0, []
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts, np.int64)
    chosen = selector[starts] if n else np.zeros(0, np.uint8)
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        if BITS[s]:
            mine, slots = chosen == s, np.arange(COUNTS[s])
            parts = padded[starts[mine][:, None] + slots] << (slots * BITS[s]).astype(np.uint64)
            words[mine] |= np.bitwise_or.reduce(parts, axis=1)
    return words


def unpack(words: np.ndarray) -> np.ndarray:
    """Values of all slots of the words (the last ones may be filling)."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[chosen]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(chosen):
        if BITS[s]:
            mine, slots = chosen == s, np.arange(COUNTS[s])
            mask = np.uint64((1 << int(BITS[s])) - 1)
            out[starts[mine][:, None] + slots] = words[mine][:, None] >> (slots * BITS[s]).astype(np.uint64) & mask
    return out


def encode_block(ids: np.ndarray) -> bytes:
    """Bytes of a block of unsigned 64-bit ids."""
    ids = ids.astype(np.uint64)
    top = int(ids.max()) if len(ids) else 0
    best = None
    for bits in LIMIT_BITS:
        limit = (1 << bits) - 1
        if bits < 60 and limit <= top < 1 << 2 * bits:
            continue
        escaped = np.flatnonzero(ids >= np.uint64(limit))
        if bits < 60 and len(escaped) > ESCAPED_SHARE * len(ids):
            continue
        words = pack(np.minimum(ids, np.uint64(limit)))
        if best is None or len(words) + len(escaped) < len(best[1]) + len(best[2]):
            best = limit, words, escaped
        if top < limit:  # larger limits give the same words
            break
    limit, words, escaped = best
    before = np.concatenate([[0], np.cumsum(COUNTS[(words >> np.uint64(60)).astype(np.int64)])[:-1]])[::STRIDE]
    before = before if len(words) else before[:0]
    head = _HEAD.pack(_MAGIC, len(ids), len(words), len(escaped), len(before), limit)
    return b"".join([
        head, words.astype("<u8").tobytes(), (ids[escaped] - np.uint64(limit)).astype("<u8").tobytes(),
        before.astype("<u8").tobytes(), np.searchsorted(escaped, before).astype("<u4").tobytes(),
    ])


def decode_block(data: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids `start` to `stop` of a block, from the words that hold them."""
    magic, n_ids, n_words, n_escapes, n_marks, limit = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a block of token ids")
    stop = n_ids if stop is None else min(stop, n_ids)
    if start >= stop:
        return np.zeros(0, np.uint64)
    at = _HEAD.size
    words = np.frombuffer(data, "<u8", n_words, at)
    escapes = np.frombuffer(data, "<u8", n_escapes, at + 8 * n_words)
    marks = np.frombuffer(data, "<u8", n_marks, at + 8 * (n_words + n_escapes)).astype(np.int64)
    skipped = np.frombuffer(data, "<u4", n_marks, at + 8 * (n_words + n_escapes + n_marks))
    first = int(np.searchsorted(marks, start, "right")) - 1
    last = int(np.searchsorted(marks, stop, "left"))
    out = unpack(words[first * STRIDE : last * STRIDE])
    out = out[: n_ids - marks[first]]
    large = np.flatnonzero(out == np.uint64(limit))
    out[large] += escapes[skipped[first] : skipped[first] + len(large)]
    return out[start - marks[first] : stop - marks[first]]


# ---------------------------------------------------------------------- files


def _coder(tokenizer_path: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, file = encoder(tokenizer_path), TaskContext.get().partitionId()
        block = start = held = 0
        docs: list[int | None] = []
        parts: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            ends = np.cumsum([len(p) for p in parts])
            values = [file, block, start, held, docs, ends, encode_block(np.concatenate(parts))]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(values, _BLOCK_TYPE)], schema=_BLOCK_TYPE)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs.append(doc_id)
                parts.append(np.append(enc.ids(text or ""), np.uint32(end_id)))
                held += len(parts[-1])
                if held >= block_ids:
                    yield row()
                    block, start, held, docs, parts = block + 1, start + held, 0, [], []
        if docs:
            yield row()

    return run


def write(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS,
          files: int | None = None) -> None:
    """Files of the ids of all texts in ascending doc_id order under `path`, a shared folder."""
    spark = docs.sparkSession
    C.small_batches(spark)
    order = ["doc_id", "_hash", "_row"]
    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        # The row number splits the rows of one doc_id and text, which are interchangeable.
        .withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
        .repartitionByRange(files or parallelism(spark), *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    dealt.mapInArrow(_coder(tokenizer_path, end_id, block_ids), BLOCK_SCHEMA).write.parquet(f"{path}/blocks")
    sizes = _blocks(spark, path).groupBy("file").agg(
        F.sum("n_ids").alias("n_ids"), F.sum(F.size("doc_ids").cast("bigint")).alias("n_docs"))
    # One row per file.
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes.withColumn("before", before).write.parquet(f"{path}/manifest")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")


def _decoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode_block(row["data"])
            if len(ids) and ids.max() > 0xFFFFFFFF:
                raise ValueError("an id exceeds 32 bits")
            ids = ids.astype("<u4")
            ends = [0, *row["ends"]]
            pieces = [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["file"]] * len(pieces), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                    pa.array([row["start"] + a for a in ends[:-1]], pa.int64()),
                    pa.array(np.diff(ends), pa.int64()), pa.array(pieces, pa.binary()),
                ],
                names=["file", "doc_id", "within", "n_tokens", "ids"],
            )


def read(spark: SparkSession, path: str, first_doc: int | None = None, last_doc: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents of the files; ids: unsigned
    32-bit, little-endian.  With bounds, only blocks that reach into them are decoded."""
    blocks = _blocks(spark, path)
    bounds = F.lit(True)
    if first_doc is not None:
        blocks, bounds = blocks.where(F.array_max("doc_ids") >= first_doc), bounds & (F.col("doc_id") >= first_doc)
    if last_doc is not None:
        blocks, bounds = blocks.where(F.array_min("doc_ids") <= last_doc), bounds & (F.col("doc_id") <= last_doc)
    rows = blocks.mapInArrow(_decoder, "file int, doc_id long, within long, n_tokens long, ids binary")
    manifest = F.broadcast(spark.read.parquet(f"{path}/manifest").select("file", "before"))  # one row per file
    return rows.where(bounds).join(manifest, "file").select(
        "doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids")
