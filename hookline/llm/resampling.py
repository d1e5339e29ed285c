"""Importance resampling of documents towards a target distribution.

Features are the runs of one to three consecutive words, hashed by crc32 into
buckets.  Both sides' feature counts per bucket give an array of gains (scaled log
ratios); a document's weight is the sum of the gains of its features, read from that
array.  Weight plus seeded Gumbel noise is its score, and the documents of the highest
scores are drawn: sampling without replacement in proportion to the exponential of the
weight.

Exact ranks come from parallel sorting by regular sampling.  The scored rows are
written as locally sorted runs; samples at regular places of every run, sorted, give
regular splitters; each row finds its segment by binary search among them; rows per
segment, summed up, give the rank before each segment, and the segments that reach
into the draw are exchanged, merged and numbered locally.  Rows are ordered by score,
doc_id, then place in their run, so no two are equal: a segment holds at most about
twice its share, however many rows are alike.

The crc32 of a run of words is put together from those of its words: appending n bytes
to a string moves its crc by a linear map, kept as four tables per n.

Edge cases: a null or empty text, or one without words, has no features, weight 0 and
no rank, but a score; rows that repeat a doc_id are drawn each; a null doc_id hashes as
an empty string and comes before the others on ties; an empty target gives gains from
the smoothing alone; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hookline.llm import common as C
from hookline.session import parallelism

#: Buckets of the features, words of the longest one.
BUCKETS = 10_000
LONGEST_RUN = 3
#: Least words of a document that may be drawn, percent drawn, seed of the noise.
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Runs that give samples, at most, and segments; the samples are their product.
MOST_RUNS = 1_000
#: Words whose crc a task remembers, and words that are hashed together, about.
KNOWN_WORDS = 400_000
PART_WORDS = 200_000

SCORED_SCHEMA = "doc_id long, n_words long, n_features long, weight long, score long"


# -------------------------------------------------------------------- features


def _shift_tables() -> np.ndarray:
    """T[n, k, v]: crc after n zero bytes of a crc that is v in byte k and 0 elsewhere
    (without the customary inversions), for n up to 64."""
    step = np.array([zlib.crc32(bytes([v])) ^ zlib.crc32(b"\0") for v in range(256)], np.uint32)
    out = np.empty((65, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(64):
        out[n + 1] = step[out[n] & 255] ^ out[n] >> np.uint32(8)
    return out


_SHIFT = _shift_tables()


def _joined(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of left + right strings, from theirs and the bytes of the right ones."""
    out = left.copy()
    rest = length.copy()
    while len(rest) and rest.max() > 0:
        n = np.minimum(rest, 64)
        out = (
            _SHIFT[n, 0, out & 255] ^ _SHIFT[n, 1, out >> np.uint32(8) & 255]
            ^ _SHIFT[n, 2, out >> np.uint32(16) & 255] ^ _SHIFT[n, 3, out >> np.uint32(24)]
        )
        rest = rest - n
    return out ^ right


class _Words(dict):
    """crc32 of " " + word times 2**32, plus its bytes, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = zlib.crc32(b" " + word) << 32 | len(word) + 1
        return value


def feature_buckets(texts: list[list[bytes]], known: _Words, buckets: int = BUCKETS, longest: int = LONGEST_RUN):
    """(text number, bucket) of all runs of one to `longest` words of texts, given as
    their words; repeats included."""
    words = list(itertools.chain.from_iterable(texts))
    of = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
    got = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    spaced, length = (got >> np.uint64(32)).astype(np.uint32), (got & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # A word alone: " " + word without the space's share.
    run = _joined(np.full(len(words), _SPACE, np.uint32), spaced, length - 1)
    found, owner = [run], [of]
    for k in range(1, longest):
        run = _joined(run[:-1], spaced[k:], length[k:])
        inside = of[k:] == of[: len(run)]
        found.append(run[inside])
        owner.append(of[k:][inside])
    return np.concatenate(owner), np.concatenate(found).astype(np.int64) % buckets


def _in_parts(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    """Words of texts, in parts of about `PART_WORDS` words."""
    part: list[list[bytes]] = []
    held = 0
    for text in texts:
        part.append(C.alnum_words(text))
        held += len(part[-1])
        if held >= PART_WORDS:
            yield part
            part, held = [], 0
    yield part


#: XORed with the crc of " " + word and moved behind it, gives the crc of the word.
_SPACE = np.uint32(zlib.crc32(b" "))


def _counter(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Words(), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in _in_parts(batch.column(0).to_pylist()):
                total += np.bincount(feature_buckets(part, known, buckets)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts per bucket, summed in each task first."""
    C.small_batches(texts.sparkSession)
    counted = texts.select(F.col("text").cast("binary")).mapInArrow(_counter(buckets), "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket: one number per bucket comes to the driver."""

    def counts(df: DataFrame) -> list[int]:
        out = [0] * buckets
        for bucket, n in bucket_counts(df, buckets).collect():
            out[bucket] = n
        return out

    s, t = counts(docs), counts(target)
    whole_s, whole_t = sum(s), sum(t)
    return np.array([
        math.floor(1000 * math.log((b + 1) * (whole_s + buckets) / ((a + 1) * (whole_t + buckets)))) for a, b in zip(s, t)
    ], np.int64)


def noise(doc_id, seed: int = SEED) -> int:
    """Scaled Gumbel noise of a document."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scorer(gain: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = np.zeros((len(ids), 4), np.int64)
            rows[:, 3] = [noise(i, seed) for i in ids]
            at = 0
            for part in _in_parts(batch.column(1).to_pylist()):
                owner, found = feature_buckets(part, known, len(gain))
                mine = rows[at : at + len(part)]
                mine[:, 0] = [len(words) for words in part]
                mine[:, 1] = np.bincount(owner, minlength=len(part))
                # Sums of whole numbers below 2**53 are exact.
                mine[:, 2] = np.bincount(owner, gain[found], len(part))
                at += len(part)
            rows[:, 3] += rows[:, 2]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(rows[:, k]) for k in range(4))],
                names=["doc_id", "n_words", "n_features", "weight", "score"])

    return run


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of all documents."""
    C.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        _scorer(gain, seed), SCORED_SCHEMA)


# ---------------------------------------------------- sorting by regular sampling


def _key(score: int, doc_id: int | None, at: int) -> tuple:
    """Ascending: higher scores first, then smaller doc_ids (null first), then places."""
    return (-score, doc_id is not None, doc_id or 0, at)


def _segment(splitters: list[tuple]):
    @F.pandas_udf("int")
    def find(score, doc_id_known, doc_id, at):  # noqa: ANN001
        import pandas as pd

        keys = zip((-score).tolist(), doc_id_known.tolist(), doc_id.tolist(), at.tolist())
        return pd.Series([bisect_left(splitters, k) for k in keys], dtype="int32")

    return find(F.col("score"), F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), F.col("_at"))


def sorted_runs(rows: DataFrame) -> DataFrame:
    """`rows` written as one sorted run per task, with `_at`: run and place in it."""
    runs = rows.sortWithinPartitions(F.desc("score"), F.asc_nulls_first("doc_id"))
    return C.stage(runs.withColumn("_at", F.monotonically_increasing_id()), "runs")


def splitters(runs: DataFrame, segments: int) -> list[tuple]:
    """Keys that cut the rows of all runs into about equal segments."""
    place, run = F.col("_at").bitwiseAND((1 << 33) - 1), F.shiftright("_at", 33)
    keyed = runs.select("score", "doc_id", "_at", run.alias("run"), place.alias("place"))
    # One row per run.
    sizes = keyed.groupBy("run").agg(F.count(F.lit(1)).alias("size"))
    step = F.greatest(F.ceil(F.col("size") / segments), F.lit(1))
    # At most `segments` samples of a run.
    samples = keyed.join(F.broadcast(sizes), "run").where(F.col("place") % step == 0).select(
        "score", "doc_id", "_at", step.alias("stands_for"))
    found = sorted((_key(r.score, r.doc_id, r["_at"]), r.stands_for) for r in samples.collect())
    total = sum(n for _, n in found)
    out, passed = [], 0
    for key, n in found:
        # A sample stands for the rows up to the next one of its run.
        if passed * segments >= total * (len(out) + 1):
            out.append(key)
        passed += n
    return out


def ranked(rows: DataFrame, eligible, limit: int, segments: int | None = None) -> DataFrame:
    """`rows` (doc_id, score and more) with `rank`: 1, 2, 3 ... of the first `limit`
    eligible ones by descending score, then ascending doc_id; null for the others."""
    segments = segments or parallelism(rows.sparkSession)
    # Runs of at least some rows, so that their number and the samples stay bounded.
    runs = sorted_runs(rows.withColumn("_in", eligible).coalesce(MOST_RUNS))
    kept = runs.where("_in")
    cuts = splitters(kept, min(segments, MOST_RUNS))
    placed = C.stage(runs.withColumn("_segment", F.when(F.col("_in"), _segment(cuts))), "segments")
    sizes = dict(placed.where("_in").groupBy("_segment").count().collect())  # one row per segment
    before, reaching = {}, []
    passed = 0
    for k in range(len(cuts) + 1):
        before[k] = passed
        if passed < limit:
            reaching.append(k)
        passed += sizes.get(k, 0)
    inside = F.col("_segment").isin(reaching) if reaching else F.lit(False)
    order = W.partitionBy("_segment").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "_at")
    base = F.element_at(F.array(*[F.lit(before[k]).cast("long") for k in range(len(cuts) + 1)]), F.col("_segment") + 1)
    place = base + F.row_number().over(order)
    drawn = placed.where(inside).withColumn("rank", place).withColumn(
        "rank", F.when(F.col("rank") <= limit, F.col("rank")))
    rest = placed.where(~F.coalesce(inside, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(*rows.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of all documents; the first
    `percent` of those with at least `least_words` words are ranked."""
    rows = C.stage(scored(docs, gains(docs, target, buckets), seed), "scored")
    eligible = F.col("n_words") >= least_words
    return ranked(rows, eligible, percent * rows.where(eligible).count() // 100)
