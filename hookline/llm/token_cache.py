"""Token counts through a digest cache.

A text's count depends only on its normalised content and the tokenizer version,
so counts are stored under both digests.  Documents join the cache by digest;
one text of each missing digest is encoded, its count is appended to the cache,
and all documents take their counts from there.

Normal form: runs of ASCII white space become one space and are trimmed, which
the word tokenizer drops in any case.  (Pass `normal=None` for tokenizers that
count white space.)  The digest is SHA-256.

Counting: the vocabulary's pre-tokenizer splits a text into pieces that are
encoded one by one, so a worker remembers the counts of pieces as the library
gave them.  Texts outside the plain alphabet (`_SLOW`: special strings, control
characters, letters beyond Latin Extended-B) go to the library whole.

Recovery: the append is one Spark job whose files appear only when it commits; a
digest that two jobs append is read once.

Edge cases: null texts count as empty texts (0 bytes, 0 tokens); repeated rows
each get their count, encoded once; very long texts are encoded whole; an empty
table leaves the cache as it is; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hookline.llm import common as C

#: Pieces whose counts a worker remembers before it begins anew.
PIECES = 500_000
CACHE_SCHEMA = "tokenizer string, digest string, n_tokens long"

# The piece pattern of the word vocabulary file.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SLOW = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x9f\u0250-\u200f\u2028-\u202f\u205f-\U0010ffff]|<\|")

_COUNTERS: dict[str, PieceCounts] = {}


class PieceCounts(dict):
    """Tokens of pieces, as the library counts them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, piece: str) -> int:
        if len(self) >= PIECES:
            self.clear()
        value = self[piece] = self.whole(piece)
        return value

    def learn(self, pieces: set[str]) -> None:
        """Count the pieces that are not remembered yet, in one call."""
        new = [p for p in pieces if p not in self]
        if len(self) + len(new) > PIECES:
            self.clear()
        encoded = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        self.update(zip(new, (len(e.ids) for e in encoded)))

    def count(self, text: str) -> int:
        return self.counts([text])[0]

    def counts(self, texts: list[str]) -> list[int]:
        split = [None if _SLOW.search(t) else _PIECES.findall(t.lower()) for t in texts]
        self.learn(set().union(*(s for s in split if s)))
        return [self.whole(t) if s is None else sum(map(self.__getitem__, s)) for t, s in zip(texts, split)]


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file (read where the job is submitted) and library version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def collapse_white_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " "))


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """Stored counts (digest, n_tokens) of one tokenizer version."""
    return (
        spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
        .where(F.col("tokenizer") == version)
        .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    )


def open_cache(spark: SparkSession, cache_path: str) -> None:
    """Create an empty cache unless there is one (as Spark's Hadoop file system sees it)."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str,
                 normal=collapse_white_space) -> DataFrame:
    """doc_id, n_bytes, digest and n_tokens per document; new counts are appended
    to the cache at `cache_path`."""
    spark = docs.sparkSession
    C.small_batches(spark)
    version = tokenizer_version(tokenizer_path)
    open_cache(spark, cache_path)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = C.stage(
        docs.select(
            "doc_id", F.xxhash64(text).alias("place"), F.octet_length(text).cast("bigint").alias("n_bytes"),
            F.sha2((normal(text) if normal else text).cast("binary"), 256).alias("digest"),
        ),
        "digests",
    )
    # One row stands for each digest; pre-aggregated, so copies cost little.
    missing = (
        rows.groupBy("digest").agg(F.min(F.struct("doc_id", "place")).alias("one"))
        .join(read_cache(spark, cache_path, version).select("digest"), "digest", "left_anti")
        .select(F.col("one.doc_id").alias("doc_id"), F.col("one.place").alias("place"), "digest")
    )
    texts = docs.select("doc_id", text.alias("text")).withColumn("place", F.xxhash64("text")).alias("t")
    m = missing.hint("shuffle_hash").alias("m")
    # The ids spread copies; only this join moves texts, each once.
    misses = texts.join(m, F.expr("t.doc_id <=> m.doc_id AND t.place = m.place")).select("m.digest", "t.text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.setdefault(tokenizer_path, None) or PieceCounts(tokenizer_path)
        _COUNTERS[tokenizer_path] = counter
        for batch in batches:
            counts = counter.counts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(counts), pa.string()), batch.column(0), pa.array(counts, pa.int64())],
                names=["tokenizer", "digest", "n_tokens"],
            )

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    return rows.drop("place").join(read_cache(spark, cache_path, version), "digest").select(
        "doc_id", "n_bytes", "digest", "n_tokens"
    )
