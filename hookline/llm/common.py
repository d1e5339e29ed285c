"""Helpers shared by the operators: staging, row keys, word splitting, hashing."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hookline.session import checkpoint_dir

#: Rows per Arrow batch sent to Python; keeps a batch of long texts small.
BATCH_ROWS = 1024

_UPPER = bytes(range(65, 91))
_LOWER_TABLE = bytes.maketrans(_UPPER, _UPPER.lower())
#: A-Z to lower case; every other ASCII character but 0-9 and a-z to a space.
_ALNUM_TABLE = bytes(
    (c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batch of the session's Python stages."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def stage(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read
    it back: lineage is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key() -> Column:
    """64-bit key of (doc_id, text).  Rows that repeat both share it."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


_KEY, _PLACE = "_llm_row_key", "_llm_row_place"


def rows_of(docs: DataFrame, keys: DataFrame, column: str, one_each: bool = True) -> DataFrame:
    """Rows of `docs` whose row key is in `keys` (distinct), all columns; of equal
    rows one, or all of them."""
    wanted = keys.select(F.col(column).alias(_KEY))
    found = docs.withColumn(_KEY, row_key()).join(wanted.hint("merge"), _KEY, "left_semi")
    if one_each:  # the join has sorted by the key already
        place = F.row_number().over(W.partitionBy(_KEY).orderBy(_KEY))
        found = found.withColumn(_PLACE, place).where(F.col(_PLACE) == 1)
    return found.select(*docs.columns)


def lower_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z."""
    return text.translate(_LOWER_TABLE).split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(_ALNUM_TABLE).split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound and then begun anew."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pair_hash(left: np.ndarray, right: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of ordered pairs of hashes."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + right + np.uint64(salt))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of ``n`` hashes (none if there are fewer)."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1]
    for k in range(1, n):
        out = pair_hash(out, h[k : len(h) - n + 1 + k], k)
    return out


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal significance together, so that zeros compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(raw: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(dtype).ravel()
