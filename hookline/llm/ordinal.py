"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Proportional odds: one weight vector over hashed text features is shared by all
grades, and ordered thresholds cut its value, P(grade <= k) = s(theta_k - f(text)).
The weights are fitted by per-coordinate gradient steps with L1 sparsity, the
thresholds along with them (their order is kept).  A text gets its expected grade
and the probability of each upper tail; selection is by a tail probability.

Features: distinct hashes of lower-cased words, of the shapes of words (letters and
digits folded, other characters as they are) and of pairs of shapes, and the share
of repeated three-word windows and the length on a coarse scale.

The model is fitted on at most `FIT_ROWS` rated rows (a documented bound, chosen by a
hash of doc_id), in one task; every whole text is scored.

Edge cases: null and empty texts have the length feature alone; null ids, null
ratings and unrated rows teach nothing; without ratings all thresholds stay at
their starts; repeated rows score alike; other columns are carried along untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookline.llm import common as C
from hookline.llm.toxicity import held_out, sigmoid

BITS = 20
FIT_ROWS = 12_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 4.0, 1.0
#: Step of the thresholds and the least distance between two of them.
THETA_STEP, THETA_GAP = 0.02, 0.05

_SHAPE = bytes(
    (97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c) for c in range(256)
)
_RUNS = re.compile(rb"(.)\1+")
_HASHES = C.WordHashes()
_MODEL: dict[str, tuple] = {}


class _Shapes(dict):
    """Hashes of word shapes; runs of one character count once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= C.WordHashes.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(_RUNS.sub(rb"\1", word.translate(_SHAPE)), 5)
        return value


_SHAPES = _Shapes()


def features(text: bytes | None) -> np.ndarray:
    """Distinct coordinates of a text."""
    raw = text.split() if text else []
    length = np.array([xxhash.xxh64_intdigest(b"length%d" % len(raw).bit_length())], np.uint64)
    shift = np.uint64(64 - BITS)
    if not raw:
        return (C.mix(length) >> shift).astype(np.int64)
    h = _HASHES.of(C.alnum_words(text))
    s = np.fromiter(map(_SHAPES.__getitem__, raw), np.uint64, len(raw))
    w = C.ngram_hashes(_HASHES.of(C.lower_words(text)), 3)
    share = 1.0 - len(np.unique(w)) / len(w) if len(w) else 0.0
    repeats = np.array([xxhash.xxh64_intdigest(b"repeats%d" % int(8 * share))], np.uint64)
    s = np.unique(np.concatenate([s, C.pair_hash(s[:-1], s[1:], 31)]))
    return np.unique((C.mix(np.concatenate([h, s, length, repeats])) >> shift).astype(np.int64))


def fit(texts: list[bytes], grades: list[int], levels: int, epochs: int = EPOCHS):
    """(thresholds, coordinates, weights) after passes in the given order."""
    size = 1 << BITS
    z, n = np.zeros(size), np.zeros(size)
    theta = np.arange(levels - 1, dtype=np.float64) - (levels - 2) / 2
    rows = [features(t).astype(np.int32) for t in texts]
    for _ in range(epochs):
        for x, y in zip(rows, grades):
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= L1, 0.0, -(zx - np.sign(zx) * L1) / ((BETA + np.sqrt(nx)) / ALPHA + L2))
            f = w.sum()
            above = float(sigmoid(theta[y] - f)) if y < levels - 1 else 1.0
            below = float(sigmoid(theta[y - 1] - f)) if y else 0.0
            p = max(above - below, 1e-9)
            g = 1.0 - above - below  # of the negative log likelihood, by f
            sigma = (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA
            z[x] = zx + g - sigma * w
            n[x] = nx + g * g
            if y < levels - 1:
                theta[y] += THETA_STEP * min(above * (1 - above) / p, 5.0)
            if y:
                theta[y - 1] -= THETA_STEP * min(below * (1 - below) / p, 5.0)
            for k in range(1, levels - 1):
                theta[k] = max(theta[k], theta[k - 1] + THETA_GAP)
    kept = np.flatnonzero(np.abs(z) > L1)
    weights = -(z[kept] - np.sign(z[kept]) * L1) / ((BETA + np.sqrt(n[kept])) / ALPHA + L2)
    return theta, kept, weights


def tails(text: bytes | None, theta: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1, 2, ..."""
    return 1.0 - sigmoid(theta - dense[features(text)].astype(np.float64).sum())


def train(docs: DataFrame, rated: DataFrame, levels: int, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Model table (coordinate, weight); threshold k has coordinate -1 - k.

    `rated`: doc_id, grade (0 to levels - 1).  The sample's ids come from the ratings
    alone and are broadcast (at most `fit_rows`)."""
    C.small_batches(docs.sparkSession)
    chosen = (
        rated.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, levels - 1) & ~held_out())
        .select("doc_id", F.col("grade").cast("int").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(fit_rows)
    )
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["order", "doc_id", "grade"], kind="stable")
        theta, at, weights = fit(part["text"].tolist(), part["grade"].tolist(), levels)
        return pd.DataFrame({
            "coordinate": np.concatenate([-1 - np.arange(levels - 1), at]), "weight": np.concatenate([theta, weights])
        })

    one = rows.withColumn("order", F.xxhash64("doc_id", F.lit(9))).groupBy(F.lit(0).alias("all"))
    return one.applyInPandas(learn, "coordinate long, weight double")


def expected_grades(docs: DataFrame, model: DataFrame, levels: int, out: str = "tails") -> DataFrame:
    """`docs` with an array column `out` of P(grade >= k); their sum is the expected grade."""
    spark = docs.sparkSession
    C.small_batches(spark)
    rows = model.toPandas()  # at most 2**BITS weights
    at, weights = rows["coordinate"].to_numpy(np.int64), rows["weight"].to_numpy(np.float64)
    theta = np.arange(levels - 1, dtype=np.float64) - (levels - 2) / 2
    theta[-1 - at[at < 0]] = weights[at < 0]
    sent = spark.sparkContext.broadcast((theta, at[at >= 0], weights[at >= 0]))
    key = f"{spark.sparkContext.applicationId}-{sent._jbroadcast.id()}"

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _MODEL:
            _MODEL.clear()
            t, idx, w = sent.value
            dense = np.zeros(1 << BITS, np.float32)
            dense[idx] = w
            _MODEL[key] = (t, dense)
        for texts in batches:
            yield pd.Series([tails(t, *_MODEL[key]) for t in texts])

    return docs.withColumn(out, score(F.col("text").cast("binary")))


def grade(quality: Column, toxic: Column) -> Column:
    """Grade of two labels: 0 poor, 1 good but toxic, 2 good and clean."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when((quality == 1) & (toxic == 0), 2)
