"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, its word pairs and its
pairs with one word skipped, in `2**BITS` coordinates.  Training is FTRL-proximal
(McMahan et al., "Ad click prediction: a view from the trenches", 2013):
per-coordinate learning rates and L1 sparsity, so that few weights remain.  Only
those are sent to the workers (at most `MAX_WEIGHTS`, checked), which score every
whole text.

The model is fitted on at most `fit_rows` labelled rows (a documented bound; rows
are chosen by a hash of doc_id), in one task.  Nothing but the text enters a score.

Edge cases: a null or empty text has no features and scores by the bias; labels
other than 0 and 1, null ids and unlabelled rows teach nothing; a doc_id with
several label rows teaches each of them; without usable labels every score is
0.5; repeated rows score alike; other columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookline.llm import common as C

#: Coordinates of the hashed feature space: 2**BITS.
BITS = 22
#: Labelled rows that the model is fitted on, at most.
FIT_ROWS = 16_000
#: Passes over them.
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.2, 1.0, 8.0, 1.0
#: Non-zero weights that may be sent to the workers: those that FTRL leaves from
#: FIT_ROWS rows, 12 bytes each.
MAX_WEIGHTS = 1 << BITS

_MODEL: dict[str, tuple[float, np.ndarray]] = {}
_HASHES = C.WordHashes()


def held_out(modulus: int = 5) -> Column:
    """Rows that never teach: crc32 of doc_id as text divisible by `modulus`."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 0, F.lit(False))


def features(text: bytes | None, hashes: C.WordHashes = _HASHES) -> np.ndarray:
    """Coordinates of words, word pairs and skip pairs, with repeats."""
    words = C.alnum_words(text)
    if not words:
        return np.empty(0, np.int64)
    h = hashes.of(words)
    shift = np.uint64(64 - BITS)
    return np.concatenate([
        C.mix(h) >> shift,
        C.pair_hash(h[:-1], h[1:], 11) >> shift,
        C.pair_hash(h[:-2], h[2:], 12) >> shift,
    ]).astype(np.int64)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, coordinates and weights after FTRL-proximal passes in the given order."""
    size = 1 << BITS
    z, n = np.zeros(size), np.zeros(size)
    zb = nb = 0.0
    rows = [np.unique(features(t)).astype(np.int32) for t in texts]
    for _ in range(epochs):
        for x, y in zip(rows, labels):
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= L1, 0.0, -(zx - np.sign(zx) * L1) / ((BETA + np.sqrt(nx)) / ALPHA + L2))
            b = -zb / ((BETA + nb**0.5) / ALPHA + L2)
            g = float(sigmoid(w.sum() + b)) - y
            sigma = (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA
            z[x] = zx + g - sigma * w
            n[x] = nx + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / ALPHA * b
            nb += g * g
    kept = np.flatnonzero(np.abs(z) > L1)
    zx, nx = z[kept], n[kept]
    weights = -(zx - np.sign(zx) * L1) / ((BETA + np.sqrt(nx)) / ALPHA + L2)
    return float(-zb / ((BETA + nb**0.5) / ALPHA + L2)), kept, weights


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Model table (coordinate, weight); the bias has coordinate -1.

    The ids of the sample are chosen from the labels alone, so that only those
    (at most `fit_rows`, hence broadcast) select texts; no text table is shuffled."""
    C.small_batches(docs.sparkSession)
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
        .select("doc_id", F.col(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(fit_rows)
    )
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["order", "doc_id", "y"], kind="stable")
        bias, at, weights = fit(part["text"].tolist(), part["y"].tolist())
        return pd.DataFrame({"coordinate": np.concatenate([[-1], at]), "weight": np.concatenate([[bias], weights])})

    one = rows.withColumn("order", F.xxhash64("doc_id", F.lit(7))).groupBy(F.lit(0).alias("all"))
    return one.applyInPandas(learn, "coordinate long, weight double")


def scorer(model: DataFrame):
    """Column function text -> probability, holding the model's non-zero weights."""
    spark = model.sparkSession
    rows = model.limit(MAX_WEIGHTS + 2).toPandas()
    if len(rows) > MAX_WEIGHTS + 1:
        raise ValueError(f"the model has over {MAX_WEIGHTS} weights")
    at, weights = rows["coordinate"].to_numpy(np.int64), rows["weight"].to_numpy(np.float64)
    bias = float(weights[at == -1].sum())
    sent = spark.sparkContext.broadcast((bias, at[at >= 0], weights[at >= 0]))
    key = f"{spark.sparkContext.applicationId}-{sent._jbroadcast.id()}"

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _MODEL:
            _MODEL.clear()
            b, idx, w = sent.value
            dense = np.zeros(1 << BITS, np.float32)
            dense[idx] = w
            _MODEL[key] = (b, dense)
        b, dense = _MODEL[key]
        for texts in batches:
            yield pd.Series([probability(t, b, dense) for t in texts], dtype="float64")

    return lambda text: score(text.cast("binary"))


def probability(text: bytes | None, bias: float, dense: np.ndarray) -> float:
    x = features(text)
    x = np.unique(x[dense[x] != 0])
    return float(sigmoid(bias + dense[x].astype(np.float64).sum()))


def toxicity(docs: DataFrame, model: DataFrame, out: str = "toxicity") -> DataFrame:
    """`docs` with the probability `out` of label 1."""
    C.small_batches(docs.sparkSession)
    return docs.withColumn(out, scorer(model)(F.col("text")))
