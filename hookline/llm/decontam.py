"""Benchmark decontamination with one Aho-Corasick automaton.

Items are normalised (A-Z to lower case, words of digits, a-z and non-ASCII
characters joined by single spaces) and cut into windows of ten consecutive
words; an item of fewer words, but not none, is one window.  All windows go into
one automaton, and each document is scanned once; matches map back to word
numbers and to character offsets of the original text.

The items of one automaton are bounded (`MAX_BLOCK_BYTES`, checked before they
are collected).  Larger benchmarks are dealt into blocks by a hash of the item,
and each block scans all documents; the hits of a text are then united.

Edge cases: a null or empty text, or one without words, has no words and no
hits; null item texts and items without words have no windows; repeated items
count once by id; items with a null id are left out; repeated documents give
equal rows; other columns are carried along untouched.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookline.llm import common as C

#: Words in a window.
WINDOW = 10
#: Text bytes of the items of one automaton.
MAX_BLOCK_BYTES = 8 << 20

SCHEMA = "n_words long, n_hit long, words array<int>, items array<string>, spans array<struct<start:int,end:int>>"

_AUTOMATA: dict[str, tuple] = {}


def build(items: list[tuple[str, bytes]], window: int = WINDOW):
    """Automaton over the windows of (item id, text); values: (words, item numbers)."""
    ids, found = [], {}
    for item_id, text in items:
        words = C.alnum_words(text)
        if not words:
            continue
        ids.append(item_id)
        size = min(window, len(words))
        for i in range(len(words) - size + 1):
            pattern = b" " + b" ".join(words[i : i + size]) + b" "
            found.setdefault(pattern, (size, set()))[1].add(len(ids) - 1)
    automaton = ahocorasick.Automaton()
    for pattern, (size, owners) in found.items():
        automaton.add_word(pattern.decode("latin-1"), (size, tuple(owners)))
    if found:
        automaton.make_automaton()
    return automaton, ids, bool(found)


def scan(text: bytes | None, automaton, ids: list[str], any_pattern: bool):
    """(words, hit word numbers, ids of the items found, spans of hit runs as
    character offsets of the original text)."""
    words = C.alnum_words(text)
    if not words or not any_pattern:
        return len(words), [], [], []
    plain = b" " + b" ".join(words) + b" "
    matches = list(automaton.iter(plain.decode("latin-1")))
    if not matches:
        return len(words), [], [], []
    spaces = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
    after = np.searchsorted(spaces, np.array([end for end, _ in matches]))
    edge = np.zeros(len(words) + 1, np.int64)
    owners: set[int] = set()
    for last, (_, (size, items)) in zip(after, matches):
        edge[last - size] += 1
        edge[last] -= 1
        owners.update(items)
    hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    return len(words), hit.tolist(), sorted({ids[k] for k in owners}), spans(text, hit)


def spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Character ranges of the runs of hit words in the original text."""
    mapped = np.frombuffer(b" " + text.translate(C._ALNUM_TABLE) + b" ", np.uint8) != 32
    step = np.diff(mapped.astype(np.int8))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    cut = np.flatnonzero(np.diff(hit) > 1)
    first, last = hit[np.concatenate([[0], cut + 1])], hit[np.concatenate([cut, [len(hit) - 1]])]
    return [{"start": int(lead[starts[a]]), "end": int(lead[ends[b]])} for a, b in zip(first, last)]


def _scanner(blocks, key: str, window: int):
    @F.pandas_udf(SCHEMA)
    def run(texts: pd.Series) -> pd.DataFrame:
        if key not in _AUTOMATA:
            _AUTOMATA.clear()
            _AUTOMATA[key] = build(blocks.value, window)
        rows = [scan(t, *_AUTOMATA[key]) for t in texts]
        return pd.DataFrame(rows, columns=["n_words", "hit", "items", "spans"]).assign(
            n_hit=lambda x: x["hit"].map(len)
        ).rename(columns={"hit": "words"})[["n_words", "n_hit", "words", "items", "spans"]]

    return run


def _items(benchmark: DataFrame) -> DataFrame:
    return (
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
        .where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
        .distinct()
    )


def contamination(docs: DataFrame, benchmark: DataFrame, out: str = "hits", window: int = WINDOW,
                  max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """`docs` with a struct column `out`: n_words, n_hit, words (numbers of the hit
    words), items (sorted ids) and spans (character ranges)."""
    spark = docs.sparkSession
    C.small_batches(spark)
    items = _items(benchmark)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / max_block_bytes))
    text = F.col("text").cast("binary")

    def block(number: int) -> Column:
        # An item's rows share a block, which holds about max_block_bytes of text.
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number) if blocks > 1 else items
        rows = sorted((r["item_id"], bytes(r["text"])) for r in part.collect())
        sent = spark.sparkContext.broadcast(rows)
        return _scanner(sent, f"{spark.sparkContext.applicationId}-{sent._jbroadcast.id()}", window)(text)

    if blocks == 1:
        return docs.withColumn(out, block(0))
    key = "_key_" + out
    keyed = docs.withColumn(key, F.xxhash64("text"))
    found = None
    for number in range(blocks):
        one = keyed.select(key, block(number).alias("h"))
        found = one if found is None else found.unionByName(one)
    united = found.groupBy(key).agg(
        F.max("h.n_words").alias("n_words"),
        # Each text adds to these sets at most its own words and items.
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("h.words")))).alias("words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("h.items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("h.spans")))).alias("spans"),
    )
    verdict = F.struct(
        "n_words", F.size("words").cast("bigint").alias("n_hit"), "words", "items", "spans"
    ).alias(out)
    return keyed.join(united.select(key, verdict), key, "left").drop(key)
