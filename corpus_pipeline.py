"""Corpus pipeline: quality rules, toxicity, near duplicates, benchmark
decontamination, packing.

Each stage reads the whole table that its predecessor wrote and returns the
columns of ``documents`` for the rows it keeps; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hookline.llm import common as C
from hookline.llm import decontam, packing, quality_rules, toxicity, trie_join
from hookline.llm.queries import tokenizer_path

_COLUMN = "_llm_verdict"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the robust outlier test keep."""
    return quality_rules.keep_good(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by the toxicity model, learnt from this stage's rows."""
    model = C.stage(toxicity.train(docs, C.table(spark, sf_dir, "labels")), "toxicity")
    scored = toxicity.toxicity(docs, model, _COLUMN)
    return scored.where(F.col(_COLUMN) < 0.5).select(*docs.columns)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8 or more."""
    return trie_join.keep_one(docs, n=5, percent=80)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontam.contamination(docs, C.table(spark, sf_dir, "benchmark"), _COLUMN)
    return found.where(F.col(_COLUMN)["n_hit"] == 0).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


#: Stages in order: (name, function of (spark, docs, sf_dir)).
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("toxicity", clean),
    ("jaccard_join", unique),
    ("decontamination", uncontaminated),
    ("packing", packed),
]

#: The quality and toxicity verdicts come from iterated estimates, which SQL
#: cannot express; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written and read again."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
