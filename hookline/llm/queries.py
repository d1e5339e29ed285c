"""Registered queries of the subpackage: thin digests over the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hookline.llm import common as C
from hookline.llm import alignment, bloom_lm, decontam, jump_shard, license_scan, ordinal, packing, quality_rules, resampling, token_cache, token_files, toxicity, trie_join
from hookline.llm.oracles import ORACLES
from hookline.session import checkpoint_dir

__all__ = ["QUERIES", "ORACLES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of 1024 tokens."""
    return packing.pack_documents(C.table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query
def op2_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and robust outlier verdicts of all documents."""
    return quality_rules.verdicts(C.table(spark, sf_dir, "documents"))


@query
def op3_aho_corasick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in all documents."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontam.contamination(docs, C.table(spark, sf_dir, "benchmark"), out="h")
    return hits.select(
        "doc_id", F.col("h.n_words").alias("n_words"), F.col("h.n_hit").alias("n_hit"),
        F.size("h.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("h.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("h.n_hit") > 0).alias("contaminated"),
    )


@query
def op4_log_frequency_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model and base scores of all documents."""
    return bloom_lm.language_model_scores(C.table(spark, sf_dir, "documents"))


@query
def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probabilities of all documents; kept: grade 1 or more likelier than not."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = C.table(spark, sf_dir, "labels")
    rated = labels.select("doc_id", ordinal.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    model = C.stage(ordinal.train(docs, rated, 3), "ordinal")
    graded = ordinal.expected_grades(docs, model, 3, "p")
    return graded.select(
        "doc_id", toxicity.held_out().alias("held_out"), (F.col("p")[0] + F.col("p")[1]).alias("expected_grade"),
        F.col("p")[0].alias("p_grade_1"), F.col("p")[1].alias("p_grade_2"), (F.col("p")[0] >= 0.5).alias("kept"),
    )


@query
def op6_trie_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles overlap by 90 % or more."""
    found = trie_join.near_duplicates(C.table(spark, sf_dir, "documents"), n=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op7_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by jump consistent hashing of doc_id."""
    return jump_shard.assign_shards(C.table(spark, sf_dir, "documents"), 40)


@query
def op8_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents through a cache that begins empty."""
    cache = f"{checkpoint_dir(spark)}/llm-token-cache-{uuid.uuid4().hex}"
    counts = token_cache.token_counts(
        C.table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), cache
    )
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query
def op9_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the rows that are not held out."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = C.stage(toxicity.train(docs, C.table(spark, sf_dir, "labels")), "toxicity")
    scored = toxicity.toxicity(docs, model, "score")
    return scored.select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of all documents."""
    return license_scan.licenses(C.table(spark, sf_dir, "documents"))


@query
def op11_simple8b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and checksums of the ids of all documents, read back from Simple-8b files."""
    path = f"{checkpoint_dir(spark)}/llm-token-files-{uuid.uuid4().hex}"
    token_files.write(C.table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), path)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op12_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two tokenizers over all documents, scored by linked pairs."""
    docs = C.table(spark, sf_dir, "documents")
    return alignment.alignments(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


@query
def op13_regular_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of all documents towards the benchmark, and the ranks of the drawn ones."""
    drawn = resampling.resample(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
