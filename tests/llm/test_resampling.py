import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hookline.llm import resampling as K

from . import data


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(data.UPPER))


def features(text):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def buckets(text):
    return [zlib.crc32(f.encode()) % 10_000 for f in features(text)]


def brute(docs, target):
    s, t = (Counter(b for x in texts for b in buckets(x)) for texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (S + 10000) / ((s[k] + 1) * (T + 10000)))) for k in range(10000)]
    rows = []
    for d, x in docs:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets(x))
        rows.append([d, len(features(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = [r for r, (_, x) in zip(rows, docs) if len(words(x)) >= 20]
    able.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, rows), key=str)


def rows(df):
    got = df.select("doc_id", "n_features", "weight", "score", "rank").collect()
    return sorted((tuple(r) for r in got), key=str)


def target():
    return pq.read_table(f"{data.SF}/benchmark.parquet")["text"].to_pylist()


some_words = st.lists(st.one_of(st.sampled_from(["a", "bc", "é東"]), st.integers(0, 300).map(lambda n: "x" * n + "y")), max_size=20)


@settings(max_examples=100, deadline=None)
@given(st.lists(some_words, max_size=5))
def test_buckets_of_runs(texts):
    owner, got = K.feature_buckets([[w.encode() for w in t] for t in texts], K._Words())
    for i, t in enumerate(texts):
        assert sorted(got[owner == i].tolist()) == sorted(buckets(" ".join(t)))


def test_parts_hold_all_texts(monkeypatch):
    monkeypatch.setattr(K, "PART_WORDS", 5)
    texts = [b"a b c", None, b"", b"d e f g h i j", b"k", b"l m n o p"]
    assert [w for part in K._in_parts(texts) for w in part] == [(t or b"").split() for t in texts]


def test_documents_equal_brute_force(spark):
    bench = spark.read.parquet(f"{data.SF}/benchmark.parquet")
    docs = data.documents(spark).repartition(5)
    assert rows(K.resample(docs, bench)) == brute(list(data.texts().items()), target())


def test_edge_cases(spark):
    bench = spark.read.parquet(f"{data.SF}/benchmark.parquet")
    assert rows(K.resample(data.edge_docs(spark), bench)) == brute([r[:2] for r in data.ROWS], target())
    assert rows(K.resample(data.edge_docs(spark), bench.limit(0))) == brute([r[:2] for r in data.ROWS], [])
    assert K.resample(data.empty_docs(spark), bench).count() == 0


def check_ranks(got, limit):
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, len(drawn) + 1))
    able = sorted(((-r.score, r.doc_id is not None, r.doc_id or 0) for r in got if r.ok))
    assert len(drawn) == min(limit, len(able))
    assert [(-r.score, r.doc_id is not None, r.doc_id or 0) for r in drawn] == able[: len(drawn)]


def test_ranks_with_many_ties(spark):
    many = spark.range(0, 20_000, 1, 7).select(
        F.when(F.col("id") % 3 != 0, F.col("id") % 11).alias("doc_id"), F.pmod(F.xxhash64("id"), F.lit(4)).alias("score"),
        (F.col("id") % 5 != 0).alias("ok"))
    for limit in (0, 1, 777, 30_000):
        check_ranks(K.ranked(many, F.col("ok"), limit, segments=13).collect(), limit)


def test_equal_rows_are_split_into_segments(spark):
    same = spark.range(0, 10_000, 1, 8).select(F.lit(5).cast("long").alias("doc_id"), F.lit(9).cast("long").alias("score"))
    runs = K.sorted_runs(same)
    cuts = K.splitters(runs, 10)
    sizes = [r["count"] for r in runs.groupBy(K._segment(cuts)).count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 2 * 1_000


def test_draw_follows_the_weights(spark):
    docs = spark.range(2_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, F.repeat(F.lit("wanted topic words "), 10)).otherwise(
            F.repeat(F.lit("other plain stuff "), 10)).alias("text"))
    got = K.resample(docs, spark.createDataFrame([("wanted topic words",)], "text string"))
    assert all(r.doc_id % 4 == 0 for r in got.where("rank is not null").collect())
