import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from hookline.llm import bloom_lm as B

from . import data


def brute(docs):
    tokens = [data.lower_words(t) + [""] for _, t in docs]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs]
    c = Counter()
    pairs = Counter()
    for w, h in zip(tokens, held):
        if not h:
            c.update(w)
            pairs.update(zip(["", *w], w))
    n, v = sum(c.values()), len(c)
    rows = []
    for (i, _), w, h in zip(docs, tokens, held):
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        model = 0.0
        for a, x in zip(["", *w], w):
            one = (c[x] + 0.1) / (n + 0.1 * (v + 1))
            model += math.log10((min(pairs[a, x], c[a]) + B.PRIOR * one) / (c[a] + B.PRIOR))
        rows.append((str(i), h, len(w), sum(c[x] > 0 for x in w), n, base, model))
    return sorted(rows, key=str)


def compare(df, docs, model_slack):
    got = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
                  for r in df.collect()), key=str)
    want = brute(docs)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5]))
        assert abs(g[6] - w[6]) < model_slack * max(2.0, w[2])
    return got


def test_documents_against_exact_counts(spark):
    docs = list(data.texts().items())
    got = compare(B.language_model_scores(data.documents(spark)), docs, 0.12)
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)  # pairs help on unseen rows


def test_edge_cases_and_empty(spark):
    compare(B.language_model_scores(data.edge_docs(spark)), [(r[0], r[1]) for r in data.ROWS], 0.12)
    assert B.language_model_scores(data.empty_docs(spark)).count() == 0


def test_rare_words_are_joined(spark):
    docs = data.documents(spark)
    model, rare = B.train_model(docs.where(~B.held_out()), frequent=50)
    assert 0 < len(model["words"]) <= 50 and rare.count() > 1000
    compare(B.scores(docs, model, rare, {"held_out": B.held_out()}), list(data.texts().items()), 0.12)


def test_quantised_counts_come_back():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64) * np.uint64(2))
    counts = np.minimum(rng.zipf(1.5, len(keys)), 10**6)
    bits, size, lowest = B.build_segment(keys, counts, 1 << 30)
    one = B.LogFrequencyFilter(bits, np.zeros(2, np.int64), np.full(2, size, np.uint64), np.full(2, lowest), 63)
    got = one.counts(keys)
    assert (got >= B.level_values()[B.levels(counts)]).all()  # no false negatives
    assert (got == B.level_values()[B.levels(counts)]).mean() > 0.95
    absent = np.setdiff1d(rng.integers(0, 2**63, 20_000).astype(np.uint64) * np.uint64(2) + np.uint64(1), keys)
    assert (one.counts(absent) > 0).mean() < 0.05


def test_a_bounded_segment_drops_its_lowest_levels():
    keys = np.arange(1, 5001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.concatenate([np.ones(4900, np.int64), np.full(100, 500)])
    bits, size, lowest = B.build_segment(keys, counts, 20_000)
    assert size <= 20_000 + B.BLOCK and lowest > 1
    one = B.LogFrequencyFilter(bits, np.zeros(2, np.int64), np.full(2, size, np.uint64), np.full(2, lowest), 63)
    assert (one.counts(keys[4900:]) > 300).all()
    assert (one.counts(keys[:4900]) > 0).mean() < 0.1


def test_planes_round_trip():
    x = np.array([0, 1, 2**63, 5, 2**64 - 1], np.uint64)
    assert (B.C.from_planes(B.C.planes(x), np.uint64) == x).all()


def test_no_levels_are_dropped_however_small_the_parts(spark, monkeypatch):
    for name, value in (("MAX_BITS", 1 << 14), ("CHUNK_BYTES", 1 << 16), ("BUCKET_KEYS", 1 << 10)):
        monkeypatch.setattr(B, name, value, raising=False)
    docs = data.documents(spark).repartition(3)
    compare(B.language_model_scores(docs), list(data.texts().items()), 0.12)
    chunk = pa.table({"teach": [True] * 3, "text": [b"a b c", b"a b", b"a"]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, chunk.schema) as out:
        out.write_table(chunk)
    rows = spark.createDataFrame([(0, bytearray(sink.getvalue()))], "chunk long, rows binary")
    got = B.levels_by_bucket(rows, 16).orderBy("bucket").collect()
    level = np.frombuffer(b"".join(bytes(r.levels) for r in got), np.uint8)
    assert len(level) == 4 + 6 and (level >= 1).all()  # a b c, end; end-a, a-b, b-c, c-end, b-end, a-end
