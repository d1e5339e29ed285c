import numpy as np
from pyspark.sql import functions as F

from hookline.llm import quality_rules as Q

from . import data


def counts(text):
    w = data.words(text)
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {i for i, x in enumerate(wins) if wins.count(x) > 1} if len(wins) < 3000 else set()
    if len(wins) >= 3000:
        seen = {}
        for i, x in enumerate(wins):
            seen.setdefault(x, []).append(i)
        twice = {i for v in seen.values() if len(v) > 1 for i in v}
    covered = {i + k for i in twice for k in range(3)}
    lines = [x for x in (text or "").split("\n") if data.words(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(covered), failed), len(lines)


def got(df):
    return sorted((str(r.doc_id), (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
                  for r in df.collect())


def test_counts_and_edge_cases(spark):
    df = Q.verdicts(data.edge_docs(spark))
    assert got(df) == sorted((str(r[0]), counts(r[1])[0]) for r in data.ROWS)
    rows = {r.doc_id: r for r in df.collect()}
    assert not rows[4].kept and not rows[5].kept and rows[7].kept
    docs = Q.verdicts(data.documents(spark))
    assert got(docs) == sorted((str(i), counts(t)[0]) for i, t in data.texts().items())


def test_repeats_overlap_and_symbols(spark):
    texts = ["a b c a b c a b", "a a a a", "x # y | z ### \n\n x", "a b c d a b c e b c d", "q\nq\n \nq"]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    assert got(Q.verdicts(df)) == sorted((str(i), counts(t)[0]) for i, t in enumerate(texts))


def test_empty(spark):
    assert Q.verdicts(data.empty_docs(spark)).count() == 0
    assert Q.keep_good(data.empty_docs(spark)).count() == 0


def test_chi_square():
    assert abs(Q.chi2_quantile(0.975, 5) - 12.8325) < 1e-3
    assert abs(Q.chi2_quantile(0.5, 2) - 1.386294) < 1e-5
    assert abs(Q.chi2_cdf(3.0, 1) - 0.916735) < 1e-5


def vectors(spark, rows):
    return spark.createDataFrame([(i, "en", s, *map(float, v)) for i, (s, v) in enumerate(rows)],
                                 "doc_id long, lang string, source string, " + ", ".join(f"{c} double" for c in Q.STATS))


def test_distance_is_mahalanobis(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5))
    _, est = Q.estimate(vectors(spark, [("a", v) for v in x]))
    row = est.first()
    low = np.array([[row[f"l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    centre = np.array([row[f"m{i}"] for i in range(5)])
    df = vectors(spark, [("a", v) for v in x[:20]]).withColumn("unit", F.lit(row.unit)).join(est, "unit")
    d2 = {r.doc_id: r.d2 for r in Q.with_distance(df).collect()}
    inverse = np.linalg.inv(low @ low.T)
    for i in range(20):
        assert abs(d2[i] - (x[i] - centre) @ inverse @ (x[i] - centre)) < 1e-6 * max(1, d2[i])


def test_planted_outliers_do_not_move_the_estimate(spark):
    """20 % far points: the robust scatter stays that of the clean rows, in both
    sources, and rejects all far points and hardly a clean one."""
    rng = np.random.default_rng(1)
    mixing = np.diag([1.0, 0.5, 0.4, 0.6, 0.8]) @ (np.eye(5) + 0.3 * rng.normal(size=(5, 5)))
    rows = []
    for source, shift in (("a", 0.0), ("b", 5.0)):
        clean = rng.normal(size=(800, 5)) @ mixing.T + shift
        far = rng.normal(size=(200, 5)) * 0.3 + shift + np.array([0, 6, -6, 6, 0])
        rows += [(source, v) for v in clean] + [(source, v) for v in far]
    df = vectors(spark, rows)
    units, est = Q.estimate(df)
    floors = np.diag([f * f for f in Q.FLOORS.values()])
    for r in est.join(units, "unit").collect():
        low = np.array([[r[f"l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
        want = mixing @ mixing.T + floors
        assert np.abs(low @ low.T - want).max() < 0.25 * np.abs(want).max()
    d = Q.with_distance(df.join(units.join(est, "unit"), ["lang", "source"])).select("doc_id", "d2").collect()
    limit = Q.chi2_quantile(1 - 1e-4, 5)
    far = [r.d2 > limit for r in d if r.doc_id % 1000 >= 800]
    near = [r.d2 > limit for r in d if r.doc_id % 1000 < 800]
    assert all(far) and sum(near) <= 8


def test_small_pairs_are_pooled(spark):
    rows = [("big", np.arange(5) + i % 7) for i in range(100)] + [(f"s{i}", np.arange(5) + i % 5) for i in range(30)]
    units = {r.source: r.unit for r in Q._units(vectors(spark, rows), 60).collect()}
    assert units["s3"] == units["big"]  # the pool of 30 joins the largest pair
    units = {r.source: r.unit for r in Q._units(vectors(spark, rows), 20).collect()}
    assert units["s3"] == "l:en" != units["big"]


def test_plan_is_native(spark):
    plan = Q.verdicts(data.documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
