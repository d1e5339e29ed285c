"""Neighbours against brute force; oversampling; the shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hookline.operators import balance as X
from hookline.operators import corpus as CO


def data(spark, n=700, seed=1, parts=4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        c = "abc"[int(rng.choice(3, p=[0.7, 0.25, 0.05]))]
        v = rng.integers(0, 6, 3).astype(float) if rng.random() < 0.6 else rng.normal(size=3) * 4
        rows.append((c, f"k{i}", *map(float, v)))
    rows += [("c", f"same{i}", 1.0, 1.0, 1.0) for i in range(9)]
    return spark.createDataFrame(rows, "type string, key string, x double, y double, z double").repartition(parts)


def brute_near(points, k):
    """First k neighbours of each point, copies counted, as sorted (distance, vector) lists."""
    out = {}
    for p in points:
        others = []
        for q in points:
            if q.label == p.label and q.pid != p.pid:
                d = float(np.sqrt(((np.array(p.v) - np.array(q.v)) ** 2).sum()))
                others.append((d, tuple(q.v), q.copies))
        need, found = k - (p.copies - 1), []
        for d, v, n in sorted(others):
            if need <= 0:
                break
            found.append((d, v, n))
            need -= n
        out[p.pid] = found
    return out


@pytest.mark.parametrize("chunk, part, pivots", [(2048, 8192, 512), (20, 30, 6), (7, 9, 40)])
def test_neighbours_equal_brute_force(spark, monkeypatch, chunk, part, pivots):
    monkeypatch.setattr(X, "CHUNK_POINTS", chunk)
    monkeypatch.setattr(X, "PART_QUERIES", part)
    monkeypatch.setattr(X, "MOST_PIVOTS", pivots)
    rows = data(spark).select(F.col("type").alias("label"), F.array("x", "y", "z").alias("v"))
    points = X._points(rows)
    want = brute_near(points.collect(), 5)
    for r in X.nearest_in_class(points, 5, 3).collect():
        got, need = [], 5 - (r.copies - 1)
        for d, v, n in r.near or []:
            if need > 0:
                got.append((d, tuple(v), n))
                need -= n
        assert got == want[r.pid]


def as_set(df):
    return sorted(tuple(r) for r in df.collect())


def test_smote_fills_up_the_classes(spark):
    df = data(spark)
    got = X.smote(df, ["x", "y", "z"], "type", "key").cache()
    sizes = {r.type: r["count"] for r in got.groupBy("type").count().collect()}
    assert len(set(sizes.values())) == 1
    assert as_set(got.where("not synthetic").drop("synthetic")) == as_set(df.drop("key"))
    # Each new row lies between a row and one of its five nearest neighbours.
    by = {}
    for r in df.collect():
        by.setdefault(r.type, []).append((r.x, r.y, r.z))
    for label, x, y, z in got.where("synthetic").drop("synthetic").collect():
        p, rows = np.array([x, y, z]), np.array(by[label])
        near = False
        for i, base in enumerate(rows):
            d = np.sqrt(((rows - base) ** 2).sum(axis=1))
            d[i] = -1
            limit = np.sort(d)[min(5, len(d) - 1)]
            for other in rows[(d <= limit) & (np.arange(len(d)) != i)]:
                way = other - base
                t = np.dot(p - base, way) / max(np.dot(way, way), 1e-300)
                if -1e-9 <= t <= 1 + 1e-9 and np.abs(base + t * way - p).max() < 1e-9:
                    near = True
                    break
            if near:
                break
        assert near


def test_smote_does_not_depend_on_the_partitioning(spark):
    one = X.smote(data(spark, 200, parts=1), ["x", "y", "z"], "type", "key")
    many = X.smote(data(spark, 200, parts=7), ["x", "y", "z"], "type", "key")
    assert as_set(one) == as_set(many)


def test_smote_edge_cases(spark):
    schema = "type string, key string, x double"
    rows = [("a", str(i), float(i)) for i in range(6)] + [("b", "one", 5.0), ("c", "n", None), (None, "m", 1.0)]
    got = X.smote(spark.createDataFrame(rows, schema), ["x"], "type", "key").collect()
    assert [r.x for r in got if r.synthetic] == [5.0] * 5  # a class of one row repeats it
    assert len(got) == len(rows) + 5
    assert X.smote(spark.createDataFrame([], schema), ["x"], "type", "key").count() == 0


def test_shuffle_is_a_permutation_on_any_partitioning(spark):
    def made(parts):
        df = spark.range(3_000).select(F.pmod(F.col("id"), F.lit(1000)).cast("string").alias("url"), "id").repartition(parts)
        return sorted((r.position, r.url, r.id) for r in CO.shuffle(df, "url", 7).collect())

    one = made(1)
    assert one == made(5)
    assert [p for p, _, _ in one] == list(range(3_000)) and [i for *_, i in one] != sorted(i for *_, i in one)


def test_shuffle_of_equal_rows_and_of_none(spark):
    same = spark.range(500).select(F.lit(None).cast("string").alias("url"))
    assert sorted(r.position for r in CO.shuffle(same, "url", 7).collect()) == list(range(500))
    assert CO.shuffle(same.limit(0), "url", 7).count() == 0


def test_stacked_frames_with_other_columns_warn(spark):
    a = spark.createDataFrame([("u", "benign")], "url string, type string")
    b = spark.createDataFrame([("phishing", 1)], "type string, n int")
    with pytest.warns(UserWarning, match="frame 2"):
        got = CO.merge_same_schema([a, b])
    assert sorted(map(tuple, got.collect()), key=str) == [("u", "benign", None), (None, "phishing", 1)]


def test_tokens_are_letters_and_digits(spark):
    got = [r.t for r in spark.range(500).select(CO.random_token(F.col("id"), 6).alias("t")).collect()]
    assert all(len(t) == 6 for t in got) and len(set(got)) == 500
    assert set("".join(got)) == set("abcdefghijklmnopqrstuvwxyz0123456789")
