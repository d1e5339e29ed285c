import zlib

from pyspark.sql import functions as F

from hookline.llm import ordinal as O
from hookline.llm import toxicity as T
from hookline.llm.queries import QUERIES

from . import data


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def made(n):
    """Every third text holds a bad word, a bad pair or a bad skip pair."""
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        core = [f"w{i * k % 37}" for k in range(1, 12)]
        core[5:5] = [["vile"], ["very", "nasty"], ["you", f"w{i % 37}", "fool"]][i // 3 % 3] if bad else []
        core += [] if bad else [["nasty", "very"], ["fool"], ["very"]][i // 3 % 3]
        rows.append((i, " ".join(core), int(bad)))
    return rows


def test_learns_words_pairs_and_skip_pairs_on_held_out_rows(spark):
    rows = made(1500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = T.train(docs, labels(spark, [(i, 1, y) for i, _, y in rows]))
    got = {r.doc_id: r.s for r in T.toxicity(docs, model, "s").collect()}
    test = [(got[i] >= 0.5, y) for i, _, y in rows if held(i)]
    assert sum(p == bool(y) for p, y in test) > 0.95 * len(test)
    weights = model.count()
    assert weights < 600  # sparse: most coordinates are zero


def test_held_out_and_labels_do_not_leak(spark):
    rows = made(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    a = T.train(docs, labels(spark, [(i, 1, y) for i, _, y in rows]))
    b = T.train(docs, labels(spark, [(i, 1, 1 - y if held(i) else y) for i, _, y in rows]))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    flags = {r.doc_id: r.h for r in docs.select("doc_id", T.held_out().alias("h")).collect()}
    assert flags == {i: held(i) for i in flags}


def test_edge_cases(spark):
    docs = data.edge_docs(spark)
    marks = labels(spark, [(1, 1, 1), (2, 0, 0), (2, 0, 1), (7, 1, None), (None, 1, 1), (4, 1, 0), (99, 1, 7)])
    model = T.train(docs, marks)
    out = T.toxicity(docs, model, "s")
    assert out.columns == [*docs.columns, "s"]
    got = out.collect()
    assert len(got) == len(data.ROWS) and all(0 <= r.s <= 1 for r in got)
    assert len({r.s for r in got if r.doc_id in (4, 5, 6)}) == 1
    none = T.toxicity(docs, T.train(docs, labels(spark, [])), "s").collect()
    assert {r.s for r in none} == {0.5}
    assert T.toxicity(data.empty_docs(spark), model, "s").count() == 0


def test_query_shape(spark):
    df = QUERIES["op9_ftrl_toxicity"](spark, data.SF)
    assert df.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert df.count() == len(data.texts())


def test_ordinal_grades_rise_with_the_text(spark):
    words = ["awful", "fair", "great"]
    rows = [(i, " ".join([words[i % 3]] + [f"w{i * k % 41}" for k in range(1, 15)]), i % 3) for i in range(1200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    rated = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int")
    model = O.train(docs, rated, 3)
    out = O.expected_grades(docs, model, 3, "p").collect()
    test = [(r.p[0] + r.p[1], r.doc_id % 3) for r in out if held(r.doc_id)]
    means = [sum(e for e, g in test if g == k) / sum(1 for _, g in test if g == k) for k in range(3)]
    assert means[0] < 0.4 < 0.6 < means[1] < 1.4 < 1.6 < means[2]
    assert all(r.p[0] >= r.p[1] for r in out)  # ordered thresholds


def test_ordinal_edge_cases(spark):
    docs = data.edge_docs(spark)
    rated = spark.createDataFrame([(1, 0), (2, 2), (3, None), (None, 1), (4, 2), (7, 9)], "doc_id long, grade int")
    out = O.expected_grades(docs, O.train(docs, rated, 3), 3, "p")
    assert out.count() == len(data.ROWS)
    none = spark.createDataFrame([], "doc_id long, grade int")
    flat = O.expected_grades(docs, O.train(docs, none, 3), 3, "p").select(F.col("p")[0]).distinct().collect()
    assert len(flat) == 1
    assert O.expected_grades(data.empty_docs(spark), O.train(docs, rated, 3), 3, "p").count() == 0
