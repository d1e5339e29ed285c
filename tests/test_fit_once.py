"""Forest fits: rows are made once, and keeping each row's node changes no tree."""

from pyspark.sql import functions as F

from hookline import constants as K
from hookline.functions import features as FT
from hookline.operators import corpus as CO
from hookline.operators import train as TR
from hookline.plans import catalog as C


def typed_rows(spark, n=240):
    rows = [(i, "made", f"http://h{i}.example.com/{'a' * (i % 9)}", K.CLASSES[i % 4], "test" if i % 10 == 0 else "train",
             float(i % 4 + i % 3), float(i % 7)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, source string, url string, type string, split string, x double, y double").repartition(3, "id")


def counting(df, column):
    """`df` whose `column` passes a UDF that counts the rows it is called for."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    @F.udf("string")
    def passed(v):
        seen.add(1)
        return v

    return df.withColumn(column, passed(column)), seen


def trees_of(model):
    return model.stages[-1].toDebugString.split("\n", 1)[1]


def test_rows_are_made_once_for_a_fit(spark):
    df, seen = counting(typed_rows(spark), "type")
    TR.fit(df, ["x", "y"], TR.random_forest(3, 4))
    assert seen.value == 240
    assert not df.storageLevel.useMemory


def test_fit_leaves_rows_kept_that_the_caller_kept(spark):
    df = typed_rows(spark).persist()
    TR.fit(df, ["x", "y"], TR.random_forest(2, 3))
    assert df.storageLevel.useMemory
    df.unpersist()


def test_kept_nodes_change_no_tree(spark):
    df = typed_rows(spark)
    forest = TR.random_forest(5, 8)
    assert forest.getCacheNodeIds()
    kept = TR.fit(df, ["x", "y"], forest)
    walked = TR.fit(df, ["x", "y"], TR.random_forest(5, 8).setCacheNodeIds(False))
    assert trees_of(kept) == trees_of(walked)


def test_ranks_from_counted_rows(spark):
    df = typed_rows(spark).withColumn("key", F.concat_ws(":", F.col("source"), (F.col("id") % 200).cast("string")))
    made, seen = counting(df, "url")
    ranked = CO.split_assignments(made, "type", "key", counted=df.select("type", "key"))
    names = ["type", "key", "split", "fold", "step", "cls_rank", "cls_n"]
    got = ranked.select("url", *names).collect()
    assert seen.value == 240
    want = CO.split_assignments(df, "type", "key").select(*names).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(map(tuple, want))


def test_train_frame_counts_rows_without_features(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(CO, "split_assignments", lambda df, *a, **k: seen.update(k) or df)
    C._train_frame(spark, "/root/testdata/sf0.001")
    assert seen["counted"].columns == ["type", "key"]


def test_scored_rows_are_made_once(spark, monkeypatch):
    base = typed_rows(spark, 80).drop("x", "y").select("*", *[
        F.pmod(F.xxhash64("id", F.lit(i)), F.lit(5)).cast("double").alias(c) for i, c in enumerate(FT.MAIN_NATIVE_FEATURES)])
    df, seen = counting(base, "type")
    df = df.withColumn("split", F.when(F.col("type") == "x", "test").otherwise(F.col("split")))
    forest = TR.random_forest
    monkeypatch.setattr(C, "_train_frame", lambda *a: df)
    monkeypatch.setattr(TR, "random_forest", lambda: forest(3, 4))
    got = C.q_score_with_model(spark, "").collect()
    assert len(got) == 80 and seen.value == 80


def test_rows_of_the_binary_forest_are_made_once(spark, monkeypatch):
    df, seen = counting(typed_rows(spark).select("id", "source", "url", "type"), "url")
    monkeypatch.setattr(C.D, "typed_urls", lambda *a: df)
    got = C.q_predict_from_record(spark, "")
    assert seen.value == 240
    assert got.count() == 240
