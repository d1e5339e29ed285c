"""Batch measures against the column functions of the same names; rows dealt over the tasks."""

import pytest
from pyspark.sql import functions as F

from hookline.functions import features as FT
from hookline.functions import text as T
from hookline.functions.measures import Measures, NativeMeasures
from hookline.session import parallelism

ODD = [None, "", " ", "\n\n\n", "aaa\n\n\n\nbb", "http://exämple.com/päth?q=ß", "HTTP://İstanbul/K12", "日本語.jp/路径", "😀😀😀.x😀",
       "paypa1-login.tk/verify.exe?x=1&&y=22#f", "a", "ab", "  x", "user@@h.com/!!**", "\x00\x7f\x80~"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(ODD)), "id int, s string").coalesce(1)


@pytest.mark.parametrize("kind", [Measures, NativeMeasures])
def test_same_as_column_functions(texts, kind):
    words = ["paypa1", "login", "x", "verify", "ß", "a.b", "&&"]
    classes = ["[0-9]", r"\p{L}", r"\p{Lu}", r"[^\p{L}\p{N}]", "[@!*]", r"\.", "[^A-Za-z0-9]"]
    s, m = F.col("s"), kind()
    asked = {}
    for name, f in (("one", T), ("many", m)):
        asked[name] = [
            *[f.count_re(s, c) for c in classes], F.round(f.entropy(s, True), 9), F.round(f.entropy(s, False), 9), f.longest_run(s),
            f.longest_match(s, "[bcdfgh]" if name == "many" else "[bcdfgh]+"), f.longest_token(s, r"[./?=&_-]"),
            f.ngram_diversity(s, 2), f.ngram_diversity(s, 3), f.any_literal(s, words), f.count_present(s, words),
        ]
    for row in m.add(texts).select("id", F.array([c.cast("string") for c in asked["one"]]).alias("a"),
                                   F.array([c.cast("string") for c in asked["many"]]).alias("b")).collect():
        assert row.a == row.b, ODD[row.id]


def test_many_batches_and_no_rows(spark, texts):
    m = Measures()
    c = m.longest_run(F.col("s"))
    assert m.add(texts.where("id < 0")).select(c).count() == 0
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = [r[0] for r in m.add(texts).orderBy("id").select(c).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == [r[0] for r in texts.orderBy("id").select(T.longest_run("s")).collect()]


def test_rows_of_one_file_are_dealt(spark, texts):
    rows = texts.select("id", F.col("s").alias("url"))
    for f in (FT.featurize_main, FT.featurize_v1, FT.featurize_v2, FT.featurize_decoded, FT.featurize_host29,
              FT.featurize_subst_aware, lambda d: FT.featurize_draft63(d, native_only=True)):
        assert f(rows).rdd.getNumPartitions() == parallelism(spark)
