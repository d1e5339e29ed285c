import zlib

from pyspark.sql import functions as F

from hookline.llm import jump_shard as J

from . import data


def jump(key, shards):
    """The published loop over 64-bit integers."""
    key &= 2**64 - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_matches_the_published_loop(spark):
    keys = [0, 1, 2, -1, -(2**63), 2**63 - 1, *range(100, 2000, 7)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 40, 41, 1000):
        got = {r.k: r.s for r in df.select("k", J.jump_hash(F.col("k"), n).alias("s")).collect()}
        assert got == {k: jump(k, n) for k in keys}


def check(rows, docs, shards=40):
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), jump(i or 0, shards),
                   jump(i or 0, shards + 1)) for i, t in docs)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32, r.shard, r.grown_shard) for r in rows) == want
    for s in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, shards) for r in rows)
    assert all(r.law == "key" for r in rows)


def test_documents(spark):
    check(J.assign_shards(data.documents(spark), 40).collect(), data.texts().items())


def test_edge_cases_and_empty(spark):
    check(J.assign_shards(data.edge_docs(spark), 40).collect(), [(r[0], r[1]) for r in data.ROWS])
    assert J.assign_shards(data.empty_docs(spark), 40).count() == 0


def test_only_new_shards_receive_rows(spark):
    docs = spark.range(20_000).withColumnRenamed("id", "doc_id")
    r = J.moved_fraction(docs, "doc_id", 40, 41).first()
    assert r.moved_among_old == 0
    assert abs(r.moved / r.rows - 1 / 41) < 0.006
    names = docs.select(F.col("doc_id").cast("string").alias("name"))
    sizes = [r["count"] for r in names.select(J.jump_hash(J.key_of(names, "name"), 10).alias("s")).groupBy("s").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 1.1 * min(sizes)
