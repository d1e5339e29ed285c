import hashlib
import re

import duckdb

from hookline.llm import decontam as D
from hookline.llm.oracles import OP3
from hookline.llm.queries import QUERIES

from . import data

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items):
    def split(t):
        return PATTERN.findall((t or "").translate(data.UPPER))

    windows = {}
    for item_id, text in items:
        w = split(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item_id))
    out = []
    for doc_id, text in docs:
        w, hit, own = split(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                found = windows.get(tuple(w[i : i + size]))
                if found:
                    hit.update(range(i, i + size))
                    own |= found
        out.append((str(doc_id), len(w), sorted(hit), sorted(own)))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.h2.n_words, list(r.h2.words), list(r.h2["items"])) for r in df.collect())


ITEMS = [(1, "short one"), (2, " ".join(f"alpha{i} beta{i * 7 % 53}" for i in range(3))), (2, None), (None, "two lines"),
         (3, data.LONG[:3000]), (4, ""), (5, "Naïve CAFÉ"), (5, "Naïve CAFÉ"), (10, "gamma0 alpha1 beta7")]


def benchmark(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string")


def test_edge_cases(spark):
    docs = [(r[0], r[1]) for r in data.ROWS]
    want = brute(docs, [(i, t) for i, t in ITEMS if i is not None])
    df = D.contamination(data.edge_docs(spark), benchmark(spark), "h2")
    assert got(df) == want
    assert any(w[2] for w in want)
    # Blocks of a larger benchmark give the same.
    blocks = D.contamination(data.edge_docs(spark), benchmark(spark), "h2", max_block_bytes=40)
    assert got(blocks) == want


def test_empty_tables(spark):
    assert D.contamination(data.empty_docs(spark), benchmark(spark), "h2").count() == 0
    none = D.contamination(data.edge_docs(spark), benchmark(spark, []), "h2").collect()
    assert len(none) == len(data.ROWS) and all(r.h2.n_hit == 0 for r in none)


def test_spans_point_into_the_original(spark):
    text = "Ä début: THE quick, brown-fox jümps  over\nthe lazy dog again today! end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = benchmark(spark, [(7, "the quick brown fox jümps over the lazy dog again")])
    r = D.contamination(docs, items, "h2").first().h2
    assert [text[s.start : s.end] for s in r.spans] == ["THE quick, brown-fox jümps  over\nthe lazy dog again"]
    assert r.n_hit == 10


def test_query_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data.SF}/{t}.parquet')")
    rel = con.sql(OP3)
    df = QUERIES["op3_aho_corasick"](spark, data.SF)
    assert sorted(tuple(r[c] for c in rel.columns) for r in df.collect()) == sorted(rel.fetchall())
    assert hashlib.sha256(b"").hexdigest() in {r.items_sha256 for r in df.collect()}
