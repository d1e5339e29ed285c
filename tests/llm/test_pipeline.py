import duckdb

import corpus_pipeline as P
from hookline.llm import common as C
from hookline.llm.oracles import OP3

from . import data
from .test_quality import counts
from .test_trie import brute


def test_stages_follow_brute_force(spark):
    """Each stage on what its predecessor kept, on the small tables."""
    first = C.table(spark, data.SF, "documents")
    docs, kept = first, []
    for name, stage in P.STAGES[:-1]:
        docs = C.stage(stage(spark, docs, data.SF), name)
        assert docs.columns == first.columns
        kept.append({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    text = data.texts()
    good, clean, one, left = kept
    base = {i: t for i, t in text.items() if not counts(t)[0][-1]}
    assert set(good) <= set(base)
    # Clean prose stays: what is rejected besides is rich in symbols.
    assert all(counts(t)[0][2] > 0.03 * counts(t)[0][1] for i, t in base.items() if i not in good)
    assert set(clean) <= set(good) and len(clean) > 0.8 * len(good)
    groups = brute(sorted(clean.items()), 5, 80)
    assert set(one) == {int(c) for _, _, c in groups}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data.SF}/documents.parquet')")
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{data.SF}/benchmark.parquet')")
    hit = {r[0] for r in con.sql(f"SELECT doc_id FROM ({OP3}) WHERE contaminated").fetchall()}
    assert set(left) == set(one) - hit
    rows = P.STAGES[-1][1](spark, docs, data.SF).collect()
    assert {r.doc_id for r in rows} == set(left)


def test_edge_cases(spark):
    docs = data.edge_docs(spark)
    for name, stage in P.STAGES[:-1]:
        out = C.stage(stage(spark, docs, data.SF), name)
        assert out.columns == docs.columns
        assert C.stage(stage(spark, data.empty_docs(spark), data.SF), name).count() == 0
    assert P.STAGES[-1][1](spark, docs, data.SF).count() > 0
