import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hookline.llm import token_files as K

from . import data

PATH = public_tokenizers.path("byte_bpe_50k.json")

mixed = st.lists(
    st.one_of(st.integers(0, 1), st.integers(0, 255), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=700)


@settings(max_examples=150, deadline=None)
@given(mixed)
def test_any_ids_come_back(values):
    ids = np.array(values, np.uint64)
    assert K.decode_block(K.encode_block(ids)).tolist() == values


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 6000), st.integers(0, 6000))
def test_any_range_comes_back(seed, a, b):
    rng = np.random.default_rng(seed)
    ids = np.where(rng.random(5000) < 0.03, rng.integers(0, 2**40, 5000), rng.integers(0, 3000, 5000)).astype(np.uint64)
    data_ = K.encode_block(ids)
    assert K.decode_block(data_, a, b).tolist() == ids[a:b].tolist()


def greedy(values):
    """Words by the published rule, one value at a time."""
    out, at = [], 0
    while at < len(values):
        for s, (count, bits) in enumerate(zip(K.COUNTS.tolist(), K.BITS.tolist())):
            part = values[at : at + count]
            if all(v < 1 << bits for v in part):
                out.append(s << 60 | sum(v << i * bits for i, v in enumerate(part)))
                at += count
                break
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 0), st.integers(0, 9), st.integers(0, 70_000), st.integers(0, 2**60 - 1)), max_size=400))
def test_words_follow_the_selectors(values):
    assert K.pack(np.array(values, np.uint64)).tolist() == greedy(values)


def test_few_large_ids_are_escaped():
    ids = np.full(10_000, 900, np.uint64)
    ids[::100] = 2**45
    plain = len(K.pack(ids))
    words, escapes = K._HEAD.unpack_from(K.encode_block(ids))[2:4]
    assert escapes == 100 and words + escapes < plain
    assert len(K.encode_block(np.zeros(24_000, np.uint64))) < 24_000 / 240 * 8 + 100


def test_other_bytes_are_refused():
    with pytest.raises(ValueError):
        K.decode_block(b"x" * 100)


def want(docs):
    tok = Tokenizer.from_file(PATH)
    out, at = [], 0
    for doc_id, text in docs:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).orderBy("start").collect()]


def test_documents_come_back(spark, tmp_path):
    K.write(data.documents(spark), PATH, str(tmp_path / "a"), files=3, block_ids=5_000)
    assert rows(K.read(spark, str(tmp_path / "a"))) == want(sorted(data.texts().items()))
    ids = sorted(data.texts())
    some = K.read(spark, str(tmp_path / "a"), ids[20], ids[40])
    assert sorted(r.doc_id for r in some.collect()) == ids[20:41]


def test_edge_cases(spark, tmp_path):
    K.write(data.edge_docs(spark), PATH, str(tmp_path / "a"), files=4, block_ids=50)
    got = rows(K.read(spark, str(tmp_path / "a")))
    plain = [(r[0], r[1]) for r in data.ROWS]
    by_id = sorted(plain, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [g[0] for g in got] == [d for d, _ in by_id]
    assert sorted((str(g[0]), *g[2:]) for g in got) == sorted((str(w[0]), *w[2:]) for w in want(plain))
    assert [g[1] for g in got] == np.cumsum([0, *[g[2] for g in got]])[:-1].tolist()


def test_empty_table(spark, tmp_path):
    K.write(data.empty_docs(spark), PATH, str(tmp_path / "a"))
    assert K.read(spark, str(tmp_path / "a")).count() == 0


def test_rows_of_one_id_are_split(spark, tmp_path):
    docs = spark.range(4_000).select(F.lit(7).alias("doc_id"), F.lit("the same text").alias("text"))
    K.write(docs, PATH, str(tmp_path / "a"), files=4)
    sizes = [r.n_docs for r in spark.read.parquet(str(tmp_path / "a/manifest")).collect()]
    assert sum(sizes) == 4_000 and max(sizes) < 2_000
