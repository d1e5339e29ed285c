import os
import uuid

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hookline.llm import token_cache as T
from hookline.session import checkpoint_dir

from . import data

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(PATH)


def want(library, docs):
    return sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in docs)


def got(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in df.collect())


def cache(spark):
    return f"{checkpoint_dir(spark)}/test-cache-{uuid.uuid4().hex}"


def test_counts_and_reuse(spark, library):
    path = cache(spark)
    docs = data.documents(spark)
    half = docs.where("doc_id % 2 = 0")
    assert got(T.token_counts(half, PATH, path)) == want(library, [x for x in data.texts().items() if x[0] % 2 == 0])
    stored = spark.read.parquet(path).count()
    assert stored == half.select("text").distinct().count()
    assert got(T.token_counts(docs, PATH, path)) == want(library, data.texts().items())
    again = T.token_counts(docs, PATH, path)
    assert got(again) == want(library, data.texts().items())
    assert spark.read.parquet(path).count() == docs.select("text").distinct().count()  # only misses were added


def test_edge_cases_and_empty(spark, library):
    rows = [(r[0], r[1]) for r in data.ROWS]
    path = cache(spark)
    assert got(T.token_counts(data.edge_docs(spark), PATH, path)) == want(library, rows)
    assert T.token_counts(data.empty_docs(spark), PATH, path).count() == 0


def test_normal_form_and_versions(spark, library):
    path = cache(spark)
    rows = [(1, "some  words\n here"), (2, " some words here\t"), (3, "some words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(T.token_counts(docs, PATH, path)) == want(library, rows)
    assert spark.read.parquet(path).count() == 1
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert T.tokenizer_version(PATH) != T.tokenizer_version(other)
    assert T.read_cache(spark, path, T.tokenizer_version(other)).count() == 0


def test_pieces_count_like_the_library(library):
    counter = T.PieceCounts(PATH)
    for c in [*range(1, 0x2100, 3), 0x130, 0x3A3, 0x1E9E, 0x1F600]:
        text = f"Ab{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}. don't {chr(c)}"
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), hex(c)
