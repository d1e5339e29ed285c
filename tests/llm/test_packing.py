import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hookline.llm import packing as K

from . import data

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, docs):
    """Pieces and places against the library's own ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tok = Tokenizer.from_file(PATH)
    want = defaultdict(int)
    for doc_id, text in docs:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % 1024 or 1024
        starts = [0, *range(first, len(ids), 1024)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    got = defaultdict(int)
    by = defaultdict(list)
    for r in rows:
        got[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        by[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by), sum(r.length for r in rows)


def test_documents_are_packed_whole(spark):
    rows = K.pack_documents(data.documents(spark), PATH).collect()
    bins, total = check(rows, data.texts().items())
    assert bins <= 1.02 * -(-total // 1024) + 1


def test_edge_cases_and_several_groups(spark):
    rows = K.pack_documents(data.edge_docs(spark), PATH, group_pieces=5).collect()
    check(rows, [(r[0], r[1]) for r in data.ROWS])


def test_empty_table(spark):
    assert K.pack_documents(data.empty_docs(spark), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_any_sizes_fit_and_bound_holds(sizes):
    bins = K.pack_group(np.array(sizes, np.int64), 100)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) >= K.lower_bound(sizes, 100)
    assert len(bins) <= len(K.best_fit_decreasing(sizes, 100))


def test_exchange_empties_a_bin():
    # One for one (5 for 4) fills a bin; the 4 then moves and its bin is empty.
    sizes = [3, 3, 5, 4, 5]
    bins = K.LocalSearch(sizes, [[0, 1], [2, 3], [4]], 10).run()
    assert sorted(sorted(sizes[i] for i in b) for b in bins) == [[3, 3, 4], [5, 5]]


def test_two_for_one():
    # No single piece can move or be exchanged; two fours for the seven can.
    sizes = [4, 4, 7, 2]
    search = K.LocalSearch(sizes, [[0, 1], [2, 3]], 10)
    assert search.step(0)
    assert sorted(sorted(sizes[i] for i in b) for b in search.bins) == [[2, 4, 4], [7]]
    assert search.fill == [7, 10]


def test_lower_bound_counts_large_pieces():
    assert K.lower_bound([60, 60, 60], 100) == 3
    assert K.lower_bound([], 100) == 0
