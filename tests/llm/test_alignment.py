import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hookline.llm import alignment as K

from . import data

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Brute:
    """The rules on whole texts, with the libraries alone."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        plain = K._byte_of_character()
        self.bytes_a = {i: bytes(plain[c] for c in e) for e, i in self.a.get_vocab(with_added_tokens=False).items()}

    def bytes_b(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        raw = (" " + text).encode()
        ba, bb = [self.bytes_a[i] for i in a], [self.bytes_b(i) for i in b]
        if b"".join(ba) != raw or b"".join(bb) != raw:
            return []
        out, x, y, i, j = [([], [])], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if x <= y and i < len(a):
                out[-1][0].append(a[i])
                x, i = x + len(ba[i]), i + 1
            else:
                out[-1][1].append(b[j])
                y, j = y + len(bb[j]), j + 1
            if x == y and out[-1][0] and out[-1][1]:
                out.append(([], []))
        return out[:-1]

    def rows(self, docs):
        found = [(d, self.groups(t)) for d, t in docs]
        links = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in found]
        count = Counter(p for many in links for p in many)
        most = defaultdict(int)
        for (x, _), n in count.items():
            most[x] = max(most[x], n)
        for (d, g), many in zip(found, links):
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            yield (
                d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(many.values()),
                sum(m for p, m in many.items() if count[p] == most[p[0]]), sum(m * count[p] for p, m in many.items()),
                hashlib.sha256(text.encode()).hexdigest() if g else "",
            )


def key(row):
    return str(row)


def test_documents_equal_brute_force(spark):
    got = [tuple(r) for r in K.alignments(data.documents(spark), A, B).collect()]
    assert sorted(got, key=key) == sorted(Brute().rows(data.texts().items()), key=key)


TRICKY = [
    "a \n b", "\n\nx  y\t z ", "tabs\t\tand   blanks  ", " leading", "trailing ", "   ", "it's we'll  I'd",
    "▁ already", "a▁b", "　wide　 blank", "no break   x", "<0x41> <s> </s> <unk>",
    "日本語のテキスト。改行なし", "\x1f sep \x85 next", "emoji 😀😀 👩‍👩‍👧", "a​ b ﻿ c", "===== ---- ....  ", "\r\n {\r\n}",
]


def test_edge_cases_in_small_chunks(spark):
    rows = [(r[0], r[1]) for r in data.ROWS] + [(100 + i, t) for i, t in enumerate(TRICKY)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        index = K.build_index(docs, A, B, chunk_docs=128)
        got = [tuple(r) for r in K.document_scores(index, K.pair_table(index)).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    assert sorted(got, key=key) == sorted(Brute().rows(rows), key=key)


def test_clashing_columns_and_empty_table(spark):
    docs = data.edge_docs(spark)
    assert K.alignments(docs, A, B).count() == len(data.ROWS)
    assert K.alignments(data.empty_docs(spark), A, B).count() == 0


def test_whole_groups(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    shown = K.alignments(docs, A, B, whole_groups=True).first().groups
    assert shown == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in Brute().groups("one two"))


def test_pair_table(spark):
    docs = data.edge_docs(spark)
    index = K.build_index(docs, A, B)
    count, links = Counter(), Counter()
    for r in data.ROWS:
        many = Counter((x, y) for a, b in Brute().groups(r[1]) for x in a for y in b)
        count.update(many.keys())
        links.update(many)
    got = {(r.a, r.b): (r.n_docs, r.n_links) for r in K.pair_table(index).collect()}
    assert got == {p: (count[p], links[p]) for p in count}


posts = st.lists(st.tuples(st.integers(0, 6), st.integers(0, 300), st.integers(1, 9)), max_size=80)


@settings(max_examples=100, deadline=None)
@given(posts, posts)
def test_bitmaps_count_and_merge(left, right):
    right = [(p, d + 320, m) for p, d, m in right]

    def made(rows):
        p, d, m = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        return K.PairBitmaps.of(p, d, m)

    both = K.PairBitmaps.from_bytes(*made(left).union(made(right)).to_bytes())
    want = Counter()
    for p, d, m in left + right:
        want[p, d] += m
    got = Counter()
    for p, d, m in zip(*(v.tolist() for v in both.postings())):
        got[int(both.pairs[p]), d] += m
    assert got == want
    docs, links = both.popcounts()
    assert dict(zip(both.pairs.tolist(), docs.tolist())) == Counter(p for p, _ in want)
    assert links.sum() == sum(want.values())


def test_large_groups_are_counted_first(monkeypatch):
    rng = np.random.default_rng(5)
    group_a, group_b = np.sort(np.r_[0:9, rng.integers(0, 9, 90)]), np.sort(np.r_[0:9, rng.integers(0, 9, 70)])
    a, b = rng.integers(0, 4, len(group_a)), rng.integers(0, 4, len(group_b))
    want = Counter((int(g), int(x), int(y)) for x, g in zip(a, group_a) for y, k in zip(b, group_b) if g == k)
    for limit in (0, 60, 1 << 12):
        monkeypatch.setattr(K, "LARGE_GROUP", limit)
        got = Counter()
        group, left, right, times = (v.tolist() for v in K._links(a, b, group_a, group_b, 9))
        for g, x, y, n in zip(group, left, right, times):
            got[g, x, y] += n
        assert got == want and group == sorted(group)
