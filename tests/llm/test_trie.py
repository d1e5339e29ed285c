import random

import numpy as np
import pytest

from hookline.llm import components as K
from hookline.llm import trie_join as T

from . import data


def brute(docs, n, percent):
    """Sets, and the smallest id reachable by links, from all pairs."""
    sets = []
    for _, t in docs:
        w = data.lower_words(t)
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                if 100 * len(a & b) >= percent * len(a | b):
                    up[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            low[find(i)] = min(low.get(find(i), doc_id), doc_id)
    return sorted((str(d), len(sets[i]), str(low.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(docs))


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_documents(spark, n, percent):
    docs = list(data.texts().items())
    df = T.near_duplicates(data.documents(spark), n, percent)
    assert got(df) == brute(docs, n, percent)


def test_edge_cases_and_empty(spark):
    docs = [(r[0], r[1]) for r in data.ROWS]
    assert got(T.near_duplicates(data.edge_docs(spark), 3, 90)) == brute(docs, 3, 90)
    assert T.near_duplicates(data.empty_docs(spark), 3, 90).count() == 0


def edited(rng, words, times):
    out = list(words)
    for _ in range(times):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def test_chains_copies_and_large_blocks(spark):
    """Many near copies of few texts, with links only through other copies, more
    than a trie holds: the second round has to find what the hubs miss."""
    rng = random.Random(5)
    docs = []
    for size in (12, 30, 60, 150, 400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(25):
            docs.append(edited(rng, base, rng.randrange(0, max(2, size // 22))))
            base = docs[-1] if rng.random() < 0.4 else base
    docs += [["the", "same", "passage", "of", "words", f"x{i}", "again"] for i in range(30)]
    rows = [(i + 1, " ".join(w)) for i, w in enumerate(docs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, percent in ((3, 90), (5, 80), (2, 70)):
        assert got(T.near_duplicates(df, n, percent, trie_sets=7)) == brute(rows, n, percent)


@pytest.mark.parametrize("held", [2 << 20, 40])
def test_sets_are_cut_to_what_others_hold(spark, monkeypatch, held):
    monkeypatch.setattr(T, "HELD", held)  # many chunks: the buckets do the work
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    docs = [edited(rng, base, rng.randrange(0, 12)) for _ in range(40)] + [[f"x{i}{j}" for j in range(30)] for i in range(9)]
    texts = [" ".join(w) for w in docs] + [" ".join(docs[0])]
    sets = {T._name(s): s for s in (T.shingle_set(t.encode(), 3) for t in texts)}
    grams, counts = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    shared = set(grams[counts > 1].tolist()) | set(T.shingle_set(texts[0].encode(), 3).tolist())  # its copy may lie in another chunk
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.node: (r.n, T._numbers(r.set).tolist()) for r in T.shared_sets(df, 3, 70, 64).collect()}
    short = {r.node: (r.n, T._numbers(r.set).tolist()) for r in T.shared_sets(df, 3, 70, 64, 44).collect()}
    assert short == {k: (n, [g >> 20 for g in kept]) for k, (n, kept) in got.items()}
    least = {k: [g for g in s.tolist() if g in set(grams[counts > 1].tolist())] for k, s in sets.items()}
    for name, s in sets.items():
        most = [g for g in s.tolist() if g in shared]
        if name in got:
            n, kept = got[name]
            assert n == len(s) and 100 * len(kept) >= 70 * n and set(least[name]) <= set(kept) <= set(most)
        else:
            assert 100 * len(least[name]) < 70 * len(s)


def test_trie_links_equal_all_pairs():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**40, 90).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(70, 91)], rng.integers(0, 2**40, rng.integers(0, 9)).astype(np.uint64)])) for _ in range(40)]
    known = T._Union()
    for a, b in T.trie_links([(i, i, s.tobytes()) for i, s in enumerate(sets)], 80):
        both = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)
        known.join(a, b)
    for i in range(40):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert known.find(i) == known.find(j)


@pytest.mark.parametrize("local", [250_000, 7])
def test_components_of_chains_and_stars(spark, monkeypatch, local):
    monkeypatch.setattr(K, "LOCAL_LINKS", local)  # many partitions: the joins do the work
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(300, 300), (500, 400)]
    df = spark.createDataFrame(links, "u long, v long").repartition(8)
    found = {r.node: r.component for r in K.components(df).collect()}
    assert {found[i] for i in range(1, 61)} == {1}
    assert {found[i] for i in range(100, 140)} == {100}
    assert found[500] == found[400] == 400 and 300 not in found


def test_keep_one_keeps_one_of_each_group(spark):
    docs = data.edge_docs(spark)
    kept = T.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert [ids.count(i) for i in (1, 2, 3, 4, 5, 6, 7, 8)] == [1, 0, 0, 1, 1, 1, 1, 1]
    assert ids.count(None) == 2
    assert T.keep_one(data.empty_docs(spark)).count() == 0


@pytest.mark.parametrize("percent", [1, 40, 66, 100])
def test_any_percent(spark, percent):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(edited(rng, base[: rng.randrange(5, 31)], rng.randrange(0, 8)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(T.near_duplicates(df, 2, percent, trie_sets=9)) == brute(rows, 2, percent)


def test_trie_links_of_cut_sets():
    """Sets given by their shared elements and their full sizes link like the whole ones."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**60, 80).astype(np.uint64)
    whole = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(60, 81)], rng.integers(2**61, 2**62, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(30)]
    cut = [(i, i, s[s < 2**60].tobytes()) for i, s in enumerate(whole)]
    full = T.trie_links([(i, i, s.tobytes()) for i, s in enumerate(whole)], 80)
    ends = [T._Union(), T._Union()]
    for known, links in zip(ends, (full, T.trie_links(cut, 80, sizes=[len(s) for s in whole]))):
        for a, b in links:
            known.join(a, b)
    assert all((ends[0].find(i) == ends[0].find(j)) == (ends[1].find(i) == ends[1].find(j)) for i in range(30) for j in range(i))
