"""N-gram Jaccard self-join with prefix trees.

A document's set holds the hashes of its distinct word n-grams, in one global
order (by hash).  Two documents link when 100 * |A and B| >= percent * |A or B|.

1.  Shared n-grams.  An n-gram that only one set holds is in no overlap.  Tasks send
    the n-grams of a chunk of documents, each once, to buckets by hash, and a bucket
    answers which of them others hold too; each set is cut down to those (its full size
    stays with it).  A set that keeps less than `percent` of its n-grams links with
    nothing and goes no further, so documents that merely share a passage end here.
2.  Groups.  Sets that link share one of their first n - ceil(t n) + 1 n-grams in any
    global order.  The order puts n-grams of one set alone first (they were counted in
    step 1 and are left out), then rare ones, by a count sketch of fixed size.  Sets
    connected by these n-grams form candidate groups, and links never leave a group.
3.  Tries.  The sets of a group are stored in a path-compressed prefix tree in
    their global order.  A new set walks the tree with the overlap of each shared
    prefix counted once, and a subtree is left when even all remaining elements
    could not reach the overlap that the sizes of its sets ask for.  Sets that are
    already connected are not compared again.
4.  Large groups (beyond `TRIE_SETS` sets).  The first round works around hubs (for
    each n-gram of step 2 the set with most shared ones), in tries that hold a hub and
    a bounded share of its sets.  Where the sets of such an n-gram are in several
    components after that, the sets outside the largest component meet all sets
    concerned, chunk by chunk, so that no link between components is missed and no task
    holds more than two chunks.

A set is named by 64 bits of its digest, so copies are one set from the start.  From
step 1 on, n-grams are the leading bits of their hashes, `SPARE_BITS` more than it takes
to count all n-grams of the corpus, and travel as differences of sorted ones.  The
components are those of all links; pairs inside a component need not all be emitted.

Edge cases: null and empty texts and texts without words have the empty set, link
with nothing and are their own component; texts with fewer than n words have one
n-gram, the whole text; repeated rows and copies are one set; rows that share a doc_id
but not the text are joined by their own texts; rows with a null doc_id link like others
and get the smallest doc_id of their component (null if it has none); an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hookline.llm import common as C
from hookline.llm.components import components

#: Sets in one trie, or in each of the two chunks of a large group, about.
TRIE_SETS = 400
#: N-grams of a chunk of documents, and of a bucket, about.
HELD, BUCKET_KEYS = 2 << 20, 1 << 18
#: Bits of an n-gram beyond those that count the n-grams of the corpus.
SPARE_BITS = 18
#: Counters of shared n-grams: 2**SKETCH_BITS.
SKETCH_BITS = 22
#: Stands for "several documents of the chunk" in place of one's number.
_SEVERAL = 0xFFFFFFFF

_HASHES = C.WordHashes()


# ------------------------------------------------------------------ sets and shared n-grams


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Distinct n-gram hashes in ascending order; empty without words."""
    words = C.lower_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = _HASHES.of(words)
    return np.unique(C.ngram_hashes(h, min(n, len(h))) ^ np.uint64(min(n, len(h))))


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, row key, n (set size) and node (name of the set) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, n) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_name(s) if len(s) else None for s in sets], pa.int64())],
                names=["doc_id", "key", "n", "node"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), C.row_key().alias("key"), F.col("text").cast("binary").alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, key long, n long, node long")


def _name(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


MESSAGE = "place long, chunk long, kind int, a binary, b binary"


def _message(place, chunk, kind: int, a: list[bytes], b: list[bytes]) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.broadcast_to(np.asarray(x, np.int64), n)) for x in (place, chunk)]
        + [pa.array(np.full(n, kind, np.int32)), pa.array(a, pa.binary()), pa.array(b, pa.binary())],
        names=["place", "chunk", "kind", "a", "b"])


def _parts(first: np.ndarray, x: np.ndarray) -> list[bytes]:
    return [C.planes(np.ascontiguousarray(part)) for part in np.split(x, first[1:])] if len(first) else []


#: Kinds of messages: n-grams asked for, shared n-grams with the numbers of their
#: documents, names and sizes of a chunk's sets.
_ASKED, _SHARED, _NAMES = range(3)


def _coded(s: np.ndarray) -> bytes:
    """Ascending numbers as differences, bytes of equal significance together."""
    return C.planes(np.diff(s, prepend=np.uint64(0)))


def _numbers(raw: bytes) -> np.ndarray:
    return np.cumsum(C.from_planes(raw, np.uint64))


def shared_sets(docs: DataFrame, n: int, percent: int, buckets: int, bits: int = 64) -> DataFrame:
    """node, n (full size) and set (coded n-grams of `bits` bits that another set holds too)
    of the sets that keep at least `percent` of their n-grams.

    An n-gram of very many documents costs its bucket one entry per chunk.  Copies of a
    set that lie in several chunks give equal rows (their n-grams count as shared)."""
    shift, less = np.uint64(bits - int(math.log2(buckets))), np.uint64(64 - bits)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        sets: list[np.ndarray] = []
        names: dict[int, None] = {}
        held = 0

        def sent() -> Iterator[pa.RecordBatch]:
            size = np.array([len(s) for s in sets])
            gram, number = np.concatenate(sets) >> less, np.repeat(np.arange(len(sets), dtype=np.uint32), size)
            order = np.argsort(gram, kind="stable")
            gram, number = gram[order], number[order]
            new = np.concatenate([[True], gram[1:] != gram[:-1]])
            several = np.diff(np.append(np.flatnonzero(new), len(gram))) > 1
            own, one = gram[new], np.where(several, np.uint32(_SEVERAL), number[new])
            bucket = (own >> shift).astype(np.int64)
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            step = np.diff(own, prepend=np.uint64(0))
            step[first] = own[first]
            yield _message(bucket[first], chunk, _ASKED, _parts(first, step), _parts(first, one))
            # What the chunk knows by itself goes where its answers go.
            known = several[np.cumsum(new) - 1]
            place = -1 - chunk
            yield _message(place, chunk, _SHARED, [_coded(gram[known])], [C.planes(number[known])])
            yield _message(place, chunk, _NAMES, [C.planes(np.array(list(names), np.int64))], [C.planes(size)])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                s = shingle_set(text, n)
                if not len(s) or (name := _name(s)) in names:
                    continue
                names[name] = None
                sets.append(s)
                held += len(s)
                if held >= HELD:
                    yield from sent()
                    chunk, held, sets, names = chunk + 1, 0, [], {}
        if sets:
            yield from sent()

    def answer(part: pa.Table) -> pa.Table:
        if part.column("kind")[0].as_py() != _ASKED:  # a chunk's own messages pass
            return part
        rows = part.to_pylist()
        gram = np.concatenate([_numbers(r["a"]) for r in rows])
        number = np.concatenate([C.from_planes(r["b"], np.uint32) for r in rows])
        ends = np.cumsum([len(r["b"]) // 4 for r in rows])
        order = np.argsort(gram, kind="stable")
        found = gram[order]
        alike = found[1:] == found[:-1]
        shared = np.zeros(len(gram), bool)
        shared[order] = np.concatenate([[False], alike]) | np.concatenate([alike, [False]])
        out = []
        for r, a, b in zip(rows, [0, *ends], ends):
            mine = a + np.flatnonzero(shared[a:b] & (number[a:b] != _SEVERAL))
            if len(mine):
                out.append(_message(r["place"], r["chunk"], _SHARED, [_coded(gram[mine])], [C.planes(number[mine])]))
        return pa.Table.from_batches(out, part.schema) if out else part.slice(0, 0)

    def put_together(part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        named = next(r for r in rows if r["kind"] == _NAMES)
        names, size = C.from_planes(named["a"], np.int64), C.from_planes(named["b"], np.int64)
        some = [r for r in rows if r["kind"] == _SHARED]
        gram = np.concatenate([_numbers(r["a"]) for r in some])
        number = np.concatenate([C.from_planes(r["b"], np.uint32) for r in some]).astype(np.int64)
        order = np.lexsort((gram, number))
        gram, ends = gram[order], np.cumsum(np.bincount(number, minlength=len(names)))
        kept = np.flatnonzero(100 * np.diff(ends, prepend=0) >= percent * size)
        raw = [_coded(gram[ends[k - 1] if k else 0 : ends[k]]) for k in kept]
        return pa.table({"node": names[kept], "n": size[kept], "set": pa.array(raw, pa.binary())})

    asked = docs.where(F.col("text").isNotNull()).select(F.col("text").cast("binary")).mapInArrow(ask, MESSAGE)
    told = asked.groupBy("place").applyInArrow(answer, MESSAGE)
    return told.groupBy("chunk").applyInArrow(put_together, "node long, n long, set binary")


# ------------------------------------------------------------------ the trie


class _Node:
    __slots__ = ("edge", "children", "members", "longest", "shortest", "deepest")

    def __init__(self, edge: np.ndarray):
        self.edge, self.children, self.members = edge, {}, []
        self.longest = self.shortest = 0  # full sizes of the sets below
        self.deepest = 0  # and the length of the longest array


class Trie:
    """Prefix tree over ascending arrays, with the bounds of the sizes below each node.

    A set may be given by those of its elements that others hold too, with its full size."""

    def __init__(self, percent: int):
        self.percent, self.root = percent, _Node(np.empty(0, np.uint64))
        self.root.shortest = 1 << 60

    def needed(self, a: int, b: int) -> int:
        """Least overlap of sets of sizes a and b that link."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def insert(self, s: np.ndarray, member, size: int | None = None) -> None:
        size = len(s) if size is None else size
        node, at = self.root, 0
        while True:
            node.longest, node.shortest = max(node.longest, size), min(node.shortest, size)
            node.deepest = max(node.deepest, len(s))
            if at == len(s):
                node.members.append((member, size))
                return
            child = node.children.get(int(s[at]))
            if child is None:
                leaf = _Node(s[at:])
                leaf.longest = leaf.shortest = size
                leaf.deepest = len(s)
                leaf.members.append((member, size))
                node.children[int(s[at])] = leaf
                return
            width = min(len(child.edge), len(s) - at)
            differ = np.flatnonzero(child.edge[:width] != s[at : at + width])
            same = int(differ[0]) if len(differ) else width
            if same < len(child.edge):  # split the edge
                top = _Node(child.edge[:same])
                top.longest, top.shortest, top.deepest = child.longest, child.shortest, child.deepest
                node.children[int(s[at])] = top
                child.edge = child.edge[same:]
                top.children[int(child.edge[0])] = child
                child = top
            node, at = child, at + same

    def search(self, q: np.ndarray, skip, size: int | None = None) -> Iterator:
        """Members that link with q and that `skip` doesn't name, by depth-first
        traversal; one overlap count serves all sets below a shared path."""
        stack = [(self.root, 0, 0, 0)]
        nq = len(q)
        size = nq if size is None else size
        while stack:
            node, depth, at, overlap = stack.pop()
            for member, other in node.members:
                if overlap >= self.needed(size, other) and not skip(member):
                    yield member
            for child in node.children.values():
                if not child.children and all(skip(m) for m, _ in child.members):
                    continue
                if 100 * min(size, child.longest) < self.percent * max(size, child.shortest):
                    continue
                need = self.needed(size, child.shortest)
                found, p, reached = overlap, at, True
                for begin in range(0, len(child.edge), 64):
                    chunk = child.edge[begin : begin + 64]
                    end = int(np.searchsorted(q[p:], chunk[-1], "right")) + p
                    if end > p:
                        found += len(np.intersect1d(q[p:end], chunk, assume_unique=True))
                    p = end
                    left = child.deepest - depth - begin - len(chunk)
                    if found + min(nq - p, left) < need:
                        reached = False
                        break
                if reached:
                    stack.append((child, depth + len(child.edge), p, found))


class _Union:
    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        root = x
        while self.up.get(root, root) != root:
            root = self.up[root]
        while self.up.get(x, x) != root:
            self.up[x], x = root, self.up[x]
        return root

    def join(self, a, b) -> None:
        self.up[self.find(b)] = self.find(a)


def trie_links(members: list[tuple[int, int, bytes]], percent: int, sides: list[int] | None = None,
               sizes: list[int] | None = None) -> list[tuple]:
    """Links that connect what is connected among (node, component, set bytes).

    Members of one component count as connected already.  With `sides`, only
    members of different sides are compared.  `sizes`: full sizes of the sets."""
    known = _Union()
    for node, component, _ in members:
        known.join(("c", component), node)
    sets = [np.frombuffer(raw, np.uint64) for _, _, raw in members]
    sizes = sizes or [len(s) for s in sets]
    out, trie = [], Trie(percent)

    def meet(node, s, size) -> None:
        for other in trie.search(s, lambda m: known.find(m) == known.find(node), size):
            known.join(other, node)
            out.append((node, other))

    if sides is None:
        for (node, _, _), s, size in zip(members, sets, sizes):
            meet(node, s, size)
            trie.insert(s, node, size)
        return out
    for (node, _, _), s, size, side in zip(members, sets, sizes, sides):
        if side == 0:
            trie.insert(s, node, size)
    for (node, _, _), s, size, side in zip(members, sets, sizes, sides):
        if side == 1:
            meet(node, s, size)
    return out


# ------------------------------------------------------------------ the join


def _links(blocks: DataFrame, percent: int) -> DataFrame:
    """Links inside each block of (block, side, node, component, rank, n, set)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["rank", "node"], kind="stable")
        sides = part["side"].tolist()
        raw = [_numbers(x).tobytes() for x in part["set"]]
        members = list(zip(part["node"].tolist(), part["component"].tolist(), raw))
        found = trie_links(members, percent, sides if any(sides) else None, part["n"].tolist())
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return blocks.groupBy("block").applyInPandas(run, "u long, v long")


def _sketch(sets: DataFrame) -> np.ndarray:
    """Upper bounds of the n-grams' document counts: `2**SKETCH_BITS` counters by hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for x in batch.column(1):
                np.add.at(total, _counter(_numbers(x.as_py())), 1)
        for begin in range(0, len(total), 1 << 16):
            some = begin + np.flatnonzero(total[begin : begin + (1 << 16)])
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([begin >> 16]), *(pa.array([C.planes(x)], pa.binary()) for x in (some, total[some].astype(np.int64)))],
                    names=["bucket", "a", "b"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << 16, np.int64)
        for a, b in zip(part["a"], part["b"]):
            total[C.from_planes(a, np.int64) & 0xFFFF] += C.from_planes(b, np.int64)
        return pd.DataFrame({"bucket": [part["bucket"].iloc[0]], "total": [total.tobytes()]})

    rows = sets.select("node", "set").mapInArrow(count, "bucket long, a binary, b binary")
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in rows.groupBy("bucket").applyInPandas(add, "bucket long, total binary").collect():
        out[r["bucket"] << 16 : (r["bucket"] + 1) << 16] = np.frombuffer(r["total"], np.int64)
    return out


def _counter(s: np.ndarray) -> np.ndarray:
    return (C.mix(s) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _rare_tokens(sets: DataFrame, percent: int) -> DataFrame:
    """(node, sig): each set's first n - ceil(t n) + 1 n-grams in a global order that puts
    n-grams of one set first (those that `set` lacks), then rare ones, as far as several
    sets have them.  Two sets that link share one."""
    counts = _sketch(sets)
    # Levels of the counts: a bounded array (2**SKETCH_BITS bytes) for the workers.
    levels = np.floor(2 * np.log2(np.maximum(counts, 1))).astype(np.uint8)
    sent = sets.sparkSession.sparkContext.broadcast(levels.tobytes())

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            found = []
            for x, n in zip(batch.column(1), batch.column(2).to_pylist()):
                s = _numbers(x.as_py())
                rank = (level[_counter(s)].astype(np.uint64) << np.uint64(57)) | (C.mix(s) >> np.uint64(7))
                size = len(s) + (-percent * n // 100) + 1
                found.append(s[np.argsort(rank, kind="stable")[:size]])
            node = np.repeat(batch.column(0).to_numpy(), [len(g) for g in found])
            sig = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sig)], names=["node", "sig"])

    tokens = sets.select("node", "set", "n").mapInArrow(first, "node long, sig long")
    shared = tokens.groupBy("sig").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    return tokens.join(shared.select("sig"), "sig").distinct()


def _hub_places(wide: DataFrame, trie_sets: int) -> DataFrame:
    """hub, share, node, rank: the sets around each hub in bounded shares, each with
    the hub first.  A signature's hub is the set that shares most signatures."""
    degree = wide.join(wide.groupBy("sig").count(), "sig").groupBy("node").agg(F.sum("count").alias("degree"))
    hub = (
        wide.join(degree, "node").groupBy("sig")
        .agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"))).alias("top"))
        .select("sig", (-F.col("top.minus")).alias("hub"))
    )
    # Each set goes to the hub that it shares most with; the second round does the rest.
    shares = wide.join(hub, "sig").where("node != hub").groupBy("hub", "node").count()
    stars = shares.groupBy("node").agg(F.max(F.struct("count", (-F.col("hub")).alias("minus"))).alias("top"))
    stars = C.stage(stars.select((-F.col("top.minus")).alias("hub"), "node"), "hubs")
    sizes = stars.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / trie_sets).alias("shares"))
    dealt = stars.join(sizes, "hub").withColumn("share", F.pmod(F.xxhash64("node", "hub"), F.col("shares")))
    return dealt.select("hub", "share", "node", F.lit(1).alias("rank")).unionByName(
        sizes.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"),
                     F.col("hub").alias("node"), F.lit(0).alias("rank"))
    )


def _open_places(wide: DataFrame, found: DataFrame, trie_sets: int) -> DataFrame:
    """block, side, node, component, rank for what the first round left open.

    Blocks whose sets are in several components connect sets to groups.  A group that
    fits in one trie is joined whole; of a larger one, each block (of equal ones one).
    The members outside the most frequent component (side 1) meet all members (side 0),
    chunk by chunk, so that every pair between components shares a block."""
    labelled = wide.join(found, "node", "left").select(
        "sig", "node", F.coalesce("component", "node").alias("component")
    )
    mixed = labelled.groupBy("sig").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("v"),
        F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("members"),
    ).where("low < high")
    once = mixed.groupBy("members", "size", "low", "high", "v").agg(F.min("sig").alias("sig"))
    still = C.stage(labelled.join(once.select("sig", "v"), "sig").select("sig", "node", "component", "v"), "open")
    group = components(still.select(F.col("node").alias("u"), "v")).withColumnRenamed("component", "grp")
    group = C.stage(group, "rest")
    sizes = group.groupBy("grp").agg((F.count(F.lit(1)) <= trie_sets).alias("fits"))
    # A group and a signature may have the same number: the flag tells them apart.
    nodes = still.join(group.join(sizes, "grp"), "node").select(
        F.struct("fits", F.when(F.col("fits"), F.col("grp")).otherwise(F.col("sig")).alias("number")).alias("grp"),
        "node", "component",
    ).distinct()
    nodes = C.stage(nodes, "blocks")
    counts = nodes.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("n"))
    major = counts.groupBy("grp").agg(
        F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all")
    ).select(
        "grp", F.col("top.component").alias("major"), F.ceil(F.col("all") / trie_sets).alias("chunks"),
        F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("top.n")) / trie_sets)).alias("probes"),
    )
    placed = nodes.join(major, "grp").withColumn("at", F.xxhash64("node", "grp"))

    def chunks(column: str):
        return F.sequence(F.lit(0).cast("long"), F.col(column) - 1)

    targets = placed.select(
        "grp", F.pmod("at", F.col("chunks")).alias("a"), F.explode(chunks("probes")).alias("b"), F.lit(0).alias("side"),
        "node", "component",
    )
    probes = placed.where("component != major").select(
        "grp", F.explode(chunks("chunks")).alias("a"), F.pmod("at", F.col("probes")).alias("b"), F.lit(1).alias("side"),
        "node", "component",
    )
    return targets.unionByName(probes).select(
        F.struct("grp", "a", "b").alias("block"), "side", "node", "component", F.lit(0).alias("rank")
    )


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, trie_sets: int = TRIE_SETS) -> DataFrame:
    """doc_id, key (of doc_id and text), n_shingles, node (name of the set) and component_id
    per document; see the module's text."""
    C.small_batches(docs.sparkSession)
    rows = C.stage(sets_of(docs, n), "sets")
    elements = rows.agg(F.sum("n")).first()[0] or 0
    buckets = 1 << max(6, math.ceil(math.log2(max(1, elements / BUCKET_KEYS))))
    bits = min(64, math.ceil(math.log2(max(2, elements))) + SPARE_BITS)
    sets = C.stage(shared_sets(docs, n, percent, buckets, bits), "shared")

    # Candidate groups: sets connected by one of their first n-grams.
    wide = C.stage(_rare_tokens(sets, percent), "wide")
    sets = sets.dropDuplicates(["node"])  # in the same exchange as the joins by node below
    near = wide.join(wide.groupBy("sig").agg(F.min("node").alias("v")), "sig").select(F.col("node").alias("u"), "v")
    groups = C.stage(components(near).withColumnRenamed("component", "grp"), "groups")
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    large = C.stage(sizes.where(F.col("size") > trie_sets).select("grp"), "large")

    # First round: a group that fits in one trie is joined whole; a larger one by
    # tries of a hub and a share of the sets that share an n-gram with it.
    whole = groups.join(large, "grp", "left_anti").select(
        F.col("grp").alias("hub"), F.lit(0).cast("long").alias("share"), "node", F.lit(0).alias("rank")
    )
    members = groups.join(large, "grp", "left_semi").select("node")
    wide = C.stage(wide.join(members, "node", "left_semi"), "large-wide")
    places = whole.unionByName(_hub_places(wide, trie_sets))
    blocks = places.join(sets, "node").select(
        F.struct("hub", "share").alias("block"), F.lit(0).alias("side"), "node", F.col("node").alias("component"),
        "rank", "n", "set",
    )
    links = C.stage(_links(blocks, percent), "links")
    found = C.stage(components(links), "components")

    # Second round: n-grams of large groups whose sets are in several components.
    rest = _open_places(wide, found, trie_sets)
    late = C.stage(_links(rest.join(sets, "node"), percent), "late")
    found = C.stage(components(links.unionByName(late)), "components")

    # The smallest doc_id of each component, for each of its sets.
    named = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("low")).join(found, "node", "left")
    named = C.stage(named.select("node", "low", F.coalesce("component", "node").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    label = named.join(least, "component").select("node", "component_id")
    return rows.join(label, "node", "left").select(
        "doc_id", "key", F.col("n").alias("n_shingles"), "node",
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each component: its smallest doc_id, and of rows that
    repeat that id the one of the smallest row key.  Rows of components without any id
    stay, one of each set."""
    rows = near_duplicates(docs, n, percent)
    group = F.coalesce(
        F.col("component_id").cast("string"), F.concat(F.lit("#"), F.col("node").cast("string")), F.lit("#"))
    first = F.struct(
        (~F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("other"), F.col("key").alias("key")
    )
    chosen = C.stage(rows.groupBy(group.alias("g")).agg(F.min(first).alias("one")).select("one.key").distinct(), "chosen")
    return C.rows_of(docs, chosen, "key")
