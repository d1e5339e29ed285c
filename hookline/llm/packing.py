"""Best-fit packing with swap-based local search.

Documents are encoded, ended by one id, cut into pieces of at most `capacity`
tokens and packed gaplessly into sequences.  Pieces are dealt by hash into groups
of about `GROUP_PIECES`; each group is one task.  It starts from best fit in
decreasing order and then searches locally among its underfull bins: it takes
the emptiest bin and moves its pieces, exchanges one for one, two for one or one
for two with fuller bins, always by a step that increases the sum of squared
fills, until bins empty and no step is left.  Bins that stay below `POOR_FILL`
are packed once more across groups.

Encoding: the vocabulary's byte-level BPE.  Plain text is encoded from the same
vocabulary's rank file, which gives the same ids several times faster; texts that
hold a special string go through the tokenizers library, which maps it to its id.

Edge cases: a null or empty text is one piece of the end id alone; a text longer
than the capacity is cut so that only its first piece may be shorter; repeated
rows are packed each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hookline.llm import common as C

CAPACITY = 1024
END_ID = 2
#: Pieces that one task packs together, about.
GROUP_PIECES = 20_000
#: Bins filled less than this share are packed again across groups.
POOR_FILL = 0.97
#: Passes of the local search, and receivers that it may look at in one group.
SWEEPS = 4
SEARCH_VISITS = 300_000

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"
PACKED_SCHEMA = "uid long, sequence_id long, offset long, fill long"

# The split pattern of the public byte-level vocabulary.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts under one vocabulary file; beside it lies its rank file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        ranks_path = os.path.splitext(path)[0] + ".tiktoken"
        self.fast = None
        if os.path.exists(ranks_path):
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: whole ones, and a shorter first one if needed."""
    first = length % capacity or capacity
    out = [(0, min(first, length))]
    out += [(s, capacity) for s in range(first, length, capacity)]
    return out


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece; `uid` numbers rows (unique within this DataFrame once staged)."""
    C.small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer_path)
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(enc.ids(text or ""), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    for col, v in zip(cols, (doc_id, k, start, length, crc, uid)):
                        col.append(v)
                    uid += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "uid"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE_SCHEMA)


# ------------------------------------------------------------ packing one group


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers; open bins are kept by their gap."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps = 0  # bit g: some bin has gap g
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        fitting = open_gaps >> size
        if fitting:
            gap = size + (fitting & -fitting).bit_length() - 1
            at = by_gap[gap].pop()
            if not by_gap[gap]:
                open_gaps &= ~(1 << gap)
            bins[at].append(item)
        else:
            gap, at = capacity, len(bins)
            bins.append([item])
        if gap - size:
            by_gap[gap - size].append(at)
            open_gaps |= 1 << (gap - size)
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Bins that any packing needs: pieces over capacity - k stand alone, those
    over half share with none of their kind, and pieces of k or more fill the rest
    (the best such bound over k)."""
    count = np.bincount(np.asarray(sizes, np.int64), minlength=capacity + 1) if sizes else np.zeros(capacity + 1)
    total = np.arange(capacity + 1) * count
    n_upto, s_upto = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(total)])
    half = capacity // 2
    k = np.arange(0, half + 1)
    alone = n_upto[-1] - n_upto[capacity - k + 1]
    paired = n_upto[capacity - k + 1] - n_upto[half + 1]
    space = paired * capacity - (s_upto[capacity - k + 1] - s_upto[half + 1])
    small = s_upto[half + 1] - s_upto[k]
    return int((alone + paired + np.maximum(0, -(-(small - space) // capacity))).max())


class LocalSearch:
    """Swaps between underfull bins that increase the sum of squared fills."""

    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int):
        self.sizes, self.capacity, self.visits = sizes, capacity, SEARCH_VISITS
        self.least = lower_bound(sizes, capacity)
        self.bins = [list(b) for b in bins]
        self.fill = [sum(sizes[i] for i in b) for b in self.bins]

    def run(self, sweeps: int = SWEEPS) -> list[list[int]]:
        for _ in range(sweeps):
            before = sum(1 for b in self.bins if b)
            donors = [k for k in range(len(self.bins)) if self.bins[k] and self.fill[k] < self.capacity]
            donors.sort(key=lambda k: self.fill[k])
            changed = False
            for donor in donors if before > self.least else []:
                while self.bins[donor] and self.visits > 0 and self.step(donor):
                    changed = True
            if not changed or self.visits <= 0:
                break
        return [b for b in self.bins if b]

    def receivers(self, donor: int) -> list[int]:
        """Underfull bins at least as full as the donor, fullest first."""
        f, cap = self.fill, self.capacity
        out = [k for k in range(len(self.bins)) if k != donor and self.bins[k] and f[donor] <= f[k] < cap]
        return sorted(out, key=lambda k: -f[k])

    def step(self, donor: int) -> bool:
        """One improving step that lightens the donor; the tightest one found."""
        sizes, cap = self.sizes, self.capacity
        own = sorted(self.bins[donor], key=lambda i: -sizes[i])
        best = None  # (gap left, -net, receiver, given, taken)
        pairs = [(sizes[a] + sizes[b], (a, b)) for i, a in enumerate(own) for b in own[i + 1 :]]
        singles = [(sizes[a], (a,)) for a in own]
        give = sorted(singles + pairs)
        give_sizes = [g for g, _ in give]
        for r in self.receivers(donor):
            self.visits -= 1
            gap = cap - self.fill[r]
            theirs = self.bins[r]
            takes = [(0, ())] + [(sizes[t], (t,)) for t in theirs]
            takes += [(sizes[a] + sizes[b], (a, b)) for i, a in enumerate(theirs) for b in theirs[i + 1 :]]
            for t_size, t_items in takes:
                # The largest gift that still fits once t_items have left.
                at = bisect_right(give_sizes, t_size + gap) - 1
                while at >= 0 and give_sizes[at] > t_size:
                    g_size, g_items = give[at]
                    if len(g_items) + len(t_items) <= 3:
                        net = g_size - t_size
                        found = (gap - net, -net, r, g_items, t_items)
                        if best is None or found[:2] < best[:2]:
                            best = found
                        break
                    at -= 1
            if best is not None and best[0] == 0 or self.visits <= 0:
                break
        if best is None:
            return False
        _, net, r, given, taken = best
        for i in given:
            self.bins[donor].remove(i)
        for i in taken:
            self.bins[r].remove(i)
        self.bins[donor].extend(taken)
        self.bins[r].extend(given)
        self.fill[donor] += net
        self.fill[r] -= net
        return True


def pack_group(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers for one group of piece lengths."""
    sizes = [int(x) for x in lengths]
    full = [[i] for i, s in enumerate(sizes) if s >= capacity]
    rest = [i for i, s in enumerate(sizes) if s < capacity]
    part = [sizes[i] for i in rest]
    bins = LocalSearch(part, best_fit_decreasing(part, capacity), capacity).run()
    return full + [[rest[i] for i in b] for b in bins]


def _pack_groups(rows: DataFrame, groups: int, base: int, capacity: int) -> DataFrame:
    """(uid, length) dealt into `groups` groups, each packed in one task."""

    def pack(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "uid"], ascending=[False, True])
        lengths, uids = part["length"].to_numpy(), part["uid"].to_numpy()
        bins = pack_group(lengths, capacity)
        out = []
        for number, items in enumerate(bins):
            at, total = 0, int(sum(lengths[i] for i in items))
            for i in items:
                out.append((uids[i], base + (int(key[0]) << 32) + number, at, total))
                at += int(lengths[i])
        return pd.DataFrame(out, columns=["uid", "sequence_id", "offset", "fill"])

    dealt = rows.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(groups)).alias("group"))
    return dealt.groupBy("group").applyInPandas(pack, PACKED_SCHEMA)


def pack(staged: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """uid, sequence_id, offset for the staged pieces (uid, length)."""
    part = staged.where(F.col("length") < capacity)
    alone = staged.where(F.col("length") >= capacity).select(
        "uid", (F.lit(3 << 60) + F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    count = part.count()
    first = C.stage(_pack_groups(part, max(1, -(-count // group_pieces)), 0, capacity), "packed")
    poor = F.col("fill") < F.lit(int(POOR_FILL * capacity))
    again = first.where(poor).join(part.select("uid", "length"), "uid").select("uid", "length")
    left = first.where(poor).count()
    second = _pack_groups(again, max(1, -(-left // group_pieces)), 1 << 60, capacity)
    return first.where(~poor).select("uid", "sequence_id", "offset").unionByName(
        second.select("uid", "sequence_id", "offset")
    ).unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    staged = C.stage(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    return staged.join(pack(staged, capacity, group_pieces), "uid").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
