"""Measures of strings that cost most as nested expressions, for a batch of rows at once.

``Measures`` collects what a profile asks for (counts, entropy, longest runs, n-gram
diversity, word lists) and adds all of it as one struct column by one Arrow UDF, which
looks at the code points of a batch with numpy and at word lists with Arrow's own
matcher.  Values are those of the functions of the same names in ``text``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookline.functions import text as T
from hookline.session import parallelism

#: What a regular expression's dot does not match.
LINE_ENDS = "[\n\r\u0085\u2028\u2029]"
_CATEGORIES: dict[str, Callable[[str], bool]] = {
    r"\p{L}": lambda k: k[0] == "L",
    r"\p{Lu}": lambda k: k == "Lu",
    r"\p{Ll}": lambda k: k == "Ll",
    r"[^\p{L}\p{N}]": lambda k: k[0] not in "LN",
}


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the tasks: a row's features cost far more than its move, and
    an input file may hold most rows."""
    return df.repartition(parallelism(df.sparkSession))


class Texts:
    """Code points of a batch of strings, one after the other; null as empty."""

    def __init__(self, values: pa.Array):
        self.values, self.n, self._seen = values, len(values), {}
        data, ends = _bytes_of(values)
        codes: np.ndarray = data
        if len(data) and data.max() >= 128:
            codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
            ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[ends]
            if ends[-1] != len(codes):  # malformed bytes: code points of each string
                each = [v or "" for v in pc.cast(values, pa.binary()).to_pylist()]
                each = [v.decode("utf-8", "replace") if v else "" for v in each]
                codes = np.frombuffer("".join(each).encode("utf-32-le"), "<u4")
                ends = np.concatenate([[0], np.cumsum([len(v) for v in each])])
        self.codes, self.start, self.end = codes, ends[:-1], ends[1:]
        self.length = self.end - self.start
        self.row = np.repeat(np.arange(self.n), self.length)
        self.used = np.flatnonzero(self.length)

    def kept(self, pattern: str) -> np.ndarray:
        """Which code points a pattern of one character matches."""
        if pattern not in self._seen:
            if self.codes.dtype == np.uint8:
                self._seen[pattern] = _table(pattern)[self.codes]
            else:
                some, at = np.unique(self.codes, return_inverse=True)
                self._seen[pattern] = np.array([_matches(pattern, chr(c)) for c in some], bool)[at]
        return self._seen[pattern]

    def dense(self) -> tuple[np.ndarray, int]:
        if self.codes.dtype == np.uint8:
            return self.codes.astype(np.int64), 128
        some, at = np.unique(self.codes, return_inverse=True)
        return at.astype(np.int64), len(some)

    def _sums(self, flags: np.ndarray) -> np.ndarray:
        passed = np.concatenate([[0], np.cumsum(flags)])
        return passed[self.end] - passed[self.start]

    def _most(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n, np.int64)
        if len(self.used):
            out[self.used] = np.maximum.reduceat(values, self.start[self.used])
        return out

    def count(self, pattern: str) -> np.ndarray:
        return self._sums(self.kept(pattern))

    def entropy(self, printable_only: bool) -> np.ndarray:
        codes, width = self.dense()
        row, n = self.row, self.length
        if printable_only:
            keep = ~self.kept(T.NON_PRINTABLE)
            codes, row, n = codes[keep], row[keep], self._sums(keep)
        out = np.zeros(self.n)
        if width == 128:
            counts = np.bincount(row * width + codes, minlength=0)
            key = np.flatnonzero(counts)
            counts = counts[key]
        else:
            key, counts = np.unique(row * width + codes, return_counts=True)
        if len(key):
            p = counts / n[key // width]
            out = np.bincount(key // width, -p * np.log2(p), self.n)
        return out + 0.0

    def longest_run(self) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(self.n, np.int64)
        at = np.arange(len(self.codes))
        new = np.concatenate([[True], self.codes[1:] != self.codes[:-1]])
        new[self.start[self.used]] = True
        run = at + 1 - np.maximum.accumulate(np.where(new, at, 0))
        return self._most(np.where(self.kept(LINE_ENDS), 0, run))

    def longest(self, pattern: str, matching: bool) -> np.ndarray:
        """Longest stretch of characters that do (not) match."""
        if not len(self.codes):
            return np.zeros(self.n, np.int64)
        inside = self.kept(pattern) if matching else ~self.kept(pattern)
        at = np.arange(len(self.codes))
        last = np.maximum.accumulate(np.where(inside, 0, at + 1))
        return self._most(at + 1 - np.maximum(last, self.start[self.row]))

    def ngram_diversity(self, n: int) -> np.ndarray:
        codes, width = self.dense()
        first = np.flatnonzero(np.arange(len(codes)) + n <= self.end[self.row]) if len(codes) else np.zeros(0, np.int64)
        row = self.row[first]
        key = row
        for k in range(n):
            key = key * width + codes[first + k]
        distinct = np.unique(key) // width**n
        found = np.bincount(distinct, minlength=self.n)
        return np.where(self.length >= n, found / np.maximum(self.length, 1), 0.0)

    def any_literal(self, words: tuple[str, ...]) -> pa.Array:
        return pc.match_substring_regex(self.values, "|".join(re.escape(w) for w in words))

    def count_present(self, words: tuple[str, ...]) -> np.ndarray:
        out = np.zeros(self.n, np.int64)
        some = np.flatnonzero(pc.fill_null(self.any_literal(words), False).to_numpy(zero_copy_only=False))
        if len(some):
            values = self.values.take(pa.array(some))
            out[some] = sum(pc.match_substring(values, w).to_numpy(zero_copy_only=False).astype(np.int64) for w in words)
        return out


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends) of strings; a null has none."""
    values = pc.fill_null(values, "") if values.null_count else values
    _, ends, data = values.buffers()
    kind = np.int64 if pa.types.is_large_string(values.type) else np.int32
    ends = np.frombuffer(ends, kind)[values.offset : values.offset + len(values) + 1].astype(np.int64) if ends else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def _matches(pattern: str, ch: str) -> bool:
    by = _CATEGORIES.get(pattern)
    return by(unicodedata.category(ch)) if by else re.fullmatch(pattern, ch) is not None


_TABLES: dict[str, np.ndarray] = {}


def _table(pattern: str) -> np.ndarray:
    if pattern not in _TABLES:
        _TABLES[pattern] = np.array([_matches(pattern, chr(c)) for c in range(128)], bool)
    return _TABLES[pattern]


class Measures:
    """Measures asked for, as columns; ``add`` computes them.  A text that is used often
    should be the same Column object each time: it is sent once."""

    def __init__(self, name: str = "_m_"):
        self.name, self.texts, self.asked = name, [], {}

    def _ask(self, c: Column, kind: str, out: str, *args) -> Column:
        at = next((i for i, x in enumerate(self.texts) if x is c), None)
        if at is None:
            at = len(self.texts)
            self.texts.append(c)
        place = self.asked.setdefault((at, kind, out, args), len(self.asked))
        return F.col(self.name)[f"m{place}"]

    def count_re(self, c: Column, pattern: str) -> Column:
        """``pattern``: one character or class."""
        return self._ask(c, "count", "int", pattern)

    def entropy(self, c: Column, printable_only: bool = True) -> Column:
        return self._ask(c, "entropy", "double", printable_only)

    def longest_run(self, c: Column) -> Column:
        return self._ask(c, "longest_run", "int")

    def longest_match(self, c: Column, char_class: str) -> Column:
        return self._ask(c, "longest", "int", char_class, True)

    def longest_token(self, c: Column, char_class: str) -> Column:
        return self._ask(c, "longest", "int", char_class, False)

    def ngram_diversity(self, c: Column, n: int) -> Column:
        return self._ask(c, "ngram_diversity", "double", n)

    def any_literal(self, c: Column, words: Iterable[str]) -> Column:
        return self._ask(c, "any_literal", "boolean", tuple(words))

    def count_present(self, c: Column, words: Iterable[str]) -> Column:
        return self._ask(c, "count_present", "int", tuple(words))

    def add(self, df: DataFrame) -> DataFrame:
        asked = list(self.asked)
        types = {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
        schema = ", ".join(f"m{i} {out}" for i, (_, _, out, _) in enumerate(asked))

        @F.arrow_udf(schema)
        def measured(*texts: pa.Array) -> pa.Array:
            batch = [Texts(t) for t in texts]
            found = []
            for at, kind, out, args in asked:
                values = getattr(batch[at], kind)(*args)
                found.append(values if isinstance(values, pa.Array) else pa.array(values, types[out]))
            return pa.StructArray.from_arrays(found, names=[f"m{i}" for i in range(len(found))])

        return df.withColumn(self.name, measured(*self.texts))


class NativeMeasures(Measures):
    """The same measures as native columns, each computed once per row; no Python."""

    def add(self, df: DataFrame) -> DataFrame:
        staged = df.withColumns({f"{self.name}t{i}": c for i, c in enumerate(self.texts)})
        found = []
        for at, kind, out, args in self.asked:
            c = F.col(f"{self.name}t{at}")
            if kind == "count":
                value = T.count_re(c, *args)
            elif kind == "longest":
                value = T.longest_match(c, args[0] + "+") if args[1] else T.longest_token(c, args[0])
            elif kind == "count_present":  # words are counted only where one occurs
                value = F.when(T.any_literal(c, *args), T.count_present(c, *args)).otherwise(F.lit(0))
            else:
                value = getattr(T, kind)(c, *args)
            found.append(value.cast(out).alias(f"m{len(found)}"))
        names = [f"{self.name}m{i}" for i in range(len(found))]
        return staged.withColumns(dict(zip(names, found)))

    def _ask(self, c: Column, kind: str, out: str, *args) -> Column:
        super()._ask(c, kind, out, *args)
        at = next(i for i, x in enumerate(self.texts) if x is c)
        return F.col(f"{self.name}m{self.asked[at, kind, out, args]}")
