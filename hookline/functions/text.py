"""Generic string column functions (all native Spark expressions).

These are the building blocks of the URL features: counts, guarded ratios,
Shannon entropy, longest runs, n-gram diversity.  Each takes and returns a
``Column`` so that Catalyst sees one projection and whole-stage codegen can
compile it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

NON_PRINTABLE = r"[^\x20-\x7E]"
# One plain character, one escaped character, or a class of plain characters.
_PLAIN = re.compile(r"([%#@&=_/-])|\\([.?*+])|\[([@!*?=%&+$#._]+)\]")


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_re(c: Column | str, pattern: str) -> Column:
    """Number of non-overlapping matches of ``pattern`` (0 for empty input).

    A pattern that stands for single characters is counted by the length that the
    string loses with them, which is much cheaper than a regular expression."""
    chars = _PLAIN.fullmatch(pattern)
    if chars:
        text = rest = col_(c)
        for ch in (chars[1] or chars[2] or chars[3]):
            rest = F.replace(rest, F.lit(ch), F.lit(""))
        return F.coalesce(F.length(text) - F.length(rest), F.lit(0)).cast("int")
    return F.coalesce(F.regexp_count(col_(c), F.lit(pattern)), F.lit(0)).cast("int")


def slen(c: Column | str) -> Column:
    return F.coalesce(F.length(col_(c)), F.lit(0)).cast("int")


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double, 0.0 when ``den`` is not positive."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def flag(cond: Column) -> Column:
    """Boolean condition as 0/1 int, null treated as 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def any_literal(c: Column | str, words: Iterable[str], case_insensitive: bool = False) -> Column:
    """True if any of ``words`` occurs as a substring (one alternation regex)."""
    alt = "|".join(re.escape(w) for w in words)
    prefix = "(?i)" if case_insensitive else ""
    return col_(c).rlike(prefix + "(" + alt + ")")


def count_present(c: Column | str, words: Iterable[str]) -> Column:
    """How many distinct words of the list occur in the string."""
    arr = F.array(*[F.lit(w) for w in words])
    s = col_(c)
    return F.size(F.filter(arr, lambda w: F.instr(s, w) > 0)).cast("int")


def printable(c: Column | str) -> Column:
    return F.regexp_replace(col_(c), NON_PRINTABLE, "")


def entropy(c: Column | str, printable_only: bool = True) -> Column:
    """Shannon entropy in bits over the distinct characters; 0 for empty.

    Occurrences of each distinct character are counted with
    ``length - length(replace)`` (one pass per distinct character), then
    ``-sum(p * log2 p)``.  Non-printable characters are dropped first when
    ``printable_only`` (the original helper does; pass False for input that
    is already clean, to skip the extra regex).
    """
    s = printable(c) if printable_only else col_(c)
    n = F.length(s)
    counts = F.transform(F.array_distinct(F.split(s, "")), lambda ch: n - F.length(F.replace(s, ch, F.lit(""))))
    total = F.aggregate(counts, F.lit(0.0), lambda acc, k: acc - (k / n) * F.log2(k / n))
    return F.when(F.coalesce(n, F.lit(0)) > 0, total).otherwise(F.lit(0.0))


def longest_run(c: Column | str) -> Column:
    """Length of the longest run of one repeated character (0 for empty)."""
    runs = F.regexp_extract_all(col_(c), F.lit(r"((.)\2*)"), 1)
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0)).cast("int")


def longest_match(c: Column | str, pattern: str) -> Column:
    """Length of the longest match of ``pattern`` (0 if none)."""
    hits = F.regexp_extract_all(col_(c), F.lit("(" + pattern + ")"), 1)
    return F.coalesce(F.array_max(F.transform(hits, lambda r: F.length(r))), F.lit(0)).cast("int")


def longest_token(c: Column | str, split_pattern: str) -> Column:
    """Length of the longest piece after splitting on ``split_pattern``."""
    parts = F.split(col_(c), split_pattern, -1)
    return F.coalesce(F.array_max(F.transform(parts, lambda p: F.length(p))), F.lit(0)).cast("int")


def ngram_diversity(c: Column | str, n: int) -> Column:
    """Distinct character n-grams divided by the length; 0 when shorter than n."""
    s = col_(c)
    ln = F.length(s)
    grams = F.transform(F.sequence(F.lit(1), ln - n + 1), lambda i: F.substring(s, i, n))
    return F.when(ln >= n, F.size(F.array_distinct(grams)) / ln).otherwise(F.lit(0.0))


def vowel_consonant_ratio(c: Column | str) -> Column:
    s = F.lower(col_(c))
    vowels = count_re(s, "[aeiou]")
    consonants = count_re(s, "[b-df-hj-np-tv-z]")
    return ratio(vowels, consonants)
