"""Public-suffix rules (the ICANN section of the list that Spark's own HTTP client
library carries), as a small table to look host names up in.

A rule is a suffix (``co.uk``), a wildcard (``*.ck``: any one label before ``ck``) or
an exception (``!www.ck``: not a suffix although the wildcard says so).  The longest
rule that fits a host wins, exceptions first.
"""

from __future__ import annotations

import functools
import glob
import os
import zipfile

import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LIST = "mozilla/public-suffix-list.txt"
#: Labels of the longest rule.
MOST_LABELS = 4
_EXACT, _WILD, _EXCEPT = 1, 2, 4


@functools.cache
def public_suffix_rules() -> tuple[str, ...]:
    """Rules of the ICANN section, as written and in their ASCII form."""
    homes = [os.path.dirname(pyspark.__file__), os.environ.get("SPARK_HOME", "")]
    jars = [j for h in homes if h for j in sorted(glob.glob(os.path.join(h, "jars", "httpclient-4*.jar")))]
    for jar in jars:
        with zipfile.ZipFile(jar) as z:
            if _LIST not in z.namelist():
                continue
            lines = z.read(_LIST).decode("utf-8").split("\n")
        first = next(i for i, x in enumerate(lines) if "===BEGIN ICANN DOMAINS===" in x)
        last = next(i for i, x in enumerate(lines) if "===END ICANN DOMAINS===" in x)
        rules = {x.split()[0].lower() for x in lines[first + 1 : last] if x.strip() and not x.startswith("//")}
        rules |= {".".join(p if p.isascii() else "xn--" + p.encode("punycode").decode() for p in r.split(".")) for r in rules}
        return tuple(sorted(r for r in rules if r.count(".") < MOST_LABELS))
    raise FileNotFoundError(f"no jar with {_LIST} beside Spark; pass the rules to add_url_parts")


def rule_table(spark: SparkSession, rules: tuple[str, ...] | None = None) -> DataFrame:
    """(key, code): host tails that rules name, with the kinds of rule as bits."""
    codes: dict[str, int] = {}
    for r in rules or public_suffix_rules():
        key, code = (r[2:], _WILD) if r.startswith("*.") else (r[1:], _EXCEPT) if r.startswith("!") else (r, _EXACT)
        codes[key] = codes.get(key, 0) | code
    return spark.createDataFrame(sorted(codes.items()), "key string, code int")


def with_suffix_labels(df: DataFrame, labels: str, out: str, rules: tuple[str, ...] | None = None) -> DataFrame:
    """``df`` with the number of labels ``out`` of the public suffix of a host, given
    as an array of labels; 0 if no rule fits.

    Every tail of up to four labels is looked up in the rule table, which is a
    constant of some thousand rows and hence broadcast."""
    table = rule_table(df.sparkSession, rules)
    n = F.size(labels)
    keys = [f"_{out}_k{t}" for t in range(1, MOST_LABELS + 1)]
    codes = [f"_{out}_c{t}" for t in range(1, MOST_LABELS + 1)]
    x = df.withColumns({
        k: F.when(n >= t, F.lower(F.array_join(F.slice(labels, -t, t), "."))) for t, k in enumerate(keys, 1)
    })
    for k, c in zip(keys, codes):
        x = x.join(F.broadcast(table.select(F.col("key").alias(k), F.col("code").alias(c))), k, "left")

    def has(t: int, bit: int) -> Column:
        return F.coalesce(F.col(codes[t - 1]).bitwiseAND(bit) > 0, F.lit(False))

    found = F.lit(0)
    for t in range(1, MOST_LABELS + 1):  # later, longer rules win
        hit = has(t, _EXACT)
        if t > 1:
            hit = hit | (has(t - 1, _WILD) & (n >= t))
        found = F.when(hit, F.lit(t)).otherwise(found)
    for t in range(2, MOST_LABELS + 1):
        found = F.when(has(t, _EXCEPT), F.lit(t - 1)).otherwise(found)
    return x.select(*df.columns, found.alias(out))
