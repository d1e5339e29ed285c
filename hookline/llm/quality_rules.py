"""Quality rules: robust multivariate outliers per language and source.

Each text is described by counts that Spark SQL expressions take from the whole
text, and by a vector of transformed statistics.  Per language and source, a
minimum-covariance-determinant estimate (Rousseeuw; concentration steps from
deterministic starts as in Hubert, Rousseeuw and Verdonck, 2012) gives a centre and
a scatter that junk doesn't move; texts far from it by Mahalanobis distance are
rejected.  Only DataFrame and SQL functions are used.

Estimation units: a (language, source) pair with at least `MIN_UNIT` texts that
pass the base rules; the texts of smaller pairs are pooled per language, a smaller
pool joins the language's largest pair, and languages without such a pair are pooled
together.  Fewer texts than that give no verdict.

A concentration step is one pass over the staged vectors: the moments of each unit
are aggregated per bin of the distance, and the bins that hold the nearest
`SUPPORT` of the unit make the next centre and scatter, so that no row is ranked
or gathered.  Two starts run side by side (median and spread of each statistic; the
correlations of its hyperbolic tangent) and the one of smaller determinant stays.
A last step reweights: all texts within the 97.5 % quantile count.

The variance of each statistic is kept from below by the square of `FLOORS`, so that
statistics that are zero in most texts neither make the scatter singular nor
reject a text for a trace.

Edge cases: null, empty and blank texts have no words and fail the base rules;
null languages and sources count as empty strings; repeated rows and ties fall in
the same bins and get the same verdict; an empty table gives no rows; columns other
than doc_id, text, lang and source are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hookline.llm import common as C

#: Statistics of the vector and the least standard deviation of each.
FLOORS = {"v_length": 0.3, "v_word": 0.06, "v_symbols": 0.03, "v_lines": 0.15, "v_repeats": 0.15}
STATS = list(FLOORS)
#: Share of a unit's texts that the estimate rests on.
SUPPORT = 0.75
#: Concentration steps of each start.
STEPS = 4
#: Texts of a unit, at least.
MIN_UNIT = 60
#: Chi-square tail beyond which a text is rejected.
TAIL = 1e-6
#: Bins a unit of log distance is cut into.
BINS = 12

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r"


# ------------------------------------------------------------------ counts of a text


def _replaced_length(text: Column, chars: str) -> Column:
    """Characters of `text` that are among `chars`."""
    rest = text
    for c in chars:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.char_length(text) - F.char_length(rest)


def text_counts(docs: DataFrame) -> DataFrame:
    """`docs` (with columns doc_id, text, ...) with n_words, word_chars, n_symbols,
    n_dup_lines, n_lines, n_repeat_words and base_failed; text is dropped."""
    keep = [c for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = text
    for c in SPACES:
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit("[^\\x20\\x09-\\x0D]")))
    one = docs.select(
        *keep,
        F.array_remove(F.split(plain, " "), "").alias("_words"),
        (F.char_length(text) - _replaced_length(text, " " + SPACES)).cast("bigint").alias("word_chars"),
        _replaced_length(text, SYMBOLS).cast("bigint").alias("n_symbols"),
        lines.alias("_lines"),
    )
    n = F.size("_words")
    windows = F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    two = one.select(
        *keep, n.cast("bigint").alias("n_words"), "word_chars", "n_symbols",
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        windows.alias("_h"),
    )
    counts = [c for c in two.columns if c != "_h"]
    # Windows sorted with their places: equal ones become neighbours.
    three = two.select(
        *counts,
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ).otherwise(F.expr("array()").cast("array<struct<h:bigint,i:int>>")).alias("_s"),
    )
    twice = F.transform(
        "_s",
        lambda e, k: F.when(
            (e["h"] == F.get("_s", k - 1)["h"]) | (e["h"] == F.get("_s", k + 1)["h"]), e["i"]
        ),
    )
    four = three.select(*counts, F.sort_array(F.filter(twice, lambda i: i.isNotNull())).alias("_p"))
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    five = four.select(*counts, covered.alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return five.withColumn("base_failed", failed)


def vectors(counts: DataFrame) -> DataFrame:
    """`counts` with the transformed statistics."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return counts.withColumns({
        "v_length": F.log(words.cast("double")),
        "v_word": F.log((F.col("word_chars") + 1) / words),
        "v_symbols": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "v_lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "v_repeats": F.sqrt(F.col("n_repeat_words") / words),
    })


# ------------------------------------------------------------------ chi-square


def chi2_cdf(x: float, df: int) -> float:
    """Regularised lower incomplete gamma function by its series."""
    if x <= 0:
        return 0.0
    a, h = df / 2.0, x / 2.0
    term = total = 1.0 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= h / k
        total += term
    return total * math.exp(-h + a * math.log(h) - math.lgamma(a))


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


# ------------------------------------------------------------------ the estimate


def _pairs():
    return [(i, j) for i in range(len(STATS)) for j in range(i + 1)]


def _distance() -> Column:
    """Squared Mahalanobis distance from m (centre) and l (Cholesky factor of the
    scatter, rows joined) by forward substitution; staged in struct fields z0.. ."""
    return sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(len(STATS))), F.lit(0.0))


def with_distance(rows: DataFrame, out: str = "d2") -> DataFrame:
    """Rows that hold statistics, m0.. and l00.., with the squared distance."""
    for i, s in enumerate(STATS):
        rest = F.col(s) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"z{j}")
        rows = rows.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return rows.withColumn(out, _distance()).drop(*(f"z{i}" for i in range(len(STATS))))


def cholesky(est: DataFrame) -> DataFrame:
    """Estimates with m0.. and scatter c00.. get the factor l00.. and ln of the
    determinant; the floors are added to the diagonal."""
    for i, s in enumerate(STATS):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") + (FLOORS[s] ** 2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # A scatter is positive definite with its floor; rounding may say otherwise.
            value = F.sqrt(F.greatest(rest, F.lit(FLOORS[s] ** 2 / 4))) if i == j else rest / F.col(f"l{j}{j}")
            est = est.withColumn(f"l{i}{j}", value)
    logdet = sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(len(STATS))), F.lit(0.0))
    keys = [c for c in est.columns if not c.startswith("c") or c == "count"]
    return est.withColumn("logdet", logdet).select(*keys, "logdet")


def _moments() -> list[Column]:
    sums = [F.sum(s).alias(f"s{i}") for i, s in enumerate(STATS)]
    return [F.count(F.lit(1)).alias("n"), *sums] + [
        F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"p{i}{j}") for i, j in _pairs()
    ]


def _from_moments(sums: DataFrame, keys: list[str], factor: Column) -> DataFrame:
    """Centre and scatter (times `factor`) from n, s0.., p00.. ."""
    means = {f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(len(STATS))}
    sums = sums.withColumns(means)
    scatter = [
        (factor * (F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"))).alias(f"c{i}{j}")
        for i, j in _pairs()
    ]
    return sums.select(*keys, *means, *scatter)


def _consistency(share: Column, pieces: int = 64) -> Column:
    """Factor that makes a scatter of the nearest `share` of Gaussian rows unbiased,
    by linear steps over a table of the share (a fixed small map)."""
    p = len(STATS)
    table = [a / pieces / chi2_cdf(chi2_quantile(a / pieces, p), p + 2) for a in range(1, pieces)] + [1.0]
    at = F.least(F.greatest(F.ceil(share * pieces), F.lit(1)), F.lit(pieces)).cast("int")
    return F.element_at(F.array(*(F.lit(float(x)) for x in table)), at)


def _concentrate(rows: DataFrame, est: DataFrame, sizes: DataFrame) -> DataFrame:
    """One concentration step of every unit and start."""
    near = with_distance(rows.join(est, "unit"))
    binned = near.withColumn("bin", F.floor(F.log(F.col("d2") + 1e-3) * BINS).cast("int"))
    per = binned.groupBy("unit", "start", "bin").agg(*_moments())
    before = W.partitionBy("unit", "start").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("nearer", F.coalesce(F.sum("n").over(before), F.lit(0))).join(sizes, "unit")
    kept = per.where(F.col("nearer") < F.ceil(F.col("size") * SUPPORT))
    sums = kept.groupBy("unit", "start").agg(
        F.first("size").alias("size"), F.sum("n").alias("n"),
        *(F.sum(f"s{i}").alias(f"s{i}") for i in range(len(STATS))),
        *(F.sum(f"p{i}{j}").alias(f"p{i}{j}") for i, j in _pairs()),
    )
    factor = _consistency(F.col("n") / F.col("size"))
    return C.stage(cholesky(_from_moments(sums, ["unit", "start"], factor)), "mcd")


def _units(rows: DataFrame, min_unit: int) -> DataFrame:
    """unit of each (lang, source): the pair itself, or a pool of small pairs."""
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    pairs = rows.select(lang.alias("lang"), source.alias("source")).groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n")
    )
    pair = F.concat(F.lit("p:"), F.to_json(F.array("lang", "source")))
    small = F.col("n") < min_unit
    langs = pairs.groupBy("lang").agg(
        F.sum(F.when(small, F.col("n")).otherwise(0)).alias("pool"),
        F.max(F.struct("n", pair.alias("unit"))).alias("top"),
    )
    key = (
        F.when(~small, pair)
        .when(F.col("pool") >= min_unit, F.concat(F.lit("l:"), F.col("lang")))
        .when(F.col("top.n") >= min_unit, F.col("top.unit"))
        .otherwise(F.lit("all"))
    )
    return pairs.join(langs, "lang").select("lang", "source", key.alias("unit"))


def estimate(rows: DataFrame, tail: float = TAIL, min_unit: int = MIN_UNIT) -> tuple[DataFrame, DataFrame]:
    """(units, estimates) of staged rows with lang, source and the statistics.

    units: lang, source, unit; estimates: unit, m0.., l00.. and size."""
    units = C.stage(_units(rows, min_unit), "units")
    keyed = C.stage(
        rows.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), *STATS)
        .join(units, ["lang", "source"]).select("unit", *STATS),
        "vectors",
    )
    p = len(STATS)
    spread = keyed.groupBy("unit").agg(
        F.count(F.lit(1)).alias("size"),
        *(F.percentile_approx(s, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1000)).alias(f"q{i}")
          for i, s in enumerate(STATS)),
    )
    spread = C.stage(
        spread.where(F.col("size") >= min_unit).select(
            "unit", "size",
            *(F.col(f"q{i}")[1].alias(f"m{i}") for i in range(p)),
            *(F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOORS[s])).alias(f"d{i}")
              for i, s in enumerate(STATS)),
        ),
        "spread",
    )
    sizes = spread.select("unit", "size")
    centre = [f"m{i}" for i in range(p)]
    zero = F.lit(0.0)
    # Start 0: median and spread of each statistic alone.
    alone = spread.select("unit", F.lit(0).alias("start"), *centre, *(
        (F.col(f"d{i}") * F.col(f"d{i}") if i == j else zero).alias(f"c{i}{j}") for i, j in _pairs()
    ))
    # Start 1: correlations of the hyperbolic tangent of the standardised statistics.
    bent = keyed.join(spread, "unit").select(
        "unit", *(F.tanh((F.col(s) - F.col(f"m{i}")) / F.col(f"d{i}")).alias(s) for i, s in enumerate(STATS))
    )
    bent = bent.groupBy("unit").agg(*_moments())
    bent = _from_moments(bent, ["unit"], F.lit(1.0)).select(
        "unit", *(F.col(f"c{i}{j}").alias(f"r{i}{j}") for i, j in _pairs())
    )

    def scaled(i: int, j: int) -> Column:
        d = F.col(f"d{i}") * F.col(f"d{j}")
        base = F.sqrt((F.col(f"r{i}{i}") + 1e-9) * (F.col(f"r{j}{j}") + 1e-9))
        return (d if i == j else d * F.col(f"r{i}{j}") / base).alias(f"c{i}{j}")

    joint = spread.join(bent, "unit").select("unit", F.lit(1).alias("start"), *centre, *(scaled(i, j) for i, j in _pairs()))
    est = C.stage(cholesky(alone.unionByName(joint)), "starts")
    for _ in range(STEPS):
        est = _concentrate(keyed, est, sizes)
    best = est.groupBy("unit").agg(F.min(F.struct("logdet", "start")).alias("b")).select(
        "unit", F.col("b.start").alias("start")
    )
    est = C.stage(est.join(best, ["unit", "start"]), "best")
    # Reweighting: everything within the 97.5 % quantile counts.
    inner = chi2_quantile(0.975, p)
    sums = with_distance(keyed.join(est, "unit")).where(F.col("d2") <= inner).groupBy("unit").agg(*_moments())
    factor = F.lit(0.975 / chi2_cdf(inner, p + 2))
    final = C.stage(cholesky(_from_moments(sums, ["unit"], factor)), "estimate")
    return units, final


def verdicts(docs: DataFrame, tail: float = TAIL, min_unit: int = MIN_UNIT, extra: dict | None = None) -> DataFrame:
    """doc_id, the counts, base_failed, d2 (null without estimate) and kept.

    `extra`: further columns of `docs`, by name, that the result carries."""
    extra = extra or {}
    base = docs.select("doc_id", "text", "lang", "source", *(c.alias(n) for n, c in extra.items()))
    rows = C.stage(vectors(text_counts(base)), "counts")
    units, est = estimate(rows.where(~F.col("base_failed")), tail, min_unit)
    keys = {"lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit(""))}
    known = units.join(est, "unit", "left").drop("unit")
    scored = with_distance(rows.withColumns(keys).join(known, ["lang", "source"], "left"))
    limit = chi2_quantile(1 - tail, len(STATS))
    kept = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= limit)
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        kept.alias("kept"), "d2", *extra,
    )


def keep_good(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """Rows of `docs` that the rules keep, all columns."""
    found = verdicts(docs, tail, extra={"row_key": C.row_key()})
    kept = C.stage(found.where("kept").select("row_key").distinct(), "kept")
    return C.rows_of(docs, kept, "row_key", one_each=False)
