"""Corpus building: ranked domains, synthetic look-alike URLs, merges,
samples and splits (A2–A5, E4, H1–H12, I1–I5, J1–J5).

Random draws of the original scripts become hash draws keyed by the row and a
seed, so every output is reproducible on any partitioning and needs no
driver-side state.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hookline import constants as K


# ------------------------------------------------------------------ helpers

def brand_table(spark: SparkSession, brands: Sequence[str] = K.BRAND_KEYWORDS) -> DataFrame:
    """(brand_ord, brand), 1-based order — a constant, bounded dimension."""
    return spark.createDataFrame([(i + 1, b) for i, b in enumerate(brands)], "brand_ord int, brand string")


def unit_hash(*cols: Column | str, seed: int = 42) -> Column:
    """Deterministic draw in [0, 1): the first 32 bits of ``md5(seed|cols)``.

    md5 is used (not xxhash64) so that the same draw can be written in any
    SQL engine, which is how the generators are checked."""
    parts = [F.lit(str(seed))] + [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    hexs = F.substr(F.md5(F.concat_ws("|", *parts)), F.lit(1), F.lit(8))
    return F.conv(hexs, 16, 10).cast("long").cast("double") / 4294967296.0


def _positions(b: Column) -> Column:
    return F.sequence(F.lit(1), F.length(b))


def _before(b: Column, i: Column) -> Column:
    return F.substr(b, F.lit(1), i - 1)


def _after(b: Column, i: Column) -> Column:
    return F.substr(b, i + 1, F.length(b))


def _char(b: Column, i: Column) -> Column:
    return F.substr(b, i, F.lit(1))


# ------------------------------------------------------------ typo generators

def typos_for(brands: DataFrame, brand_col: str = "brand") -> DataFrame:
    """H2: typo variants of each brand (homoglyph, omission when longer than
    3, duplication, adjacent swap, digit affixes, digram replacement); the
    brand itself and empty strings are excluded.  Returns (…, typo)."""
    b = F.col(brand_col)
    homo = F.create_map(*[x for kv in K.SYNTH_HOMO.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    n = F.length(b)
    homoglyph = F.transform(
        _positions(b),
        lambda i: F.when(
            F.element_at(homo, _char(b, i)).isNotNull(),
            F.concat(_before(b, i), F.element_at(homo, _char(b, i)), _after(b, i)),
        ),
    )
    omission = F.when(n > 3, F.transform(_positions(b), lambda i: F.concat(_before(b, i), _after(b, i)))).otherwise(
        F.array().cast("array<string>")
    )
    duplication = F.transform(_positions(b), lambda i: F.concat(F.substr(b, F.lit(1), i), F.substr(b, i, F.length(b))))
    swap = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.when(
            i <= n - 1, F.concat(_before(b, i), _char(b, i + 1), _char(b, i), F.substr(b, i + 2, F.length(b)))
        ),
    )
    affix = F.array(*[F.concat(b, F.lit(d)) for d in K.SYNTH_DIGIT_AFFIXES] + [F.concat(F.lit(d), b) for d in K.SYNTH_DIGIT_AFFIXES])
    digram = F.array(*[F.when(b.contains(o), F.replace(b, F.lit(o), F.lit(nw))) for o, nw in K.SYNTH_DIGRAMS])
    allv = F.concat(homoglyph, omission, duplication, swap, affix, digram)
    return (
        brands.select("*", F.explode(F.array_distinct(allv)).alias("typo"))
        .where(F.col("typo").isNotNull() & (F.col("typo") != "") & (F.col("typo") != b))
    )


def typo_patterns(brands: DataFrame, brand_col: str = "brand") -> DataFrame:
    """Look-alike patterns of each brand: single and double substitution
    (several targets per letter), omission when longer than 4, duplication and
    adjacent swap.  Swapping two equal letters keeps the brand itself.  Returns
    distinct (…, pattern)."""
    b = F.col(brand_col)
    subs = F.create_map(
        *[x for k, v in K.TYPO_SUBSTITUTIONS.items() for x in (F.lit(k), F.array(*[F.lit(r) for r in v]))]
    )
    n = F.length(b)
    pos = _positions(b)

    def reps(i: Column) -> Column:
        return F.coalesce(F.element_at(subs, _char(b, i)), F.array().cast("array<string>"))

    single = F.flatten(
        F.transform(pos, lambda i: F.transform(reps(i), lambda r: F.concat(_before(b, i), r, _after(b, i))))
    )
    pairs = F.flatten(
        F.transform(pos, lambda i: F.transform(F.filter(pos, lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j"))))
    )
    double = F.flatten(
        F.flatten(
            F.transform(
                pairs,
                lambda p: F.transform(
                    reps(p["i"]),
                    lambda r1: F.transform(
                        reps(p["j"]),
                        lambda r2: F.concat(
                            _before(b, p["i"]), r1, F.substr(b, p["i"] + 1, p["j"] - p["i"] - 1), r2, _after(b, p["j"])
                        ),
                    ),
                ),
            )
        )
    )
    omission = F.when(n > 4, F.transform(pos, lambda i: F.concat(_before(b, i), _after(b, i)))).otherwise(
        F.array().cast("array<string>")
    )
    duplication = F.transform(pos, lambda i: F.concat(F.substr(b, F.lit(1), i), F.substr(b, i, F.length(b))))
    swap = F.filter(
        F.transform(
            pos,
            lambda i: F.when(
                i <= n - 1, F.concat(_before(b, i), _char(b, i + 1), _char(b, i), F.substr(b, i + 2, F.length(b)))
            ),
        ),
        lambda x: x.isNotNull(),
    )
    allp = F.array_distinct(F.concat(single, double, omission, duplication, swap))
    return brands.select("*", F.explode(allp).alias("pattern"))


# ------------------------------------------------------------ URL generators

def _pick(values: Sequence[str], h: Column) -> Column:
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (F.floor(h * len(values)) + 1).cast("int"))


def make_url(host: Column, tld: Column, sub: Column | None, path: Column, query: Column, h: Column) -> Column:
    """H8: https with probability 0.7 (hash draw ``h``), optional subdomain."""
    scheme = F.when(h < K.SYNTH_HTTPS_SHARE, F.lit("https://")).otherwise(F.lit("http://"))
    full = F.concat(host, tld) if sub is None else F.when(sub.isNull(), F.concat(host, tld)).otherwise(
        F.concat(sub, F.lit("."), host, tld)
    )
    return F.concat(scheme, full, path, query)


def random_token(h: Column, n: int) -> Column:
    """Lower-case alphanumeric token of length ``n`` (up to 16) from a hash: each byte of
    it draws a character."""

    def spelt(digest: Column) -> Column:
        byte = lambda i: F.conv(F.substr(digest, F.lit(2 * i + 1), F.lit(2)), 16, 10).cast("int")
        return F.concat(*[F.substr(F.lit(K.TOKEN_ALPHABET), byte(i) % len(K.TOKEN_ALPHABET) + 1, F.lit(1)) for i in range(n)])

    digest = F.md5(F.concat(F.lit("t|"), h.cast("string")))
    return F.transform(F.array(digest), spelt)[0]


def random_path(key: Column, seed: int) -> Column:
    """H8: depth 0–3 with weights .4/.35/.2/.05, words or a 6-char token."""
    d = unit_hash(key, seed=seed)
    w = K.SYNTH_PATH_DEPTH_WEIGHTS
    depth = (
        F.when(d < w[0], F.lit(0)).when(d < w[0] + w[1], F.lit(1)).when(d < w[0] + w[1] + w[2], F.lit(2)).otherwise(F.lit(3))
    )
    words = K.SYNTH_PATH_WORDS + ["<token>"]

    def part(j: int) -> Column:
        hj = unit_hash(key, F.lit(j), seed=seed + 1)
        w_ = _pick(words, hj)
        return F.when(w_ == "<token>", random_token(F.concat(key.cast("string"), F.lit(j)), 6)).otherwise(w_)

    segs = F.slice(F.array(part(1), part(2), part(3)), 1, F.greatest(depth, F.lit(1)))
    return F.when(depth == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(segs, "/")))


def random_query(key: Column, seed: int) -> Column:
    """H8: ``?k=token`` with probability 0.25."""
    q = unit_hash(key, seed=seed)
    k = _pick(K.SYNTH_QUERY_KEYS, unit_hash(key, seed=seed + 1))
    return F.when(q < K.SYNTH_QUERY_SHARE, F.concat(F.lit("?"), k, F.lit("="), random_token(key, 6))).otherwise(F.lit(""))


def pattern_urls(brands: DataFrame, seed: int = 42) -> DataFrame:
    """H1: brand × 35 host patterns × 29 TLDs, three URL shapes each (bare,
    with a subdomain, with path and optional query).  The pattern and TLD
    pools are constant literal arrays, so this is a per-brand explode — no
    cross join of data."""
    pats = F.array(*[F.lit(p) for p in K.SYNTH_PATTERNS])
    tlds = F.array(*[F.lit(t) for t in K.SYNTH_TLDS])
    x = (
        brands.select("*", F.posexplode(pats).alias("pat_ord", "pat"))
        .select("*", F.posexplode(tlds).alias("tld_ord", "tld"))
        .withColumn("host", F.replace(F.col("pat"), F.lit("{brand}"), F.col("brand")))
        .select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("shape"))
    )
    key = F.concat_ws("|", F.col("brand"), F.col("pat_ord").cast("string"), F.col("tld_ord").cast("string"), F.col("shape").cast("string"))
    h = unit_hash(key, seed=seed)
    sub = F.when(F.col("shape") == 1, _pick(K.SYNTH_SUBS, unit_hash(key, seed=seed + 1)))
    path = F.when(
        F.col("shape") == 2,
        F.concat(F.lit("/"), _pick(["login", "secure", "account"], unit_hash(key, seed=seed + 2)), F.lit("/"), random_token(key, 5)),
    ).otherwise(F.lit(""))
    query = F.when(
        (F.col("shape") == 2) & (unit_hash(key, seed=seed + 3) < 0.3), F.concat(F.lit("?ref="), random_token(F.concat(key, F.lit("q")), 6))
    ).otherwise(F.lit(""))
    return x.select("brand", "pat_ord", "tld_ord", "shape", make_url(F.col("host"), F.col("tld"), sub, path, query, h).alias("url"))


def brand_path_urls(brands: DataFrame, seed: int = 42) -> DataFrame:
    """H4: eight suspicious-path URLs per brand."""
    x = brands.select("*", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("n"))
    key = F.concat_ws("|", F.col("brand"), F.col("n").cast("string"))
    tld = _pick(K.SYNTH_TLDS, unit_hash(key, seed=seed))
    sub = _pick(K.SYNTH_SUBS + ["<none>"], unit_hash(key, seed=seed + 1))
    sub = F.when(sub != "<none>", sub)
    path = F.concat(F.lit("/"), _pick(K.SYNTH_BRAND_PATH_WORDS, unit_hash(key, seed=seed + 2)), F.lit("/"), random_token(key, 5))
    return x.select("brand", "n", make_url(F.col("brand"), tld, sub, path, random_query(key, seed + 3), unit_hash(key, seed=seed + 4)).alias("url"))


def numeric_brand_urls(brands: DataFrame, seed: int = 42) -> DataFrame:
    """H6: brand followed by a 2–3, 4 and 5 digit number."""
    x = brands.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("n"))
    key = F.concat_ws("|", F.col("brand"), F.col("n").cast("string"))
    lo = F.element_at(F.array(F.lit(10), F.lit(1000), F.lit(10000)), F.col("n") + 1)
    hi = F.element_at(F.array(F.lit(999), F.lit(9999), F.lit(99999)), F.col("n") + 1)
    num = (lo + F.floor(unit_hash(key, seed=seed) * (hi - lo + 1))).cast("long").cast("string")
    host = F.concat(F.col("brand"), num)
    tld = _pick(K.SYNTH_TLDS, unit_hash(key, seed=seed + 1))
    return x.select(
        "brand", "n",
        make_url(host, tld, None, random_path(key, seed + 2), random_query(key, seed + 4), unit_hash(key, seed=seed + 6)).alias("url"),
    )


def dedupe_urls(df: DataFrame, url_col: str = "url") -> DataFrame:
    """One row per URL."""
    return df.dropDuplicates([url_col])


def tag_seed(df: DataFrame, label: str, seed: int) -> DataFrame:
    """Add ``type`` and ``seed``."""
    return df.withColumn("type", F.lit(label)).withColumn("seed", F.lit(seed))


# ------------------------------------------------------ ranked domain sources

def ranked_top(df: DataFrame, n: int) -> DataFrame:
    """A2: the first ``n`` ranks (by rank, not file order)."""
    return df.where(F.col("rank") <= n)


def rank_slices(df: DataFrame, head: int = 1000, lo: int = 40001, hi: int = 48000) -> DataFrame:
    """A3: ranks 1..head union lo..hi."""
    return df.where((F.col("rank") <= head) | F.col("rank").between(lo, hi))


def domains_to_urls(df: DataFrame) -> DataFrame:
    """A4: ``https://www.<domain>`` labelled benign."""
    return df.select("rank", F.concat(F.lit("https://www."), F.col("domain")).alias("url"), F.lit("benign").alias("type"))


def coverage_check(domains: DataFrame, sites: DataFrame) -> DataFrame:
    """For each (category, site) whether the ranked list holds the exact
    domain, and its best rank.  ``sites`` is a small fixed list (broadcast)."""
    j = F.broadcast(sites).join(domains, F.col("site") == F.col("domain"), "left")
    return j.groupBy("category", "site").agg(
        (F.count("domain") > 0).alias("found"), F.min("rank").alias("rank")
    )


def site_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, s) for c, sites in K.COVERAGE_SITES for s in sites], "category string, site string")


# ------------------------------------------------------------ set operations

def merge_on_common_columns(frames: Sequence[DataFrame]) -> DataFrame:
    """Keep the columns all frames share (sorted), then union all."""
    common = sorted(reduce(lambda a, b: a & b, [set(f.columns) for f in frames]))
    return reduce(lambda a, b: a.unionByName(b), [f.select(*common) for f in frames])


def merge_same_schema(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack same-schema frames by name.  Frames whose columns differ from the first
    one's, in names or order, are stacked with a warning; what they lack is null."""
    expected = frames[0].columns
    for i, f in enumerate(frames[1:], 2):
        if f.columns != expected:
            warnings.warn(f"frame {i} has the columns {f.columns}, expected {expected}", stacklevel=2)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# ------------------------------------------------------ sampling and splits

def sample_up_to(df: DataFrame, n: int, seed: int, key: str = "url") -> DataFrame:
    """``n`` rows by a seeded hash order (all rows if fewer).

    The rows are counted per hash prefix (65,536 small counts).  Prefixes that fit
    wholly are kept as they are; only the one that the limit cuts is ranked."""
    h = F.md5(F.concat(F.lit(str(seed)), F.lit("|"), F.col(key)))
    x = df.withColumn("_h", h).withColumn("_b", F.coalesce(F.substring("_h", 1, 4), F.lit("")))
    order = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = x.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).where(F.col("_before") < n)
    x = x.join(F.broadcast(per), "_b")
    whole = F.col("_before") + F.col("_n") <= n
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    cut = x.where(~whole).withColumn("_r", rank).where(F.col("_before") + F.col("_r") <= n)
    return x.where(whole).unionByName(cut.drop("_r")).select(*df.columns)


def numbered(df: DataFrame, order: list, column: str = "position") -> DataFrame:
    """`df` with its place (from 0) in the order of the `order` columns, nulls first.

    Rows are dealt out by ranges of the order and numbered inside their range, behind
    the rows of the ranges before; no window spans the table.  Rows that are equal in
    all of `order` may change places, and are split over ranges like others."""
    from hookline.session import materialize, parallelism

    keys = [f"_o{i}" for i in range(len(order))]
    x = df.withColumns(dict(zip(keys, order)) | {"_row": F.monotonically_increasing_id()})
    # One materialisation: both uses below must see the same ranges.
    x = materialize(
        x.repartitionByRange(parallelism(df.sparkSession), *keys, "_row").withColumn("_range", F.spark_partition_id()))
    sizes = x.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row per range
    before = sizes.select("_range", F.coalesce(
        F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*keys, "_row")) - 1
    return (
        x.withColumn("_place", place).join(F.broadcast(before), "_range")
        .withColumn(column, F.col("_before") + F.col("_place")).drop(*keys, "_row", "_range", "_place", "_before")
    )


def shuffle(df: DataFrame, key: str = "url", seed: int = 42, column: str = "position") -> DataFrame:
    """A permutation of all rows as their new place (from 0), the same on any
    partitioning: the order of a seeded hash of the key, then of the whole row."""
    h = F.md5(F.concat(F.lit(str(seed)), F.lit("|"), F.col(key).cast("string")))
    return numbered(df, [h, F.xxhash64(*df.columns)], column)


def stratified_ranks(df: DataFrame, label: str = "type", key: str = "url", seed: int = 42,
                     prefix_hex: int = 4, counted: DataFrame | None = None) -> DataFrame:
    """Rank rows inside their class by a seeded hash; adds ``cls_rank``
    (1-based, exact) and ``cls_n``.  Reproducible, unlike ``sampleBy`` /
    ``randomSplit``.

    A window partitioned by class alone would put a whole class (a third of
    the data or more) into one task.  Instead the hash is cut into
    ``16**prefix_hex`` buckets: a small (class, bucket) count table gives each
    bucket its offset by a running sum, and rows are numbered only inside
    their (class, bucket) group.

    ``counted``: the same rows with their label and key alone, if they cost less than
    ``df``'s; the buckets are counted on them.
    """
    h = F.md5(F.concat(F.lit(str(seed)), F.lit("|"), F.col(key)))

    def hashed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_h", h).withColumn("_b", F.substr(F.col("_h"), F.lit(1), F.lit(prefix_hex)))

    x = hashed(df)
    # At most 4 classes × 16**prefix_hex rows: a bounded table.
    buckets = (x if counted is None else hashed(counted)).groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_nb"))
    wcum = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wtot = Window.partitionBy(label)
    offsets = buckets.select(
        label, "_b",
        F.coalesce(F.sum("_nb").over(wcum), F.lit(0)).alias("_off"),
        F.sum("_nb").over(wtot).alias("cls_n"),
    )
    w = Window.partitionBy(label, "_b").orderBy("_h", key)
    ranked = x.withColumn("_r", F.row_number().over(w))
    return (
        ranked.join(F.broadcast(offsets), [label, "_b"])
        .withColumn("cls_rank", (F.col("_off") + F.col("_r")).cast("long"))
        .drop("_h", "_b", "_r", "_off")
    )


def stratified_split(df: DataFrame, label: str = "type", key: str = "url", seed: int = 42,
                     train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """80/10/10 per class by exact rank; adds ``split``."""
    r = stratified_ranks(df, label, key, seed)
    pos = F.col("cls_rank")
    n = F.col("cls_n")
    n_train = F.floor(n * train + 1e-9)
    n_valid = F.floor((n - n_train) * (valid / (1 - train)) + 1e-9)
    return r.withColumn(
        "split", F.when(pos <= n_train, "train").when(pos <= n_train + n_valid, "valid").otherwise("test")
    )


def stratified_kfold(df: DataFrame, k: int = 5, label: str = "type", key: str = "url", seed: int = 42) -> DataFrame:
    """fold = rank within class modulo k."""
    r = stratified_ranks(df, label, key, seed)
    return r.withColumn("fold", F.pmod(F.col("cls_rank") - 1, F.lit(k)).cast("int"))


def size_ladder(df: DataFrame, steps: int = 10, label: str = "type", key: str = "url", seed: int = 42) -> DataFrame:
    """Smallest ladder step (1..steps) whose fraction includes the row."""
    r = stratified_ranks(df, label, key, seed)
    return r.withColumn("step", F.ceil(F.col("cls_rank") * steps / F.col("cls_n")).cast("int"))


def split_assignments(df: DataFrame, label: str = "type", key: str = "url", seed: int = 42, k: int = 5,
                      steps: int = 10, train: float = 0.8, valid: float = 0.1,
                      counted: DataFrame | None = None) -> DataFrame:
    """J3 + J4 + J5 from one exact per-class ranking: ``split``
    (train/valid/test), ``fold`` (0..k-1) and ladder ``step`` (1..steps).
    ``counted``: as in ``stratified_ranks``."""
    r = stratified_ranks(df, label, key, seed, counted=counted)
    pos, n = F.col("cls_rank"), F.col("cls_n")
    n_train = F.floor(n * train + 1e-9)
    n_valid = F.floor((n - n_train) * (valid / (1 - train)) + 1e-9)
    return r.withColumns(
        {
            "split": F.when(pos <= n_train, "train").when(pos <= n_train + n_valid, "valid").otherwise("test"),
            "fold": F.pmod(pos - 1, F.lit(k)).cast("int"),
            "step": F.ceil(pos * steps / n).cast("int"),
        }
    )


# ------------------------------------------------- more generators

def typo_tld_urls(brands: DataFrame, seed: int = 42, per_brand: int = 15, tlds_per_typo: int = 8) -> DataFrame:
    """H3: the first ``per_brand`` typos of each brand (sorted) × ``tlds_per_typo``
    TLDs drawn without replacement, optional subdomain, path and query."""
    t = typos_for(brands).select("brand", "typo")
    per = t.groupBy("brand").agg(F.slice(F.array_sort(F.collect_set("typo")), 1, per_brand).alias("typos"))
    x = per.select("brand", F.explode("typos").alias("typo"))
    key = F.concat_ws("|", F.col("brand"), F.col("typo"))
    tlds = F.array(*[F.lit(v) for v in K.SYNTH_TLDS])
    ranked = F.array_sort(F.transform(tlds, lambda v: F.struct(F.md5(F.concat(key, F.lit("|"), v)).alias("h"), v.alias("t"))))
    x = x.select("brand", "typo", F.explode(F.slice(ranked, 1, tlds_per_typo)).alias("p")).select("brand", "typo", F.col("p.t").alias("tld"))
    k2 = F.concat_ws("|", F.col("brand"), F.col("typo"), F.col("tld"))
    sub = _pick(["<none>"] + K.SYNTH_SUBS, unit_hash(k2, seed=seed))
    sub = F.when(sub != "<none>", sub)
    return x.select(
        "brand", "typo", "tld",
        make_url(F.col("typo"), F.col("tld"), sub, random_path(k2, seed + 1), random_query(k2, seed + 3), unit_hash(k2, seed=seed + 5)).alias("url"),
    )


def brand_pair_urls(brands: DataFrame, seed: int = 42, first: int = 50, share: float = K.SYNTH_PAIR_SHARE) -> DataFrame:
    """H5: ordered pairs of the first ``first`` generator brands present, kept
    with probability ``share``; each brand row explodes the (bounded) list of
    partners, no join."""
    order = {b: i for i, b in reversed(list(enumerate(K.SYNTH_BRANDS)))}
    head = sorted({b for b in K.SYNTH_BRANDS}, key=lambda b: order[b])[:first]
    partners = F.array(*[F.lit(b) for b in head])
    x = brands.where(F.col("brand").isin(*head)).select(F.col("brand").alias("a"), F.explode(partners).alias("b"))
    x = x.where(F.col("a") != F.col("b"))
    key = F.concat_ws("|", F.col("a"), F.col("b"))
    x = x.where(unit_hash(key, seed=seed) < share)
    sub = _pick(["<none>", "www", "login"], unit_hash(key, seed=seed + 1))
    sub = F.when(sub != "<none>", sub)
    host = F.concat(F.col("a"), F.lit("-"), F.col("b"))
    tld = _pick(K.SYNTH_TLDS, unit_hash(key, seed=seed + 2))
    return x.select("a", "b", make_url(host, tld, sub, random_path(key, seed + 3), random_query(key, seed + 5), unit_hash(key, seed=seed + 7)).alias("url"))


def five_pattern_urls(keys: DataFrame, key_col: str, seed: int = 42) -> DataFrame:
    """H9: per key either a phishing URL of one of five shapes (IPv4 host,
    brand-keyword on a bad TLD, leetspeak brand, keyword subdomain spam, ``@``
    trick) or a legitimate URL (16 domains × 7 paths, https with p=.9)."""
    k = F.col(key_col).cast("string")

    def h(i: int) -> Column:
        return unit_hash(k, seed=seed + i)

    octet = [(F.floor(h(10 + j) * 255) + 1).cast("int").cast("string") for j in range(8)]
    ip1 = F.concat_ws(".", *octet[:4])
    ip2 = F.concat_ws(".", *octet[4:])
    kw, kw2 = _pick(K.RISK_HOST_WORDS, h(2)), _pick(K.RISK_HOST_WORDS, h(3))
    site = _pick(K.SMALL_SET_LEGIT_SITES, h(4))
    shape = F.floor(h(1) * 5).cast("int")
    phishing = (
        F.when(shape == 0, F.concat(F.lit("http://"), ip1, F.lit("/"), kw))
        .when(shape == 1, F.concat(F.lit("http://"), site, F.lit("-"), kw, F.lit("."), _pick(K.MINI_SUSPICIOUS_TLDS, h(5))))
        .when(shape == 2, F.concat(F.lit("http://"), F.replace(F.replace(site, F.lit("a"), F.lit("4")), F.lit("o"), F.lit("0")), F.lit(".com/"), kw))
        .when(shape == 3, F.concat(F.lit("http://"), kw, F.lit("."), site, F.lit("."), kw2, F.lit(".com")))
        .otherwise(F.concat(F.lit("http://legitimate.com@"), ip2))
    )
    legit = F.concat(
        F.when(h(6) > 0.1, F.lit("https")).otherwise(F.lit("http")), F.lit("://"),
        _pick(K.SMALL_SET_DOMAINS, h(7)), _pick(K.SMALL_SET_PATHS, h(8)),
    )
    is_ph = F.pmod(F.col(key_col), F.lit(2)) == 1
    return keys.select(F.col(key_col).alias("id"), F.when(is_ph, phishing).otherwise(legit).alias("url"), is_ph.cast("int").alias("is_phishing"))


def host_diverse_sample(df: DataFrame, target: int, seed: int = 42, repeat_share: float = K.SYNTH_REPEAT_HOST_SHARE,
                        url_col: str = "url") -> DataFrame:
    """The first ``target`` URLs of a seeded shuffle, keeping a URL whose
    host is new, or a repeat with probability ``repeat_share``; when fewer
    than ``target`` remain the plain prefix is used.

    "New host" is the host's first position in the shuffle, found with a
    grouped ``min`` (map-side combined, so a hot host is one partial row per
    task) instead of a window over each host."""
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col(url_col)))
    prefix = sample_up_to(df.select(url_col), target, seed, url_col).withColumn("_o", order)
    host = F.substring_index(F.regexp_extract(F.col(url_col), r"^.*?://(.*)$", 1), "/", 1)
    x = prefix.withColumn("_host", host)
    firsts = x.groupBy("_host").agg(F.min(F.struct("_o", url_col)).alias("_first"))
    x = x.join(firsts, "_host")
    keep = (F.struct("_o", url_col) == F.col("_first")) | (unit_hash(F.col(url_col), seed=seed + 1) < repeat_share)
    x = x.withColumn("_keep", keep)
    kept = x.agg(F.sum(F.col("_keep").cast("int")).alias("_n"))
    return x.crossJoin(kept).where(F.col("_keep") | (F.col("_n") < target)).select(url_col)


def crafted_urls(keys: DataFrame, key_col: str, spark: SparkSession, seed: int = 42) -> DataFrame:
    """H7: one crafted look-alike URL per key: a generator brand, one of its
    typo variants, one of three host shapes (variant-word, variant+sep+token,
    variant+suffix word), a TLD, optional subdomain, path and query.  The
    per-brand variant lists are a bounded table (169 brands), broadcast."""
    brands = list(dict.fromkeys(K.SYNTH_BRANDS))
    variants = (
        typos_for(brand_table(spark, brands)).groupBy("brand").agg(F.array_sort(F.collect_set("typo")).alias("variants"))
    )
    k = F.col(key_col).cast("string")
    x = keys.select(k.alias("key"), _pick(K.SYNTH_BRANDS, unit_hash(k, seed=seed)).alias("brand"))
    x = x.join(F.broadcast(variants), "brand", "left")
    key = F.col("key")
    v = F.element_at(F.col("variants"), (F.floor(unit_hash(key, seed=seed + 1) * F.size("variants")) + 1).cast("int"))
    variant = F.coalesce(v, F.col("brand"))
    shape = F.floor(unit_hash(key, seed=seed + 2) * 3).cast("int")
    host = (
        F.when(shape == 0, F.concat(variant, F.lit("-"), _pick(["secure", "login", "verify", "auth"], unit_hash(key, seed=seed + 3))))
        .when(shape == 1, F.concat(variant, _pick(["", "-", "_"], unit_hash(key, seed=seed + 4)), random_token(F.concat(key, F.lit("h")), 3)))
        .otherwise(F.concat(variant, _pick(["", "auth", "portal", "pay"], unit_hash(key, seed=seed + 5))))
    )
    sub = _pick(["<none>"] + K.SYNTH_SUBS, unit_hash(key, seed=seed + 6))
    sub = F.when(sub != "<none>", sub)
    tld = _pick(K.SYNTH_TLDS, unit_hash(key, seed=seed + 7))
    return x.select("key", make_url(host, tld, sub, random_path(key, seed + 8), random_query(key, seed + 10), unit_hash(key, seed=seed + 12)).alias("url"))
