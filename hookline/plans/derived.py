"""Inputs derived from the driver tables.

The driver's tables hold no brands, threats, forms or model outputs, so the
registered queries derive comparable inputs from them: each row of a driver
table yields one URL (or page, probability vector, event) by key arithmetic.
The same rules are written in DuckDB SQL in ``hookline.plans.oracle``; both
scale with the size of the driver tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hookline import constants as K


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], key: Column) -> Column:
    """values[key % len] (0-based arithmetic, 1-based element_at)."""
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def real_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), F.lit("real").alias("source"), "url"
    )


def brand_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand look-alike URLs: pattern × brand × TLD chosen from the customer key."""
    k = F.col("c_custkey")
    brand = _pick(K.BRAND_KEYWORDS, k)
    host = F.replace(_pick(K.SYNTH_PATTERNS, k), F.lit("{brand}"), brand)
    sub = F.when(F.pmod(k, F.lit(3)) == 0, F.concat(_pick(K.SYNTH_SUBS, k), F.lit("."))).otherwise(F.lit(""))
    path = F.when(
        F.pmod(k, F.lit(4)) == 1, F.concat(F.lit("/"), _pick(K.SYNTH_PATH_WORDS, k), F.lit("/"), k.cast("string"))
    ).otherwise(F.lit(""))
    query = F.when(F.pmod(k, F.lit(5)) == 0, F.concat(F.lit("?ref="), k.cast("string"))).otherwise(F.lit(""))
    scheme = F.when(F.pmod(k, F.lit(10)) < 7, F.lit("https://")).otherwise(F.lit("http://"))
    url = F.concat(scheme, sub, host, _pick(K.SYNTH_TLDS, k), path, query)
    return read(spark, sf_dir, "customer").select(k.alias("id"), F.lit("brand").alias("source"), url.alias("url"))


def legit_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    url = F.concat(F.lit("https://www."), _pick(K.LEGITIMATE_DOMAINS, k))
    return read(spark, sf_dir, "supplier").select(k.alias("id"), F.lit("legit").alias("source"), url.alias("url"))


def odd_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shapes keyed by ``o_orderkey % 8``: IPv4 host, ``@`` trick, port,
    long path, percent-encoding, no scheme, XSS value, executable download."""
    k = F.col("o_orderkey")
    ks = k.cast("string")
    m = F.pmod(k, F.lit(8))
    ends = F.array(*[F.lit(x) for x in K.ODD_SUFFIXES])
    end = F.element_at(ends, (F.pmod(F.floor(k / 8), F.lit(len(K.ODD_SUFFIXES))) + 1).cast("int"))
    url = (
        F.when(
            m == 0,
            F.concat(
                F.lit("http://"), (F.pmod(k, F.lit(223)) + 1).cast("string"), F.lit("."),
                F.pmod(k, F.lit(97)).cast("string"), F.lit("."), F.pmod(k, F.lit(13)).cast("string"), F.lit("."),
                F.pmod(k, F.lit(251)).cast("string"), F.lit("/login.php?id="), ks,
            ),
        )
        .when(m == 1, F.concat(F.lit("https://secure-update.com@acct"), ks, F.lit(".example.com/verify")))
        .when(m == 2, F.concat(F.lit("HTTP://Host"), ks, F.lit(".Example.NET:8080/Account/Update")))
        .when(m == 3, F.concat(F.lit("https://files.example.org/"), F.repeat(F.lit("ab1-"), 30), ks))
        .when(m == 4, F.concat(F.lit("https://news.example.com/%70%61th/"), ks, F.lit("?q=%3Cscript%3E&r=caf%C3%A9+x&d=50%%3Cscript%3E")))
        .when(m == 5, F.concat(F.lit("www.shop"), ks, F.lit(".example.com/cart;v=1?item="), ks))
        .when(
            m == 6,
            F.concat(
                F.lit("https://search.example.com/find?q=<script>alert("), ks,
                F.lit(")</script>&next=javascript:void(0)"),
            ),
        )
        .otherwise(F.concat(F.lit("http://download"), ks, end, F.lit("/setup.exe")))
    )
    return read(spark, sf_dir, "orders").select(k.alias("id"), F.lit("odd").alias("source"), url.alias("url"))


def typo_variants(spark: SparkSession) -> DataFrame:
    """(brand_ord, brand, variants sorted) for the 62 brands — H2's rules."""
    from hookline.operators.corpus import brand_table, typos_for

    return (
        typos_for(brand_table(spark, K.BRAND_KEYWORDS))
        .groupBy("brand_ord", "brand")
        .agg(F.array_sort(F.collect_set("typo")).alias("variants"))
    )


def typo_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant ``p_partkey`` of the typo list of brand ``p_partkey % 62``."""
    k = F.col("p_partkey")
    part = read(spark, sf_dir, "part").select(k, (F.pmod(k, F.lit(len(K.BRAND_KEYWORDS))) + 1).alias("brand_ord"))
    # 62 rows: a bounded, constant-size side.
    variants = F.broadcast(typo_variants(spark))
    v = part.join(variants, "brand_ord")
    typo = F.element_at(F.col("variants"), (F.pmod(k, F.size("variants")) + 1).cast("int"))
    scheme = F.when(F.pmod(k, F.lit(2)) == 0, F.lit("https://")).otherwise(F.lit("http://"))
    url = F.concat(scheme, typo, _pick(K.SYNTH_TLDS, k))
    return v.select(k.alias("id"), F.lit("typo").alias("source"), url.alias("url"))


def typed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All derived URLs with a class label by source."""
    odd = odd_urls(spark, sf_dir)
    parts = [
        real_urls(spark, sf_dir).withColumn("type", F.lit("benign")),
        legit_urls(spark, sf_dir).withColumn("type", F.lit("benign")),
        brand_urls(spark, sf_dir).withColumn("type", F.lit("phishing")),
        typo_urls(spark, sf_dir).withColumn("type", F.lit("phishing")),
        odd.withColumn("type", F.when(F.pmod(F.col("id"), F.lit(2)) == 0, "malware").otherwise("defacement")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def given_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: a true class and three models' probabilities over the four
    classes from key arithmetic, each model's row normalised to sum 1."""
    k = F.col("o_orderkey")
    cols = {}
    for mi, m in enumerate(["xgb", "lgb", "rf"]):
        raw = [F.pmod(k * (7 + 3 * mi + ci) + 11 * ci + mi, F.lit(97)) + 1 for ci in range(4)]
        # A strong vote for one class on most rows, so that bands differ.
        boost = [F.when(F.pmod(k + mi, F.lit(4)) == ci, F.lit(300)).otherwise(F.lit(0)) for ci in range(4)]
        vals = [(r + b).cast("double") for r, b in zip(raw, boost)]
        total = vals[0] + vals[1] + vals[2] + vals[3]
        for ci, c in enumerate(K.CLASSES):
            cols[f"{m}_{c}"] = vals[ci] / total
    label = _pick(K.CLASSES, F.floor(k / 3))
    return read(spark, sf_dir, "orders").select(k.alias("id"), label.alias("label"), *[v.alias(n) for n, v in cols.items()])


def url_model_probs(typed: DataFrame) -> DataFrame:
    """One model's class probabilities per typed URL from key arithmetic;
    ``model_pred`` is the boosted (largest) class."""
    k = F.col("id") * 7 + F.length("source")
    vals = [
        (F.pmod(k * (7 + ci) + 11 * ci, F.lit(97)) + 1 + F.when(F.pmod(k, F.lit(4)) == ci, F.lit(300)).otherwise(F.lit(0))).cast("double")
        for ci in range(4)
    ]
    total = vals[0] + vals[1] + vals[2] + vals[3]
    cols = {f"p_{c}": vals[ci] / total for ci, c in enumerate(K.CLASSES)}
    return typed.select("id", "source", "url", _pick(K.CLASSES, k).alias("model_pred"), *[v.alias(n) for n, v in cols.items()])


def ensemble_probs(urls: DataFrame) -> DataFrame:
    """Three models' class probabilities per URL (id, source, url) from key arithmetic."""
    out = urls.select("id", "source", "url")
    for mi, m in enumerate(["xgb", "lgb", "rf"]):
        k = F.col("id") * 7 + F.length("source") + 5 * mi
        vals = [
            (F.pmod(k * (7 + ci) + 11 * ci, F.lit(97)) + 1 + F.when(F.pmod(k, F.lit(4)) == ci, F.lit(300)).otherwise(F.lit(0))).cast("double")
            for ci in range(4)
        ]
        total = vals[0] + vals[1] + vals[2] + vals[3]
        out = out.withColumns({f"{m}_{c}": vals[ci] / total for ci, c in enumerate(K.CLASSES)})
    return out


# Tags appended to the driver's pages by ``page_id % 6`` (the driver's HTML has
# no forms, password fields or external scripts).
PAGE_TAGS = [
    '<form action="http://forms.example.com/login" method="post"><input name="u"></form>',
    '<form action="https://secure.example.com/login"></form><form method="get"></form>',
    '<form action="/signin"><input type="password" name="pw"></form>',
    '<script src="https://coinhive.com/lib/coinhive.min.js"></script>',
    '<script src="https://cdn.example.com/app.js"></script><SCRIPT SRC="//webminer.pro/m.js"></SCRIPT>',
    "",
]


def page_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    return read(spark, sf_dir, "pages").select(
        k, "url", F.concat(F.col("html"), _pick(PAGE_TAGS, k)).alias("html")
    )


def threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threat strings: the hosts of every tenth page."""
    from hookline.functions.urls import browser_hostname

    p = read(spark, sf_dir, "pages")
    return p.where(F.pmod(F.col("page_id"), F.lit(10)) == 0).select(browser_hostname(F.col("url")).alias("threat")).distinct()


def navigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed URLs as navigation requests; every fifth is a sub-resource."""
    t = typed_urls(spark, sf_dir)
    rtype = F.when(F.pmod(F.col("id"), F.lit(5)) == 4, F.lit("image")).otherwise(F.lit("main_frame"))
    return t.select("id", "source", "url", rtype.alias("resource_type"))


def ranked_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rank, domain): rank = customer key; even ranks a legitimate domain,
    odd ranks a brand look-alike host."""
    k = F.col("c_custkey")
    lookalike = F.concat(F.replace(_pick(K.SYNTH_PATTERNS, k), F.lit("{brand}"), _pick(K.BRAND_KEYWORDS, k)), _pick(K.SYNTH_TLDS, k))
    dom = F.when(F.pmod(k, F.lit(2)) == 0, _pick(K.LEGITIMATE_DOMAINS, k)).otherwise(lookalike)
    return read(spark, sf_dir, "customer").select(k.cast("int").alias("rank"), dom.alias("domain"))


def synth_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generator brands named by the customer keys (distinct)."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(_pick(K.SYNTH_BRANDS, k).alias("brand")).distinct()
