"""Browser-side rules (F1–F8) and page content scans.

Native column expressions but for the threat list (F2), whose threats go into
automata of bounded size.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookline import constants as K
from hookline.functions import text as TX
from hookline.functions import urls as U
from hookline.session import parallelism


# ----------------------------------------------------------------------- F1

def quick_risk_score(url: Column) -> Column:
    """F1: additive URL risk score, capped at 1.0; terms are added in the
    original order so the double sum is identical."""
    host = U.browser_hostname(url)
    terms = [
        (url.rlike(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), 0.3),
        (url.rlike(r"(?i)\.(" + "|".join(K.RISK_TLDS) + ")$"), 0.3),
        (url.contains("@"), 0.4),
        (TX.count_re(host, r"\.") > 3, 0.2),
        (host.rlike("(?i)(" + "|".join(K.RISK_HOST_WORDS) + ")"), 0.2),
        (F.length(url) > 100, 0.15),
        (url.startswith("http://") & ~url.startswith("http://localhost"), 0.1),
    ]
    s = F.lit(0.0)
    for cond, w in terms:
        s = s + F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
    return F.least(s, F.lit(1.0))


# ----------------------------------------------------------------------- F2

#: Bytes of threats in one automaton, and distinct URLs that one task scans, about.
BLOCK_BYTES = 4 << 20
PART_URLS = 200_000


def _holds_threat(urls: pa.Table, threats: pa.Table) -> pa.Table:
    """URLs of the left table that contain a threat of the right one, or whose host does."""
    import ahocorasick

    found: list[str] = []
    if urls.num_rows and threats.num_rows:
        automaton = ahocorasick.Automaton()
        for t in threats.column("_t").to_pylist():
            automaton.add_word(t, True)
        automaton.make_automaton()
        for u, host in zip(urls.column("_u").to_pylist(), urls.column("_host").to_pylist()):
            if any(next(automaton.iter(x), None) for x in (u, host or "")):
                found.append(u)
    return pa.table({"_u": pa.array(found, pa.string())})


def threat_match(df: DataFrame, threats: DataFrame, url_col: str = "url", threat_col: str = "threat",
                 block_bytes: int = BLOCK_BYTES, part_urls: int = PART_URLS) -> DataFrame:
    """add ``known_threat`` — some threat string is contained in the URL or
    in its hostname.

    The distinct URLs are dealt into parts and the threats into blocks of bounded bytes;
    each part meets each block in a task, which builds one automaton of the block and
    scans each URL once, however short or alike the threats are.  The numbers of parts
    and blocks are subqueries of the same plan.  The flagged URLs join back on the URL."""
    t = threats.select(F.col(threat_col).alias("_t")).where(F.col("_t").isNotNull() & (F.col("_t") != "")).distinct()
    u = df.select(F.col(url_col).alias("_u")).where(F.col(url_col).isNotNull())
    blocks = t.agg(F.greatest(F.ceil(F.sum(F.octet_length("_t")) / block_bytes), F.lit(1)).cast("int")).scalar()
    parts = u.agg(F.greatest(F.ceil(F.count(F.lit(1)) / part_urls), F.lit(parallelism(df.sparkSession))).cast("int")).scalar()
    left = u.distinct().withColumns({"_n": blocks, "_p": parts}).select(
        "_u", U.browser_hostname(F.col("_u")).alias("_host"), F.pmod(F.xxhash64("_u"), F.col("_p")).cast("int").alias("_part"),
        F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_block"))
    right = t.withColumns({"_n": blocks, "_p": parts}).select(
        "_t", F.pmod(F.xxhash64("_t"), F.col("_n")).cast("int").alias("_block"),
        F.explode(F.sequence(F.lit(0), F.col("_p") - 1)).alias("_part"))
    found = left.groupBy("_part", "_block").cogroup(right.groupBy("_part", "_block")).applyInArrow(_holds_threat, "_u string")
    flagged = found.select(F.col("_u").alias(url_col)).distinct()
    return df.join(flagged.withColumn("known_threat", F.lit(True)), url_col, "left").select(
        *df.columns, F.coalesce(F.col("known_threat"), F.lit(False)).alias("known_threat")
    )


# ------------------------------------------------------------------- F3–F8

def navigation_decision(resource_type: Column, known_threat: Column, risk: Column) -> Column:
    """struct(action, reason) — main frames only; threat list, then score > 0.7."""
    main = resource_type == "main_frame"
    action = (
        F.when(~main, F.lit("allow"))
        .when(known_threat, F.lit("block"))
        .when(risk > K.BLOCK_SCORE_THRESHOLD, F.lit("block"))
        .otherwise(F.lit("scan"))
    )
    reason = (
        F.when(~main, F.lit(None).cast("string"))
        .when(known_threat, F.lit("This URL is in our threat database"))
        .when(risk > K.BLOCK_SCORE_THRESHOLD, F.lit("URL contains suspicious patterns"))
    )
    return F.struct(action.alias("action"), reason.alias("reason"))


def model_block_gate(is_phishing: Column, confidence: Column) -> Column:
    """'block' when phishing with confidence > 0.6, 'safe' otherwise;
    'allow' (fail open) when the model answer is missing."""
    return (
        F.when(is_phishing.isNull() | confidence.isNull(), F.lit("allow"))
        .when(is_phishing & (confidence > K.MODEL_BLOCK_THRESHOLD), F.lit("block"))
        .otherwise(F.lit("safe"))
    )


def model_block_reason(confidence: Column) -> Column:
    """Reason text of a model block, with the rounded percentage."""
    pct = F.format_number(F.round(confidence * 100, 0), 0)
    return F.concat(F.lit("ML model detected phishing ("), F.regexp_replace(pct, ",", ""), F.lit("% confidence)"))


def threat_type(reason: Column) -> Column:
    """label by the first keyword found in lower(reason)."""
    r = F.lower(reason)
    out = F.lit(K.DEFAULT_THREAT_TYPE)
    for word, label in reversed(K.THREAT_TYPES):
        out = F.when(F.coalesce(r.contains(word), F.lit(False)), F.lit(label)).otherwise(out)
    return out


def scam_categories(url: Column) -> Column:
    """categories of the host part ``url.split('/')[2]`` (both may apply)."""
    host = U.netloc_by_slash(url)
    return F.filter(
        F.array(
            F.when(TX.any_literal(host, K.BANKING_WORDS), F.lit("banking")),
            F.when(TX.any_literal(host, K.CRYPTO_WORDS), F.lit("crypto")),
        ),
        lambda c: c.isNotNull(),
    )


def confidence_band(p: Column) -> Column:
    """> .85 HIGH, > .60 MEDIUM, else LOW."""
    return F.when(p > K.HIGH_BAND, F.lit("HIGH")).when(p > K.MEDIUM_BAND, F.lit("MEDIUM")).otherwise(F.lit("LOW"))


def route_action(band: Column) -> Column:
    """F8: HIGH act, MEDIUM warn, LOW deep analysis."""
    out = F.lit(None).cast("string")
    for b, a in K.BAND_ACTIONS.items():
        out = F.when(band == b, F.lit(a)).otherwise(out)
    return out


# ----------------------------------------------------------------- G1–G5

FORM_TAG = r"(?i)<form\b[^>]*>"
ACTION_ATTR = r"""(?i)\baction\s*=\s*["']([^"']*)["']"""
PASSWORD_INPUT = r"""(?i)<input\b[^>]*\btype\s*=\s*["']?password\b"""
SCRIPT_SRC = r"""(?i)<script\b[^>]*\bsrc\s*=\s*["']([^"']+)["']"""


def page_origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def resolve_action(action: Column, page_url: Column) -> Column:
    """Absolute form action as a browser resolves it (missing → page URL)."""
    scheme = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    return (
        F.when(action.isNull() | (F.trim(action) == ""), page_url)
        .when(action.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), action)
        .when(action.startswith("//"), F.concat(scheme, action))
        .when(action.startswith("/"), F.concat(page_origin(page_url), action))
        .otherwise(F.concat(page_origin(page_url), F.lit("/"), action))
    )


def page_scan(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """G1–G3, G5 per page: insecure form actions, password field on an
    untrusted host, miner scripts, and the tag inventory."""
    url, html = F.col(url_col), F.col(html_col)
    forms = F.regexp_extract_all(html, F.lit(FORM_TAG), 0)
    actions = F.transform(
        forms, lambda f: resolve_action(F.nullif(F.regexp_extract(f, ACTION_ATTR, 1), F.lit("")), url)
    )
    # A form tag without an action attribute also falls back to the page URL.
    insecure = F.filter(actions, lambda a: a.startswith("http://") & ~a.contains("localhost"))
    srcs = F.regexp_extract_all(html, F.lit(SCRIPT_SRC), 1)
    miners = F.filter(srcs, lambda s: TX.any_literal(s, K.MINER_HOSTS))
    host = U.browser_hostname(url)
    n_pw = TX.count_re(html, PASSWORD_INPUT)
    return df.withColumns(
        {
            "n_forms": F.size(forms).cast("int"),
            "n_external_scripts": F.size(srcs).cast("int"),
            "n_password_fields": n_pw,
            "insecure_forms": insecure,
            "password_on_untrusted": (n_pw > 0) & ~TX.any_literal(host, K.TRUSTED_PASSWORD_HOSTS),
            "miner_scripts": miners,
        }
    )


def xss_params(url: Column) -> Column:
    """Keys of query parameters whose decoded value matches an XSS pattern."""
    pairs = U.query_pairs(U.url_query(url))
    pat = "(?i)(" + "|".join(K.XSS_PATTERNS) + ")"
    return F.transform(F.filter(pairs, lambda p: p["value"].rlike(pat)), lambda p: p["key"])
