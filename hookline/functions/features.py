"""URL feature profiles as one DataFrame projection.

``featurize_urls(df, url_col, profile)`` appends the feature columns of a
profile to ``df``.  Rows are dealt over the tasks, URL parts and cheap features are
native column expressions, and the costly ones come from one Arrow UDF over batches
of rows (``hookline.functions.measures``).  The two look-alike columns of the
main profile that need the sequence ratio (``is_typosquatting``,
``typosquatting_similarity``) are added by
``hookline.operators.lookalike.add_typosquatting`` on the distinct domains.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookline import constants as K
from hookline.constants import (
    DECODED_BRANDS, DECODED_BRANDS_DOMAIN, DECODED_DICTIONARY, DRAFT_BRANDS, DRAFT_CHECK_BRANDS,
    DRAFT_COMBO_TLDS, DRAFT_DICTIONARY, DRAFT_HYPHEN_PATTERNS, DRAFT_LEGIT, DRAFT_MAJOR_BRANDS, HOST29_ACTION,
    HOST29_SENSITIVE, HOST29_SHORTENERS, HOST29_SUSPICIOUS, HOST29_SYMBOLS, V1_ACTION_WORDS,
    V1_SENSITIVE_WORDS, V1_SHORTENERS, V1_SUSPICIOUS_WORDS, V2_BRANDS, V2_DICTIONARY, V2_HIGH_TRUST,
    V2_SENSITIVE_WORDS, V2_SUSPICIOUS_CATEGORY, V2_SUSPICIOUS_FLAG, V2_SUSPICIOUS_WORDS,
)
from hookline.functions import text as T
from hookline.functions import urls as U
from hookline.functions.measures import Measures, NativeMeasures, dealt

# Column order of the 66-column main profile.
MAIN_FEATURES = [
    "url_length", "num_dots", "num_hyphens", "num_underscores", "num_digits", "num_letters",
    "num_special_chars", "has_ip", "num_subdomains", "has_multiple_subdomains",
    "domain_length", "host_entropy", "domain_entropy", "domain_has_digits", "domain_digit_ratio",
    "domain_vowel_ratio", "domain_bigram_diversity", "domain_trigram_diversity",
    "suspicious_prefix_suffix", "num_suspicious_symbols", "subdomain_length", "domain_is_dictionary_word",
    "tld_length", "tld_trust_category", "is_suspicious_tld", "is_high_trust_tld", "is_country_tld",
    "path_length", "num_path_segments", "num_query_params", "query_length", "num_encoded_chars",
    "num_fragments", "path_entropy", "path_has_suspicious_ext", "query_has_redirect", "path_url_ratio",
    "suspicious_word", "num_suspicious_words", "sensitive_word", "action_word", "has_brand_name",
    "brand_not_in_domain", "is_shortening_service", "is_mixed_case",
    "num_repeated_chars", "longest_token_length", "digit_letter_ratio", "special_char_ratio",
    "uppercase_ratio", "consecutive_consonants",
    "url_entropy",
    "has_port", "uses_https", "punycode_domain", "subdomain_count_dot",
    "domain_url_ratio", "query_url_ratio",
    "brand_impersonation", "brand_with_hyphen", "is_typosquatting", "typosquatting_similarity",
    "has_character_substitution", "suspicious_tld_brand_combo", "multiple_brands_in_domain",
    "brand_not_in_main_domain",
]
RATIO_FEATURES = {"is_typosquatting", "typosquatting_similarity"}
MAIN_NATIVE_FEATURES = [c for c in MAIN_FEATURES if c not in RATIO_FEATURES]
DOUBLE_FEATURES = {
    "host_entropy", "domain_entropy", "domain_digit_ratio", "domain_vowel_ratio",
    "domain_bigram_diversity", "domain_trigram_diversity", "path_entropy", "path_url_ratio",
    "digit_letter_ratio", "special_char_ratio", "uppercase_ratio", "url_entropy",
    "domain_url_ratio", "query_url_ratio", "typosquatting_similarity",
}

V1_FEATURES = [
    "url_length", "num_dots", "num_hyphens", "num_underscores", "num_digits", "num_letters",
    "num_special_chars", "has_ip", "num_subdomains", "domain_length", "host_entropy",
    "path_length", "num_path_segments", "num_query_params", "query_length", "num_encoded_chars",
    "num_fragments", "suspicious_word", "sensitive_word", "action_word", "is_shortening_service",
    "is_mixed_case", "url_entropy", "path_entropy", "domain_entropy", "num_repeated_chars",
    "longest_token_length", "suspicious_prefix_suffix", "num_suspicious_symbols",
]
HOST29_FEATURES = list(V1_FEATURES)
MINI11_FEATURES = [
    "url_length", "domain_length", "path_length", "has_ip", "subdomain_count", "has_at",
    "has_double_slash", "special_chars", "is_https", "suspicious_tld", "has_suspicious_words",
]


def leet_patterns() -> list[str]:
    """Brands with every occurrence of one letter replaced, one rule at a time."""
    out: list[str] = []
    for letter, rep in K.LEET_RULES:
        for b in K.BRAND_KEYWORDS:
            if letter in b:
                p = b.replace(letter, rep)
                if p not in out:
                    out.append(p)
    return out


def has_character_substitution(c: Column | str) -> Column:
    """Some brand with one leetspeak rule applied occurs in lower(s)."""
    return T.any_literal(F.lower(T.col_(c)), leet_patterns())


def _isin(c: Column, values: list[str]) -> Column:
    return c.isin(*values)


def cumulative_variants(brand: str) -> list[str]:
    """E10 helper: the brand with every subset of the applicable leetspeak
    rules applied (each rule replaces all occurrences), brand first."""
    out = [brand]
    for letter, rep in K.LEET_RULES:
        if letter in brand:
            out = out + [v.replace(letter, rep) for v in out]
    seen: list[str] = []
    for v in out:
        if v not in seen:
            seen.append(v)
    return seen


def substitution_variants() -> list[str]:
    """Every cumulative variant of every brand (the brands included)."""
    out: list[str] = []
    for b in K.BRAND_KEYWORDS:
        for v in cumulative_variants(b):
            if v not in out:
                out.append(v)
    return out


def brand_with_substitution(c: Column | str) -> Column:
    """E10 flag: a brand, or a brand with any subset of leetspeak rules
    applied, is a substring of lower(s)."""
    return T.any_literal(F.lower(T.col_(c)), substitution_variants())


def brand_with_substitution_match(c: Column | str) -> Column:
    """E10 brand: the first brand contained as is, else the first brand one
    of whose (substituted) variants is contained; null when none."""
    s = F.lower(T.col_(c))
    brands = F.array(*[F.lit(b) for b in K.BRAND_KEYWORDS])
    plain = F.array_position(F.transform(brands, lambda b: F.instr(s, b) > 0), True)
    variants = F.array(*[F.array(*[F.lit(v) for v in cumulative_variants(b)[1:]] or [F.lit(None).cast("string")])
                         for b in K.BRAND_KEYWORDS])
    subst = F.array_position(F.transform(variants, lambda vs: F.exists(vs, lambda v: F.coalesce(F.instr(s, v) > 0, F.lit(False)))), True)
    pos = F.when(plain > 0, plain).when(subst > 0, subst)
    return F.when(pos.isNotNull(), F.element_at(brands, pos.cast("int")))


def _main_exprs(m: Measures, u: Column, scheme: Column, netloc: Column, path: Column, query: Column,
                sub: Column, dom: Column, sfx: Column, brand_check: Column | None = None) -> dict[str, Column]:
    """The 64 native features of the main profile (everything but the ratio pair).

    ``brand_check`` replaces "some brand is in the domain" in the impersonation
    features (the substitution-aware profile passes E10 there).  The caller adds
    the measures that ``m`` collects."""
    lu = F.lower(u)
    ld = F.lower(dom)
    n = T.slen(u)
    num_digits = m.count_re(u, "[0-9]")
    num_letters = m.count_re(u, "[A-Za-z]")
    num_special = m.count_re(u, r"[@?=%&!+$]")
    brand_in_url = m.any_literal(lu, K.BRAND_KEYWORDS)
    brand_in_domain = m.any_literal(ld, K.BRAND_KEYWORDS)
    legit = _isin(U.registered_domain(dom, sfx), K.LEGITIMATE_DOMAINS)
    dom_entropy = m.entropy(dom, False)
    susp = m.any_literal(lu, K.SUSPICIOUS_WORDS)
    lsfx = F.lower(sfx)
    nd = T.slen(dom)
    num_sub = F.when(sub == "", F.lit(0)).otherwise(F.size(F.split(sub, r"\.", -1))).cast("int")
    brand_count = m.count_present(ld, K.BRAND_KEYWORDS)
    lpath, lquery = F.lower(path), F.lower(query)
    e: dict[str, Column] = {}
    e["url_length"] = n
    e["num_dots"] = m.count_re(u, r"\.")
    e["num_hyphens"] = m.count_re(u, "-")
    e["num_underscores"] = m.count_re(u, "_")
    e["num_digits"] = num_digits
    e["num_letters"] = num_letters
    e["num_special_chars"] = num_special
    e["has_ip"] = T.flag(netloc.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"))
    e["num_subdomains"] = num_sub
    e["has_multiple_subdomains"] = T.flag(num_sub >= 3)
    e["domain_length"] = nd
    e["host_entropy"] = dom_entropy
    e["domain_entropy"] = dom_entropy
    e["domain_has_digits"] = T.flag(dom.rlike("[0-9]"))
    e["domain_digit_ratio"] = T.ratio(m.count_re(dom, "[0-9]"), nd)
    e["domain_vowel_ratio"] = T.ratio(m.count_re(ld, "[aeiou]"), m.count_re(ld, "[b-df-hj-np-tv-z]"))
    e["domain_bigram_diversity"] = m.ngram_diversity(dom, 2)
    e["domain_trigram_diversity"] = m.ngram_diversity(dom, 3)
    e["suspicious_prefix_suffix"] = T.flag(dom.contains("-"))
    e["num_suspicious_symbols"] = m.count_re(dom, r"[@!*]")
    e["subdomain_length"] = T.slen(sub)
    e["domain_is_dictionary_word"] = T.flag(_isin(ld, K.BRAND_KEYWORDS))
    e["tld_length"] = T.slen(sfx)
    e["tld_trust_category"] = (
        F.when(_isin(lsfx, K.HIGH_TRUST_TLDS), F.lit(2))
        .when(_isin(lsfx, K.SUSPICIOUS_TLDS_CATEGORY), F.lit(0))
        .otherwise(F.lit(1))
    )
    e["is_suspicious_tld"] = T.flag(_isin(lsfx, K.SUSPICIOUS_TLDS_FLAG))
    e["is_high_trust_tld"] = T.flag(_isin(lsfx, K.HIGH_TRUST_TLDS))
    e["is_country_tld"] = T.flag(sfx.rlike("^[A-Za-z]{2}$"))
    e["path_length"] = T.slen(path)
    e["num_path_segments"] = F.size(F.filter(F.split(path, "/", -1), lambda p: p != "")).cast("int")
    e["num_query_params"] = F.when(query == "", F.lit(0)).otherwise(F.size(F.split(query, "&", -1))).cast("int")
    e["query_length"] = T.slen(query)
    e["num_encoded_chars"] = m.count_re(u, "%")
    e["num_fragments"] = m.count_re(u, "#")
    e["path_entropy"] = m.entropy(path, False)
    e["path_has_suspicious_ext"] = T.flag(m.any_literal(lpath, K.SUSPICIOUS_EXTENSIONS))
    e["query_has_redirect"] = T.flag(m.any_literal(lquery, K.REDIRECT_WORDS))
    e["path_url_ratio"] = T.ratio(T.slen(path), n)
    e["suspicious_word"] = T.flag(susp)
    e["num_suspicious_words"] = m.count_present(lu, K.SUSPICIOUS_WORDS)
    e["sensitive_word"] = T.flag(m.any_literal(lu, K.SENSITIVE_WORDS))
    e["action_word"] = T.flag(m.any_literal(lu, K.ACTION_WORDS))
    e["has_brand_name"] = T.flag(brand_in_url)
    e["brand_not_in_domain"] = T.flag(brand_in_url & ~brand_in_domain)
    e["is_shortening_service"] = T.flag(m.any_literal(u, K.SHORTENERS))
    e["is_mixed_case"] = T.flag(u.rlike("[A-Z]") & u.rlike("[a-z]"))
    e["num_repeated_chars"] = m.longest_run(u)
    e["longest_token_length"] = m.longest_token(u, r"[./?=&_-]")
    e["digit_letter_ratio"] = T.ratio(num_digits, num_letters)
    e["special_char_ratio"] = T.ratio(num_special, n)
    e["uppercase_ratio"] = T.ratio(m.count_re(u, "[A-Z]"), n)
    e["consecutive_consonants"] = m.longest_match(lu, "[bcdfghjklmnpqrstvwxyz]+")
    e["url_entropy"] = m.entropy(u, False)
    e["has_port"] = T.flag(netloc.contains(":") & ~netloc.startswith("["))
    e["uses_https"] = T.flag(scheme == "https")
    e["punycode_domain"] = T.flag(dom.contains("xn--"))
    e["subdomain_count_dot"] = m.count_re(sub, r"\.")
    e["domain_url_ratio"] = T.ratio(nd, n)
    e["query_url_ratio"] = T.ratio(T.slen(query), n)
    bcheck = brand_in_domain if brand_check is None else brand_check
    e["brand_impersonation"] = T.flag(bcheck & ~legit)
    e["brand_with_hyphen"] = T.flag(bcheck & dom.contains("-") & ~legit)
    e["has_character_substitution"] = T.flag(m.any_literal(ld, leet_patterns()))
    e["suspicious_tld_brand_combo"] = T.flag(_isin(lsfx, K.SUSPICIOUS_TLDS_BRAND_COMBO) & bcheck & ~legit)
    e["multiple_brands_in_domain"] = T.flag(brand_count >= 2)
    e["brand_not_in_main_domain"] = T.flag(brand_in_url & ~bcheck)
    return e


def url_parts(df: DataFrame, url_col: str = "url", prefix: str = "_p_") -> DataFrame:
    """Add the cleaned URL and its parts as temporary columns (staged)."""
    return U.add_url_parts(df, url_col, prefix, clean=True)


def _zero(name: str) -> Column:
    return F.lit(0.0) if name in DOUBLE_FEATURES else F.lit(0)


def featurize_main(df: DataFrame, url_col: str = "url", native_only: bool = True, batches: bool = False) -> DataFrame:
    """D1–D66 (native part): the main 66-column profile minus the ratio pair.

    Invalid URLs (null, blank, unparsable netloc) get the all-zero row.  With
    ``batches`` the measures come from the Arrow UDF, otherwise there is no Python.
    """
    p = "_p_"
    parts = url_parts(dealt(df), url_col, p)
    m = Measures() if batches else NativeMeasures()
    ex = _main_exprs(
        m, F.col(f"{p}u"), F.col(f"{p}scheme"), F.col(f"{p}netloc"), F.col(f"{p}path"), F.col(f"{p}query"),
        F.col(f"{p}sub"), F.col(f"{p}dom"), F.col(f"{p}sfx"),
    )
    bad = F.col(f"{p}bad")
    cols = {
        name: F.when(bad, _zero(name)).otherwise(ex[name]).cast("double" if name in DOUBLE_FEATURES else "int")
        for name in MAIN_NATIVE_FEATURES
    }
    out = m.add(parts).withColumns(cols)
    keep = [c for c in df.columns] + MAIN_NATIVE_FEATURES
    return out.select(*keep)


def featurize_v1(df: DataFrame, url_col: str = "url") -> DataFrame:
    """DV1: first-generation 29 columns on the raw URL (no clean-up, no zero row)."""
    p = "_p_"
    staged = U.add_url_parts(dealt(df), url_col, p, clean=False)
    u = F.col(url_col)
    netloc, path, query = F.col(f"{p}netloc"), F.col(f"{p}path"), F.col(f"{p}query")
    dom, sub = F.col(f"{p}dom"), F.col(f"{p}sub")
    lu = F.lower(u)
    m = Measures()
    e = {
        "url_length": T.slen(u),
        "num_dots": m.count_re(u, r"\."),
        "num_hyphens": m.count_re(u, "-"),
        "num_underscores": m.count_re(u, "_"),
        "num_digits": m.count_re(u, "[0-9]"),
        "num_letters": m.count_re(u, "[A-Za-z]"),
        "num_special_chars": m.count_re(u, r"[@?=%&!+$]"),
        "has_ip": T.flag(netloc.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")),
        "num_subdomains": F.when(sub == "", F.lit(0)).otherwise(F.size(F.split(sub, r"\.", -1))).cast("int"),
        "domain_length": T.slen(dom),
        "host_entropy": m.entropy(dom),
        "path_length": T.slen(path),
        "num_path_segments": F.size(F.filter(F.split(path, "/", -1), lambda p: p != "")).cast("int"),
        "num_query_params": F.when(query == "", F.lit(0)).otherwise(F.size(F.split(query, "&", -1))).cast("int"),
        "query_length": T.slen(query),
        "num_encoded_chars": m.count_re(u, "%"),
        "num_fragments": m.count_re(u, "#"),
        "suspicious_word": T.flag(m.any_literal(lu, V1_SUSPICIOUS_WORDS)),
        "sensitive_word": T.flag(m.any_literal(lu, V1_SENSITIVE_WORDS)),
        "action_word": T.flag(m.any_literal(lu, V1_ACTION_WORDS)),
        "is_shortening_service": T.flag(m.any_literal(u, V1_SHORTENERS)),
        "is_mixed_case": T.flag(u.rlike("[A-Z]") & u.rlike("[a-z]")),
        "url_entropy": m.entropy(u),
        "path_entropy": m.entropy(path),
        "domain_entropy": m.entropy(dom),
        "num_repeated_chars": m.longest_run(u),
        "longest_token_length": m.longest_token(u, r"[./?=&_-]"),
        "suspicious_prefix_suffix": T.flag(dom.contains("-")),
        "num_suspicious_symbols": m.count_re(dom, r"[@!*]"),
    }
    return m.add(staged).withColumns(e).select(*df.columns, *V1_FEATURES)


def featurize_host29(df: DataFrame, url_col: str = "url") -> DataFrame:
    """DV5: 29 columns on the percent-decoded URL with netloc-based host
    definitions (labels − 2 subdomains, ``=`` count as params, exact IPv4)."""
    p = "_h_"
    staged = U.add_url_parts(dealt(df).withColumn(f"{p}url", U.ensure_scheme_http(F.col(url_col))), f"{p}url", p, clean=False)
    staged = staged.withColumn(f"{p}full", U.percent_decode(F.col(f"{p}url")))
    host = F.lower(F.col(f"{p}netloc"))
    path = F.col(f"{p}path")
    q = F.col(f"{p}query")
    frag = F.col(f"{p}fragment")
    full = F.col(f"{p}full")
    sym_re = "[" + re.escape(HOST29_SYMBOLS) + "]"
    m = Measures()
    e = {
        "url_length": T.slen(full),
        "num_dots": m.count_re(full, r"\."),
        "num_hyphens": m.count_re(full, "-"),
        "num_underscores": m.count_re(full, "_"),
        "num_digits": m.count_re(full, "[0-9]"),
        "num_letters": m.count_re(full, r"\p{L}"),
        "num_special_chars": m.count_re(full, "[^A-Za-z0-9]"),
        "has_ip": T.flag(host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")),
        "num_subdomains": F.greatest(F.size(F.split(host, r"\.", -1)) - 2, F.lit(0)).cast("int"),
        "domain_length": T.slen(host),
        "host_entropy": m.entropy(host, False),
        "path_length": T.slen(path),
        "num_path_segments": m.count_re(path, "/"),
        "num_query_params": m.count_re(q, "="),
        "query_length": T.slen(q),
        "num_encoded_chars": (m.count_re(full, "%") + m.count_re(full, r"\+")).cast("int"),
        "num_fragments": T.flag(frag != ""),
        "suspicious_word": T.flag(m.any_literal(full, HOST29_SUSPICIOUS)),
        "sensitive_word": T.flag(m.any_literal(full, HOST29_SENSITIVE)),
        "action_word": T.flag(m.any_literal(full, HOST29_ACTION)),
        "is_shortening_service": T.flag(m.any_literal(host, HOST29_SHORTENERS)),
        "is_mixed_case": T.flag(full.rlike(r"\p{Lu}") & full.rlike(r"\p{Ll}")),
        "url_entropy": m.entropy(full, False),
        "path_entropy": m.entropy(path, False),
        "domain_entropy": m.entropy(host, False),
        # The original takes len() of the one-character group of each run, so
        # the value is 1 whenever a word character exists.
        "num_repeated_chars": T.flag(full.rlike(r"\w")),
        "longest_token_length": m.longest_token(full, "[^A-Za-z0-9]"),
        "suspicious_prefix_suffix": T.flag(host.rlike("^(login|secure)") | host.rlike("(login|secure)$")),
        "num_suspicious_symbols": m.count_re(full, sym_re),
    }
    return m.add(staged).withColumns(e).select(*df.columns, *HOST29_FEATURES)


def featurize_mini11_py(df: DataFrame, url_col: str = "url") -> DataFrame:
    """DV6: eleven columns of the small dataset script (slash-split host)."""
    u = F.col(url_col)
    parts = F.split(u, "/", -1)
    nparts = F.size(parts)
    host = F.coalesce(F.get(parts, 2), F.lit(""))
    e = {
        "url_length": T.slen(u),
        "domain_length": F.when(nparts > 2, T.slen(host)).otherwise(F.lit(0)).cast("int"),
        "path_length": F.when(nparts > 3, T.slen(F.regexp_extract(u, r"^[^/]*/[^/]*/[^/]*/(.*)$", 1)))
        .otherwise(F.lit(0))
        .cast("int"),
        "has_ip": T.flag(host.rlike("[0-9]") & host.contains(".")),
        "subdomain_count": F.when(nparts > 2, T.count_re(host, r"\.") - 1).otherwise(F.lit(0)).cast("int"),
        "has_at": T.flag(u.contains("@")),
        "has_double_slash": T.flag(T.count_re(u, "//") > 1),
        "special_chars": T.count_re(u, r"[^\p{L}\p{N}]"),
        "is_https": T.flag(u.startswith("https")),
        "suspicious_tld": T.flag(u.rlike(r"\.(" + "|".join(K.MINI_SUSPICIOUS_TLDS) + ")$")),
        "has_suspicious_words": T.flag(T.any_literal(F.lower(u), K.MINI_SUSPICIOUS_WORDS)),
    }
    return df.withColumns(e).select(*df.columns, *MINI11_FEATURES)


def featurize_mini11_js(df: DataFrame, url_col: str = "url") -> DataFrame:
    """DV7: eleven columns of the browser side; all null when the URL does not parse."""
    u = F.col(url_col)
    ok = u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]")
    host = U.browser_hostname(u)
    e = {
        "url_length": T.slen(u),
        "domain_length": T.slen(host),
        "path_length": T.slen(U.browser_pathname(u)),
        "has_ip": T.flag(u.rlike(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}")),
        "subdomain_count": (T.count_re(host, r"\.") - 1).cast("int"),
        "has_at": T.flag(u.contains("@")),
        "has_double_slash": T.flag(T.count_re(u, "//") > 1),
        "special_chars": T.count_re(u, "[^a-zA-Z0-9]"),
        "is_https": T.flag(F.lower(U.url_scheme(u)) == "https"),
        "suspicious_tld": T.flag(host.rlike(r"(?i)\.(" + "|".join(K.MINI_SUSPICIOUS_TLDS) + ")$")),
        "has_suspicious_words": T.flag(T.any_literal(host, K.MINI_SUSPICIOUS_WORDS, case_insensitive=True)),
    }
    e = {k: F.when(ok, v).otherwise(F.lit(None).cast("int")) for k, v in e.items()}
    return df.withColumns(e).select(*df.columns, *MINI11_FEATURES)


def featurize_urls(df: DataFrame, url_col: str = "url", profile: str = "main") -> DataFrame:
    """Append the feature columns of ``profile`` to ``df``."""
    if profile == "main":
        from hookline.operators.lookalike import add_typosquatting

        return add_typosquatting(featurize_main(df, url_col, batches=True), url_col)
    if profile == "main_native":
        return featurize_main(df, url_col)
    if profile == "v1":
        return featurize_v1(df, url_col)
    if profile == "host29":
        return featurize_host29(df, url_col)
    if profile == "mini11_py":
        return featurize_mini11_py(df, url_col)
    if profile == "mini11_js":
        return featurize_mini11_js(df, url_col)
    if profile == "v2":
        return featurize_v2(df, url_col)
    if profile == "decoded":
        return featurize_decoded(df, url_col)
    if profile == "decoded_https":
        return featurize_decoded(df, url_col, https_first=True)
    raise ValueError(f"unknown profile {profile!r}")


DECODED_FEATURES = [c for c in MAIN_FEATURES if c not in {
    "brand_impersonation", "brand_with_hyphen", "is_typosquatting", "typosquatting_similarity",
    "has_character_substitution", "suspicious_tld_brand_combo", "multiple_brands_in_domain", "brand_not_in_main_domain"}]


def featurize_decoded(df: DataFrame, url_col: str = "url", https_first: bool = False) -> DataFrame:
    """DV3 (and DV4 with ``https_first``): 58 columns computed on the
    percent-decoded URL, with a lower-cased netloc, shorter brand lists and
    ``special_char_ratio`` over every non-alphanumeric character."""
    p = "_d_"
    u0 = F.col(url_col)
    if https_first:
        u0 = U.ensure_scheme_https(u0)
    staged = U.add_url_parts(dealt(df).withColumn(f"{p}url", U.ensure_scheme_http(u0)), f"{p}url", p, clean=False)
    staged = staged.withColumn(f"{p}full", U.percent_decode(F.col(f"{p}url")))
    full = F.col(f"{p}full")
    host = F.lower(F.col(f"{p}netloc"))
    path, q = F.col(f"{p}path"), F.col(f"{p}query")
    dom, sub, sfx = F.col(f"{p}dom"), F.col(f"{p}sub"), F.col(f"{p}sfx")
    lf, ld, lsfx = F.lower(full), F.lower(dom), F.lower(sfx)
    m = Measures()
    n = T.slen(full)
    nd = T.slen(dom)
    digits = m.count_re(full, "[0-9]")
    letters = m.count_re(full, r"\p{L}")
    special = m.count_re(full, r"[@?=%&!+$]")
    nsub = F.when(sub == "", F.lit(0)).otherwise(F.size(F.split(sub, r"\.", -1))).cast("int")
    e = {
        "url_length": n,
        "num_dots": m.count_re(full, r"\."),
        "num_hyphens": m.count_re(full, "-"),
        "num_underscores": m.count_re(full, "_"),
        "num_digits": digits,
        "num_letters": letters,
        "num_special_chars": special,
        "has_ip": T.flag(host.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")),
        "num_subdomains": nsub,
        "has_multiple_subdomains": T.flag(nsub >= 3),
        "domain_length": nd,
        "host_entropy": m.entropy(dom),
        "domain_entropy": m.entropy(dom),
        "domain_has_digits": T.flag(dom.rlike("[0-9]")),
        "domain_digit_ratio": T.ratio(m.count_re(dom, "[0-9]"), nd),
        "domain_vowel_ratio": T.ratio(m.count_re(ld, "[aeiou]"), m.count_re(ld, r"\p{L}") - m.count_re(ld, "[aeiou]")),
        "domain_bigram_diversity": m.ngram_diversity(dom, 2),
        "domain_trigram_diversity": m.ngram_diversity(dom, 3),
        "suspicious_prefix_suffix": T.flag(dom.contains("-")),
        "num_suspicious_symbols": m.count_re(dom, r"[@!*]"),
        "subdomain_length": T.slen(sub),
        "domain_is_dictionary_word": T.flag(ld.isin(*DECODED_DICTIONARY)),
        "tld_length": T.slen(sfx),
        "tld_trust_category": F.when(lsfx.isin(*K.HIGH_TRUST_TLDS), F.lit(2))
        .when(lsfx.isin(*K.SUSPICIOUS_TLDS_CATEGORY), F.lit(0)).otherwise(F.lit(1)),
        "is_suspicious_tld": T.flag(lsfx.isin(*K.SUSPICIOUS_TLDS_CATEGORY)),
        "is_high_trust_tld": T.flag(lsfx.isin(*K.HIGH_TRUST_TLDS)),
        "is_country_tld": T.flag(sfx.rlike(r"^\p{L}{2}$")),
        "path_length": T.slen(path),
        "num_path_segments": F.size(F.filter(F.split(path, "/", -1), lambda s: s != "")).cast("int"),
        "num_query_params": F.when(q == "", F.lit(0)).otherwise(F.size(F.split(q, "&", -1))).cast("int"),
        "query_length": T.slen(q),
        "num_encoded_chars": m.count_re(full, "%"),
        "num_fragments": m.count_re(full, "#"),
        "path_entropy": m.entropy(path),
        "path_has_suspicious_ext": T.flag(m.any_literal(F.lower(path), K.SUSPICIOUS_EXTENSIONS)),
        "query_has_redirect": T.flag(m.any_literal(F.lower(q), K.REDIRECT_WORDS)),
        "path_url_ratio": T.ratio(T.slen(path), n),
        "suspicious_word": T.flag(m.any_literal(lf, K.SUSPICIOUS_WORDS)),
        "num_suspicious_words": m.count_present(lf, K.SUSPICIOUS_WORDS),
        "sensitive_word": T.flag(m.any_literal(lf, K.SENSITIVE_WORDS)),
        "action_word": T.flag(m.any_literal(lf, K.ACTION_WORDS)),
        "has_brand_name": T.flag(m.any_literal(lf, DECODED_BRANDS)),
        "brand_not_in_domain": T.flag(m.any_literal(lf, DECODED_BRANDS_DOMAIN) & ~m.any_literal(ld, DECODED_BRANDS_DOMAIN)),
        "is_shortening_service": T.flag(m.any_literal(full, K.SHORTENERS)),
        "is_mixed_case": T.flag(full.rlike(r"\p{Lu}") & full.rlike(r"\p{Ll}")),
        "num_repeated_chars": m.longest_run(full),
        "longest_token_length": m.longest_token(full, r"[./?=&_-]"),
        "digit_letter_ratio": T.ratio(digits, letters),
        "special_char_ratio": T.ratio(m.count_re(full, r"[^\p{L}\p{N}]"), n),
        "uppercase_ratio": T.ratio(m.count_re(full, r"\p{Lu}"), n),
        "consecutive_consonants": m.longest_match(lf, "[bcdfghjklmnpqrstvwxyz]+"),
        "url_entropy": m.entropy(full),
        "has_port": T.flag(host.contains(":") & ~host.startswith("[")),
        "uses_https": T.flag(F.col(f"{p}scheme") == "https"),
        "punycode_domain": T.flag(dom.contains("xn--")),
        "subdomain_count_dot": m.count_re(sub, r"\."),
        "domain_url_ratio": T.ratio(nd, n),
        "query_url_ratio": T.ratio(T.slen(q), n),
    }
    cols = {k: v.cast("double" if k in DOUBLE_FEATURES else "int") for k, v in e.items()}
    return m.add(staged).withColumns(cols).select(*df.columns, *DECODED_FEATURES)


# Fixed lists of the 57-column second-generation profile.
V2_FEATURES = [
    "url_length", "num_dots", "num_hyphens", "num_underscores", "num_digits", "num_letters", "num_special_chars",
    "has_ip", "num_subdomains", "domain_length", "host_entropy", "domain_has_digits", "domain_digit_ratio",
    "domain_vowel_ratio", "domain_is_dictionary_word", "tld_length", "tld_trust_category", "is_suspicious_tld",
    "is_high_trust_tld", "is_country_tld", "path_length", "num_path_segments", "num_query_params", "query_length",
    "num_encoded_chars", "num_fragments", "path_has_suspicious_ext", "query_has_redirect", "suspicious_word",
    "num_suspicious_words", "sensitive_word", "action_word", "has_brand_name", "brand_not_in_domain",
    "is_shortening_service", "is_mixed_case", "num_repeated_chars", "longest_token_length", "digit_letter_ratio",
    "special_char_ratio", "uppercase_ratio", "consecutive_consonants", "url_entropy", "path_entropy", "domain_entropy",
    "domain_bigram_diversity", "domain_trigram_diversity", "suspicious_prefix_suffix", "num_suspicious_symbols",
    "has_multiple_subdomains", "subdomain_length", "has_port", "uses_https", "punycode_domain", "domain_url_ratio",
    "path_url_ratio", "query_url_ratio",
]


def featurize_v2(df: DataFrame, url_col: str = "url") -> DataFrame:
    """DV2: 57 columns on the raw URL with the second-generation lists.

    A failing row (unparsable netloc, or a non-empty URL without any
    consonant run, where the original's ``max`` of an empty list raises) gets
    the all-zero row with the regular column names (the original switched to
    45 ``feature_i`` columns, a schema bug not reproduced)."""
    p = "_v2_"
    staged = U.add_url_parts(dealt(df), url_col, p, clean=False)
    u = F.col(url_col)
    netloc, path, q = F.col(f"{p}netloc"), F.col(f"{p}path"), F.col(f"{p}query")
    dom, sub, sfx = F.col(f"{p}dom"), F.col(f"{p}sub"), F.col(f"{p}sfx")
    lu, ld, lsfx = F.lower(u), F.lower(dom), F.lower(sfx)
    m = Measures()
    n, nd = T.slen(u), T.slen(dom)
    digits = m.count_re(u, "[0-9]")
    letters = m.count_re(u, r"\p{L}")
    special = m.count_re(u, r"[@?=%&!+$]")
    nsub = F.when(sub == "", F.lit(0)).otherwise(F.size(F.split(sub, r"\.", -1))).cast("int")
    e = {
        "url_length": n, "num_dots": m.count_re(u, r"\."), "num_hyphens": m.count_re(u, "-"),
        "num_underscores": m.count_re(u, "_"), "num_digits": digits, "num_letters": letters,
        "num_special_chars": special,
        "has_ip": T.flag(netloc.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")),
        "num_subdomains": nsub, "domain_length": nd, "host_entropy": m.entropy(dom, False),
        "domain_has_digits": T.flag(dom.rlike("[0-9]")),
        "domain_digit_ratio": T.ratio(m.count_re(dom, "[0-9]"), nd),
        "domain_vowel_ratio": T.ratio(m.count_re(ld, "[aeiou]"), m.count_re(ld, r"\p{L}") - m.count_re(ld, "[aeiou]")),
        "domain_is_dictionary_word": T.flag(ld.isin(*V2_DICTIONARY)),
        "tld_length": T.slen(sfx),
        "tld_trust_category": F.when(lsfx.isin(*V2_HIGH_TRUST), F.lit(2))
        .when(lsfx.isin(*V2_SUSPICIOUS_CATEGORY), F.lit(0)).otherwise(F.lit(1)),
        "is_suspicious_tld": T.flag(lsfx.isin(*V2_SUSPICIOUS_FLAG)),
        "is_high_trust_tld": T.flag(lsfx.isin(*V2_HIGH_TRUST)),
        "is_country_tld": T.flag(sfx.rlike(r"^\p{L}{2}$")),
        "path_length": T.slen(path),
        "num_path_segments": F.size(F.filter(F.split(path, "/", -1), lambda s: s != "")).cast("int"),
        "num_query_params": F.when(q == "", F.lit(0)).otherwise(F.size(F.split(q, "&", -1))).cast("int"),
        "query_length": T.slen(q), "num_encoded_chars": m.count_re(u, "%"), "num_fragments": m.count_re(u, "#"),
        "path_has_suspicious_ext": T.flag(m.any_literal(F.lower(path), K.SUSPICIOUS_EXTENSIONS)),
        "query_has_redirect": T.flag(m.any_literal(F.lower(q), K.REDIRECT_WORDS)),
        "suspicious_word": T.flag(m.any_literal(lu, V2_SUSPICIOUS_WORDS)),
        "num_suspicious_words": m.count_present(lu, V2_SUSPICIOUS_WORDS),
        "sensitive_word": T.flag(m.any_literal(lu, V2_SENSITIVE_WORDS)),
        "action_word": T.flag(m.any_literal(lu, K.ACTION_WORDS)),
        "has_brand_name": T.flag(m.any_literal(lu, V2_BRANDS)),
        "brand_not_in_domain": T.flag(m.any_literal(lu, V2_BRANDS) & ~m.any_literal(ld, V2_BRANDS)),
        "is_shortening_service": T.flag(m.any_literal(u, K.SHORTENERS)),
        "is_mixed_case": T.flag(u.rlike(r"\p{Lu}") & u.rlike(r"\p{Ll}")),
        "num_repeated_chars": m.longest_run(u),
        "longest_token_length": m.longest_token(u, r"[./?=&_-]"),
        "digit_letter_ratio": T.ratio(digits, letters),
        "special_char_ratio": T.ratio(special, n),
        "uppercase_ratio": T.ratio(m.count_re(u, r"\p{Lu}"), n),
        "consecutive_consonants": m.longest_match(lu, "[bcdfghjklmnpqrstvwxyz]+"),
        "url_entropy": m.entropy(u, False), "path_entropy": m.entropy(path, False),
        "domain_entropy": m.entropy(dom, False),
        "domain_bigram_diversity": m.ngram_diversity(dom, 2), "domain_trigram_diversity": m.ngram_diversity(dom, 3),
        "suspicious_prefix_suffix": T.flag(dom.contains("-")),
        "num_suspicious_symbols": m.count_re(dom, r"[@!*]"),
        "has_multiple_subdomains": T.flag(nsub >= 3),
        "subdomain_length": T.slen(sub),
        "has_port": T.flag(netloc.contains(":") & ~netloc.startswith("[")),
        "uses_https": T.flag(F.col(f"{p}scheme") == "https"),
        "punycode_domain": T.flag(dom.contains("xn--")),
        "domain_url_ratio": T.ratio(nd, n), "path_url_ratio": T.ratio(T.slen(path), n),
        "query_url_ratio": T.ratio(T.slen(q), n),
    }
    parse_error = F.col(f"{p}bad") & ~U.url_is_blank(u)
    bad = parse_error | u.isNull() | ((n > 0) & ~F.lower(u).rlike("[bcdfghjklmnpqrstvwxyz]"))
    cols = {
        k: F.when(bad, _zero(k)).otherwise(v).cast("double" if k in DOUBLE_FEATURES else "int") for k, v in e.items()
    }
    return m.add(staged).withColumns(cols).select(*df.columns, *V2_FEATURES)


def featurize_subst_aware(df: DataFrame, url_col: str = "url", native_only: bool = True) -> DataFrame:
    """DV8: the 66-column profile after strict cleaning (B11: only
    ``[a-zA-Z0-9:/?&=._%-]`` kept; shorter than 8 or without a dot gives the
    zero row), with the impersonation features testing brands under
    cumulative leetspeak substitutions (E10)."""
    p = "_s_"
    raw = F.col(url_col)
    x = dealt(df).withColumn(f"{p}url", U.strict_clean(U.keep_printable_ascii(raw)))
    staged = U.add_url_parts(x, f"{p}url", p, clean=False)
    s_url = F.col(f"{p}url")
    m, dom = Measures(), F.col(f"{p}dom")
    ex = _main_exprs(
        m, s_url, F.col(f"{p}scheme"), F.col(f"{p}netloc"), F.col(f"{p}path"), F.col(f"{p}query"),
        F.col(f"{p}sub"), dom, F.col(f"{p}sfx"), brand_check=m.any_literal(F.lower(dom), substitution_variants()),
    )
    bad = U.url_is_blank(raw) | (F.length(s_url) < 8) | ~s_url.contains(".") | (F.col(f"{p}bad") & ~U.url_is_blank(s_url))
    cols = {
        name: F.when(bad, _zero(name)).otherwise(ex[name]).cast("double" if name in DOUBLE_FEATURES else "int")
        for name in MAIN_NATIVE_FEATURES
    }
    out = m.add(staged).withColumns(cols).withColumn("_s_bad", bad)
    if native_only:
        return out.select(*df.columns, *MAIN_NATIVE_FEATURES)
    from hookline.operators.lookalike import add_typosquatting

    res = add_typosquatting(out.select(*df.columns, f"{p}url", "_s_bad", *MAIN_NATIVE_FEATURES), f"{p}url")
    res = res.withColumns({c: F.when(F.col("_s_bad"), _zero(c)).otherwise(F.col(c)) for c in RATIO_FEATURES})
    return res.select(*df.columns, *MAIN_FEATURES)


# Fixed lists of the first-draft 63-column profile.
DRAFT_NEW = ["brand_with_hyphen", "brand_impersonation", "typosquatting_similarity", "is_typosquatting",
             "suspicious_tld_brand_combo"]
DRAFT_FEATURES = [c for c in MAIN_FEATURES if c not in set(DRAFT_NEW) | {
    "has_character_substitution", "multiple_brands_in_domain", "brand_not_in_main_domain"}] + DRAFT_NEW
DRAFT_NATIVE = [c for c in DRAFT_FEATURES if c not in RATIO_FEATURES]


def featurize_draft63(df: DataFrame, url_col: str = "url", native_only: bool = False) -> DataFrame:
    """DV9: the 63-column first draft — 58 base columns (own dictionary and
    brand lists) plus hyphenated-brand, whole-URL impersonation against 30
    domains, best ratio to 11 major brands (typosquatting when strictly
    between 0.75 and 0.95) and bad-TLD + brand."""
    p = "_p_"
    parts = url_parts(dealt(df), url_col, p)
    u, dom, sfx = F.col(f"{p}u"), F.col(f"{p}dom"), F.col(f"{p}sfx")
    m = Measures()
    ex = _main_exprs(m, u, F.col(f"{p}scheme"), F.col(f"{p}netloc"), F.col(f"{p}path"), F.col(f"{p}query"),
                     F.col(f"{p}sub"), dom, sfx)
    lu, ld = F.lower(u), F.lower(dom)
    brand_in_url = m.any_literal(lu, DRAFT_CHECK_BRANDS)
    full = F.lower(F.concat(dom, F.lit("."), sfx))
    ex["domain_is_dictionary_word"] = T.flag(ld.isin(*DRAFT_DICTIONARY))
    ex["has_brand_name"] = T.flag(m.any_literal(lu, DRAFT_BRANDS))
    ex["brand_not_in_domain"] = T.flag(m.any_literal(lu, DRAFT_BRANDS) & ~m.any_literal(ld, DRAFT_BRANDS))
    ex["brand_with_hyphen"] = T.flag(m.any_literal(ld, DRAFT_HYPHEN_PATTERNS))
    ex["brand_impersonation"] = T.flag(brand_in_url & ~full.isin(*DRAFT_LEGIT))
    ex["suspicious_tld_brand_combo"] = T.flag(F.lower(sfx).isin(*DRAFT_COMBO_TLDS) & brand_in_url)
    bad = F.col(f"{p}bad")
    cols = {n: F.when(bad, _zero(n)).otherwise(ex[n]).cast("double" if n in DOUBLE_FEATURES else "int") for n in DRAFT_NATIVE}
    out = m.add(parts).withColumns(cols)
    if native_only:
        return out.select(*df.columns, *DRAFT_NATIVE)
    from hookline.operators.lookalike import ratios_against

    best = F.array_max(ratios_against(DRAFT_MAJOR_BRANDS)(ld))
    out = out.withColumn("_best", F.when(bad, F.lit(0.0)).otherwise(F.coalesce(best, F.lit(0.0))))
    out = out.withColumns(
        {"typosquatting_similarity": F.col("_best"), "is_typosquatting": T.flag((F.col("_best") > 0.75) & (F.col("_best") < 0.95))}
    )
    return out.select(*df.columns, *DRAFT_FEATURES)
