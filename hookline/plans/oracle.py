"""DuckDB oracle SQL for the registered queries.

Each oracle is one SELECT over the driver's views.  The derived inputs of
``hookline.plans.derived`` are restated here in SQL, and every feature or
rule is written from its definition — not translated from the Spark code — so
that the two engines check each other.  Doubles are rounded to 9 places in
both, because the engines sum terms in different orders.
"""

from __future__ import annotations

from hookline import constants as K
from hookline.functions.features import (
    DOUBLE_FEATURES, HOST29_ACTION, HOST29_FEATURES, HOST29_SENSITIVE, HOST29_SHORTENERS, HOST29_SUSPICIOUS,
    HOST29_SYMBOLS, MAIN_NATIVE_FEATURES, MINI11_FEATURES, V1_ACTION_WORDS, V1_FEATURES, V1_SENSITIVE_WORDS,
    V1_SHORTENERS, V1_SUSPICIOUS_WORDS,
)
from hookline.functions.suffixes import public_suffix_rules

ROUND = 9


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def pick(values, key: str) -> str:
    return f"({lst(values)})[(({key}) % {len(values)}) + 1]"


def contains_any(x: str, words) -> str:
    return f"(len(list_filter({lst(words)}, lambda w: contains({x}, w))) > 0)"


def count_present(x: str, words) -> str:
    return f"len(list_filter({lst(words)}, lambda w: contains({x}, w)))::INTEGER"


def nchars(x: str, cls: str) -> str:
    """Number of characters of ``x`` inside the regex class ``cls``."""
    return f"length(regexp_replace({x}, '[^{cls}]', '', 'g'))::INTEGER"


def nsub(x: str, lit: str) -> str:
    return f"((length({x}) - length(replace({x}, {q(lit)}, ''))) // {len(lit)})::INTEGER"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0 END)"


def flag(cond: str) -> str:
    return f"(CASE WHEN {cond} THEN 1 ELSE 0 END)"


def entropy(x: str, printable_only: bool = True) -> str:
    s = f"regexp_replace({x}, '[^\\x20-\\x7E]', '', 'g')" if printable_only else x
    p = f"((length({s}) - length(replace({s}, ch, ''))) / length({s}))"
    return (
        f"(CASE WHEN length({s}) = 0 THEN 0.0 ELSE "
        f"-list_sum(list_transform(list_distinct(string_split({s}, '')), lambda ch: {p} * log2({p}))) END)"
    )


def longest_run(x: str) -> str:
    starts = f"list_filter(range(1, length({x}) + 1), lambda i: i = 1 OR substr({x}, i, 1) <> substr({x}, i - 1, 1))"
    return (
        f"coalesce(list_max(list_transform(list_append({starts}, length({x}) + 1), "
        f"lambda v, j: CASE WHEN j = 1 THEN 0 ELSE v - list_append({starts}, length({x}) + 1)[j - 1] END)), 0)::INTEGER"
    )


def longest_match(x: str, pattern: str) -> str:
    return f"coalesce(list_max(list_transform(regexp_extract_all({x}, {q(pattern)}), lambda t: length(t))), 0)::INTEGER"


def longest_token(x: str, pattern: str) -> str:
    return f"coalesce(list_max(list_transform(string_split_regex({x}, {q(pattern)}), lambda t: length(t))), 0)::INTEGER"


def ngram_div(x: str, n: int) -> str:
    return (
        f"(CASE WHEN length({x}) >= {n} THEN "
        f"len(list_distinct(list_transform(range(1, length({x}) - {n} + 2), lambda i: substr({x}, i, {n})))) / length({x}) "
        f"ELSE 0.0 END)"
    )


def leet_list_sql() -> str:
    """Brands with all of one letter replaced, one rule at a time, as a constant list."""
    brands = ", ".join(f"({q(b)})" for b in K.BRAND_KEYWORDS)
    rules = ", ".join(f"({q(o)}, {q(n)})" for o, n in K.LEET_RULES)
    return (
        f"(SELECT list(replace(b.w, r.o, r.n)) FROM (VALUES {brands}) b(w), (VALUES {rules}) r(o, n) "
        "WHERE contains(b.w, r.o))"
    )


def has_any_sql(x: str, words: str) -> str:
    return f"(len(list_filter({words}, lambda w: contains({x}, w))) > 0)"


def variant_rows_sql() -> str:
    """(brand_ord, variant): the brand after any subset of the rules, rule by rule."""
    steps = [f"c0 AS (SELECT brand_ord, brand AS variant FROM {brands_values()})"]
    for i, (o, n) in enumerate(K.LEET_RULES):
        steps.append(f"c{i + 1} AS (SELECT * FROM c{i} UNION SELECT brand_ord, replace(variant, {q(o)}, {q(n)}) FROM c{i})")
    return f"(WITH {', '.join(steps)} SELECT brand_ord, variant FROM c{len(K.LEET_RULES)})"


def rnd(expr: str) -> str:
    return f"round(({expr})::DOUBLE, {ROUND})"


# ------------------------------------------------------------ derived inputs

REAL_URLS = "SELECT page_id::BIGINT AS id, 'real' AS source, url FROM pages"


def brand_urls_sql() -> str:
    k = "c_custkey"
    host = f"replace({pick(K.SYNTH_PATTERNS, k)}, '{{brand}}', {pick(K.BRAND_KEYWORDS, k)})"
    sub = f"(CASE WHEN {k} % 3 = 0 THEN {pick(K.SYNTH_SUBS, k)} || '.' ELSE '' END)"
    path = f"(CASE WHEN {k} % 4 = 1 THEN '/' || {pick(K.SYNTH_PATH_WORDS, k)} || '/' || {k}::VARCHAR ELSE '' END)"
    query = f"(CASE WHEN {k} % 5 = 0 THEN '?ref=' || {k}::VARCHAR ELSE '' END)"
    scheme = f"(CASE WHEN {k} % 10 < 7 THEN 'https://' ELSE 'http://' END)"
    return (
        f"SELECT {k}::BIGINT AS id, 'brand' AS source, "
        f"{scheme} || {sub} || {host} || {pick(K.SYNTH_TLDS, k)} || {path} || {query} AS url FROM customer"
    )


def legit_urls_sql() -> str:
    return f"SELECT s_suppkey::BIGINT AS id, 'legit' AS source, 'https://www.' || {pick(K.LEGITIMATE_DOMAINS, 's_suppkey')} AS url FROM supplier"


def odd_urls_sql() -> str:
    k = "o_orderkey"
    ks = f"{k}::VARCHAR"
    ends = lst(K.ODD_SUFFIXES)
    return f"""SELECT {k}::BIGINT AS id, 'odd' AS source, CASE {k} % 8
      WHEN 0 THEN 'http://' || ({k} % 223 + 1)::VARCHAR || '.' || ({k} % 97)::VARCHAR || '.' || ({k} % 13)::VARCHAR
                  || '.' || ({k} % 251)::VARCHAR || '/login.php?id=' || {ks}
      WHEN 1 THEN 'https://secure-update.com@acct' || {ks} || '.example.com/verify'
      WHEN 2 THEN 'HTTP://Host' || {ks} || '.Example.NET:8080/Account/Update'
      WHEN 3 THEN 'https://files.example.org/' || repeat('ab1-', 30) || {ks}
      WHEN 4 THEN 'https://news.example.com/%70%61th/' || {ks} || '?q=%3Cscript%3E&r=caf%C3%A9+x&d=50%%3Cscript%3E'
      WHEN 5 THEN 'www.shop' || {ks} || '.example.com/cart;v=1?item=' || {ks}
      WHEN 6 THEN 'https://search.example.com/find?q=<script>alert(' || {ks} || ')</script>&next=javascript:void(0)'
      ELSE 'http://download' || {ks} || {ends}[(o_orderkey // 8) % {len(K.ODD_SUFFIXES)} + 1] || '/setup.exe' END AS url
    FROM orders"""


def brands_values(brands=K.BRAND_KEYWORDS) -> str:
    rows = ", ".join(f"({i + 1}, {q(b)})" for i, b in enumerate(brands))
    return f"(SELECT * FROM (VALUES {rows}) t(brand_ord, brand))"


def typo_variants_sql() -> str:
    homo = ", ".join(f"({q(a)}, {q(b)})" for a, b in K.SYNTH_HOMO.items())
    affix = " UNION ALL ".join(
        f"SELECT brand_ord, brand, brand || {q(d)} AS typo FROM b UNION ALL SELECT brand_ord, brand, {q(d)} || brand FROM b"
        for d in K.SYNTH_DIGIT_AFFIXES
    )
    digram = " UNION ALL ".join(
        f"SELECT brand_ord, brand, replace(brand, {q(o)}, {q(n)}) FROM b WHERE contains(brand, {q(o)})"
        for o, n in K.SYNTH_DIGRAMS
    )
    return f"""(WITH b AS {brands_values()},
      pos AS (SELECT brand_ord, brand, unnest(range(1, length(brand) + 1)) AS i FROM b),
      homo AS (SELECT * FROM (VALUES {homo}) h(ch, rep)),
      v AS (
        SELECT brand_ord, brand, substr(brand, 1, i - 1) || rep || substr(brand, i + 1) AS typo
          FROM pos JOIN homo ON substr(brand, i, 1) = ch
        UNION ALL SELECT brand_ord, brand, substr(brand, 1, i - 1) || substr(brand, i + 1) FROM pos WHERE length(brand) > 3
        UNION ALL SELECT brand_ord, brand, substr(brand, 1, i) || substr(brand, i) FROM pos
        UNION ALL SELECT brand_ord, brand, substr(brand, 1, i - 1) || substr(brand, i + 1, 1) || substr(brand, i, 1)
                  || substr(brand, i + 2) FROM pos WHERE i <= length(brand) - 1
        UNION ALL {affix}
        UNION ALL {digram})
      SELECT brand_ord, brand, list_sort(list(DISTINCT typo)) AS variants
      FROM v WHERE typo <> '' AND typo <> brand GROUP BY brand_ord, brand)"""


def typo_urls_sql() -> str:
    k = "p_partkey"
    return f"""SELECT {k}::BIGINT AS id, 'typo' AS source,
        (CASE WHEN {k} % 2 = 0 THEN 'https://' ELSE 'http://' END)
        || variants[({k} % len(variants)) + 1] || {pick(K.SYNTH_TLDS, k)} AS url
      FROM part JOIN {typo_variants_sql()} tv ON tv.brand_ord = ({k} % {len(K.BRAND_KEYWORDS)}) + 1"""


def typed_urls_sql() -> str:
    return f"""(SELECT *, 'benign' AS type FROM ({REAL_URLS})
      UNION ALL SELECT *, 'benign' AS type FROM ({legit_urls_sql()})
      UNION ALL SELECT *, 'phishing' AS type FROM ({brand_urls_sql()})
      UNION ALL SELECT *, 'phishing' AS type FROM ({typo_urls_sql()})
      UNION ALL SELECT *, CASE WHEN id % 2 = 0 THEN 'malware' ELSE 'defacement' END AS type FROM ({odd_urls_sql()}))"""


def given_probs_sql() -> str:
    k = "o_orderkey"
    cols = []
    for mi, m in enumerate(["xgb", "lgb", "rf"]):
        vals = [
            f"(({k} * {7 + 3 * mi + ci} + {11 * ci + mi}) % 97 + 1 + CASE WHEN ({k} + {mi}) % 4 = {ci} THEN 300 ELSE 0 END)::DOUBLE"
            for ci in range(4)
        ]
        total = "(" + " + ".join(vals) + ")"
        for ci, c in enumerate(K.CLASSES):
            cols.append(f"{vals[ci]} / {total} AS {m}_{c}")
    label = pick(K.CLASSES, f"floor({k} / 3)::BIGINT")
    return f"(SELECT {k}::BIGINT AS id, {label} AS label, {', '.join(cols)} FROM orders)"


# ------------------------------------------------------------------ URL parts

IPV4_STRICT = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
IPV6_LIKE = r"^([0-9A-Fa-f]{0,4}:){2,7}([0-9A-Fa-f]{0,4}|[0-9]{1,3}(\.[0-9]{1,3}){3})(%[A-Za-z0-9._~-]+)?$"
IPVFUTURE = r"^v[A-Fa-f0-9]+\..+$"
WS = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def url_parts_ctes(src: str, url: str = "url", clean: bool = True) -> str:
    """CTEs p1..p4 over ``src``: u (printable ASCII), bad, scheme, netloc,
    path, query, fragment, subdomain, domain, suffix."""
    schemes = lst(K.URL_SCHEMES_WITH_PARAMS)
    rules = ", ".join(f"({q(r)})" for r in public_suffix_rules())
    return f"""psl AS MATERIALIZED (SELECT rule FROM (VALUES {rules}) r(rule)),
    p1 AS (
      SELECT *, {"regexp_replace(" + url + ", '[^\\x20-\\x7E]', '', 'g')" if clean else url} AS u,
             ({url} IS NULL OR length(trim({url}, {WS})) = 0) AS blank
      FROM {src}),
    p2 AS (
      SELECT *, lower(regexp_extract(ltrim(u), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
             regexp_replace(ltrim(u), '^[A-Za-z][A-Za-z0-9+.-]*:', '') AS after_scheme
      FROM p1),
    p3 AS (
      SELECT *, regexp_extract(after_scheme, '^//([^/?#]*)', 1) AS netloc,
             regexp_replace(after_scheme, '^//[^/?#]*', '') AS rest,
             regexp_replace(regexp_extract(regexp_replace(u, '^(//|[A-Za-z0-9+.-]+://)', ''),
                 '^([^/?#]*)', 1), '^.*@', '') AS after_user
      FROM p2),
    p4 AS (
      SELECT *, regexp_extract(rest, '^([^?#]*)', 1) AS path_raw,
             regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1) AS query,
             regexp_extract(rest, '^[^#]*#(.*)$', 1) AS fragment,
             regexp_replace(trim(CASE WHEN regexp_extract(after_user, '^(\\[[^\\]]*\\])', 1) <> ''
                  THEN regexp_extract(after_user, '^(\\[[^\\]]*\\])', 1)
                  ELSE regexp_extract(after_user, '^([^:]*)', 1) END), '\\.+$', '') AS host
      FROM p3),
    p5 AS (
      SELECT *, CASE WHEN list_contains({schemes}, scheme) THEN regexp_extract(path_raw, '^((.*/)?[^/;]*)', 1)
                     ELSE path_raw END AS path,
             string_split(host, '.') AS labels,
             ((contains(netloc, '[') <> contains(netloc, ']'))
               OR (contains(netloc, '[') AND NOT (regexp_matches(regexp_extract(netloc, '\\[([^\\]]*)\\]', 1), {q(IPV6_LIKE)})
                    OR regexp_matches(regexp_extract(netloc, '\\[([^\\]]*)\\]', 1), {q(IPVFUTURE)})))) AS parse_error
      FROM p4),
    p5t AS (
      SELECT *, lower(labels[len(labels)]) AS t1,
        CASE WHEN len(labels) >= 2 THEN lower(array_to_string(labels[-2:], '.')) END AS t2,
        CASE WHEN len(labels) >= 3 THEN lower(array_to_string(labels[-3:], '.')) END AS t3,
        CASE WHEN len(labels) >= 4 THEN lower(array_to_string(labels[-4:], '.')) END AS t4
      FROM p5),
    p6 AS (
      SELECT *, CASE
          WHEN t4 IS NOT NULL AND '!' || t4 IN (SELECT rule FROM psl) THEN 3
          WHEN t3 IS NOT NULL AND '!' || t3 IN (SELECT rule FROM psl) THEN 2
          WHEN t2 IS NOT NULL AND '!' || t2 IN (SELECT rule FROM psl) THEN 1
          WHEN t4 IS NOT NULL AND (t4 IN (SELECT rule FROM psl) OR '*.' || t3 IN (SELECT rule FROM psl)) THEN 4
          WHEN t3 IS NOT NULL AND (t3 IN (SELECT rule FROM psl) OR '*.' || t2 IN (SELECT rule FROM psl)) THEN 3
          WHEN t2 IS NOT NULL AND (t2 IN (SELECT rule FROM psl) OR '*.' || t1 IN (SELECT rule FROM psl)) THEN 2
          WHEN t1 IN (SELECT rule FROM psl) THEN 1
          ELSE 0 END AS sk
      FROM p5t),
    p7 AS (
      SELECT *, (sk = 0 AND regexp_matches(lower(host), {q(IPV4_STRICT)})) AS is_ip FROM p6),
    parts AS (
      SELECT *,
        CASE WHEN is_ip THEN '' WHEN len(labels) - sk >= 2 THEN array_to_string(list_slice(labels, 1, len(labels) - sk - 1), '.') ELSE '' END AS sub,
        CASE WHEN is_ip THEN host WHEN len(labels) - sk >= 1 THEN labels[len(labels) - sk] ELSE '' END AS dom,
        CASE WHEN is_ip THEN '' WHEN sk > 0 THEN array_to_string(list_slice(labels, len(labels) - sk + 1, len(labels)), '.') ELSE '' END AS sfx,
        (blank OR parse_error) AS bad
      FROM p7)"""


def main_feature_exprs(brand_check: str | None = None) -> dict[str, str]:
    u, d, sd, sx, p, qq, n = "u", "dom", "sub", "sfx", "path", "query", "netloc"
    lu, ld, lsx = "lower(u)", "lower(dom)", "lower(sfx)"
    brand_in_url = contains_any(lu, K.BRAND_KEYWORDS)
    brand_in_dom_plain = contains_any(ld, K.BRAND_KEYWORDS)
    brand_in_dom = brand_check or brand_in_dom_plain
    full = f"lower(CASE WHEN {sx} <> '' THEN {d} || '.' || {sx} ELSE {d} END)"
    legit = f"list_contains({lst(K.LEGITIMATE_DOMAINS)}, {full})"
    nsd = f"(CASE WHEN {sd} = '' THEN 0 ELSE len(string_split({sd}, '.')) END)"
    e = {
        "url_length": f"length({u})",
        "num_dots": nsub(u, "."),
        "num_hyphens": nsub(u, "-"),
        "num_underscores": nsub(u, "_"),
        "num_digits": nchars(u, "0-9"),
        "num_letters": nchars(u, "A-Za-z"),
        "num_special_chars": nchars(u, "@?=%&!+$"),
        "has_ip": flag(f"regexp_matches({n}, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+')"),
        "num_subdomains": nsd,
        "has_multiple_subdomains": flag(f"{nsd} >= 3"),
        "domain_length": f"length({d})",
        "host_entropy": entropy(d),
        "domain_entropy": entropy(d),
        "domain_has_digits": flag(f"regexp_matches({d}, '[0-9]')"),
        "domain_digit_ratio": ratio(nchars(d, "0-9"), f"length({d})"),
        "domain_vowel_ratio": ratio(nchars(ld, "aeiou"), nchars(ld, "b-df-hj-np-tv-z")),
        "domain_bigram_diversity": ngram_div(d, 2),
        "domain_trigram_diversity": ngram_div(d, 3),
        "suspicious_prefix_suffix": flag(f"contains({d}, '-')"),
        "num_suspicious_symbols": nchars(d, "@!*"),
        "subdomain_length": f"length({sd})",
        "domain_is_dictionary_word": flag(f"list_contains({lst(K.BRAND_KEYWORDS)}, {ld})"),
        "tld_length": f"length({sx})",
        "tld_trust_category": f"(CASE WHEN list_contains({lst(K.HIGH_TRUST_TLDS)}, {lsx}) THEN 2 "
        f"WHEN list_contains({lst(K.SUSPICIOUS_TLDS_CATEGORY)}, {lsx}) THEN 0 ELSE 1 END)",
        "is_suspicious_tld": flag(f"list_contains({lst(K.SUSPICIOUS_TLDS_FLAG)}, {lsx})"),
        "is_high_trust_tld": flag(f"list_contains({lst(K.HIGH_TRUST_TLDS)}, {lsx})"),
        "is_country_tld": flag(f"regexp_matches({sx}, '^[A-Za-z]{{2}}$')"),
        "path_length": f"length({p})",
        "num_path_segments": f"len(list_filter(string_split({p}, '/'), lambda s: s <> ''))",
        "num_query_params": f"(CASE WHEN {qq} = '' THEN 0 ELSE len(string_split({qq}, '&')) END)",
        "query_length": f"length({qq})",
        "num_encoded_chars": nsub(u, "%"),
        "num_fragments": nsub(u, "#"),
        "path_entropy": entropy(p),
        "path_has_suspicious_ext": flag(contains_any(f"lower({p})", K.SUSPICIOUS_EXTENSIONS)),
        "query_has_redirect": flag(contains_any(f"lower({qq})", K.REDIRECT_WORDS)),
        "path_url_ratio": ratio(f"length({p})", f"length({u})"),
        "suspicious_word": flag(contains_any(lu, K.SUSPICIOUS_WORDS)),
        "num_suspicious_words": count_present(lu, K.SUSPICIOUS_WORDS),
        "sensitive_word": flag(contains_any(lu, K.SENSITIVE_WORDS)),
        "action_word": flag(contains_any(lu, K.ACTION_WORDS)),
        "has_brand_name": flag(brand_in_url),
        "brand_not_in_domain": flag(f"{brand_in_url} AND NOT {brand_in_dom_plain}"),
        "is_shortening_service": flag(contains_any(u, K.SHORTENERS)),
        "is_mixed_case": flag(f"regexp_matches({u}, '[A-Z]') AND regexp_matches({u}, '[a-z]')"),
        "num_repeated_chars": longest_run(u),
        "longest_token_length": longest_token(u, "[./?=&_-]"),
        "digit_letter_ratio": ratio(nchars(u, "0-9"), nchars(u, "A-Za-z")),
        "special_char_ratio": ratio(nchars(u, "@?=%&!+$"), f"length({u})"),
        "uppercase_ratio": ratio(nchars(u, "A-Z"), f"length({u})"),
        "consecutive_consonants": longest_match(lu, "[bcdfghjklmnpqrstvwxyz]+"),
        "url_entropy": entropy(u),
        "has_port": flag(f"contains({n}, ':') AND NOT starts_with({n}, '[')"),
        "uses_https": flag("scheme = 'https'"),
        "punycode_domain": flag(f"contains({d}, 'xn--')"),
        "subdomain_count_dot": nsub(sd, "."),
        "domain_url_ratio": ratio(f"length({d})", f"length({u})"),
        "query_url_ratio": ratio(f"length({qq})", f"length({u})"),
        "brand_impersonation": flag(f"{brand_in_dom} AND NOT {legit}"),
        "brand_with_hyphen": flag(f"{brand_in_dom} AND contains({d}, '-') AND NOT {legit}"),
        "has_character_substitution": flag(has_any_sql(ld, leet_list_sql())),
        "suspicious_tld_brand_combo": flag(
            f"list_contains({lst(K.SUSPICIOUS_TLDS_BRAND_COMBO)}, {lsx}) AND {brand_in_dom} AND NOT {legit}"
        ),
        "multiple_brands_in_domain": flag(f"{count_present(ld, K.BRAND_KEYWORDS)} >= 2"),
        "brand_not_in_main_domain": flag(f"{brand_in_url} AND NOT {brand_in_dom}"),
    }
    return e


def url_features_sql() -> str:
    e = main_feature_exprs()
    cols = []
    for name in MAIN_NATIVE_FEATURES:
        if name in DOUBLE_FEATURES:
            cols.append(f"CASE WHEN bad THEN 0.0 ELSE {rnd(e[name])} END AS {name}")
        else:
            cols.append(f"CASE WHEN bad THEN 0 ELSE ({e[name]})::INTEGER END AS {name}")
    return f"""WITH src AS {typed_urls_sql()},
    {url_parts_ctes('src')}
    SELECT id, source, url, type, {', '.join(cols)} FROM parts"""


def url_split_sql() -> str:
    return f"""WITH src AS {typed_urls_sql()},
    {url_parts_ctes('src')}
    SELECT id, source, url, scheme, netloc, path, query, fragment, sub AS subdomain, dom AS domain, sfx AS suffix,
      bad AS invalid,
      CASE WHEN regexp_matches(url, '^https?://') THEN url ELSE 'https://' || url END AS url_https,
      CASE WHEN regexp_matches(url, '^[a-zA-Z]+://') THEN url ELSE 'http://' || url END AS url_http,
      regexp_replace(url, '[^a-zA-Z0-9:/?&=._%-]', '', 'g') AS strict_url,
      (length(regexp_replace(url, '[^a-zA-Z0-9:/?&=._%-]', '', 'g')) >= 8
         AND contains(regexp_replace(url, '[^a-zA-Z0-9:/?&=._%-]', '', 'g'), '.')) AS strict_ok,
      coalesce(string_split(url, '/')[3], '') AS netloc_by_slash,
      CASE WHEN contains(url, '://') THEN split_part(regexp_extract(url, '^.*?://(.*)$', 1), '/', 1) END AS host_key,
      CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\\\]')
             AND regexp_extract(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\\\]*)', 1), '^.*@', ''),
                   '^(\\[[^\\]]*\\]|[^:]*)', 1) <> ''
           THEN lower(regexp_extract(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\\\]*)', 1), '^.*@', ''),
                   '^(\\[[^\\]]*\\]|[^:]*)', 1))
           ELSE url END AS hostname
    FROM parts"""


def v1_features_sql() -> str:
    """DV1 on the raw URL (no clean-up, no zero row)."""
    e = {
        "url_length": "length(u)",
        "num_dots": nsub("u", "."),
        "num_hyphens": nsub("u", "-"),
        "num_underscores": nsub("u", "_"),
        "num_digits": nchars("u", "0-9"),
        "num_letters": nchars("u", "A-Za-z"),
        "num_special_chars": nchars("u", "@?=%&!+$"),
        "has_ip": flag("regexp_matches(netloc, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+')"),
        "num_subdomains": "(CASE WHEN sub = '' THEN 0 ELSE len(string_split(sub, '.')) END)",
        "domain_length": "length(dom)",
        "host_entropy": rnd(entropy("dom")),
        "path_length": "length(path)",
        "num_path_segments": "len(list_filter(string_split(path, '/'), lambda s: s <> ''))",
        "num_query_params": "(CASE WHEN query = '' THEN 0 ELSE len(string_split(query, '&')) END)",
        "query_length": "length(query)",
        "num_encoded_chars": nsub("u", "%"),
        "num_fragments": nsub("u", "#"),
        "suspicious_word": flag(contains_any("lower(u)", V1_SUSPICIOUS_WORDS)),
        "sensitive_word": flag(contains_any("lower(u)", V1_SENSITIVE_WORDS)),
        "action_word": flag(contains_any("lower(u)", V1_ACTION_WORDS)),
        "is_shortening_service": flag(contains_any("u", V1_SHORTENERS)),
        "is_mixed_case": flag("regexp_matches(u, '[A-Z]') AND regexp_matches(u, '[a-z]')"),
        "url_entropy": rnd(entropy("u")),
        "path_entropy": rnd(entropy("path")),
        "domain_entropy": rnd(entropy("dom")),
        "num_repeated_chars": longest_run("u"),
        "longest_token_length": longest_token("u", "[./?=&_-]"),
        "suspicious_prefix_suffix": flag("contains(dom, '-')"),
        "num_suspicious_symbols": nchars("dom", "@!*"),
    }
    cols = ", ".join(
        f"({e[c]})::{'DOUBLE' if 'entropy' in c else 'INTEGER'} AS {c}" for c in V1_FEATURES
    )
    # The raw URL is used as is: the typed URLs are printable ASCII already.
    return f"""WITH src AS {typed_urls_sql()},
    {url_parts_ctes('src')}
    SELECT id, source, url, {cols} FROM parts"""


def host29_features_sql() -> str:
    """DV5 on the percent-decoded URL."""
    full, host = "fullu", "host29"
    sym = "".join("\\" + ch if ch in "]\\^-" else ch for ch in HOST29_SYMBOLS)
    e = {
        "url_length": f"length({full})",
        "num_dots": nsub(full, "."),
        "num_hyphens": nsub(full, "-"),
        "num_underscores": nsub(full, "_"),
        "num_digits": nchars(full, "0-9"),
        "num_letters": f"length(regexp_replace({full}, '[^\\pL]', '', 'g'))",
        "num_special_chars": f"length(regexp_replace({full}, '[A-Za-z0-9]', '', 'g'))",
        "has_ip": flag(f"regexp_matches({host}, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$')"),
        "num_subdomains": f"greatest(len(string_split({host}, '.')) - 2, 0)",
        "domain_length": f"length({host})",
        "host_entropy": rnd(entropy(host, False)),
        "path_length": "length(path)",
        "num_path_segments": nsub("path", "/"),
        "num_query_params": nsub("query", "="),
        "query_length": "length(query)",
        "num_encoded_chars": f"({nsub(full, '%')} + {nsub(full, '+')})",
        "num_fragments": flag("fragment <> ''"),
        "suspicious_word": flag(contains_any(full, HOST29_SUSPICIOUS)),
        "sensitive_word": flag(contains_any(full, HOST29_SENSITIVE)),
        "action_word": flag(contains_any(full, HOST29_ACTION)),
        "is_shortening_service": flag(contains_any(host, HOST29_SHORTENERS)),
        "is_mixed_case": flag(f"regexp_matches({full}, '\\p{{Lu}}') AND regexp_matches({full}, '\\p{{Ll}}')"),
        "url_entropy": rnd(entropy(full, False)),
        "path_entropy": rnd(entropy("path")),
        "domain_entropy": rnd(entropy(host, False)),
        "num_repeated_chars": flag(f"regexp_matches({full}, '\\w')"),
        "longest_token_length": longest_token(full, "[^A-Za-z0-9]"),
        "suspicious_prefix_suffix": flag(f"regexp_matches({host}, '^(login|secure)') OR regexp_matches({host}, '(login|secure)$')"),
        "num_suspicious_symbols": f"length(regexp_replace({full}, '[^{sym}]', '', 'g'))",
    }
    cols = ", ".join(f"({e[c]})::{'DOUBLE' if 'entropy' in c else 'INTEGER'} AS {c}" for c in HOST29_FEATURES)
    return f"""WITH src0 AS {typed_urls_sql()},
    src AS (SELECT id, source, url AS url_in,
                   CASE WHEN regexp_matches(url, '^[a-zA-Z]+://') THEN url ELSE 'http://' || url END AS url FROM src0),
    {url_parts_ctes('src')},
    h AS (SELECT *, lower(netloc) AS host29, url_decode(url) AS fullu FROM parts)
    SELECT id, source, url_in AS url, {cols} FROM h"""


def mini11_py_sql() -> str:
    parts = "string_split(url, '/')"
    host = f"coalesce({parts}[3], '')"
    e = {
        "url_length": "length(url)",
        "domain_length": f"CASE WHEN len({parts}) > 2 THEN length({host}) ELSE 0 END",
        "path_length": f"CASE WHEN len({parts}) > 3 THEN length(regexp_extract(url, '^[^/]*/[^/]*/[^/]*/(.*)$', 1)) ELSE 0 END",
        "has_ip": flag(f"regexp_matches({host}, '[0-9]') AND contains({host}, '.')"),
        "subdomain_count": f"CASE WHEN len({parts}) > 2 THEN {nsub(host, '.')} - 1 ELSE 0 END",
        "has_at": flag("contains(url, '@')"),
        "has_double_slash": flag(f"{nsub('url', '//')} > 1"),
        "special_chars": "length(regexp_replace(url, '[\\pL\\pN]', '', 'g'))",
        "is_https": flag("starts_with(url, 'https')"),
        "suspicious_tld": flag(f"regexp_matches(url, '\\.({'|'.join(K.MINI_SUSPICIOUS_TLDS)})$')"),
        "has_suspicious_words": flag(contains_any("lower(url)", K.MINI_SUSPICIOUS_WORDS)),
    }
    cols = ", ".join(f"({e[c]})::INTEGER AS {c}" for c in MINI11_FEATURES)
    return f"SELECT id, source, url, {cols} FROM {typed_urls_sql()}"


def mini11_js_sql() -> str:
    ok = "regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\\\]')"
    host = (
        "(CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\\\]') AND "
        "regexp_extract(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\\\]*)', 1), '^.*@', ''), '^(\\[[^\\]]*\\]|[^:]*)', 1) <> '' "
        "THEN lower(regexp_extract(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\\\]*)', 1), '^.*@', ''), '^(\\[[^\\]]*\\]|[^:]*)', 1)) "
        "ELSE url END)"
    )
    pathname = "(CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END)"
    e = {
        "url_length": "length(url)",
        "domain_length": f"length({host})",
        "path_length": f"length({pathname})",
        "has_ip": flag("regexp_matches(url, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}')"),
        "subdomain_count": f"({nsub(host, '.')} - 1)",
        "has_at": flag("contains(url, '@')"),
        "has_double_slash": flag(f"{nsub('url', '//')} > 1"),
        "special_chars": "length(regexp_replace(url, '[a-zA-Z0-9]', '', 'g'))",
        "is_https": flag("lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) = 'https'"),
        "suspicious_tld": flag(f"regexp_matches({host}, '(?i)\\.({'|'.join(K.MINI_SUSPICIOUS_TLDS)})$')"),
        "has_suspicious_words": flag(contains_any(f"lower({host})", K.MINI_SUSPICIOUS_WORDS)),
    }
    cols = ", ".join(f"CASE WHEN {ok} THEN ({e[c]})::INTEGER END AS {c}" for c in MINI11_FEATURES)
    return f"SELECT id, source, url, {cols} FROM {typed_urls_sql()}"


# ----------------------------------------------------------- look-alikes

def typo_patterns_sql() -> str:
    """E4 pattern table (brand_ord, pattern) in SQL."""
    subs = ", ".join(f"({q(k)}, {q(r)})" for k, v in K.TYPO_SUBSTITUTIONS.items() for r in v)
    return f"""(WITH b AS {brands_values()},
      pos AS (SELECT brand_ord, brand, unnest(range(1, length(brand) + 1)) AS i FROM b),
      subs AS (SELECT * FROM (VALUES {subs}) s(ch, rep)),
      allp AS (
        SELECT brand_ord, substr(brand, 1, i - 1) || rep || substr(brand, i + 1) AS pattern
          FROM pos JOIN subs ON substr(brand, i, 1) = ch
        UNION ALL
        SELECT p1.brand_ord, substr(p1.brand, 1, p1.i - 1) || s1.rep || substr(p1.brand, p1.i + 1, p2.i - p1.i - 1)
               || s2.rep || substr(p1.brand, p2.i + 1)
          FROM pos p1 JOIN pos p2 ON p1.brand_ord = p2.brand_ord AND p2.i > p1.i
          JOIN subs s1 ON substr(p1.brand, p1.i, 1) = s1.ch
          JOIN subs s2 ON substr(p2.brand, p2.i, 1) = s2.ch
        UNION ALL SELECT brand_ord, substr(brand, 1, i - 1) || substr(brand, i + 1) FROM pos WHERE length(brand) > 4
        UNION ALL SELECT brand_ord, substr(brand, 1, i) || substr(brand, i) FROM pos
        UNION ALL SELECT brand_ord, substr(brand, 1, i - 1) || substr(brand, i + 1, 1) || substr(brand, i, 1)
                  || substr(brand, i + 2) FROM pos WHERE i < length(brand))
      SELECT DISTINCT brand_ord, pattern FROM allp)"""


def legit_first_labels() -> list[str]:
    return sorted({d.split(".")[0] for d in K.LEGITIMATE_DOMAINS})


def homograph_pairs() -> list[tuple[str, str]]:
    return [(r, o) for o, reps in K.HOMOGLYPHS.items() for r in reps if r.isalnum() and r == r.lower()]


def homograph_sql(dl: str) -> str:
    pairs = ", ".join(f"{{'c': {q(r)}, 'o': {q(o)}}}" for r, o in homograph_pairs())
    brands = lst(K.BRAND_KEYWORDS)
    return (
        f"(len(list_filter([{pairs}], lambda pr: contains({dl}, pr.c) AND "
        f"len(list_filter({brands}, lambda bb: contains(replace({dl}, pr.c, pr.o), bb))) > 0)) > 0)"
    )


def pattern_verdict_ctes(domains: str) -> str:
    """CTEs over ``domains`` (one column ``domain``): ``verdict`` with the
    pattern-only look-alike verdict, homograph and substitution flags."""
    brands = brands_values()
    return f"""pats AS {typo_patterns_sql()},
    doms AS (SELECT DISTINCT domain, lower(domain) AS dl FROM {domains} WHERE domain IS NOT NULL),
    hits AS (
      SELECT d.domain, d.dl, p.brand_ord, bool_or(p.pattern = d.dl) AS exact
      FROM doms d JOIN pats p ON contains(d.dl, p.pattern)
      GROUP BY d.domain, d.dl, p.brand_ord),
    qual AS (
      SELECT h.domain, h.brand_ord, CASE WHEN h.exact THEN 0.95 ELSE 0.90 END AS conf
      FROM hits h JOIN {brands} b ON b.brand_ord = h.brand_ord
      WHERE h.dl <> b.brand
        AND (h.exact OR NOT len(list_filter({lst(K.LEGITIMATE_DOMAINS)}, lambda g: starts_with(g, h.dl))) > 0)),
    firsts AS (SELECT domain, arg_min(brand_ord, brand_ord) AS brand_ord, arg_min(conf, brand_ord) AS conf FROM qual GROUP BY domain),
    verdict AS (
      SELECT d.domain,
        (f.brand_ord IS NOT NULL AND NOT list_contains({lst(legit_first_labels())}, d.domain)) AS typo_flag,
        CASE WHEN f.brand_ord IS NOT NULL AND NOT list_contains({lst(legit_first_labels())}, d.domain)
             THEN b.brand END AS typo_brand,
        CASE WHEN f.brand_ord IS NOT NULL AND NOT list_contains({lst(legit_first_labels())}, d.domain)
             THEN f.conf ELSE 0.0 END AS typo_confidence,
        {homograph_sql('d.dl')} AS homograph,
        {has_any_sql('d.dl', leet_list_sql())} AS char_substitution
      FROM doms d LEFT JOIN firsts f ON f.domain = d.domain LEFT JOIN {brands} b ON b.brand_ord = f.brand_ord)"""


def lookalike_patterns_sql() -> str:
    return f"""WITH src AS {typed_urls_sql()},
    {url_parts_ctes('src')},
    dsrc AS (SELECT dom AS domain FROM parts),
    {pattern_verdict_ctes('dsrc')}
    SELECT domain, typo_flag, typo_brand, round(typo_confidence::DOUBLE, {ROUND}) AS typo_confidence, homograph, char_substitution
    FROM verdict"""


def url_model_probs_sql(src: str) -> str:
    """One model's probabilities per typed URL from key arithmetic."""
    k = "(id * 7 + length(source))"
    vals = [f"(({k} * {7 + ci} + {11 * ci}) % 97 + 1 + CASE WHEN {k} % 4 = {ci} THEN 300 ELSE 0 END)::DOUBLE" for ci in range(4)]
    total = "(" + " + ".join(vals) + ")"
    cols = ", ".join(f"{vals[ci]} / {total} AS p_{c}" for ci, c in enumerate(K.CLASSES))
    pred = pick(K.CLASSES, k)
    return f"(SELECT id, source, url, {pred} AS model_pred, {cols} FROM {src})"


def override_rules_sql() -> str:
    fixed = {1: K.WHITELIST_PROBS, 3: K.TYPOSQUAT_PROBS, 4: K.HOMOGRAPH_PROBS}
    finals = []
    for c in K.CLASSES:
        cases = " ".join(f"WHEN {k} THEN {probs[c]}" for k, probs in fixed.items())
        finals.append(f"round((CASE ocase {cases} ELSE p_{c} END)::DOUBLE, {ROUND}) AS final_{c}")
    return f"""WITH typed AS {typed_urls_sql()},
    scored AS {url_model_probs_sql('typed')},
    src AS (SELECT *, CASE WHEN regexp_matches(url, '^https?://') THEN url ELSE 'https://' || url END AS url2 FROM scored),
    {url_parts_ctes('src', 'url2', clean=False)},
    dsrc AS (SELECT dom AS domain FROM parts),
    {pattern_verdict_ctes('dsrc')},
    cased AS (
      SELECT p.*, v.typo_brand,
        CASE WHEN list_contains({lst(K.LEGITIMATE_DOMAINS)}, lower(p.dom || '.' || p.sfx)) THEN 1
             WHEN p.model_pred = 'phishing' AND p.p_phishing > {K.MODEL_CONFIDENT_THRESHOLD} THEN 2
             WHEN v.typo_flag AND v.typo_confidence > {K.TYPOSQUAT_ACCEPT} THEN 3
             WHEN v.homograph THEN 4
             ELSE 6 END AS ocase
      FROM parts p LEFT JOIN verdict v ON v.domain = p.dom)
    SELECT id, source, url, model_pred,
      {', '.join(f'round(p_{c}, {ROUND}) AS p_{c}' for c in K.CLASSES)},
      CASE WHEN ocase = 1 THEN 'benign' WHEN ocase IN (3, 4) THEN 'phishing' ELSE model_pred END AS final_pred,
      {', '.join(finals)},
      CASE ocase WHEN 1 THEN 'whitelist_match' WHEN 2 THEN 'model_confident' WHEN 3 THEN 'typosquatting_' || typo_brand
                 WHEN 4 THEN 'homograph_attack' ELSE 'model_decision' END AS reason,
      ocase <> 6 AS heuristic_applied
    FROM cased"""


def event_urls_sql() -> str:
    """Events as URL rows: page ``event_id`` modulo the number of pages."""
    return """(SELECT e.event_id AS id, 'event' AS source, p.url
      FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages))"""


def ensemble_verdicts_sql(src: str) -> str:
    """Three models' key-arithmetic probabilities, each overridden, then voted."""
    models, votes = ["xgb", "lgb", "rf"], K.VOTE_WEIGHTS
    probs, preds = [], []
    for mi, m in enumerate(models):
        k = f"(id * 7 + length(source) + {5 * mi})"
        vals = [f"(({k} * {7 + ci} + {11 * ci}) % 97 + 1 + CASE WHEN {k} % 4 = {ci} THEN 300 ELSE 0 END)::DOUBLE" for ci in range(4)]
        total = "(" + " + ".join(vals) + ")"
        probs += [f"{vals[ci]} / {total} AS r_{m}_{c}" for ci, c in enumerate(K.CLASSES)]
        top = "greatest(" + ", ".join(f"r_{m}_{c}" for c in K.CLASSES) + ")"
        whens = " ".join(f"WHEN r_{m}_{c} = {top} THEN {q(c)}" for c in K.CLASSES)
        preds.append(f"CASE {whens} END AS own_{m}")
    fixed = {1: K.WHITELIST_PROBS, 3: K.TYPOSQUAT_PROBS, 4: K.HOMOGRAPH_PROBS}
    cases, finals = [], []
    for m in models:
        cases.append(f"""CASE WHEN list_contains({lst(K.LEGITIMATE_DOMAINS)}, lower(p.dom || '.' || p.sfx)) THEN 1
             WHEN own_{m} = 'phishing' AND r_{m}_phishing > {K.MODEL_CONFIDENT_THRESHOLD} THEN 2
             WHEN v.typo_flag AND v.typo_confidence > {K.TYPOSQUAT_ACCEPT} THEN 3
             WHEN v.homograph THEN 4 ELSE 6 END AS case_{m}""")
        finals.append(f"CASE WHEN case_{m} = 1 THEN 'benign' WHEN case_{m} IN (3, 4) THEN 'phishing' ELSE own_{m} END AS {m}_pred")
        finals.append(f"""CASE case_{m} WHEN 1 THEN 'whitelist_match' WHEN 2 THEN 'model_confident'
             WHEN 3 THEN 'typosquatting_' || typo_brand WHEN 4 THEN 'homograph_attack' ELSE 'model_decision' END AS {m}_reason""")
        for c in K.CLASSES:
            whens = " ".join(f"WHEN {k} THEN {given[c]}" for k, given in fixed.items())
            finals.append(f"(CASE case_{m} {whens} ELSE r_{m}_{c} END)::DOUBLE AS {m}_{c}")
    vote = {c: " + ".join(f"{votes[m]}::DOUBLE * {m}_{c}" for m in ("xgb", "rf", "lgb")) for c in K.CLASSES}
    top = "greatest(" + ", ".join(f"v_{c}" for c in K.CLASSES) + ")"
    category = "CASE " + " ".join(f"WHEN v_{c} = {top} THEN {q(c)}" for c in K.CLASSES) + " END"
    reasons = ", ".join(f"{m}_reason" for m in models)
    return f"""WITH urls AS {src},
    given AS (SELECT id, source, url, {', '.join(probs)} FROM urls),
    src AS (SELECT *, {', '.join(preds)},
              CASE WHEN regexp_matches(url, '^https?://') THEN url ELSE 'https://' || url END AS url2 FROM given),
    {url_parts_ctes('src', 'url2', clean=False)},
    dsrc AS (SELECT dom AS domain FROM parts),
    {pattern_verdict_ctes('dsrc')},
    cased AS (SELECT p.*, v.typo_brand, {', '.join(cases)} FROM parts p LEFT JOIN verdict v ON v.domain = p.dom),
    done AS (SELECT id, source, url, {', '.join(finals)} FROM cased),
    voted AS (SELECT *, {', '.join(f'{e} AS v_{c}' for c, e in vote.items())} FROM done)
    SELECT id, source, url, {category} <> 'benign' AS threat_detected, {category} AS category,
      round({top}, 4) AS confidence,
      array_to_string(list_transform(list_filter([{reasons}], lambda r, i: r <> 'model_decision'
          AND list_position([{reasons}], r) = i), lambda r: r), ',') AS reasons,
      {', '.join(f'round(v_{c}, 4) AS prob_{c}' for c in K.CLASSES)},
      {', '.join(f'{m}_pred, {m}_reason' for m in models)},
      {', '.join('round(greatest(' + ', '.join(f'{m}_{c}' for c in K.CLASSES) + f'), {ROUND}) AS {m}_confidence' for m in models)}
    FROM voted"""


# ------------------------------------------------------------ rules, pages

def hostname_expr(x: str) -> str:
    """Browser hostname (lower-cased), the raw string when it does not parse."""
    auth = f"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\\\]*)', 1)"
    host = f"regexp_extract(regexp_replace({auth}, '^.*@', ''), '^(\\[[^\\]]*\\]|[^:]*)', 1)"
    return (
        f"(CASE WHEN regexp_matches({x}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\\\]') AND {host} <> '' "
        f"THEN lower({host}) ELSE {x} END)"
    )


def threat_type_sql(reason: str) -> str:
    r = f"lower({reason})"
    whens = " ".join(f"WHEN contains({r}, {q(w)}) THEN {q(label)}" for w, label in K.THREAT_TYPES)
    return f"(CASE {whens} ELSE {q(K.DEFAULT_THREAT_TYPE)} END)"


def risk_sql(url: str, host: str) -> str:
    terms = [
        (f"regexp_matches({url}, '[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}')", 0.3),
        (f"regexp_matches({url}, '(?i)\\.({'|'.join(K.RISK_TLDS)})$')", 0.3),
        (f"contains({url}, '@')", 0.4),
        (f"{nsub(host, '.')} > 3", 0.2),
        (f"regexp_matches({host}, '(?i)({'|'.join(K.RISK_HOST_WORDS)})')", 0.2),
        (f"length({url}) > 100", 0.15),
        (f"starts_with({url}, 'http://') AND NOT starts_with({url}, 'http://localhost')", 0.1),
    ]
    s = "0.0::DOUBLE"
    for cond, w in terms:
        s = f"({s} + CASE WHEN {cond} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END)"
    return f"least({s}, 1.0::DOUBLE)"


def risk_navigation_sql() -> str:
    host_of_slash = "coalesce(string_split(url, '/')[3], '')"
    return f"""WITH typed AS {typed_urls_sql()},
    nav AS (SELECT id, source, url, CASE WHEN id % 5 = 4 THEN 'image' ELSE 'main_frame' END AS resource_type FROM typed),
    th AS (SELECT DISTINCT {hostname_expr('url')} AS threat FROM pages WHERE page_id % 10 = 0),
    x AS (SELECT n.*, {hostname_expr('n.url')} AS host FROM nav n),
    y AS (SELECT x.*, EXISTS (SELECT 1 FROM th WHERE th.threat IS NOT NULL AND th.threat <> ''
                               AND (contains(x.url, th.threat) OR contains(x.host, th.threat))) AS known_threat FROM x),
    z AS (SELECT y.*, {risk_sql('url', 'host')} AS risk FROM y),
    d AS (SELECT z.*,
        CASE WHEN resource_type <> 'main_frame' THEN 'allow' WHEN known_threat THEN 'block'
             WHEN risk > {K.BLOCK_SCORE_THRESHOLD} THEN 'block' ELSE 'scan' END AS action,
        CASE WHEN resource_type <> 'main_frame' THEN NULL WHEN known_threat THEN 'This URL is in our threat database'
             WHEN risk > {K.BLOCK_SCORE_THRESHOLD} THEN 'URL contains suspicious patterns' END AS reason
      FROM z)
    SELECT id, source, url, resource_type, round(risk, {ROUND}) AS risk, known_threat, action, reason,
      CASE WHEN action = 'block' THEN {threat_type_sql('reason')} END AS threat_type,
      list_filter([CASE WHEN {contains_any(host_of_slash, K.BANKING_WORDS)} THEN 'banking' END,
                   CASE WHEN {contains_any(host_of_slash, K.CRYPTO_WORDS)} THEN 'crypto' END], lambda c: c IS NOT NULL)
        AS scam_categories
    FROM d"""


def band_sql(p: str) -> str:
    return f"(CASE WHEN {p} > {K.HIGH_BAND} THEN 'HIGH' WHEN {p} > {K.MEDIUM_BAND} THEN 'MEDIUM' ELSE 'LOW' END)"


def route_sql(band: str) -> str:
    whens = " ".join(f"WHEN {q(b)} THEN {q(a)}" for b, a in K.BAND_ACTIONS.items())
    return f"(CASE {band} {whens} END)"


def model_gate_sql() -> str:
    conf = "greatest(" + ", ".join(f"p_{c}" for c in K.CLASSES) + ")"
    return f"""WITH typed AS {typed_urls_sql()},
    s AS {url_model_probs_sql('typed')},
    g AS (SELECT *, {conf} AS conf,
            CASE WHEN model_pred = 'phishing' AND {conf} > {K.MODEL_BLOCK_THRESHOLD} THEN 'block' ELSE 'safe' END AS gate
          FROM s),
    r AS (SELECT *, CASE WHEN gate = 'block' THEN 'ML model detected phishing (' || round(conf * 100, 0)::BIGINT::VARCHAR
                  || '% confidence)' END AS reason FROM g)
    SELECT id, source, url, model_pred, round(conf, {ROUND}) AS confidence, gate, reason,
      CASE WHEN gate = 'block' THEN {threat_type_sql('reason')} END AS threat_type,
      {band_sql('conf')} AS band, {route_sql(band_sql('conf'))} AS route
    FROM r"""


def page_scans_sql() -> str:
    from hookline.plans.derived import PAGE_TAGS

    origin = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
    scheme = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1)"
    resolve = (
        f"CASE WHEN a IS NULL OR trim(a) = '' THEN url "
        f"WHEN regexp_matches(a, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN a "
        f"WHEN starts_with(a, '//') THEN {scheme} || a "
        f"WHEN starts_with(a, '/') THEN {origin} || a ELSE {origin} || '/' || a END"
    )
    return f"""WITH pg AS (SELECT page_id, url, html || {pick(PAGE_TAGS, 'page_id')} AS html FROM pages),
    tags AS (SELECT *, list_transform(string_split(html, '<'), lambda t: string_split(t, '>')[1]) AS tags FROM pg),
    f AS (SELECT *, list_filter(tags, lambda t: regexp_matches(t, '^(?i:form)([^a-zA-Z0-9_]|$)')) AS forms,
                 list_filter(list_transform(list_filter(tags, lambda t: regexp_matches(t, '^(?i:script)([^a-zA-Z0-9_]|$)')),
                     lambda t: regexp_extract(t, '(?i)[^a-zA-Z0-9_]src\\s*=\\s*["'']([^"'']+)["'']', 1)), lambda x: x <> '') AS srcs,
                 len(list_filter(tags, lambda t: regexp_matches(t, '^(?i:input)([^a-zA-Z0-9_]|$)')
                     AND regexp_matches(t, '(?i)[^a-zA-Z0-9_]type\\s*=\\s*["'']?password([^a-zA-Z0-9_]|$)')))::INTEGER AS n_pw,
                 {hostname_expr('url')} AS host
          FROM tags),
    a AS (SELECT *, list_transform(forms, lambda fm: nullif(regexp_extract(fm, '(?i)[^a-zA-Z0-9_]action\\s*=\\s*["'']([^"'']*)["'']', 1), '')) AS raw_actions FROM f)
    SELECT page_id, url, len(forms)::INTEGER AS n_forms, len(srcs)::INTEGER AS n_external_scripts,
      n_pw AS n_password_fields,
      list_filter(list_transform(raw_actions, lambda a: {resolve}),
                  lambda x: starts_with(x, 'http://') AND NOT contains(x, 'localhost')) AS insecure_forms,
      (n_pw > 0 AND NOT {contains_any('host', K.TRUSTED_PASSWORD_HOSTS)}) AS password_on_untrusted,
      list_filter(srcs, lambda s: {contains_any('s', K.MINER_HOSTS)}) AS miner_scripts
    FROM a"""


def xss_params_sql() -> str:
    pat = "(?i)(" + "|".join(K.XSS_PATTERNS) + ")"

    def dec(x: str) -> str:
        return f"url_decode(replace({x}, '+', ' '))"

    return f"""WITH src AS {typed_urls_sql()},
    {url_parts_ctes('src', 'url', clean=False)},
    pr AS (SELECT id, source, url, list_transform(list_filter(string_split(query, '&'), lambda p: p <> ''),
             lambda p: {{'key': {dec("split_part(p, '=', 1)")},
                         'value': {dec("CASE WHEN contains(p, '=') THEN regexp_extract(p, '^[^=]*=(.*)$', 1) ELSE '' END")}}})
             AS pairs
           FROM parts)
    SELECT id, source, url, len(pairs)::INTEGER AS n_params,
      list_transform(list_filter(pairs, lambda x: regexp_matches(x.value, {q(pat)})), lambda x: x.key) AS xss_keys
    FROM pr"""


# --------------------------------------------------------- scoring, metrics

def vote_cols_sql(src: str) -> str:
    w = K.VOTE_WEIGHTS
    v = {c: f"({w['xgb']}::DOUBLE * xgb_{c} + {w['rf']}::DOUBLE * rf_{c} + {w['lgb']}::DOUBLE * lgb_{c})" for c in K.CLASSES}
    m = "greatest(" + ", ".join(v.values()) + ")"
    pred = "CASE " + " ".join(f"WHEN {v[c]} = {m} THEN {q(c)}" for c in K.CLASSES) + " END"
    cols = ", ".join(f"round({v[c]}, 4) AS vote_{c}" for c in K.CLASSES)
    return f"(SELECT *, {pred} AS vote_pred, round({m}, 4) AS vote_confidence, {cols} FROM {src})"


def soft_vote_sql() -> str:
    return f"""WITH g AS {given_probs_sql()}, v AS {vote_cols_sql('g')}
    SELECT id, label, vote_pred, vote_confidence, {', '.join(f'vote_{c}' for c in K.CLASSES)},
      vote_pred <> 'benign' AS threat_detected, {band_sql('vote_confidence')} AS band,
      {route_sql(band_sql('vote_confidence'))} AS route
    FROM v"""


def meta_features_sql() -> str:
    models = ["xgb", "lgb", "rf"]
    mean = {c: f"((xgb_{c} + lgb_{c} + rf_{c}) / 3.0)" for c in K.CLASSES}
    std = {
        c: "sqrt((" + " + ".join(f"({m}_{c} - {mean[c]}) * ({m}_{c} - {mean[c]})" for m in models) + ") / 3.0)"
        for c in K.CLASSES
    }
    allp = ", ".join(f"{m}_{c}" for m in models for c in K.CLASSES)

    def top(m):
        mx = "greatest(" + ", ".join(f"{m}_{c}" for c in K.CLASSES) + ")"
        return "CASE " + " ".join(f"WHEN {m}_{c} = {mx} THEN {i}" for i, c in enumerate(K.CLASSES)) + " END"

    counts = [" + ".join(f"(CASE WHEN {top(m)} = {i} THEN 1 ELSE 0 END)" for m in models) for i in range(4)]
    agreement = "greatest(" + ", ".join(f"({c})" for c in counts) + ") / 3.0"
    ent = "-(" + " + ".join(f"{mean[c]} * ln({mean[c]} + 1e-10)" for c in K.CLASSES) + ")"
    srt = "list_sort([" + ", ".join(mean.values()) + "])"
    cols = [f"round({m}_{c}, {ROUND}) AS {m}_{c}" for m in models for c in K.CLASSES]
    cols += [f"round({mean[c]}, {ROUND}) AS mean_{c}" for c in K.CLASSES]
    cols += [f"round({std[c]}, {ROUND}) AS std_{c}" for c in K.CLASSES]
    cols += [
        f"round(greatest({allp}), {ROUND}) AS max_prob", f"round(least({allp}), {ROUND}) AS min_prob",
        f"round({agreement}, {ROUND}) AS agreement", f"round({ent}, {ROUND}) AS entropy",
        f"round({srt}[4] - {srt}[3], {ROUND}) AS margin",
    ]
    return f"SELECT id, label, {', '.join(cols)} FROM {given_probs_sql()}"


def preds_sql() -> str:
    return f"(SELECT id, label, vote_pred AS pred, vote_confidence AS confidence, {', '.join(f'vote_{c}' for c in K.CLASSES)} FROM {vote_cols_sql(given_probs_sql())})"


def classes_sql() -> str:
    return "(SELECT * FROM (VALUES " + ", ".join(f"({i}, {q(c)})" for i, c in enumerate(K.CLASSES)) + ") t(class_ord, class))"


def classification_report_sql() -> str:
    return f"""WITH p AS {preds_sql()},
    per AS (
      SELECT c.class_ord, c.class,
        (SELECT count(*) FROM p WHERE label = c.class) AS support,
        (SELECT count(*) FROM p WHERE pred = c.class) AS n_pred,
        (SELECT count(*) FROM p WHERE pred = c.class AND label = c.class) AS tp
      FROM {classes_sql()} c),
    m AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
                    CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM per),
    f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m),
    t AS (SELECT sum(support) AS n, sum(tp) AS correct, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
                 sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr,
                 sum(f1 * support) / sum(support) AS wf FROM f)
    SELECT class_ord, class, round(precision, {ROUND}) AS precision, round(recall, {ROUND}) AS recall,
           round(f1, {ROUND}) AS f1, support::BIGINT AS support FROM f
    UNION ALL SELECT 4, 'accuracy', round(correct / n, {ROUND}), round(correct / n, {ROUND}), round(correct / n, {ROUND}), n::BIGINT FROM t
    UNION ALL SELECT 5, 'macro avg', round(mp, {ROUND}), round(mr, {ROUND}), round(mf, {ROUND}), n::BIGINT FROM t
    UNION ALL SELECT 6, 'weighted avg', round(wp, {ROUND}), round(wr, {ROUND}), round(wf, {ROUND}), n::BIGINT FROM t"""


def confusion_matrix_sql() -> str:
    cols = ", ".join(f"count(p.id) FILTER (WHERE p.pred = {q(c)})::BIGINT AS {c}" for c in K.CLASSES)
    return f"""WITH p AS {preds_sql()}
    SELECT c.class_ord, c.class AS true_class, {cols}
    FROM {classes_sql()} c LEFT JOIN p ON p.label = c.class GROUP BY c.class_ord, c.class"""


def confidence_distribution_sql() -> str:
    return f"""WITH p AS {preds_sql()},
    b AS (SELECT * FROM (VALUES (0, 'HIGH'), (1, 'MEDIUM'), (2, 'LOW')) t(band_ord, band)),
    c AS (SELECT {band_sql('confidence')} AS band, count(*) AS n FROM p GROUP BY 1)
    SELECT band_ord, b.band, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / (SELECT count(*) FROM p), {ROUND}) AS share
    FROM b LEFT JOIN c ON c.band = b.band"""


def error_summary_sql() -> str:
    return f"""WITH p AS {preds_sql()},
    e AS (SELECT * FROM p WHERE label <> pred ORDER BY id LIMIT 5)
    SELECT count(*)::BIGINT AS n, sum(CASE WHEN label <> pred THEN 1 ELSE 0 END)::BIGINT AS misclassified,
      sum(CASE WHEN label = pred AND confidence < {K.MEDIUM_BAND} THEN 1 ELSE 0 END)::BIGINT AS low_confidence_correct,
      sum(CASE WHEN label = 'benign' AND pred <> 'benign' THEN 1 ELSE 0 END)::BIGINT AS false_positives,
      sum(CASE WHEN label <> 'benign' AND pred = 'benign' THEN 1 ELSE 0 END)::BIGINT AS false_negatives,
      round(sum(CASE WHEN label <> pred THEN 1 ELSE 0 END) / count(*), {ROUND}) AS misclassified_share,
      (SELECT list({{'key': id, 'true': label, 'pred': pred, 'confidence': confidence,
              'probabilities': [{', '.join(f'vote_{c}' for c in K.CLASSES)}]}} ORDER BY id) FROM e) AS first_errors
    FROM p"""


def prediction_table_sql() -> str:
    return f"""SELECT p.id, o.url, label, pred, confidence, {band_sql('confidence')} AS band, label = pred AS correct
    FROM {preds_sql()} p JOIN ({odd_urls_sql()}) o ON o.id = p.id"""


def corpus_file_sql() -> str:
    return f"SELECT url, type FROM {typed_urls_sql()} WHERE url <> ''"


def ranked_file_sql() -> str:
    return f"SELECT rank, domain FROM {ranked_domains_sql()} WHERE rank <= 500"


def threat_file_sql() -> str:
    return f"SELECT DISTINCT {hostname_expr('url')} AS threat FROM pages WHERE page_id % 10 = 0"


def aligned_records_sql() -> str:
    return f"""SELECT id, length(url)::INTEGER AS url_length, 0 AS missing_feature, {nsub('url', '.')}::INTEGER AS num_dots
    FROM {typed_urls_sql()} WHERE url <> ''"""


def stacked_corpus_sql() -> str:
    return f"""SELECT id, source, url FROM {typed_urls_sql()} WHERE source = 'legit'
    UNION ALL SELECT id, source, url FROM {typed_urls_sql()} WHERE source = 'odd'"""


def weighted_roc_auc_sql() -> str:
    unions = " UNION ALL ".join(f"SELECT {q(c)} AS cls, vote_{c} AS score, label = {q(c)} AS pos FROM p" for c in K.CLASSES)
    return f"""WITH p AS {preds_sql()},
    x AS ({unions}),
    r AS (SELECT cls, pos, rank() OVER (PARTITION BY cls ORDER BY score) + (count(*) OVER (PARTITION BY cls, score) - 1) / 2.0 AS rk FROM x),
    a AS (SELECT cls, sum(CASE WHEN pos THEN 1 ELSE 0 END) AS P, sum(CASE WHEN pos THEN 0 ELSE 1 END) AS N,
                 sum(CASE WHEN pos THEN rk ELSE 0 END) AS rsum FROM r GROUP BY cls),
    u AS (SELECT cls, P, CASE WHEN P > 0 AND N > 0 THEN (rsum - P * (P + 1) / 2.0) / (P * N) END AS auc FROM a)
    SELECT cls, round(auc, {ROUND}) AS auc, P::BIGINT AS support FROM u
    UNION ALL SELECT 'weighted', round(sum(auc * P) / sum(CASE WHEN auc IS NOT NULL THEN P END), {ROUND}), NULL FROM u"""


def model_comparison_sql() -> str:
    def pred_of(m):
        mx = "greatest(" + ", ".join(f"{m}_{c}" for c in K.CLASSES) + ")"
        return "CASE " + " ".join(f"WHEN {m}_{c} = {mx} THEN {q(c)}" for c in K.CLASSES) + " END"

    parts = " UNION ALL ".join(
        f"SELECT {q(m)} AS model, avg(CASE WHEN {pred_of(m)} = label THEN 1.0 ELSE 0.0 END) AS accuracy FROM v"
        for m in ["xgb", "lgb", "rf"]
    )
    return f"""WITH v AS {vote_cols_sql(given_probs_sql())},
    acc AS ({parts} UNION ALL SELECT 'vote', avg(CASE WHEN vote_pred = label THEN 1.0 ELSE 0.0 END) FROM v)
    SELECT model, round(accuracy, {ROUND}) AS accuracy,
      round(accuracy - (SELECT max(accuracy) FROM acc WHERE model <> 'vote'), {ROUND}) AS improvement_over_best_base
    FROM acc"""


# ------------------------------------------------------ corpus and statistics

def keyed_sql() -> str:
    return f"(SELECT *, source || ':' || id::VARCHAR AS key FROM {typed_urls_sql()})"


def stratified_split_sql() -> str:
    return f"""WITH t AS {keyed_sql()},
    r AS (SELECT key, type,
            row_number() OVER (PARTITION BY type ORDER BY md5('42|' || key), key) AS cls_rank,
            count(*) OVER (PARTITION BY type) AS cls_n FROM t),
    s AS (SELECT *, floor(cls_n * 0.8 + 1e-9) AS n_train FROM r),
    v AS (SELECT *, floor((cls_n - n_train) * (0.1 / (1 - 0.8)) + 1e-9) AS n_valid FROM s)
    SELECT key, type, cls_rank::BIGINT AS cls_rank, cls_n::BIGINT AS cls_n,
      CASE WHEN cls_rank <= n_train THEN 'train' WHEN cls_rank <= n_train + n_valid THEN 'valid' ELSE 'test' END AS split,
      ((cls_rank - 1) % 5)::INTEGER AS fold, ceil(cls_rank * 10 / cls_n)::INTEGER AS step
    FROM v"""


def shuffle_sql() -> str:
    return f"""SELECT key, url, row_number() OVER (ORDER BY md5('42|' || key)) - 1 AS position FROM {keyed_sql()}"""


def class_stats_inner(src: str) -> str:
    return f"""(SELECT c.class_ord, c.class, coalesce(n.n, 0)::BIGINT AS count,
        coalesce(n.n, 0) / (SELECT count(*) FROM {src}) AS share,
        CASE WHEN n.n > 0 THEN (SELECT count(*) FROM {src}) / ({len(K.CLASSES)} * n.n) END AS weight
      FROM {classes_sql()} c LEFT JOIN (SELECT trim(lower(type)) AS class, count(*) AS n FROM {src} GROUP BY 1) n
      ON n.class = c.class)"""


def class_stats_sql() -> str:
    return f"""WITH t AS {typed_urls_sql()}
    SELECT class_ord, class, count, round(share, {ROUND}) AS share, round(weight, {ROUND}) AS weight FROM {class_stats_inner('t')}"""


def sample_weights_sql() -> str:
    return f"""WITH t AS {keyed_sql()}, w AS {class_stats_inner('t')}
    SELECT t.key, t.type, round(w.weight, {ROUND}) AS weight FROM t LEFT JOIN w ON w.class = trim(lower(t.type))"""


def mini_js_src() -> str:
    return f"({mini11_js_sql()})"


def median_fill_sql() -> str:
    meds = ", ".join(f"median({c}::DOUBLE) AS m_{c}" for c in MINI11_FEATURES)
    cols = ", ".join(f"round(coalesce({c}::DOUBLE, m_{c}), {ROUND}) AS {c}" for c in MINI11_FEATURES)
    return f"""WITH f AS {mini_js_src()}, m AS (SELECT {meds} FROM f)
    SELECT id, source, {cols} FROM f, m"""


STD_COLS = ["url_length", "num_dots", "domain_length", "path_length", "url_entropy"]


def standardise_sql() -> str:
    def whole(x: str) -> str:
        return f"sum(CAST({x} AS DECIMAL(38,15)))::DOUBLE"

    means = ", ".join(f"{whole(c)} / count({c}) AS mu_{c}" for c in STD_COLS)
    stats = ", ".join(
        f"any_value(mu_{c}) AS mu_{c}, sqrt({whole(f'pow({c} - mu_{c}, 2)')} / count({c})) AS sd_{c}" for c in STD_COLS)
    cols = ", ".join(
        f"round(({c} - mu_{c}) / CASE WHEN sd_{c} = 0 OR sd_{c} IS NULL THEN 1.0 ELSE sd_{c} END, {ROUND}) AS {c}"
        for c in STD_COLS
    )
    return f"""WITH f AS ({url_features_sql()}), m AS (SELECT {means} FROM f), s AS (SELECT {stats} FROM f, m)
    SELECT id, source, {cols} FROM f, s"""


def profile_columns_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT {q(c)} AS column, count(*)::BIGINT AS rows, count(*) FILTER (WHERE {c} IS NULL)::BIGINT AS nulls, "
        f"count(DISTINCT {c})::BIGINT AS distinct, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM f"
        for c in MINI11_FEATURES
    )
    return f"WITH f AS {mini_js_src()} {parts}"


def dataset_summary_sql() -> str:
    return f"""WITH t AS {typed_urls_sql()}, d AS (SELECT type, count(*) AS n FROM t GROUP BY type)
    SELECT (SELECT count(*) FROM t) AS rows,
      (SELECT list({{'class': type, 'n': n}} ORDER BY type) FROM d) AS distribution,
      {len(MAIN_NATIVE_FEATURES)} AS n_features"""


def ranked_domains_sql() -> str:
    k = "c_custkey"
    look = f"replace({pick(K.SYNTH_PATTERNS, k)}, '{{brand}}', {pick(K.BRAND_KEYWORDS, k)}) || {pick(K.SYNTH_TLDS, k)}"
    return f"(SELECT {k}::INTEGER AS rank, CASE WHEN {k} % 2 = 0 THEN {pick(K.LEGITIMATE_DOMAINS, k)} ELSE {look} END AS domain FROM customer)"


def ranked_urls_sql() -> str:
    lo, hi = K.RANK_SLICE
    return f"""SELECT rank, 'https://www.' || domain AS url, 'benign' AS type FROM {ranked_domains_sql()}
    WHERE rank <= {K.RANK_HEAD} OR rank BETWEEN {lo} AND {hi}"""


def coverage_check_sql() -> str:
    sites = ", ".join(f"({q(c)}, {q(s)})" for c, ss in K.COVERAGE_SITES for s in ss)
    return f"""WITH s AS (SELECT * FROM (VALUES {sites}) t(category, site)), r AS {ranked_domains_sql()}
    SELECT category, site, count(r.domain) > 0 AS found, min(r.rank) AS rank
    FROM s LEFT JOIN r ON r.domain = s.site GROUP BY category, site"""


def merged_sample_sql() -> str:
    return f"""WITH m AS (SELECT type, url FROM {typed_urls_sql()}
                  UNION ALL SELECT 'benign' AS type, 'https://www.' || domain AS url FROM {ranked_domains_sql()})
    SELECT type, url FROM m ORDER BY md5('42|' || url), url LIMIT 5000"""


def uh(seed: int, *parts: str) -> str:
    """Hash draw in [0, 1): first 32 bits of md5(seed|parts)."""
    inner = " || '|' || ".join([q(str(seed))] + [f"({p})::VARCHAR" for p in parts])
    return f"(('0x' || substr(md5({inner}), 1, 8))::BIGINT::DOUBLE / 4294967296.0)"


def upick(values, h: str) -> str:
    return f"({lst(values)})[floor({h} * {len(values)})::BIGINT + 1]"


def token(key: str, n: int) -> str:
    size = len(K.TOKEN_ALPHABET)
    return "(" + " || ".join(
        f"substr('{K.TOKEN_ALPHABET}', ('0x' || substr(md5('t|' || ({key})), {2 * i + 1}, 2))::INTEGER % {size} + 1, 1)"
        for i in range(n)) + ")"


def make_url_sql(host: str, tld: str, sub: str | None, path: str, query: str, h: str) -> str:
    scheme = f"(CASE WHEN {h} < {K.SYNTH_HTTPS_SHARE} THEN 'https://' ELSE 'http://' END)"
    full = f"({host} || {tld})" if sub is None else f"(CASE WHEN {sub} IS NULL THEN {host} || {tld} ELSE {sub} || '.' || {host} || {tld} END)"
    return f"{scheme} || {full} || {path} || {query}"


def random_path_sql(key: str, seed: int) -> str:
    w = K.SYNTH_PATH_DEPTH_WEIGHTS
    d = uh(seed, key)
    depth = f"(CASE WHEN {d} < {w[0]!r} THEN 0 WHEN {d} < {w[0] + w[1]!r} THEN 1 WHEN {d} < {w[0] + w[1] + w[2]!r} THEN 2 ELSE 3 END)"
    words = K.SYNTH_PATH_WORDS + ["<token>"]

    def part(j: int) -> str:
        wj = upick(words, uh(seed + 1, key, str(j)))
        return f"(CASE WHEN {wj} = '<token>' THEN {token(f'({key}) || {q(str(j))}', 6)} ELSE {wj} END)"

    segs = f"[{part(1)}, {part(2)}, {part(3)}]"
    return f"(CASE WHEN {depth} = 0 THEN '' ELSE '/' || array_to_string(list_slice({segs}, 1, {depth}), '/') END)"


def random_query_sql(key: str, seed: int) -> str:
    k = upick(K.SYNTH_QUERY_KEYS, uh(seed + 1, key))
    return f"(CASE WHEN {uh(seed, key)} < {K.SYNTH_QUERY_SHARE} THEN '?' || {k} || '=' || {token(key, 6)} ELSE '' END)"


def synthetic_corpus_sql(seed: int = 42) -> str:
    brands = f"(SELECT DISTINCT {pick(K.SYNTH_BRANDS, 'c_custkey')} AS brand FROM customer)"
    pats = ", ".join(f"({i}, {q(p)})" for i, p in enumerate(K.SYNTH_PATTERNS))
    tlds = ", ".join(f"({i}, {q(t)})" for i, t in enumerate(K.SYNTH_TLDS))
    key1 = "brand || '|' || pat_ord::VARCHAR || '|' || tld_ord::VARCHAR || '|' || shape::VARCHAR"
    h1 = uh(seed, "key")
    sub1 = f"CASE WHEN shape = 1 THEN {upick(K.SYNTH_SUBS, uh(seed + 1, 'key'))} END"
    path1 = f"CASE WHEN shape = 2 THEN '/' || {upick(['login', 'secure', 'account'], uh(seed + 2, 'key'))} || '/' || {token('key', 5)} ELSE '' END"
    qtok = token("key || 'q'", 6)
    query1 = f"CASE WHEN shape = 2 AND {uh(seed + 3, 'key')} < 0.3 THEN '?ref=' || {qtok} ELSE '' END"
    key2 = "brand || '|' || n::VARCHAR"
    sub2 = upick(K.SYNTH_SUBS + ["<none>"], uh(seed + 1, "key"))
    path2 = f"'/' || {upick(K.SYNTH_BRAND_PATH_WORDS, uh(seed + 2, 'key'))} || '/' || {token('key', 5)}"
    lo = "[10, 1000, 10000][n + 1]"
    hi = "[999, 9999, 99999][n + 1]"
    num = f"({lo} + floor({uh(seed, 'key')} * ({hi} - {lo} + 1)))::BIGINT::VARCHAR"
    return f"""WITH b AS {brands},
    p AS (SELECT * FROM (VALUES {pats}) t(pat_ord, pat)),
    tl AS (SELECT * FROM (VALUES {tlds}) t(tld_ord, tld)),
    h1 AS (SELECT brand, replace(pat, '{{brand}}', brand) AS host, tld, {key1} AS key, shape
           FROM b, p, tl, (SELECT unnest([0, 1, 2]) AS shape)),
    u1 AS (SELECT {make_url_sql('host', 'tld', sub1, path1, query1, h1)} AS url FROM h1),
    h2 AS (SELECT brand, {key2} AS key FROM b, (SELECT unnest(range(1, 9)) AS n)),
    u2 AS (SELECT {make_url_sql('brand', upick(K.SYNTH_TLDS, uh(seed, 'key')), f"CASE WHEN {sub2} <> '<none>' THEN {sub2} END", path2, random_query_sql('key', seed + 3), uh(seed + 4, 'key'))} AS url FROM h2),
    h3 AS (SELECT brand, n, {key2} AS key FROM b, (SELECT unnest([0, 1, 2]) AS n)),
    u3 AS (SELECT {make_url_sql(f"brand || {num}", upick(K.SYNTH_TLDS, uh(seed + 1, 'key')), None, random_path_sql('key', seed + 2), random_query_sql('key', seed + 4), uh(seed + 6, 'key'))} AS url FROM h3)
    SELECT DISTINCT url, 'phishing' AS type, {seed} AS seed FROM (SELECT url FROM u1 UNION ALL SELECT url FROM u2 UNION ALL SELECT url FROM u3)"""


# ---------------------------------------------------------------- streaming

def events_kind_sql() -> str:
    from hookline.streaming.streams import EVENT_KINDS

    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in EVENT_KINDS.items())
    return f"(SELECT *, CASE event_type {whens} END AS kind, ts::DATE AS day FROM events)"


def nav_stats_sql() -> str:
    return f"""SELECT user_id, count(*) FILTER (WHERE kind = 'blocked') AS blocked,
      count(*) FILTER (WHERE kind = 'scanned') AS scanned, count(*) FILTER (WHERE kind = 'safe') AS safe
    FROM {events_kind_sql()} GROUP BY user_id"""


def event_report_sql() -> str:
    return f"SELECT kind, count(*) AS n FROM {events_kind_sql()} GROUP BY kind"


def redirect_alerts_sql() -> str:
    return f"""SELECT user_id, day, event_id, ts, redirect_count::INTEGER AS redirect_count FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS redirect_count
      FROM {events_kind_sql()} WHERE kind = 'redirect') WHERE redirect_count > {K.REDIRECT_ALERT_AFTER}"""


def warning_dwell_sql() -> str:
    return f"""SELECT user_id, event_id, (epoch_us(next_ts) - epoch_us(ts)) // 1000 AS dwell_ms FROM (
      SELECT *, lead(ts) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS next_ts FROM {events_kind_sql()})
    WHERE kind = 'blocked' AND next_ts IS NOT NULL"""


def feedback_count_sql() -> str:
    cls = lst(K.CLASSES)
    return f"""WITH e AS (SELECT * FROM {events_kind_sql()} WHERE kind = 'feedback'),
    f AS (SELECT e.event_id, p.url, ({cls})[e.event_id % 4 + 1] AS user_label,
                 CASE WHEN e.event_id % 5 <> 0 THEN ({cls})[floor(e.event_id / 4)::BIGINT % 4 + 1] END AS model_pred
          FROM e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages))
    SELECT user_label, count(*) AS n, count(*) FILTER (WHERE user_label = model_pred) AS agrees FROM f GROUP BY user_label"""


def navigation_events_sql() -> str:
    return f"""WITH e AS (SELECT k.*, p.url FROM {events_kind_sql()} k
                JOIN pages p ON p.page_id = k.event_id % (SELECT count(*) FROM pages)),
    th AS (SELECT DISTINCT {hostname_expr('url')} AS threat FROM pages WHERE page_id % 10 = 0),
    x AS (SELECT e.*, {hostname_expr('e.url')} AS host,
                 CASE WHEN kind = 'feedback' THEN 'xhr' ELSE 'main_frame' END AS resource_type FROM e),
    y AS (SELECT x.*, EXISTS (SELECT 1 FROM th WHERE th.threat IS NOT NULL AND th.threat <> ''
                               AND (contains(x.url, th.threat) OR contains(x.host, th.threat))) AS known_threat FROM x),
    z AS (SELECT y.*, {risk_sql('url', 'host')} AS risk FROM y)
    SELECT event_id, user_id, url, resource_type, known_threat, round(risk, {ROUND}) AS risk,
      CASE WHEN resource_type <> 'main_frame' THEN 'allow' WHEN known_threat THEN 'block'
           WHEN risk > {K.BLOCK_SCORE_THRESHOLD} THEN 'block' ELSE 'scan' END AS action,
      CASE WHEN resource_type <> 'main_frame' THEN NULL WHEN known_threat THEN 'This URL is in our threat database'
           WHEN risk > {K.BLOCK_SCORE_THRESHOLD} THEN 'URL contains suspicious patterns' END AS reason
    FROM z"""


# ------------------------------------------------------ sources and cleaning

def feature_records_sql() -> str:
    cols = ", ".join(f"coalesce({c}::DOUBLE, 0.0) AS {c}" for c in MINI11_FEATURES)
    return f"SELECT id, source, {cols}, 0.0 AS index FROM ({mini11_js_sql()})"


def tld_one_hot_sql() -> str:
    return f"""WITH src AS {typed_urls_sql()},
    {url_parts_ctes('src')},
    lv AS (SELECT list(DISTINCT sfx ORDER BY sfx) AS levels FROM parts)
    SELECT id, source, sfx AS suffix,
      list_transform(levels[2:], lambda l: CASE WHEN sfx = l THEN 1.0 ELSE 0.0 END) AS suffix_onehot
    FROM parts, lv"""


def phishing_head_sql() -> str:
    return f"""SELECT id, source, url, type AS label FROM {typed_urls_sql()}
    WHERE lower(type) = 'phishing' ORDER BY source, id LIMIT 1000"""


def decoded_features_sql(https_first: bool = False) -> str:
    """DV3 / DV4 in SQL."""
    from hookline.functions.features import (
        DECODED_BRANDS, DECODED_BRANDS_DOMAIN, DECODED_DICTIONARY, DECODED_FEATURES,
    )

    full, host = "fullu", "lower(netloc)"
    lf, ld, lsx = f"lower({full})", "lower(dom)", "lower(sfx)"
    n = f"length({full})"
    letters = f"length(regexp_replace({full}, '[^\\pL]', '', 'g'))"
    nsd = "(CASE WHEN sub = '' THEN 0 ELSE len(string_split(sub, '.')) END)"
    e = {
        "url_length": n,
        "num_dots": nsub(full, "."),
        "num_hyphens": nsub(full, "-"),
        "num_underscores": nsub(full, "_"),
        "num_digits": nchars(full, "0-9"),
        "num_letters": letters,
        "num_special_chars": nchars(full, "@?=%&!+$"),
        "has_ip": flag(f"regexp_matches({host}, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+')"),
        "num_subdomains": nsd,
        "has_multiple_subdomains": flag(f"{nsd} >= 3"),
        "domain_length": "length(dom)",
        "host_entropy": entropy("dom"),
        "domain_entropy": entropy("dom"),
        "domain_has_digits": flag("regexp_matches(dom, '[0-9]')"),
        "domain_digit_ratio": ratio(nchars("dom", "0-9"), "length(dom)"),
        "domain_vowel_ratio": ratio(nchars(ld, "aeiou"), f"(length(regexp_replace({ld}, '[^\\pL]', '', 'g')) - {nchars(ld, 'aeiou')})"),
        "domain_bigram_diversity": ngram_div("dom", 2),
        "domain_trigram_diversity": ngram_div("dom", 3),
        "suspicious_prefix_suffix": flag("contains(dom, '-')"),
        "num_suspicious_symbols": nchars("dom", "@!*"),
        "subdomain_length": "length(sub)",
        "domain_is_dictionary_word": flag(f"list_contains({lst(DECODED_DICTIONARY)}, {ld})"),
        "tld_length": "length(sfx)",
        "tld_trust_category": f"(CASE WHEN list_contains({lst(K.HIGH_TRUST_TLDS)}, {lsx}) THEN 2 "
        f"WHEN list_contains({lst(K.SUSPICIOUS_TLDS_CATEGORY)}, {lsx}) THEN 0 ELSE 1 END)",
        "is_suspicious_tld": flag(f"list_contains({lst(K.SUSPICIOUS_TLDS_CATEGORY)}, {lsx})"),
        "is_high_trust_tld": flag(f"list_contains({lst(K.HIGH_TRUST_TLDS)}, {lsx})"),
        "is_country_tld": flag("regexp_matches(sfx, '^\\pL{2}$')"),
        "path_length": "length(path)",
        "num_path_segments": "len(list_filter(string_split(path, '/'), lambda s: s <> ''))",
        "num_query_params": "(CASE WHEN query = '' THEN 0 ELSE len(string_split(query, '&')) END)",
        "query_length": "length(query)",
        "num_encoded_chars": nsub(full, "%"),
        "num_fragments": nsub(full, "#"),
        "path_entropy": entropy("path"),
        "path_has_suspicious_ext": flag(contains_any("lower(path)", K.SUSPICIOUS_EXTENSIONS)),
        "query_has_redirect": flag(contains_any("lower(query)", K.REDIRECT_WORDS)),
        "path_url_ratio": ratio("length(path)", n),
        "suspicious_word": flag(contains_any(lf, K.SUSPICIOUS_WORDS)),
        "num_suspicious_words": count_present(lf, K.SUSPICIOUS_WORDS),
        "sensitive_word": flag(contains_any(lf, K.SENSITIVE_WORDS)),
        "action_word": flag(contains_any(lf, K.ACTION_WORDS)),
        "has_brand_name": flag(contains_any(lf, DECODED_BRANDS)),
        "brand_not_in_domain": flag(f"{contains_any(lf, DECODED_BRANDS_DOMAIN)} AND NOT {contains_any(ld, DECODED_BRANDS_DOMAIN)}"),
        "is_shortening_service": flag(contains_any(full, K.SHORTENERS)),
        "is_mixed_case": flag(f"regexp_matches({full}, '\\p{{Lu}}') AND regexp_matches({full}, '\\p{{Ll}}')"),
        "num_repeated_chars": longest_run(full),
        "longest_token_length": longest_token(full, "[./?=&_-]"),
        "digit_letter_ratio": ratio(nchars(full, "0-9"), letters),
        "special_char_ratio": ratio(f"length(regexp_replace({full}, '[\\pL\\pN]', '', 'g'))", n),
        "uppercase_ratio": ratio(f"length(regexp_replace({full}, '[^\\p{{Lu}}]', '', 'g'))", n),
        "consecutive_consonants": longest_match(lf, "[bcdfghjklmnpqrstvwxyz]+"),
        "url_entropy": entropy(full),
        "has_port": flag(f"contains({host}, ':') AND NOT starts_with({host}, '[')"),
        "uses_https": flag("scheme = 'https'"),
        "punycode_domain": flag("contains(dom, 'xn--')"),
        "subdomain_count_dot": nsub("sub", "."),
        "domain_url_ratio": ratio("length(dom)", n),
        "query_url_ratio": ratio("length(query)", n),
    }
    cols = ", ".join(
        f"{rnd(e[c]) if c in DOUBLE_FEATURES else '(' + e[c] + ')::INTEGER'} AS {c}" for c in DECODED_FEATURES
    )
    first = "CASE WHEN regexp_matches(url, '^https?://') THEN url ELSE 'https://' || url END" if https_first else "url"
    return f"""WITH src0 AS {typed_urls_sql()},
    src1 AS (SELECT id, source, url AS url_in, {first} AS u1 FROM src0),
    src AS (SELECT id, source, url_in, CASE WHEN regexp_matches(u1, '^[a-zA-Z]+://') THEN u1 ELSE 'http://' || u1 END AS url FROM src1),
    {url_parts_ctes('src', 'url', clean=False)},
    h AS (SELECT *, url_decode(url) AS fullu FROM parts)
    SELECT id, source, url_in AS url, {cols} FROM h"""


def v2_features_sql() -> str:
    from hookline.functions.features import (
        V2_BRANDS, V2_DICTIONARY, V2_FEATURES, V2_HIGH_TRUST, V2_SENSITIVE_WORDS, V2_SUSPICIOUS_CATEGORY,
        V2_SUSPICIOUS_FLAG, V2_SUSPICIOUS_WORDS,
    )

    u = "url"
    lu, ld, lsx = "lower(url)", "lower(dom)", "lower(sfx)"
    n = "length(url)"
    letters = "length(regexp_replace(url, '[^\\pL]', '', 'g'))"
    nsd = "(CASE WHEN sub = '' THEN 0 ELSE len(string_split(sub, '.')) END)"
    e = {
        "url_length": n, "num_dots": nsub(u, "."), "num_hyphens": nsub(u, "-"), "num_underscores": nsub(u, "_"),
        "num_digits": nchars(u, "0-9"), "num_letters": letters, "num_special_chars": nchars(u, "@?=%&!+$"),
        "has_ip": flag("regexp_matches(netloc, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+')"),
        "num_subdomains": nsd, "domain_length": "length(dom)", "host_entropy": entropy("dom", False),
        "domain_has_digits": flag("regexp_matches(dom, '[0-9]')"),
        "domain_digit_ratio": ratio(nchars("dom", "0-9"), "length(dom)"),
        "domain_vowel_ratio": ratio(nchars(ld, "aeiou"), f"(length(regexp_replace({ld}, '[^\\pL]', '', 'g')) - {nchars(ld, 'aeiou')})"),
        "domain_is_dictionary_word": flag(f"list_contains({lst(V2_DICTIONARY)}, {ld})"),
        "tld_length": "length(sfx)",
        "tld_trust_category": f"(CASE WHEN list_contains({lst(V2_HIGH_TRUST)}, {lsx}) THEN 2 "
        f"WHEN list_contains({lst(V2_SUSPICIOUS_CATEGORY)}, {lsx}) THEN 0 ELSE 1 END)",
        "is_suspicious_tld": flag(f"list_contains({lst(V2_SUSPICIOUS_FLAG)}, {lsx})"),
        "is_high_trust_tld": flag(f"list_contains({lst(V2_HIGH_TRUST)}, {lsx})"),
        "is_country_tld": flag("regexp_matches(sfx, '^\\pL{2}$')"),
        "path_length": "length(path)",
        "num_path_segments": "len(list_filter(string_split(path, '/'), lambda s: s <> ''))",
        "num_query_params": "(CASE WHEN query = '' THEN 0 ELSE len(string_split(query, '&')) END)",
        "query_length": "length(query)", "num_encoded_chars": nsub(u, "%"), "num_fragments": nsub(u, "#"),
        "path_has_suspicious_ext": flag(contains_any("lower(path)", K.SUSPICIOUS_EXTENSIONS)),
        "query_has_redirect": flag(contains_any("lower(query)", K.REDIRECT_WORDS)),
        "suspicious_word": flag(contains_any(lu, V2_SUSPICIOUS_WORDS)),
        "num_suspicious_words": count_present(lu, V2_SUSPICIOUS_WORDS),
        "sensitive_word": flag(contains_any(lu, V2_SENSITIVE_WORDS)),
        "action_word": flag(contains_any(lu, K.ACTION_WORDS)),
        "has_brand_name": flag(contains_any(lu, V2_BRANDS)),
        "brand_not_in_domain": flag(f"{contains_any(lu, V2_BRANDS)} AND NOT {contains_any(ld, V2_BRANDS)}"),
        "is_shortening_service": flag(contains_any(u, K.SHORTENERS)),
        "is_mixed_case": flag("regexp_matches(url, '\\p{Lu}') AND regexp_matches(url, '\\p{Ll}')"),
        "num_repeated_chars": longest_run(u), "longest_token_length": longest_token(u, "[./?=&_-]"),
        "digit_letter_ratio": ratio(nchars(u, "0-9"), letters),
        "special_char_ratio": ratio(nchars(u, "@?=%&!+$"), n),
        "uppercase_ratio": ratio("length(regexp_replace(url, '[^\\p{Lu}]', '', 'g'))", n),
        "consecutive_consonants": longest_match(lu, "[bcdfghjklmnpqrstvwxyz]+"),
        "url_entropy": entropy(u, False), "path_entropy": entropy("path", False), "domain_entropy": entropy("dom", False),
        "domain_bigram_diversity": ngram_div("dom", 2), "domain_trigram_diversity": ngram_div("dom", 3),
        "suspicious_prefix_suffix": flag("contains(dom, '-')"), "num_suspicious_symbols": nchars("dom", "@!*"),
        "has_multiple_subdomains": flag(f"{nsd} >= 3"), "subdomain_length": "length(sub)",
        "has_port": flag("contains(netloc, ':') AND NOT starts_with(netloc, '[')"),
        "uses_https": flag("scheme = 'https'"), "punycode_domain": flag("contains(dom, 'xn--')"),
        "domain_url_ratio": ratio("length(dom)", n), "path_url_ratio": ratio("length(path)", n),
        "query_url_ratio": ratio("length(query)", n),
    }
    bad = "(parse_error OR url IS NULL OR (length(url) > 0 AND NOT regexp_matches(lower(url), '[bcdfghjklmnpqrstvwxyz]')))"
    cols = ", ".join(
        (f"CASE WHEN {bad} THEN 0.0 ELSE {rnd(e[c])} END" if c in DOUBLE_FEATURES else f"CASE WHEN {bad} THEN 0 ELSE ({e[c]})::INTEGER END")
        + f" AS {c}"
        for c in V2_FEATURES
    )
    return f"""WITH src AS {typed_urls_sql()},
    {url_parts_ctes('src', 'url', clean=False)}
    SELECT id, source, url, {cols} FROM parts"""


def labelled_case_check_sql() -> str:
    return f"""WITH v AS ({override_rules_sql()})
    SELECT source, count(*) AS n, round(avg(CASE WHEN (source IN ('real', 'legit') AND final_pred = 'benign')
        OR (source NOT IN ('real', 'legit') AND final_pred <> 'benign') THEN 1.0 ELSE 0.0 END), {ROUND}) AS accuracy
    FROM v GROUP BY source"""


# ------------------------------------------------------ more generators

def typo_tld_urls_sql(seed: int = 42) -> str:
    brands = f"(SELECT DISTINCT {pick(K.SYNTH_BRANDS, 'c_custkey')} AS brand FROM customer)"
    homo = ", ".join(f"({q(a)}, {q(b)})" for a, b in K.SYNTH_HOMO.items())
    affix = " UNION ALL ".join(
        f"SELECT brand, brand || {q(d)} AS typo FROM b UNION ALL SELECT brand, {q(d)} || brand FROM b" for d in K.SYNTH_DIGIT_AFFIXES
    )
    digram = " UNION ALL ".join(
        f"SELECT brand, replace(brand, {q(o)}, {q(n)}) FROM b WHERE contains(brand, {q(o)})" for o, n in K.SYNTH_DIGRAMS
    )
    tl = lst(K.SYNTH_TLDS)
    key2 = "brand || '|' || typo || '|' || tld"
    sub = upick(["<none>"] + K.SYNTH_SUBS, uh(seed, "key2"))
    return f"""WITH b AS {brands},
    pos AS (SELECT brand, unnest(range(1, length(brand) + 1)) AS i FROM b),
    homo AS (SELECT * FROM (VALUES {homo}) h(ch, rep)),
    v AS (
      SELECT brand, substr(brand, 1, i - 1) || rep || substr(brand, i + 1) AS typo FROM pos JOIN homo ON substr(brand, i, 1) = ch
      UNION ALL SELECT brand, substr(brand, 1, i - 1) || substr(brand, i + 1) FROM pos WHERE length(brand) > 3
      UNION ALL SELECT brand, substr(brand, 1, i) || substr(brand, i) FROM pos
      UNION ALL SELECT brand, substr(brand, 1, i - 1) || substr(brand, i + 1, 1) || substr(brand, i, 1) || substr(brand, i + 2)
                FROM pos WHERE i <= length(brand) - 1
      UNION ALL {affix} UNION ALL {digram}),
    per AS (SELECT brand, list_slice(list_sort(list(DISTINCT typo)), 1, 15) AS typos FROM v WHERE typo <> '' AND typo <> brand GROUP BY brand),
    x AS (SELECT brand, unnest(typos) AS typo FROM per),
    y AS (SELECT brand, typo, unnest(list_slice(list_sort(list_transform({tl}, lambda t: {{'h': md5(brand || '|' || typo || '|' || t), 't': t}})), 1, 8)).t AS tld FROM x),
    z AS (SELECT *, {key2} AS key2 FROM y)
    SELECT brand, typo, tld, {make_url_sql('typo', 'tld', f"CASE WHEN {sub} <> '<none>' THEN {sub} END", random_path_sql('key2', seed + 1), random_query_sql('key2', seed + 3), uh(seed + 5, 'key2'))} AS url
    FROM z"""


def brand_pair_urls_sql(seed: int = 42) -> str:

    order = {b: i for i, b in reversed(list(enumerate(K.SYNTH_BRANDS)))}
    head = sorted(set(K.SYNTH_BRANDS), key=lambda b: order[b])[:50]
    brands = f"(SELECT DISTINCT {pick(K.SYNTH_BRANDS, 'c_custkey')} AS brand FROM customer)"
    key = "a || '|' || b"
    sub = upick(["<none>", "www", "login"], uh(seed + 1, "key"))
    return f"""WITH br AS {brands},
    x AS (SELECT brand AS a, unnest({lst(head)}) AS b FROM br WHERE list_contains({lst(head)}, brand)),
    y AS (SELECT a, b, {key} AS key FROM x WHERE a <> b),
    z AS (SELECT * FROM y WHERE {uh(seed, 'key')} < {K.SYNTH_PAIR_SHARE})
    SELECT a, b, {make_url_sql("a || '-' || b", upick(K.SYNTH_TLDS, uh(seed + 2, 'key')), f"CASE WHEN {sub} <> '<none>' THEN {sub} END", random_path_sql('key', seed + 3), random_query_sql('key', seed + 5), uh(seed + 7, 'key'))} AS url
    FROM z"""


def five_pattern_urls_sql(seed: int = 42) -> str:
    k = "p_partkey::VARCHAR"

    def h(i):
        return uh(seed + i, k)

    octs = [f"(floor({h(10 + j)} * 255) + 1)::INTEGER::VARCHAR" for j in range(8)]
    ip1 = " || '.' || ".join(octs[:4])
    ip2 = " || '.' || ".join(octs[4:])
    kw, kw2 = upick(K.RISK_HOST_WORDS, h(2)), upick(K.RISK_HOST_WORDS, h(3))
    site = upick(K.SMALL_SET_LEGIT_SITES, h(4))
    shape = f"floor({h(1)} * 5)::INTEGER"
    ph = f"""CASE {shape}
        WHEN 0 THEN 'http://' || {ip1} || '/' || {kw}
        WHEN 1 THEN 'http://' || {site} || '-' || {kw} || '.' || {upick(K.MINI_SUSPICIOUS_TLDS, h(5))}
        WHEN 2 THEN 'http://' || replace(replace({site}, 'a', '4'), 'o', '0') || '.com/' || {kw}
        WHEN 3 THEN 'http://' || {kw} || '.' || {site} || '.' || {kw2} || '.com'
        ELSE 'http://legitimate.com@' || {ip2} END"""
    legit = f"(CASE WHEN {h(6)} > 0.1 THEN 'https' ELSE 'http' END) || '://' || {upick(K.SMALL_SET_DOMAINS, h(7))} || {upick(K.SMALL_SET_PATHS, h(8))}"
    return f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 1 THEN {ph} ELSE {legit} END AS url,
      (p_partkey % 2 = 1)::INTEGER AS is_phishing FROM part"""


def host_diverse_sample_sql(target: int = 5000, seed: int = 42) -> str:
    return f"""WITH c AS ({synthetic_corpus_sql(seed)}),
    p AS (SELECT url, md5('{seed}|' || url) AS o FROM c ORDER BY o, url LIMIT {target}),
    x AS (SELECT *, split_part(regexp_extract(url, '^.*?://(.*)$', 1), '/', 1) AS host FROM p),
    f AS (SELECT host, min({{'o': o, 'u': url}}) AS first FROM x GROUP BY host),
    k AS (SELECT x.*, ({{'o': x.o, 'u': x.url}} = f.first OR {uh(seed + 1, 'x.url')} < {K.SYNTH_REPEAT_HOST_SHARE}) AS keep
          FROM x JOIN f ON f.host = x.host),
    n AS (SELECT sum(keep::INTEGER) AS nk FROM k)
    SELECT url FROM k, n WHERE keep OR nk < {target}"""



def subst_aware_features_sql() -> str:
    variants = f"(SELECT list(variant) FROM {variant_rows_sql()})"
    e = main_feature_exprs(brand_check=has_any_sql("lower(dom)", variants))
    cols = []
    bad = "(raw_blank OR length(u) < 8 OR NOT contains(u, '.') OR (parse_error AND NOT blank))"
    for name in MAIN_NATIVE_FEATURES:
        if name in DOUBLE_FEATURES:
            cols.append(f"CASE WHEN {bad} THEN 0.0 ELSE {rnd(e[name])} END AS {name}")
        else:
            cols.append(f"CASE WHEN {bad} THEN 0 ELSE ({e[name]})::INTEGER END AS {name}")
    return f"""WITH src0 AS {typed_urls_sql()},
    src AS (SELECT id, source, url AS url_in, type, (url IS NULL OR length(trim(url, {WS})) = 0) AS raw_blank,
                   regexp_replace(regexp_replace(url, '[^\\x20-\\x7E]', '', 'g'), '[^a-zA-Z0-9:/?&=._%-]', '', 'g') AS url
            FROM src0),
    {url_parts_ctes('src', 'url', clean=False)}
    SELECT id, source, url_in AS url, type, {', '.join(cols)} FROM parts"""


def brand_substitution_sql() -> str:
    brands = brands_values()
    return f"""WITH src AS {typed_urls_sql()},
    {url_parts_ctes('src')},
    d AS (SELECT DISTINCT dom AS domain, lower(dom) AS dl FROM parts),
    v AS {variant_rows_sql()},
    plain AS (SELECT d.domain, min(b.brand_ord) AS o FROM d JOIN {brands} b ON contains(d.dl, b.brand) GROUP BY d.domain),
    sub AS (SELECT d.domain, min(v.brand_ord) AS o FROM d JOIN v ON contains(d.dl, v.variant) GROUP BY d.domain)
    SELECT d.domain, coalesce(plain.o, sub.o) IS NOT NULL AS flag, b.brand AS brand
    FROM d LEFT JOIN plain ON plain.domain = d.domain LEFT JOIN sub ON sub.domain = d.domain
    LEFT JOIN {brands} b ON b.brand_ord = coalesce(plain.o, sub.o)"""



def draft63_features_sql() -> str:
    from hookline.functions.features import (
        DRAFT_BRANDS, DRAFT_CHECK_BRANDS, DRAFT_COMBO_TLDS, DRAFT_DICTIONARY, DRAFT_HYPHEN_PATTERNS, DRAFT_LEGIT,
        DRAFT_NATIVE,
    )

    e = main_feature_exprs()
    lu, ld = "lower(u)", "lower(dom)"
    biu = contains_any(lu, DRAFT_CHECK_BRANDS)
    e["domain_is_dictionary_word"] = flag(f"list_contains({lst(DRAFT_DICTIONARY)}, {ld})")
    e["has_brand_name"] = flag(contains_any(lu, DRAFT_BRANDS))
    e["brand_not_in_domain"] = flag(f"{contains_any(lu, DRAFT_BRANDS)} AND NOT {contains_any(ld, DRAFT_BRANDS)}")
    e["brand_with_hyphen"] = flag(contains_any(ld, DRAFT_HYPHEN_PATTERNS))
    e["brand_impersonation"] = flag(f"{biu} AND NOT list_contains({lst(DRAFT_LEGIT)}, lower(dom || '.' || sfx))")
    e["suspicious_tld_brand_combo"] = flag(f"list_contains({lst(DRAFT_COMBO_TLDS)}, lower(sfx)) AND {biu}")
    cols = []
    for name in DRAFT_NATIVE:
        if name in DOUBLE_FEATURES:
            cols.append(f"CASE WHEN bad THEN 0.0 ELSE {rnd(e[name])} END AS {name}")
        else:
            cols.append(f"CASE WHEN bad THEN 0 ELSE ({e[name]})::INTEGER END AS {name}")
    return f"""WITH src AS {typed_urls_sql()},
    {url_parts_ctes('src')}
    SELECT id, source, url, type, {', '.join(cols)} FROM parts"""


def crafted_urls_sql(seed: int = 42) -> str:
    brands = list(dict.fromkeys(K.SYNTH_BRANDS))
    bvals = ", ".join(f"({q(b)})" for b in brands)
    homo = ", ".join(f"({q(a)}, {q(b)})" for a, b in K.SYNTH_HOMO.items())
    affix = " UNION ALL ".join(
        f"SELECT brand, brand || {q(d)} AS typo FROM b UNION ALL SELECT brand, {q(d)} || brand FROM b" for d in K.SYNTH_DIGIT_AFFIXES
    )
    digram = " UNION ALL ".join(
        f"SELECT brand, replace(brand, {q(o)}, {q(n)}) FROM b WHERE contains(brand, {q(o)})" for o, n in K.SYNTH_DIGRAMS
    )
    key = "key"
    variant = f"coalesce(variants[floor({uh(seed + 1, key)} * len(variants))::BIGINT + 1], brand)"
    shape = f"floor({uh(seed + 2, key)} * 3)::INTEGER"
    host = f"""CASE {shape}
        WHEN 0 THEN {variant} || '-' || {upick(['secure', 'login', 'verify', 'auth'], uh(seed + 3, key))}
        WHEN 1 THEN {variant} || {upick(['', '-', '_'], uh(seed + 4, key))} || {token("key || 'h'", 3)}
        ELSE {variant} || {upick(['', 'auth', 'portal', 'pay'], uh(seed + 5, key))} END"""
    sub = upick(["<none>"] + K.SYNTH_SUBS, uh(seed + 6, key))
    return f"""WITH b AS (SELECT * FROM (VALUES {bvals}) t(brand)),
    pos AS (SELECT brand, unnest(range(1, length(brand) + 1)) AS i FROM b),
    homo AS (SELECT * FROM (VALUES {homo}) h(ch, rep)),
    v AS (
      SELECT brand, substr(brand, 1, i - 1) || rep || substr(brand, i + 1) AS typo FROM pos JOIN homo ON substr(brand, i, 1) = ch
      UNION ALL SELECT brand, substr(brand, 1, i - 1) || substr(brand, i + 1) FROM pos WHERE length(brand) > 3
      UNION ALL SELECT brand, substr(brand, 1, i) || substr(brand, i) FROM pos
      UNION ALL SELECT brand, substr(brand, 1, i - 1) || substr(brand, i + 1, 1) || substr(brand, i, 1) || substr(brand, i + 2)
                FROM pos WHERE i <= length(brand) - 1
      UNION ALL {affix} UNION ALL {digram}),
    vars AS (SELECT brand, list_sort(list(DISTINCT typo)) AS variants FROM v WHERE typo <> '' AND typo <> brand GROUP BY brand),
    k AS (SELECT l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR AS key FROM lineitem),
    x AS (SELECT k.key, {upick(K.SYNTH_BRANDS, uh(seed, 'k.key'))} AS brand FROM k),
    y AS (SELECT x.key, x.brand, vars.variants FROM x LEFT JOIN vars ON vars.brand = x.brand)
    SELECT key, {make_url_sql(f'({host})', upick(K.SYNTH_TLDS, uh(seed + 7, key)), f"CASE WHEN {sub} <> '<none>' THEN {sub} END", random_path_sql(key, seed + 8), random_query_sql(key, seed + 10), uh(seed + 12, key))} AS url
    FROM y"""
