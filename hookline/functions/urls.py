"""URL cleaning and decomposition as native column expressions.

``parse_url`` is not used: it raises under ANSI mode on odd URLs and returns a
NULL host for schemeless URLs or hosts with ``_``.  Instead each part is cut
with an anchored regular expression that follows the standard library's
``urlsplit`` / ``urlparse`` rules (scheme lower-cased, netloc kept as written,
``;params`` of the last path segment removed for the schemes that use them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookline import constants as K
from hookline.functions.suffixes import with_suffix_labels
from hookline.functions.text import NON_PRINTABLE, col_

IPV4_STRICT = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
IPV6_LIKE = r"^([0-9A-Fa-f]{0,4}:){2,7}([0-9A-Fa-f]{0,4}|[0-9]{1,3}(\.[0-9]{1,3}){3})(%[A-Za-z0-9._~-]+)?$"
IPVFUTURE = r"^v[A-Fa-f0-9]+\..+$"


# --------------------------------------------------------------------- cleaning

def keep_printable_ascii(c: Column | str) -> Column:
    """Keep code points 32..126."""
    return F.regexp_replace(col_(c), NON_PRINTABLE, "")


def ensure_scheme_https(c: Column | str) -> Column:
    """Prefix ``https://`` unless the URL starts with http:// or https:// (case-sensitive)."""
    u = col_(c)
    return F.when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u))


def ensure_scheme_http(c: Column | str) -> Column:
    """Prefix ``http://`` unless the URL starts with ``<letters>://``."""
    u = col_(c)
    return F.when(u.rlike("^[a-zA-Z]+://"), u).otherwise(F.concat(F.lit("http://"), u))


def percent_decode(c: Column | str) -> Column:
    """``unquote`` semantics — ``+`` stays, malformed escapes stay as written.

    Valid ``%XX`` runs are decoded as UTF-8; ``+`` is protected before Java's
    form decoder and restored after.  If the whole string cannot be decoded
    (a stray ``%``), only the well-formed escapes are decoded by decoding the
    string with the stray percent signs escaped first.
    """
    u = col_(c)
    protected = F.replace(u, F.lit("+"), F.lit("%2B"))
    fixed = F.regexp_replace(protected, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(fixed)


def strict_clean(c: Column | str) -> Column:
    """Drop characters outside ``[a-zA-Z0-9:/?&=._%-]``."""
    return F.regexp_replace(col_(c), r"[^a-zA-Z0-9:/?&=._%-]", "")


def strict_clean_ok(c: Column | str) -> Column:
    """B11 gate: cleaned URL at least 8 long and with a dot."""
    s = strict_clean(c)
    return (F.length(s) >= 8) & s.contains(".")


def url_is_blank(c: Column | str) -> Column:
    """B15 part one: null or whitespace-only URL."""
    u = col_(c)
    return u.isNull() | (F.length(F.trim(u, F.lit(" \t\n\r\x0b\x0c"))) == 0)


# ------------------------------------------------------------ urlsplit parts

def _lstrip_c0(u: Column) -> Column:
    return F.regexp_replace(u, r"^[\x00-\x20]+", "")


def url_scheme(c: Column | str) -> Column:
    """Scheme as ``urlsplit`` finds it (lower-cased, '' when absent)."""
    u = _lstrip_c0(col_(c))
    return F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def _after_scheme(u: Column) -> Column:
    return F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")


def url_netloc(c: Column | str) -> Column:
    u = _after_scheme(_lstrip_c0(col_(c)))
    return F.regexp_extract(u, r"^//([^/?#]*)", 1)


def _after_netloc(c: Column | str) -> Column:
    u = _after_scheme(_lstrip_c0(col_(c)))
    return F.regexp_replace(u, r"^//[^/?#]*", "")


def url_path_raw(c: Column | str) -> Column:
    """Path of ``urlsplit`` (params included)."""
    return F.regexp_extract(_after_netloc(c), r"^([^?#]*)", 1)


def url_path(c: Column | str) -> Column:
    """Path of ``urlparse``: the ``;params`` of the last segment are cut off
    for the schemes that carry params."""
    raw = url_path_raw(c)
    cut = F.regexp_extract(raw, r"^((.*/)?[^/;]*)", 1)
    schemes = F.array(*[F.lit(s) for s in K.URL_SCHEMES_WITH_PARAMS])
    return F.when(F.array_contains(schemes, url_scheme(c)), cut).otherwise(raw)


def url_query(c: Column | str) -> Column:
    return F.regexp_extract(_after_netloc(c), r"^[^?#]*\?([^#]*)", 1)


def url_fragment(c: Column | str) -> Column:
    return F.regexp_extract(_after_netloc(c), r"^[^#]*#(.*)$", 1)


def url_parse_error(c: Column | str) -> Column:
    """True where ``urlsplit`` raises: unbalanced brackets in the netloc, or a
    bracketed host that is not an IPv6 / IPvFuture literal."""
    n = url_netloc(c)
    has_open = n.contains("[")
    has_close = n.contains("]")
    bracketed = F.regexp_extract(n, r"\[([^\]]*)\]", 1)
    bad_host = ~(bracketed.rlike(IPV6_LIKE) | bracketed.rlike(IPVFUTURE))
    return (has_open != has_close) | (has_open & bad_host)


def split_url(c: Column | str) -> Column:
    """struct(scheme, netloc, path, query, fragment)."""
    return F.struct(
        url_scheme(c).alias("scheme"),
        url_netloc(c).alias("netloc"),
        url_path(c).alias("path"),
        url_query(c).alias("query"),
        url_fragment(c).alias("fragment"),
    )


# --------------------------------------------------------- registrable domain

def lenient_host(c: Column | str) -> Column:
    """Host the way a suffix extractor finds it: scheme optional, userinfo and
    port dropped, trailing dots removed, case kept."""
    u = col_(c)
    schemeless = F.regexp_replace(u, r"^(//|[A-Za-z0-9+.-]+://)", "")
    head = F.regexp_extract(schemeless, r"^([^/?#]*)", 1)
    after_user = F.regexp_replace(head, r"^.*@", "")
    v6 = F.regexp_extract(after_user, r"^(\[[^\]]*\])", 1)
    host = F.when(v6 != "", v6).otherwise(F.regexp_extract(after_user, r"^([^:]*)", 1))
    return F.regexp_replace(F.trim(host), r"\.+$", "")


def registered_domain(domain: Column, suffix: Column) -> Column:
    """``domain.suffix`` lower-cased (just ``domain`` when no suffix)."""
    return F.lower(F.when(suffix != "", F.concat_ws(".", domain, suffix)).otherwise(domain))


# ------------------------------------------------------------- other splits

def browser_hostname(c: Column | str) -> Column:
    """Hostname as a browser URL parser gives it (lower-cased); the raw
    string when the URL has no ``scheme://authority``."""
    u = col_(c)
    auth = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)
    host = F.regexp_extract(F.regexp_replace(auth, r"^.*@", ""), r"^(\[[^\]]*\]|[^:]*)", 1)
    ok = u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]") & (host != "")
    return F.when(ok, F.lower(host)).otherwise(u)


def browser_pathname(c: Column | str) -> Column:
    """Path as a browser URL parser gives it ('/' when empty)."""
    u = col_(c)
    p = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def netloc_by_slash(c: Column | str) -> Column:
    """C4: ``url.split('/')[2]`` ('' when missing)."""
    return F.coalesce(F.get(F.split(col_(c), "/", -1), 2), F.lit(""))


def url_host_key(c: Column | str) -> Column:
    """Text between the first ``://`` and the next ``/`` (null without ``://``)."""
    u = col_(c)
    rest = F.regexp_extract(u, r"^.*?://(.*)$", 1)
    return F.when(u.contains("://"), F.substring_index(rest, "/", 1)).otherwise(F.lit(None).cast("string"))


def query_pairs(c: Column | str) -> Column:
    """array<struct<key,value>> of the query string, split at the first
    ``=``, both sides form-decoded (``+`` is a space, as in a browser)."""
    q = col_(c)
    parts = F.filter(F.split(q, "&", -1), lambda p: p != "")

    def dec(x: Column) -> Column:
        # A '%' that begins no escape stands for itself, as in a browser.
        return F.coalesce(F.try_url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25")), x)

    return F.transform(
        parts,
        lambda p: F.struct(
            dec(F.substring_index(p, "=", 1)).alias("key"),
            dec(F.when(p.contains("="), F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).otherwise(F.lit(""))).alias("value"),
        ),
    )


# ------------------------------------------------------------ staged parts

def add_url_parts(df: DataFrame, url_col: str = "url", prefix: str = "_p_", clean: bool = True,
                  suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """Add the URL parts as columns, one small projection per stage.

    Each stage refers to the previous one by attribute, so no part expression
    is inlined into its users more than once (a nested column expression that
    is referenced many times grows the plan exponentially).  Columns added:
    ``u`` (printable-ASCII URL when ``clean``), ``bad`` (blank or unparsable),
    ``scheme``, ``netloc``, ``path``, ``query``, ``fragment``, ``host``,
    ``sub``, ``dom``, ``sfx``.

    C2: the host is cut at its public suffix (``suffixes``: rules to use instead of
    the public list); an IPv4 host is wholly ``dom``, and without a rule the suffix
    is empty and the last label is ``dom``.
    """
    p = prefix
    c = F.col
    raw = c(url_col)
    s1 = df.withColumns({f"{p}u": keep_printable_ascii(raw) if clean else raw, f"{p}blank": url_is_blank(raw)})
    u = c(f"{p}u")
    lu = _lstrip_c0(u)
    s2 = s1.withColumns(
        {
            f"{p}scheme": F.lower(F.regexp_extract(lu, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)),
            f"{p}after_scheme": _after_scheme(lu),
            f"{p}host": lenient_host(u),
        }
    )
    a = c(f"{p}after_scheme")
    s3 = s2.withColumns(
        {
            f"{p}netloc": F.regexp_extract(a, r"^//([^/?#]*)", 1),
            f"{p}rest": F.regexp_replace(a, r"^//[^/?#]*", ""),
            f"{p}labels": F.split(c(f"{p}host"), r"\.", -1),
        }
    )
    rest = c(f"{p}rest")
    s3 = with_suffix_labels(s3, f"{p}labels", f"{p}k", suffixes)
    labels = c(f"{p}labels")
    n = F.size(labels)
    netloc = c(f"{p}netloc")
    has_open = netloc.contains("[")
    bracketed = F.regexp_extract(netloc, r"\[([^\]]*)\]", 1)
    s4 = s3.withColumns(
        {
            f"{p}path_raw": F.regexp_extract(rest, r"^([^?#]*)", 1),
            f"{p}query": F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1),
            f"{p}fragment": F.regexp_extract(rest, r"^[^#]*#(.*)$", 1),
            f"{p}bad": c(f"{p}blank")
            | (has_open != netloc.contains("]"))
            | (has_open & ~(bracketed.rlike(IPV6_LIKE) | bracketed.rlike(IPVFUTURE))),
        }
    )
    k = c(f"{p}k")
    host = c(f"{p}host")
    cut = n - k
    is_ip = (k == 0) & F.lower(host).rlike(IPV4_STRICT)
    schemes = F.array(*[F.lit(x) for x in K.URL_SCHEMES_WITH_PARAMS])
    path_raw = c(f"{p}path_raw")
    s5 = s4.withColumns(
        {
            f"{p}path": F.when(
                F.array_contains(schemes, c(f"{p}scheme")), F.regexp_extract(path_raw, r"^((.*/)?[^/;]*)", 1)
            ).otherwise(path_raw),
            f"{p}sub": F.when(is_ip, F.lit(""))
            .when(cut >= 2, F.array_join(F.slice(labels, F.lit(1), F.greatest(cut - 1, F.lit(1))), "."))
            .otherwise(F.lit("")),
            f"{p}dom": F.when(is_ip, host)
            .when(cut >= 1, F.element_at(labels, F.greatest(cut, F.lit(1))))
            .otherwise(F.lit("")),
            f"{p}sfx": F.when(is_ip, F.lit(""))
            .when(k > 0, F.array_join(F.slice(labels, F.greatest(cut + 1, F.lit(1)), k), "."))
            .otherwise(F.lit("")),
        }
    )
    return s5.drop(f"{p}blank", f"{p}after_scheme", f"{p}rest", f"{p}labels", f"{p}path_raw", f"{p}k")
