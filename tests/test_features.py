import math

import pytest
from pyspark.sql import functions as F

from hookline.functions.features import MAIN_FEATURES, featurize_urls
from hookline.functions import urls as U

TRICKY = [
    "https://www.g00gle.com", "google.com.secure-login.tk", "www.google.com/a?b", "google.com:80/x",
    "https://a.b/c;d=1/e;f?x=1#z", "HTTPS://A.com:80/p", "https://u@h.com:99/", "http://[bad/x", "", "   ",
    "http://192.168.1.1/login.php", "https://paypal-secure.ml/verify?redirect=x", "https://accounts.google.com/x",
    "https://xn--80ak6aa92e.com/", "https://bit.ly/abc", "http://sub.a.b.example.co.uk/p.exe",
    "https://secure-google.com", "amazon-verify.ga", "faceb00k.com", "paypa1.com", "amaz0n.com",
    "https://www.microsoft.com.login-verify.xyz/update?next=1", "http://[::1]:8080/x", "ftp://files.example.org/a;b",
    "https://www.googles.com", "https://www.googleapi.com", "http://localhost/x", "https://téléphone.fr/ü",
    "https://sbi.co.in/x", "https://a--b.example.click/%20%41", "https://x.y.z.w.v.example.com/aaaa___bbb",
]


@pytest.fixture(scope="module")
def fixture_rows(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("url").limit(40).collect()
    urls = TRICKY + [r.url for r in pages]
    return spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id long, url string"), urls


def test_urlparse_parts(spark):
    from urllib.parse import urlparse

    cases = ["www.google.com/a?b", "google.com:80/x", "https://a.b/c;d=1/e;f?x=1#z", "HTTPS://A.com:80/p",
             "https://u@h.com:99/", "ftp://h/a;b", "mailto:x@y.z", "//host/p?q#f"]
    df = spark.createDataFrame([(c,) for c in cases], "url string")
    rows = df.select("url", U.split_url(F.col("url")).alias("s")).collect()
    for r in rows:
        p = urlparse(r.url)
        assert (r.s.scheme, r.s.netloc, r.s.path, r.s.query, r.s.fragment) == (p.scheme, p.netloc, p.path, p.query, p.fragment), r.url


# Values counted by hand.
LITERAL = {
    "https://www.paypal.com/login?a=1&b=2": {
        "url_length": 36, "num_dots": 2, "num_hyphens": 0, "num_digits": 2, "num_letters": 24, "has_ip": 0,
        "num_subdomains": 1, "domain_length": 6, "subdomain_length": 3, "tld_length": 3, "path_length": 6,
        "num_path_segments": 1, "num_query_params": 2, "query_length": 7, "uses_https": 1, "has_port": 0,
        "domain_vowel_ratio": 2 / 4, "path_url_ratio": 6 / 36, "query_url_ratio": 7 / 36, "domain_url_ratio": 6 / 36,
        # p and a twice, y and l once
        "domain_entropy": 2 / 3 * math.log2(3) + 1 / 3 * math.log2(6),
        "path_entropy": math.log2(6), "digit_letter_ratio": 2 / 24, "special_char_ratio": 4 / 36,
        "has_brand_name": 1, "brand_impersonation": 0, "is_typosquatting": 0, "typosquatting_similarity": 1.0,
    },
    "http://192.168.1.1/x.php": {
        "url_length": 24, "num_dots": 4, "num_digits": 8, "num_letters": 8, "has_ip": 1, "num_subdomains": 0,
        "domain_length": 11, "tld_length": 0, "path_length": 6, "domain_has_digits": 1, "domain_digit_ratio": 8 / 11,
        "uses_https": 0, "path_url_ratio": 6 / 24, "has_brand_name": 0,
    },
    "https://xn--80ak6aa92e.com/": {
        "url_length": 27, "num_dots": 1, "num_hyphens": 2, "num_digits": 5, "num_letters": 15, "domain_length": 14,
        "path_length": 1, "num_path_segments": 0, "path_entropy": 0.0, "punycode_domain": 1, "uses_https": 1,
        "domain_url_ratio": 14 / 27,
    },
    "http://login.paypal.ru/": {"domain_length": 6, "subdomain_length": 5, "tld_length": 2},
}


def test_literal_values(spark):
    df = spark.createDataFrame([(u,) for u in LITERAL], "url string")
    for r in featurize_urls(df, "url", "main").collect():
        for k, want in LITERAL[r.url].items():
            assert math.isclose(r[k], want, rel_tol=1e-9, abs_tol=1e-12), (r.url, k, r[k], want)


def test_main_profile_invariants(spark, fixture_rows):
    df, urls = fixture_rows
    out = {r.id: r for r in featurize_urls(df, "url", "main").collect()}
    assert len(out) == len(urls)
    for i, u in enumerate(urls):
        r = out[i]
        assert all(r[k] is not None for k in MAIN_FEATURES), u
        if not r.url_length:
            continue
        assert r.num_digits + r.num_letters <= r.url_length
        assert r.path_length + r.query_length + (r.domain_length if "://" in u else 0) <= r.url_length
        assert 0 <= r.typosquatting_similarity <= 1 and 0 <= r.uppercase_ratio <= 1
        assert 0 <= r.url_entropy <= math.log2(max(2, r.url_length))
        assert r.uses_https == int(u.lower().startswith("https://")), u


def test_signals_of_reference_examples(spark):
    benign = ["google.com", "facebook.com", "paypal.com", "amazon.com", "accounts.google.com"]
    phishing = ["google-login.tk", "paypal-secure.ml", "secure-google.com", "amazon-verify.ga", "g00gle.com",
                "faceb00k.com", "paypa1.com", "amaz0n.com"]
    df = spark.createDataFrame([(u,) for u in benign + phishing], "url string")
    rows = {r.url: r for r in featurize_urls(df, "url", "main").collect()}
    for u in benign:
        assert rows[u].brand_impersonation == 0, u
    for u in phishing:
        r = rows[u]
        assert r.brand_impersonation or r.is_typosquatting or r.has_character_substitution or r.brand_with_hyphen \
            or r.suspicious_tld_brand_combo, u


def test_zero_row_for_invalid(spark):
    df = spark.createDataFrame([(None,), ("",), ("http://[bad/x",)], "url string")
    for r in featurize_urls(df, "url", "main").collect():
        assert all(r[k] == 0 for k in MAIN_FEATURES)


def test_draft63_ratio_pair(spark):
    from difflib import SequenceMatcher

    from hookline.functions.features import DRAFT_MAJOR_BRANDS, featurize_draft63

    domains = {"https://gogle.com/x": "gogle", "https://www.paypa1.com": "paypa1", "https://netflix.com": "netflix",
               "https://example.org": "example", "http://[bad/x": None}
    urls = list(domains)
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    out = {r.url: r for r in featurize_draft63(df).collect()}
    for u in urls[:-1]:
        d = domains[u]
        best = max(SequenceMatcher(None, d, b).ratio() for b in DRAFT_MAJOR_BRANDS)
        assert abs(out[u].typosquatting_similarity - best) < 1e-12
        assert out[u].is_typosquatting == int(0.75 < best < 0.95)
    assert out["http://[bad/x"].typosquatting_similarity == 0.0
