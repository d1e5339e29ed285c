"""Look-alike rules on literal cases, worked out by hand from the definitions."""

from pyspark.sql import functions as F

from hookline import constants as K
from hookline.operators import lookalike as LK

# URL -> final class and reason for a benign verdict of 0.95.
OVERRIDES = {
    "https://www.g00gle.com": ("phishing", "typosquatting_google"),
    "faceb00k.com": ("phishing", "typosquatting_facebook"),
    "paypa1.com": ("phishing", "typosquatting_paypal"),
    "microoft.com": ("phishing", "typosquatting_microsoft"),
    "arnazon.com": ("phishing", "typosquatting_amazon"),
    "twiter.com": ("phishing", "typosquatting_twitter"),
    "netfl1x.com": ("phishing", "typosquatting_netflix"),
    "https://gogle.com": ("phishing", "typosquatting_google"),
    "https://www.google.com": ("benign", "whitelist_match"),
    "facebook.com": ("benign", "whitelist_match"),
    "paypal.com": ("benign", "whitelist_match"),
    "https://wikipedia.org": ("benign", "whitelist_match"),
    # Flagged by the rules: it contains the pattern "oogle".
    "https://www.googles.com": ("phishing", "typosquatting_google"),
    # 0.3 for the contained brand and 0.3 for a ratio of 0.8 reach 0.6.
    "https://www.googleapi.com": ("phishing", "heuristic_contains_google_similar_to_google"),
    # The brand is in the subdomain; the domain is "evil".
    "secure-paypal.com.evil.tk": ("benign", "model_decision"),
}

# (string, brand) -> 2 M / T, M matched characters of T in both.
RATIOS = {
    ("gogle", "google"): 10 / 11, ("arnazon", "amazon"): 10 / 13, ("paypai", "paypal"): 10 / 12,
    ("googleapi", "google"): 12 / 15, ("example", "apple"): 8 / 12, ("google", "google"): 1.0,
    ("", "google"): 0.0, ("xyz", "google"): 0.0, ("facebook", "facebook"): 1.0,
}

# domain -> E3 (flag, score, brand): equality ends the fold; a contained brand gives 0.85; a
# one-rule leetspeak variant 0.8; else the best ratio, which flags from 0.7 on.
FOLDS = {
    "microsoft": (False, 1.0, "microsoft"), "googleapi": (True, 0.85, "google"), "mygithub": (True, 0.85, "github"),
    "g00gle": (True, 0.8, "google"), "faceb00k": (True, 0.8, "facebook"), "amaz0n-verify": (True, 0.8, "amazon"),
    "gogle": (True, 10 / 11, "google"), "arnazon": (True, 10 / 13, "amazon"), "example": (False, 8 / 12, "apple"),
}
# domain -> E5 (flag, brand, confidence): 0.95 for a pattern, 0.9 for a contained one.
VERDICTS = {
    "gogle": (True, "google", 0.95), "g00gle": (True, "google", 0.95), "faceb00k": (True, "facebook", 0.95),
    "googles": (True, "google", 0.9), "amaz0n-verify": (True, "amazon", 0.9), "arnazon": (True, "amazon", 10 / 13),
    "microsoft": (False, None, 0.0), "example": (False, None, 0.0), "secure-login": (False, None, 0.0),
}
HOMOGRAPHS = {"g00gle": True, "faceb00k": True, "amaz0n-verify": True, "gogle": False, "example": False, "microsoft": False}


def _scored(spark, urls, pred="benign"):
    low, high = (0.95, 0.05) if pred == "benign" else (0.01, 0.99)
    rows = [(i, u, pred, low, 0.0, 0.0, high) for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "id long, url string, model_pred string, p_benign double, p_defacement double, "
                                        "p_malware double, p_phishing double")


def test_override_cases(spark):
    out = {r.url: r for r in LK.apply_override(spark, _scored(spark, list(OVERRIDES)), "url", "model_pred", "p_").collect()}
    for u, want in OVERRIDES.items():
        assert (out[u].final_pred, out[u].reason) == want, u
        assert out[u].heuristic_applied == (want[1] != "model_decision")


def test_a_confident_model_goes_first_but_for_the_whitelist(spark):
    scored = _scored(spark, list(OVERRIDES), "phishing")
    for r in LK.apply_override(spark, scored, "url", "model_pred", "p_").collect():
        white = OVERRIDES[r.url][1] == "whitelist_match"
        assert (r.final_pred, r.reason) == (("benign", "whitelist_match") if white else ("phishing", "model_confident"))
        assert r.final_phishing == (K.WHITELIST_PROBS["phishing"] if white else 0.99)


def test_ratios(spark):
    df = spark.createDataFrame([(w,) for w in {w for w, _ in RATIOS}], "w string")
    got = {r.w: dict(zip(K.BRAND_KEYWORDS, r.r)) for r in df.select("w", LK.sequence_ratios(F.col("w")).alias("r")).collect()}
    for (w, brand), want in RATIOS.items():
        if brand in got[w]:
            assert abs(got[w][brand] - want) < 1e-12, (w, brand)
    assert all(0.0 <= x <= 1.0 for r in got.values() for x in r.values())


def test_pruned_ratios_keep_what_the_rules_use(spark):
    words = sorted({w for w, _ in RATIOS} | {*FOLDS, *VERDICTS} | {f"{b[1:]}{i}" for i, b in enumerate(K.BRAND_KEYWORDS)})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", LK.sequence_ratios(F.col("w")).alias("a"), LK.near_ratios(F.col("w")).alias("b")).collect():
        assert max(r.a) == max(r.b) and (max(r.a) == 0 or r.a.index(max(r.a)) == r.b.index(max(r.b))), r.w
        assert all(x == y or (y == 0.0 and x < LK.RATIO_FLOOR) for x, y in zip(r.a, r.b)), r.w


def test_profile_cases(spark):
    doms = sorted({*FOLDS, *VERDICTS, *HOMOGRAPHS})
    df = spark.createDataFrame([(d,) for d in doms], "domain string")
    prof = {r.domain: r for r in LK.domain_profile(spark, df, "domain").collect()}
    for d, (flag, score, brand) in FOLDS.items():
        assert (prof[d].e3.flag, prof[d].e3.brand) == (flag, brand) and abs(prof[d].e3.score - score) < 1e-12, d
    for d, (flag, brand, conf) in VERDICTS.items():
        assert (prof[d].e5.flag, prof[d].e5.brand) == (flag, brand) and abs(prof[d].e5.confidence - conf) < 1e-12, d
    for d, want in HOMOGRAPHS.items():
        assert prof[d].e6 == want, d


def test_patterns_of_a_brand(spark):
    from hookline.operators.corpus import brand_table, typo_patterns

    rows = typo_patterns(brand_table(spark)).collect()
    google = {r.pattern for r in rows if r.brand == "google"}
    # Omissions, doublings, swaps of neighbours, look-alike characters.
    assert {"gogle", "oogle", "googl", "ggoogle", "gooogle", "googlee", "ogogle", "goolge", "googel", "g00gle"} <= google
    assert {r.brand for r in rows} <= set(K.BRAND_KEYWORDS)


def test_cumulative_substitution_cases(spark):
    from hookline.functions.features import brand_with_substitution, brand_with_substitution_match

    # A rule replaces all of a letter; rules add up over the brand.
    cases = {"g00gle": "google", "9oo9le": "google", "9oogle": None, "g0og1e": None, "micr0s0ft": "microsoft",
             "amaz0n": "amazon", "z00m": "zoom", "zoom": "zoom", "my-zoom-x": "zoom", "fl1pk@rt": "flipkart",
             "f1ipk@rt": "flipkart", "d0pbox": None, "example": None, "x": None, "": None}
    df = spark.createDataFrame([(d,) for d in cases], "d string")
    rows = df.select("d", brand_with_substitution(F.col("d")).alias("f"), brand_with_substitution_match(F.col("d")).alias("b")).collect()
    for r in rows:
        assert (r.f, r.b) == (cases[r.d] is not None, cases[r.d]), r.d


def test_a_hot_domain_is_split(spark):
    """Nine rows of ten share a domain: its rows reach the join in many parts, and
    one row of it leaves each task before the domains are dealt."""
    rows = spark.range(20_000).select(
        F.concat(F.lit("https://"), F.when(F.col("id") % 10 != 0, "gogle").otherwise(F.concat(F.lit("d"), "id")),
                 F.lit(".com/"), F.col("id").cast("string")).alias("url"))
    staged = rows.withColumn("key", F.regexp_extract("url", "//([a-z0-9]+)", 1))
    joined = LK.join_profile(staged, staged.select("key").distinct().withColumn("v", F.length("key")), "key")
    assert joined.count() == 20_000 and joined.where("v != length(key)").count() == 0
    plain = [c for c in staged.columns]
    salts = staged.where("key = 'gogle'").groupBy(F.pmod(F.xxhash64(*plain), F.lit(LK.SALTS))).count().collect()
    assert len(salts) == LK.SALTS and max(r["count"] for r in salts) < 2 * 18_000 / LK.SALTS
    plan = staged.select("key").distinct()._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.rindex("HashAggregate")


def test_ratios_equal_the_plain_ones_and_share_masked_strings():
    import random
    from difflib import SequenceMatcher

    import pandas as pd

    from hookline.operators import lookalike as LK

    draw = random.Random(3)
    words = ["", "1", "1\0x", "\0", "paypal", "paypa1-", "éamazonx"] + [
        "".join(draw.choice("amzonpyl019-é\0") for _ in range(draw.randint(0, 12))) for _ in range(150)]
    # Strings that differ after a NUL only were taken for one, and got null.
    got = LK.near_ratios.func(pd.Series([None, *words]))
    assert got.iloc[0] is None
    for word, near in zip(words, got.iloc[1:]):
        best = 0.0
        for brand, value in zip(LK.K.BRAND_KEYWORDS, near):
            plain = SequenceMatcher(None, word, brand).ratio()
            assert LK.against(brand).ratio(word) == plain
            assert value == plain or (value == 0.0 and plain < LK.RATIO_FLOOR and plain <= best), (word, brand)
            best = max(best, plain)
    one = LK.Against("paypal")
    for i in range(500):
        one.ratio(f"download{i}")
    assert len(one.known) == 1
