from pyspark.sql import functions as F

from hookline.operators import rules as R


def test_quick_risk_score_examples(spark):
    cases = {
        "https://google.com": 0.0,
        "http://example.com": 0.1,
        "http://localhost:3000/x": 0.0,
        "http://1.2.3.4/login": 0.3 + 0.2 * 0 + 0.1,
        "https://a.b.c.d.e.com/": 0.2,
        "http://secure-login.tk": 0.3 + 0.2 + 0.1,
        "https://user@evil.ml": 0.3 + 0.4,
        "http://10.0.0.1@verify-account.tk/" + "a" * 90: 1.0,
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    got = {r.url: r.s for r in df.select("url", R.quick_risk_score(F.col("url")).alias("s")).collect()}
    for u, want in cases.items():
        assert abs(got[u] - want) < 1e-12, (u, got[u], want)


def test_threat_type_and_scam_category(spark):
    df = spark.createDataFrame(
        [("ML model detected phishing (90% confidence)", "https://paypal-bank.com/x"),
         ("URL contains suspicious patterns", "https://crypto-wallet.io/"),
         ("This URL is in our threat database", "https://bitcoin-account.net"),
         (None, "x")],
        "reason string, url string",
    )
    rows = df.select(R.threat_type(F.col("reason")).alias("t"), R.scam_categories(F.col("url")).alias("c")).collect()
    assert [r.t for r in rows] == ["Phishing Attempt", "Suspicious Activity", "Phishing / Malware", "Phishing / Malware"]
    assert [r.c for r in rows] == [["banking"], ["crypto"], ["banking", "crypto"], []]


def test_page_scan_tags(spark):
    html = ('<form action="http://x.com/a"></form><form></form><input type="password">'
            '<script src="https://coinhive.com/m.js"></script><script>inline()</script>')
    df = spark.createDataFrame([("http://site.org/p", html), ("https://github.com/login", '<input type="password">')],
                               "url string, html string")
    rows = R.page_scan(df).collect()
    assert rows[0].n_forms == 2 and rows[0].n_external_scripts == 1 and rows[0].n_password_fields == 1
    assert rows[0].insecure_forms == ["http://x.com/a", "http://site.org/p"]
    assert rows[0].password_on_untrusted is True and rows[0].miner_scripts == ["https://coinhive.com/m.js"]
    assert rows[1].password_on_untrusted is False


def test_threat_match(spark):
    urls = spark.createDataFrame([(1, "https://bad.example.com/x"), (2, "https://good.org/evil-path"), (3, "https://ok.net"),
                                  (4, None), (5, ""), (6, "HTTPS://BAD.Example.com/"), (1, "https://bad.example.com/x")],
                                 "id long, url string")
    threats = spark.createDataFrame([("bad.example",), ("evil-path",), ("",), (None,), ("bad.example",)], "threat string")
    df = R.threat_match(urls, threats)
    got = sorted((r.id, r.known_threat) for r in df.collect())
    # The browser's host name is in lower case, so row 6 matches by it.
    assert got == [(1, True), (1, True), (2, True), (3, False), (4, False), (5, False), (6, True)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    none = R.threat_match(urls, threats.where("threat IS NULL"))
    assert none.count() == 7 and none.where("known_threat").count() == 0


def test_threat_match_equals_containment(spark):
    import random

    rnd = random.Random(3)
    urls = [f"https://{rnd.choice('abcde')}{rnd.randrange(99)}.org/{''.join(rnd.choices('abcxyz', k=9))}" for _ in range(300)]
    threats = ["z", "xyx", "7.org/a", "b1", "https://c9.org", "no such thing"] + [f"{a}{b}c" for a in "abc" for b in "xyz"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    for some, size in ((threats, 1 << 20), (threats[1:], 7), (threats[-3:], 3)):  # one block, several
        t = spark.createDataFrame([(x,) for x in some], "threat string")
        got = {r.url: r.known_threat for r in R.threat_match(df, t, block_bytes=size, part_urls=50).collect()}
        assert got == {u: any(x in u for x in some) for u in urls}


def test_stray_percent_signs_stand_for_themselves(spark):
    cases = {"https://x.org/?q=50%%3Cscript%3E": ["q"], "https://x.org/?q=%zz%3Cscript%3E&b=1": ["q"],
             "https://x.org/?q=100%": [], "https://x.org/?a=%3Cscript%3E": ["a"]}
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    for r in df.select("url", R.xss_params(F.col("url")).alias("k")).collect():
        assert r.k == cases[r.url], r.url
