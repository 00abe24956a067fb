import re

from doorclock.llm import urls

CASES = [
    None, "", "no scheme", "http://", "http://ORG", "http://org/", "https://a.ORG/x?y", "ftp://example.org/es/1", "http://x.example.org/en/12#f",
    "http://example.org?/es/", "http://notexample.org/es/", "http://a.com/fr/", "http://com/de/x", "http://a.com/de", "x://y://example.org/es/",
    "http://example.org:80/es/", "http://a..org/", "http://.org/", "http://a.com/de/\n/fr/", "http://A.B.C.D.com/de/" + "z" * 9000,
    "http://" + "a." * 3000 + "org/p",
]
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def by_hand(url, rules=RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    host = re.match(r"[^/?#]*", rest)[0] if rest is not None else ""
    path = re.match(r"[^?#]*", rest[len(host) :])[0] if rest is not None else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_verdicts(spark):
    df = spark.createDataFrame([(k, u) for k, u in enumerate(CASES * 2)], "page_id int, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filtered(df, urls.rule_table(spark)).collect()}
    assert got == {k: by_hand(u) for k, u in enumerate(CASES * 2)}


def test_no_rules_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "http://a.org/x", "mine", "h"), (1, None, None, None)], "page_id int, url string, rule string, _host string")
    none = spark.createDataFrame([("block", None, "/"), (None, "org", "/")], "verdict string, host string, path string")
    got = urls.filtered(df, none, default="block").collect()
    assert [(r.rule, r.verdict) for r in got] == [(None, "block")] * 2
    assert urls.filtered(df.limit(0), urls.rule_table(spark)).collect() == []


def test_block_wins_over_an_equal_allow(spark):
    both = spark.createDataFrame([("allow", "a.b", "/"), ("block", "a.b", "/")], "verdict string, host string, path string")
    df = spark.createDataFrame([(1, "http://a.b/")], "page_id int, url string")
    assert urls.filtered(df, both).first().verdict == "block"


def test_thousands_of_rule_shapes(spark):
    """Rules of 2,000 unlike shapes, and URLs that fit the longest, some, or none of them."""
    rules = [("block" if k % 3 else "allow", ".".join(["a"] * (1 + k % 20)), "/" + "p" * (k // 20)) for k in range(2000)]
    cases = [f"http://{'.'.join(['a'] * n)}/{'p' * m}?x" for n in (1, 7, 20, 30) for m in (0, 13, 99, 300)] + ["http://b/p", None]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(cases)], "page_id int, url string")
    out = urls.filtered(df, urls.rule_table(spark, rules))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == {k: by_hand(u, rules) for k, u in enumerate(cases)}
    assert len(out._jdf.queryExecution().executedPlan().toString()) < 400_000
