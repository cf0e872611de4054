import re

import pytest
from hypothesis import given, settings, strategies as st

from evigraph.llm import url_filters as U

LOW = str.maketrans(U.UPPER, U.LOWERED)
URLS = [
    None, "", "no scheme/net/", "http://a.net/x", "https://A.Example.NET/en/1", "http://example.net/en", "http://notexample.net/en/x", "http://example.com/de/1", "http://x.example.com/de/?q#f",
    "http://sub.org/fr/2", "http://a.org", "http://a.net", "http://a.net?x", "http://ads.host.com/x", "http://host.com/ads/policy", "http://host.com/ads/1", "http://h.com/a.zip", "http://h.com/a.zip?x",
    "http://h.com/?page=2&ref=x", "http://analytics.example.org/x", "http://doubleclick.foo/", "ftp://x://y.net/z", "http://é.net/é", "://", "http://net/", "http://a.NET/\nb", "http://h.com/" + "long/" * 20_000,
]


def brute(url, rules):
    """Every rule's expression on every URL."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0].translate(LOW)
        path = re.split("[?#]", rest[len(host) :])[0]
    fit = []
    for r in rules:
        if r.kind == "host" and url is not None and "://" in url:
            h, _, p = r.text.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fit.append(r)
    if fit:
        best = max(fit, key=lambda r: (len(r.text), r.text))
        return host, path, best.text, best.verdict
    low = (url or "").translate(LOW)
    kinds = {r.kind for r in rules if r.kind != "host" and url is not None and re.search(r.regex, low)}
    return host, path, None, "allow" if "allow" in kinds or "block" not in kinds else "block"


def test_matches_plain_python(spark):
    rules = U.standard_rules()
    df = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(URLS + URLS)], "page_id long, url string, verdict string, extra int")
    out = U.judge(df)
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect())
    assert got == [(i, *brute(u, rules)) for i, u in enumerate(URLS + URLS)]
    assert "extra" in out.columns


def test_index_never_loses_a_rule(spark):
    """A URL that a rule's expression fits holds the rule's tokens whole."""
    for r in U.standard_rules():
        for u in filter(None, URLS):
            low = u.translate(LOW)
            place = "".join(brute(u, [])[:2]) if r.kind == "host" else low
            if re.search(r.regex, place):
                assert set(r.tokens) <= set(re.findall("[a-z0-9]+", low)), (r, u)


@given(st.text("ab1./", min_size=1, max_size=8), st.text("ab1./?=", max_size=20))
@settings(max_examples=300, deadline=None)
def test_pattern_tokens_are_whole(pattern, url):
    rule = U.pattern_rule(pattern)
    if re.search(rule.regex, url):
        assert set(rule.tokens) <= set(re.findall("[a-z0-9]+", url))


@pytest.mark.parametrize("limit", [0, 100_000])
def test_many_rules_with_and_without_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(U, "BROADCAST_RULES", limit)
    rules = [U.host_rule(f"h{i}.com/p{i % 3}/", "block" if i % 2 else "allow") for i in range(300)] + [U.pattern_rule(f"/w{i}/") for i in range(50)] + [U.pattern_rule("zz*")]
    urls = [f"http://s.h{i}.com/p{i % 3}/x" for i in range(40)] + [f"http://k.org/w{i}/" for i in range(60)] + ["http://k.org/azzb"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in U.judge(df, rules).orderBy("page_id").collect()]
    assert got == [brute(u, rules) for u in urls]


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert U.judge(df.limit(0)).count() == 0
    assert U.judge(df, []).first().verdict == "allow"


def test_no_python_in_the_plan(spark):
    df = spark.range(3).selectExpr("id AS page_id", "concat('http://a.net/', id) AS url")
    assert not re.search("Python|Pandas|Arrow|Cartesian", U.judge(df)._jdf.queryExecution().executedPlan().toString())


def test_rules_from_a_table_and_columns_of_any_name(spark):
    table = spark.createDataFrame([("net/", "block"), ("example.net/en/", "allow"), ("/ads/", None), ("@@/ads/policy", None), (None, "block"), ("net/", "block")], "rule string, verdict string")
    rules = [U.host_rule("net/", "block"), U.host_rule("example.net/en/", "allow"), U.pattern_rule("/ads/"), U.pattern_rule("@@/ads/policy")]
    names = ("best", "allow", "block", "best_", "allow_", "block_", "token", "place", "kind", "length", "regex", "spread", "url_of", "h.t")
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr("*", *(f"page_id + {k} AS `{x}`" for k, x in enumerate(names)), "map(1, 2) AS m")
    out = U.judge(df, table)
    rows = out.orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in rows] == [brute(u, rules) for u in URLS]
    assert out.columns == [*df.columns, "host", "path", "rule", "verdict"] and all(r[x] == r.page_id + k for r in rows for k, x in enumerate(names))


def test_long_urls_and_many_nulls(spark):
    long = "http://a.net/" + "x/" * 500_000 + "ads/" + "." * 500_000
    df = spark.createDataFrame([(i, None) for i in range(200)] + [(200, long), (201, "http://" + "a." * 300_000 + "net/")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in U.judge(df).collect()}
    assert len(got) == 202 and got[200] == got[201] == "block" and {got[i] for i in range(200)} == {"allow"}
