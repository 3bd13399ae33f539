"""Listed rules against plain Python; what mined rules add; odd rows."""

import re

from tickloom.llm.url_rules import RULES, judge_urls, mine


def brute(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, rule in RULES:
        own, tail = rule.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, None))


URLS = [
    "http://example.org/es/1", "http://a.example.org/en/12", "http://EXAMPLE.ORG/en/2?x#y", "https://notexample.org/es/", "http://x.com/fr/1", "http://x.com/de/1", "http://com/de/", "http://x.com/fr", "http://org",
    "http://org/", "http://x.org?/a", "ftp://u@h.com:80/de/#a", "no url", "", None, "://x.com/de/", "http://x.xcom/de/", "http://a://b.org/", "http:///x"]


def test_listed(spark):
    rows = list(enumerate(URLS))
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    for d, url in rows:
        host, path, rule, verdict = brute(url)
        assert (got[d].host, got[d].path, got[d].rule) == (host, path, rule), url
        assert got[d].verdict == (verdict or got[d].verdict) and got[d].verdict in ("allow", "block")


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    given = {r.page_id: r.url for r in pages.collect()}
    got = judge_urls(pages).collect()
    assert len(got) == len(given)
    for r in got:
        host, path, rule, verdict = brute(given[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)


def test_mined(spark):
    rows = [(i, f"http://spam-{i}.net/en/{i}", "block") for i in range(60)] + [(100 + i, f"http://news-{i}.net/en/{i}", "allow") for i in range(60)]
    labels = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    pages = spark.createDataFrame([(1, "http://spam-x.net/fr/1", 5), (2, "http://news-x.net/fr/1", 5), (3, "http://other.net/", 5)], "page_id long, url string, rule int")
    assert {r.page_id: r.verdict for r in judge_urls(pages, labels=labels).collect()} == {1: "block", 2: "allow", 3: "allow"}
    rules = mine(spark.createDataFrame([(["a", "b"], "block")] * 40 + [(["b"], "allow")] * 40, "tokens array<string>, verdict string")).collect()
    assert [(r.tokens, r.verdict, r.key) for r in rules if r.verdict == "block"] == [(["a"], "block", "a")]


def test_odd_rows(spark):
    pages = spark.createDataFrame([(None, None), (1, "http://x.com/de/"), (1, "http://x.com/de/")], "page_id long, url string")
    got = judge_urls(pages).collect()
    assert len(got) == 3 and sum(r.verdict == "block" for r in got) == 2
    assert judge_urls(pages.limit(0)).collect() == []
