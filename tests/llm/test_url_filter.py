import math

import pytest

from tesserae.llm import url_filter as U
from tesserae.llm.queries import URL_RULES

PAGES = "page_id long, url string, host string, n double, bad_host string"
OUT = "page_id long, bad boolean"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", 0.0, "x") for i, u in enumerate(urls)], PAGES)


def brute_rule(host, path, rules):
    fit = [(len(h + p), a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def test_parts_and_rules(spark):
    urls = [
        "http://Example.COM/en/7x?q=1", "https://a.example.com/en/8", "http://x.net/de/", "http://b.example.net/de/81#t", "http://example.net/de/9",
        "ftp://y.org/es/", "http://xorg/es/", "no scheme", None, "http://", "http://h", "http://h?x://y/z", "http://h/p://q", "HTTP://ÄB.com/en/", "http://notexample.com/EN/7",
    ]
    got = {r.page_id: r for r in U.judge_urls(pages(spark, urls), spark.createDataFrame([], OUT), URL_RULES).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
        tail = rest[n:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        action, rule = brute_rule(host, path, URL_RULES)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, action or "allow"), u


def test_reputation_shrinks_towards_the_domain(spark):
    urls, bad = [], []
    for host, n, k in [("good.site.com", 60, 3), ("other.site.com", 40, 2), ("bad.mess.net", 60, 57), ("one.fine.org", 1, 1), ("fine.org", 80, 2), ("new.mess.net", 0, 0), ("x.mess.net", 40, 38)]:
        for j in range(max(n, 1)):
            if n:
                bad.append((len(urls), j < k))
            urls.append(f"http://{host}/p{j}")
    rows = pages(spark, urls)
    host, path = U.url_parts(rows["url"])
    rep = {r.host: r for r in U.host_reputation(rows.select("page_id", host.alias("host")), spark.createDataFrame([*bad, (10_000, True), (0, None)], OUT)).collect()}
    assert rep["bad.mess.net"].bound > 0.8 > 0.3 > rep["good.site.com"].bound
    assert rep["one.fine.org"].share < 0.6 and rep["one.fine.org"].bound < 0.3
    assert rep["new.mess.net"].n == 0 and rep["new.mess.net"].share > 0.5
    for r in rep.values():
        assert 0 <= r.share <= 1 and r.bound < r.share
    verdict = {r.host: r.verdict for r in U.judge_urls(rows, spark.createDataFrame(bad, OUT)).collect()}
    assert verdict["bad.mess.net"] == verdict["x.mess.net"] == "block" and verdict["one.fine.org"] == verdict["good.site.com"] == "allow"


def test_posterior_of_one_level_by_hand(spark):
    """One host only: all levels hold the same counts and every strength is the upper bound."""
    rows = spark.createDataFrame([(i, "a.b.c") for i in range(10)], "page_id long, host string")
    out = spark.createDataFrame([(i, i < 4) for i in range(10)], OUT)
    r = U.host_reputation(rows, out).first()
    top = 4.5 / 11
    s = (4 + 1000 * top) / 1010
    d = (4 + 1000 * s) / 1010
    h = (4 + 1000 * d) / 1010
    assert r.share == pytest.approx(h)
    assert r.bound == pytest.approx(h - 1.645 * math.sqrt(h * (1 - h) / 1011))


def test_empty_tables(spark):
    assert U.judge_urls(pages(spark, []), spark.createDataFrame([], OUT), URL_RULES).collect() == []
    with pytest.raises(ValueError):
        U.judge_urls(pages(spark, []), spark.createDataFrame([], OUT), URL_RULES * 300)


def test_two_label_suffixes_addresses_and_ports(spark):
    hosts = ["a.shop.co.uk", "shop.co.uk:8080", "co.uk", "www.x.github.io", "10.0.0.1", "10.0.0.1:80", "[::1]", "x.y.org", "localhost", ""]
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = [tuple(r) for r in rows.select(*U.split_host(rows["host"])).collect()]
    assert got == [("shop.co.uk", "co.uk"), ("shop.co.uk", "co.uk"), ("co.uk", "co.uk"), ("x.github.io", "github.io"), ("10.0.0.1", "ip"), ("10.0.0.1", "ip"), ("[::1]", "ip"), ("y.org", "org"), ("localhost", "localhost"), ("", "")]


def test_owners_under_one_suffix_do_not_share_a_domain(spark):
    urls, bad = [], []
    for host, n, k in [("evil.co.uk", 60, 58), ("worse.co.uk", 60, 57), ("good.co.uk", 60, 1), ("fine.co.uk", 60, 0), ("new.good.co.uk", 1, 0)]:
        for j in range(n):
            bad.append((len(urls), j < k))
            urls.append(f"http://{host}/p{j}")
    verdict = {r.host: r.verdict for r in U.judge_urls(pages(spark, urls), spark.createDataFrame(bad, OUT)).collect()}
    assert verdict == {"evil.co.uk": "block", "worse.co.uk": "block", "good.co.uk": "allow", "fine.co.uk": "allow", "new.good.co.uk": "allow"}


def test_repeated_and_null_pages(spark):
    rows = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x"), (None, "http://a.com/y"), (None, None)], "page_id long, url string")
    got = U.judge_urls(rows, spark.createDataFrame([(1, True), (None, True)], OUT)).collect()
    assert sorted((r.page_id or -1, r.host) for r in got) == [(-1, ""), (-1, "a.com"), (1, "a.com"), (1, "a.com")]
