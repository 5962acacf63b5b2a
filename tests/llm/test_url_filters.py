import random

import pytest

from risekit.llm import queries, url_filters
from risekit.llm.url_filters import RULES, GlobAutomaton


def brute(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = ""
    for c in rest:
        if c in "/?#":
            break
        host += c.lower() if "A" <= c <= "Z" else c
    path = rest[len(host) :].split("?")[0].split("#")[0]
    fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda x: len(x[0]))[0] if fits else None


def test_against_brute_force(spark):
    r = random.Random(5)
    hosts = ["com", "example.com", "www.example.com", "a.www.example.com", "net", "x.net", "xnet", "example.org", "EXAMPLE.com", "é.net", "", ".com", "com:80"]
    paths = ["", "/", "/en/", "/en", "/es/x", "/fr/", "/x.example.com/en/", "/en/?q#f", "#/en/", "?a=://b.com/", "/" + "y" * 300]
    urls = [f"{r.choice(['http', 'https', ''])}{r.choice(['://', '://', ':/'])}{r.choice(hosts)}{r.choice(paths)}" for _ in range(600)] + [None, "", "no scheme", "a\nb://x.net/es/"]
    df = spark.createDataFrame([(i, u, "old", 1) for i, u in enumerate(urls)], "page_id long, url string, RULE string, other int")
    got = {x["page_id"]: x for x in url_filters.filter_urls(df).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule = brute(u)
        verdict = dict((h + p, v) for v, h, p in RULES).get(rule, "allow")
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict), u


def test_many_rules_cross_words():
    rules = [("block", f"site{i}.example", f"/part{i}/") for i in range(40)]
    a = GlobAutomaton(rules)
    assert len(a.first) > 10
    urls = [f"w.site{i}.example/part{i}/x".encode() for i in range(40)] + [b"site1.example/part2/", b""]
    assert a.match(urls).tolist() == [*range(40), -1, -1]


def test_columns_of_any_name_come_through(spark):
    df = spark.createDataFrame([("http://x.net/es/", 1.5, "kept")], "url string, __rule double, Rule_Number string")
    got = url_filters.filter_urls(df)
    assert [tuple(r) for r in got.collect()] == [("http://x.net/es/", 1.5, "kept", "x.net", "/es/", "net/es/", "block")]


def test_empty_table(spark):
    assert url_filters.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(compare, name):
    ours, theirs = compare(queries.queries()[name], queries.oracle_sql()[name])
    assert ours == theirs and ours
