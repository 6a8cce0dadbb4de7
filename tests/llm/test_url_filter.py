import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlink.llm import url_filter
from kinlink.llm.url_filter import Rule

PAGE = "page_id long, url string, html string"


def place(url):
    m = re.match(r"(?s)\A.*?://([^/?#]*)([^?#]*)", url or "")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (m[1].translate(lower), m[2]) if m else ("", "")


def rule_for(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


URLS = [
    "http://a.example.com/en/7", "http://example.com/en/71", "http://EXAMPLE.com/en/8", "https://com/en/", "http://notcom/en/", "http://x.net/de/8", "http://example.net/de/8", "http://m.example.net/de/81?x=http://b.org/es/",
    "http://b.org/es/", "http://b.org/es", "http://b.org?q", "http://b.org#f", "none", None, "", "a://b://c/d", "http://É.com/en/\n", "ftp://u@h.org:80/es/", "http:///en/7",
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(URLS)], PAGE)
    for r in url_filter.url_filter_digest(pages).collect():
        host, path = place(URLS[r.page_id])
        rule = rule_for(host, path, url_filter.RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.text)
        if rule:
            assert r.verdict == rule.verdict


def test_many_rules_give_the_same(spark):
    rules = (*url_filter.RULES, Rule("block", "example.com/"), Rule("allow", "a.example.com/en/"), Rule("block", "b.org"))
    rows = spark.createDataFrame([place(u) for u in URLS], "host string, path string")
    one, two = (sorted(map(tuple, f(rows, rules).select("host", "path", "rule", "rule_verdict").collect()), key=str) for f in (url_filter.match_inline, url_filter.match_joined))
    assert one == two


def pagerank(links, seeds, damping=0.85, rounds=200):
    nodes = sorted({n for e in links for n in e} | set(seeds))
    at = {n: k for k, n in enumerate(nodes)}
    s = np.zeros(len(nodes))
    for n, v in seeds.items():
        s[at[n]] = v / sum(seeds.values())
    out = {n: [b for a, b in links if a == n] for n in nodes}
    r = s
    for _ in range(rounds):
        then = (1 - damping) * s + damping * s * sum(r[at[n]] for n in nodes if not out[n])
        for n, targets in out.items():
            for b in targets:
                then[at[b]] += damping * r[at[n]] / len(targets)
        r = then
    return {n: r[at[n]] for n in nodes}


def test_spread_against_power_iteration(spark):
    links = {(f"h{a}", f"h{b}") for a in range(12) for b in ((a * 5 + 1) % 12, (a * 7 + 3) % 12, 0) if a != b}
    good, bad = {"h1": 3, "h2": 1}, {"h5": 2}
    table = [(k, *e) for k, kind in (("trust", links), ("distrust", {(b, a) for a, b in links})) for e in kind]
    seeds = [("trust", h, v / 4) for h, v in good.items()] + [("distrust", "h5", 1.0)]
    got = url_filter.spread(spark.createDataFrame(table, "kind string, src string, dst string"), spark.createDataFrame(seeds, "kind string, host string, share double"))
    got = {(r.kind, r.host): r.score for r in got.collect()}
    for kind, edges, start in (("trust", links, good), ("distrust", {(b, a) for a, b in links}, bad)):
        for host, score in pagerank(edges, start).items():
            assert got.get((kind, host), 0.0) == pytest.approx(score, abs=3e-6)


def test_long_chain_is_scored_to_its_end(spark):
    """Scores travel as far as the links do, and a verdict 60 links away from the only seed still follows from it."""
    link = '<a href="http://h{}.org/">x</a>'.format
    pages = [(k, f"http://h{k}.org/", link(k + 1)) for k in range(60)] + [(60, "http://h60.org/", None), (61, "http://bad.org/", link(0))]
    edges = [("trust", f"h{k}.org", f"h{k + 1}.org") for k in range(60)]
    seeds = spark.createDataFrame([("trust", "h0.org", 1.0)], "kind string, host string, share double")
    got = {r.host: r.score for r in url_filter.spread(spark.createDataFrame(edges, "kind string, src string, dst string"), seeds).collect()}
    want = pagerank({e[1:] for e in edges}, {"h0.org": 1}, rounds=600)
    assert len(got) == 61 and all(abs(got[h] - want[h]) < 1e-5 and got[h] > 0 for h in want)
    judged = url_filter.filter_urls(spark.createDataFrame(pages, PAGE), (Rule("block", "h60.org"),)).collect()
    assert all(r.verdict == "block" for r in judged)


def test_query_against_sql(spark):
    import duckdb

    urls = [*URLS, "http://a.net/de/1", "http://a.net/x", "http://a.net/y", "http://b.com/en/x", "http://b.com/", "https://example.net/de/81", "https://example.net/de/82", "https://example.net/de/1", "https://example.net/q"]
    pages = spark.createDataFrame([(k, u, '<a href="/own">x</a><i data-href="http://bad.org/">') for k, u in enumerate(urls)] + [(3, "http://a.net/x", None)], PAGE)
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    got = sorted(map(tuple, url_filter.url_filter_digest(pages).collect()), key=str)
    assert got == sorted(con.sql(url_filter.ORACLE).fetchall(), key=str)
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}


def test_verdicts_follow_the_graph(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">y</a>' for h in hosts)
    rules = (Rule("allow", "good.org"), Rule("block", "bad.org"))
    pages = [
        (1, "http://good.org/", link("friend.net")),
        (2, "http://bad.org/", link("victim.net")),
        (3, "http://friend.net/a", None),
        (4, "http://farm.net/a", link("BAD.org", "farm.net")),
        (5, "http://victim.net/", ""),
        (6, "http://lonely.net/", link("lonely.net")),
        (7, None, link("bad.org")),
    ]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(pages, PAGE), rules).collect()}
    assert {k: r.verdict for k, r in got.items()} == {1: "allow", 2: "block", 3: "allow", 4: "block", 5: "allow", 6: "allow", 7: "allow"}
    assert got[3].trust > 0 and got[4].distrust > 0 and got[6].trust == got[6].distrust == 0


def test_repeats_columns_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://x.org/es/1", None)] * 2, PAGE).withColumns({"host": F.lit(1), "verdict": F.lit(2), "more": F.lit(3)})
    got = url_filter.filter_urls(pages).collect()
    assert [(r.host, r.verdict, r.more) for r in got] == [("x.org", "block", 3)] * 2
    assert url_filter.url_filter_digest(spark.createDataFrame([], PAGE)).count() == 0
