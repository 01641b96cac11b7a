"""URL verdicts against a plain loop over links declared, measured and given by convention."""

import re
from collections import defaultdict
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from plumbline.llm import components, url_filter

PAGES = "page_id long, url string, html string"


def link(href, rel="canonical"):
    return f'<html><head><link rel="{rel}" href="{href}"></head></html>'


def host_path(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")


def rule_of(url):
    host, path = host_path(url)
    fits = [(len(r), r, a) for r, a in url_filter.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits and host else (None, None)


def normal(url):
    host, path = host_path(url)
    host = re.sub(r"^www\.", "", re.sub(r":(80|443)$", "", host))
    path = re.sub(r"/+$", "", re.sub(f"(?i){url_filter.INDEX_FILES}", "/", path))
    asked = re.search(r"\?([^#]*)", url)
    kept = "&".join(p for p in (asked[1].split("&") if asked else []) if p and not re.match(f"(?i)^{url_filter.TRACKING}(=|$)", p))
    return f"http://{host}{path}" + (f"?{kept}" if kept else "")


def brute(rows, redirects=()):
    """rows: page_id, url, declared absolute targets"""
    links, nodes = set(), set()

    def add(a, b):
        links.add((a.split("#")[0], b.split("#")[0]))

    def known(url):
        nodes.add(url.split("#")[0])
        add(url, normal(url))
        nodes.add(normal(url))

    for _, url, targets in rows:
        if host_path(url)[0]:
            known(url)
            for t in targets:
                known(t)
                add(url, t)
    for a, b in redirects:
        known(a)
        known(b)
        add(a, b)
    group = {n: n for n in nodes}

    def top(n):
        while group[n] != n:
            n = group[n]
        return n

    for a, b in links:
        group[top(a)] = top(b)
    decisions = defaultdict(set)
    for n in nodes:
        if rule_of(n)[1]:
            decisions[top(n)].add(rule_of(n)[1])
    out = []
    for page_id, url, _ in rows:
        rule, action = rule_of(url)
        host, path = host_path(url)
        if action is None:
            action = "block" if host and decisions[top(url.split("#")[0])] == {"block"} else "allow"
        out.append((page_id, host, path, rule, action))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in df.collect()), key=str)


def run(spark, rows, schema=PAGES, redirects=None):
    pages = spark.createDataFrame(rows, schema) if isinstance(rows, list) else rows
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(url_filter, "table", lambda *_: pages)
        if redirects is None:
            return found(url_filter.op11_url_filter(spark, ""))
        return found(url_filter.judged(pages, url_filter.rule_table(spark, url_filter.RULES), redirects))


CASES = [
    (1, "https://a.example.org/es/x", "", []),
    (2, "https://mirror.net/x", link("https://a.example.org/es/x"), ["https://a.example.org/es/x"]),  # blocked by way of a canonical link
    (3, "http://www.mirror.net/x/#top", "", []),  # the same resource by convention
    (4, "https://mirror.net/x?utm_source=feed", "", []),
    (5, "https://mirror.net/x?page=2", "", []),  # another resource
    (6, "https://both.net/", link("https://shop.com/de/") + '<meta http-equiv="refresh" content="0; url=https://shop.com/fr/">', ["https://shop.com/de/", "https://shop.com/fr/"]),  # allow goes first
    (7, "https://shop.com/de/", "", []),  # a rule of its own holds
    (8, "https://rel.net/a/b/", link("../../c/./d"), ["https://rel.net/c/d"]),
    (9, "https://rel.net/c/d", link("https://shop.com/de/z"), ["https://shop.com/de/z"]),
    (10, "https://rel.net/c/d", None, []),
    (11, "https://example.org/en/1", "", []),
    (12, "https://EXAMPLE.org/en/12?q#f", "", []),
    (13, "https://notexample.org/en/1", "", []),
    (14, None, link("https://shop.com/de/"), []),
    (15, "no scheme", link("https://shop.com/de/"), []),
    (16, "", "", []),
    (17, "https://commented.net/", "<!-- " + link("https://shop.com/de/") + " --><script>'" + link("https://shop.com/de/") + "'</script>", []),
    (18, "https://org", "", []),
    (19, "https://org/", "", []),
    (20, "https://x.net/" + "y" * 50_000, "", []),
    (21, "https://" + ".".join("a" * 20_000) + ".com/de/", "", []),
    (22, "x://u@deep.com/fr/://z", "", []),
    (None, "https://mirror.net/x", "", []),
    (2, "https://mirror.net/x", link("https://a.example.org/es/x"), ["https://a.example.org/es/x"]),
    (23, "https://style.net/", link("https://shop.com/de/", "stylesheet"), []),
    (24, "https://mail.net/", link("mailto:a@shop.com"), []),
]


def test_cases_against_a_plain_loop(spark):
    rows = [c[:3] for c in CASES]
    got = run(spark, spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("clash") for c in ("node", "host", "path", "rule", "action", "key", "class", "targets", "a", "b")}))
    assert got == brute([(i, u, t) for i, u, _, t in CASES])
    verdict = {r[0]: r[4] for r in got}
    assert [verdict[i] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == ["block", "block", "block", "block", "allow", "allow", "block", "block", "block"]


def test_given_pages_and_empty(spark):
    rows = [(r.page_id, r.url, []) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    assert found(url_filter.op11_url_filter(spark, "/root/testdata/sf0.001")) == brute(rows)
    assert run(spark, []) == []


def test_redirects_final_urls_and_long_chains(spark):
    chain = [(f"https://n{i}.net/p", f"https://n{i + 1}.net/p") for i in range(40)] + [("https://n40.net/p", "https://shop.com/de/")]
    rows = [(i, f"https://n{i}.net/p", "", None) for i in range(0, 41, 7)] + [(90, "https://moved.net/", "", "https://n3.net/p"), (91, "https://stays.net/", "", None)]
    got = run(spark, rows, PAGES + ", final_url string", spark.createDataFrame([*chain, (None, "https://shop.com/de/")], "src string, dst string"))
    assert got == brute([(i, u, [f] if f else []) for i, u, _, f in rows], chain)
    assert {r[0]: r[4] for r in got} == {**{i: "block" for i in (*range(0, 41, 7), 90)}, 91: "allow"}


def test_hub_of_a_third_of_all_links(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB_SHARE", 10)
    hub = [(0, i) for i in range(100, 200)] + [(i, i + 1) for i in range(300, 330)] + [(150, 300), (500, 501), (501, 501)]
    got = {r.doc: r["class"] for r in components.components(spark.createDataFrame(hub, "a long, b long"), "test").collect()}
    assert got == {**dict.fromkeys([0, *range(100, 200), *range(300, 331)], 0), 500: 500, 501: 500}


def test_resolved_like_the_library(spark):
    href = ["../x", "./", "/a/../b", "?q=1", "x/y#z", "//o.net/p", ""]
    base = "https://h.net/a/b/c"
    rows = [(i, base, link(h)) for i, h in enumerate(href)]
    got = spark.createDataFrame(rows, PAGES).select("page_id", url_filter.declared_targets(F.col("url"), F.col("html")).alias("t")).collect()
    assert {r.page_id: r.t for r in got} == {i: [urljoin(base, h).split("#")[0]] if h else [] for i, h in enumerate(href)}
