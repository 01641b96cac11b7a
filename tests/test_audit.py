"""The audit engine on small inline frames, and its queries against DuckDB."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.functions import copy, images, scoring, urls
from plumbline.operators import blocks, crawl, graph, links, mail, media, probes, rules, scores, structured, vitals
from plumbline.operators.records import page_links, page_records
from plumbline.plans import catalog
from plumbline.sources import sinks, tables
from plumbline.streaming import arrivals

HTML = """<!DOCTYPE html><html lang="en"><head><title> A  title </title><meta name="description" content="What it is"><link rel="canonical" href="/x/">
<meta property="og:title" content="T"><script type="application/ld+json">{"@context":"https://schema.org","@type":"Product","name":""}</script></head>
<body class="menu"><nav><a href="/a/">Home page</a></nav><main><h1>Head</h1><p>We recieve <b>the the</b> parcel  twice (once.</p><img src="http://e.com/i-300x200.png"><a href="../b/?q=1#f"></a></main></body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    return page_records(spark.createDataFrame([(1, "https://www.e.com/x/y/", HTML), (2, "https://e.com/", None)], "page_id long, url string, html string"))


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


def test_record(page):
    r = page.filter("page_id = 1").first()
    assert (r.site, r.title, r.meta_description, r.lang, r.h1, r.canonical) == ("e.com", "A title", "What it is", "en", ["Head"], "https://www.e.com/x/")
    assert (r.img_no_alt, r.img_no_dims, r.mixed_content, r.links_no_anchor_text, r.status) == (1, 1, ["http://e.com/i-300x200.png"], 1, None)
    none = page.filter("page_id = 2").first()
    assert (none.title, none.word_count, none.h1_count) == (None, 0, 0)


@pytest.mark.parametrize(
    "url, want",
    [("HTTPS://E.com/A", "https://e.com/A/"), ("https://e.com", "https://e.com/"), ("https://e.com/a.html?q#f", "https://e.com/a.html"), ("https://e.com/a/?q=1", "https://e.com/a/")],
)
def test_normalise(spark, url, want):
    assert one(spark, urls.normalise(F.lit(url))) == want


def test_url_functions(spark):
    assert one(spark, urls.image_identity(F.lit("https://E.com/_next/image?url=%2Fflag-300x200.webp&w=32"))) == "https://e.com/flag.webp"
    assert one(spark, urls.same_site(F.lit("https://www.e.com/"), F.lit("e.com"))) and not one(spark, urls.same_site(F.lit("https://a.e.com/"), F.lit("e.com")))
    assert one(spark, urls.is_feed_item(F.lit("https://e.com/blog/p/"))) and not one(spark, urls.is_feed_item(F.lit("https://e.com/blog/")))
    assert one(spark, urls.lookup_hosts(F.lit("www.co.uk"))) == ["www.co.uk"]
    assert one(spark, urls.refusal(F.lit(403), F.create_map(F.lit("cf-mitigated"), F.lit("challenge")), F.lit("")))["vendor"] == "Cloudflare"
    assert one(spark, urls.refusal(F.lit(500), F.create_map(F.lit("cf-mitigated"), F.lit("challenge")), F.lit(""))) is None


def test_copy_rules(spark):
    found = {(s.kind, s.detail.split(":")[0]) for s in one(spark, copy.copy_signals(F.lit("We recieve the the parcel  twice (once. TODO pricing.If &nbsp; Authorize.Net")))}
    assert {k for k, _ in found} == {"misspelling", "doubled-word", "punctuation", "placeholder", "entity"}
    assert one(spark, copy.copy_signals(F.lit("That that is fine, to do: nothing. example.com"))) == []


def test_blocks():
    assert [(b[2], b[3], b[4]) for b in blocks.blocks_of(HTML)] == [("body", "h1", "Head"), ("body", "p", "We recieve the the parcel twice (once.")]


def test_curves(spark):
    rows = spark.createDataFrame([(1200.0,), (2400.0,), (None,)], "v double").select(scoring.lognormal_score(1200, 2400)(F.col("v")).alias("s")).collect()
    assert [r.s if r.s is None or math.isnan(r.s) else round(r.s, 6) for r in rows[:2]] == [0.9, 0.5] and rows[2].s is None
    assert one(spark, scoring.ramp(F.lit(0.95), 0.9, 1.0)) == pytest.approx(0.5) and one(spark, scoring.ramp(F.lit(None).cast("double"), 0.9, 1.0)) is None
    assert one(spark, scoring.band(F.lit(79.6)))["word"] == "needs work"


def test_images(spark):
    assert images.candidates_of("/a,b.jpg 640w, /c.jpg 2x, /d.jpg") == [{"url": "/a,b.jpg", "width": 640.0, "density": None}, {"url": "/c.jpg", "width": None, "density": 2.0}, {"url": "/d.jpg", "width": None, "density": None}]
    assert images.slot_of("(max-width: 600px) 100vw, calc(50vw - 20px)") == 700 and images.media_matches("(hover: hover)") is None and images.media_matches("not print") is True


def test_graph(spark):
    nodes = spark.createDataFrame([("s", u) for u in "habcdx"], "site string, url string")
    edges = spark.createDataFrame([("s", "h", "a"), ("s", "a", "b"), ("s", "b", "c"), ("s", "c", "d"), ("s", "d", "d"), ("s", "a", "h")], "site string, src string, dst string")
    home = spark.createDataFrame([("s", "h")], "site string, url string")
    got = {r.url: (r.link_class, r.reach, r.depth) for r in graph.classify(graph.inbound_counts(nodes, edges), graph.bfs_depth(nodes, edges, home), home).collect()}
    assert got == {"h": ("single_inbound", "near", 0), "a": ("single_inbound", "near", 1), "b": ("single_inbound", "near", 2), "c": ("single_inbound", "near", 3), "d": ("single_inbound", "deep", 4), "x": ("true_orphan", "unreachable", None)}


def test_unmeasured_frames_stay_silent(page):
    ids = {r.finding for r in rules.run(rules.Frames(page)).select("finding").distinct().collect()}
    assert {"MET-12", "CNT-09", "MED-01", "MED-03"} <= ids and not any(i.startswith(("MAIL", "REP", "ORP-01", "SDV")) for i in ids)
    assert len(rules.RULES) == 86


def test_mail(spark):
    domains = spark.createDataFrame([("s", "a.com"), ("s", "b.com"), ("s", "c.com")], "site string, domain string")
    answers = spark.createDataFrame(
        [("a.com", "TXT", ["v=spf1 include:x.net include:x.net mx ~all"]), ("x.net", "TXT", ["v=spf1 a include:a.com include:x.net -all"]), ("b.com", "TXT", []), ("c.com", "TXT", None), ("a.com", "MX", ["0 ."]), ("_dmarc.a.com", "TXT", ["v=DMARC1; p=quarantine; rua=mailto:x"])],
        "name string, rtype string, values array<string>",
    )
    got = {r.domain: r for r in mail.mail_records(domains, answers).collect()}
    assert (got["a.com"].spf_cost, got["a.com"].spf_all, got["a.com"].mx_null, got["a.com"].dmarc_policy) == (9, "~", True, "quarantine")
    assert got["b.com"].spf_present is False and got["c.com"].spf_present is None


def test_robots_and_blocklists(spark):
    bodies = spark.createDataFrame([("ai", "User-agent: GPTBot\nDisallow: /\n\nUser-agent: *\nAllow: /"), ("all", "User-agent: a\nUser-agent: *\nDisallow: / # no"), ("but", "User-agent: *\nDisallow: /\nAllow: /x")], "site string, body string")
    got = {r.site: r.blocks for r in probes.robots_groups(bodies).groupBy("site").agg(F.bool_or("blocks_search").alias("blocks")).collect()}
    assert got == {"ai": False, "all": True, "but": False}
    for address, want in (([], "clean"), (["127.0.1.4"], "listed"), (["127.0.1.150"], "advisory"), (["127.255.255.254"], "refused"), (["10.0.0.1"], "refused"), (None, None)):
        assert one(spark, probes.blocklist_verdict(F.lit("dbl.spamhaus.org"), F.lit(address).cast("array<string>") if address is None else F.array(*map(F.lit, address)).cast("array<string>"))) == want


def test_scores(spark):
    rows = [("s", "title_present", "metadata", 5.0, 1.0), ("s", "h1", "metadata", 4.0, None), ("s", "indexable", "indexability", 8.0, 0.5)]
    groups = scores.group_scores(spark.createDataFrame(rows, "site string, metric string, group string, weight double, score double"))
    seo = scores.seo_category(groups)
    assert seo.first().score == pytest.approx((100 * 20 + 50 * 24) / 44)
    gated = spark.createDataFrame([("s", "noindex", 25)], "site string, gate string, cap int")
    r = scores.overall(seo, None, gated).first()
    assert (r.overall, r.band) == (25.0, "critical") and r.raw > 70


def test_vitals_take_the_median_page(spark):
    rows = [("s", str(i), 200, 500.0, lcp, tbt, cls) for i, (lcp, tbt, cls) in enumerate(((9000.0, 10.0, 0.0), (500.0, 2000.0, 0.0), (500.0, 10.0, 2.0)))] + [("s", "r", 403, 1.0, 1.0, 1.0, 0.0)]
    got = vitals.site_vitals(vitals.page_scores(spark.createDataFrame(rows, "site string, url string, status int, fcp double, lcp double, tbt double, cls double"))).first()
    assert got.pages == 3 and got.score < 0.8


def test_structured_data(spark, page):
    issues = structured.schema_issues(structured.jsonld_nodes(page), structured.vocabulary(spark))
    assert {(r.code, r.prop) for r in issues.filter("layer = 'schema'").collect()} == {("empty-value", "name")}
    assert ("missing-required", "name") in {(r.code, r.prop) for r in issues.collect()}
    broken = structured.nodes_of('{"a": ', 0)
    assert broken[0][-1] == "json-parse"


def ld(body):
    return '{"@context":"https://schema.org",' + body + "}"


# blocks of a page and its issues, recommendations left out: code, type, property, level, nodes
SCHEMA_PAGES = [
    # an offer is held to product prices inside a product alone
    ([ld('"@type":"Product","name":"p","offers":{"@type":"Offer","price":1}')], {("missing-required", "Offer", "priceCurrency", "error", 1)}),
    ([ld('"@type":"Service","name":"s","offers":{"@type":"Offer"}'), ld('"@type":"Offer"')], {("property-not-on-type", "Service", "offers", "warning", 1)}),
    # one node told twice; the address of the one and the name of the other
    ([ld('"@type":"LocalBusiness","@id":"#b","name":"n"'), ld('"@type":"LocalBusiness","@id":"#b","address":"a"')], {("id-merged", "LocalBusiness", "", "info", 1)}),
    ([ld('"@type":"LocalBusiness","@id":"#b","name":"n"'), ld('"@type":"LocalBusiness","@id":"#c","address":"a"')], {("missing-required", "LocalBusiness", "address", "error", 1), ("missing-required", "LocalBusiness", "name", "error", 1)}),
    ([ld('"@type":"Organization","@id":"#b","name":"n","priceRange":"x"'), ld('"@type":"LocalBusiness","@id":"#b","name":"n","address":"a"')], {("id-merged", "LocalBusiness/Organization", "", "info", 1)}),
    # a slot asks for what it expects, a pointer for nothing
    ([ld('"@type":"Service","name":"s","provider":{"@type":"LocalBusiness","name":"n","telephone":"1"}')], set()),
    ([ld('"@type":"Service","name":"s","provider":{"@type":"Organization","@id":"#x","url":"https://e.com/"}')], set()),
    ([ld('"@type":"Service","name":"s","provider":{"@type":"Organization","url":"https://e.com/"}')], {("missing-required", "Organization", "name", "error", 1)}),
    # lists
    ([ld('"@type":"OfferCatalog","name":"c","numberOfItems":3,"itemListElement":[{"@type":"Offer","position":1},{"@type":"Offer","position":2}]')], {("list-count", "OfferCatalog", "numberOfItems", "info", 1), ("list-item-position", "Offer", "position", "warning", 2)}),
    ([ld('"@type":"ItemList","itemListElement":[{"@type":"ListItem","name":"i"}]')], {("missing-required", "ListItem", "position", "error", 1)}),
    # values and references
    ([ld('"@type":"Article","headline":"h","author":{"@type":"Offer"},"publisher":"Some name","mainEntity":{"@id":"#none"}')], {("value-type", "Article", "author", "warning", 1), ("value-type", "Article", "publisher", "warning", 1), ("unresolved-id", "Article", "mainEntity", "info", 1)}),
    ([ld('"@type":"Article","headline":"h","publisher":"https://e.com/#org"')], set()),
    ([ld('"@type":"ItemList","numberOfItems":1.5,"url":"/x"')], {("invalid-number", "ItemList", "numberOfItems", "warning", 1), ("list-count", "ItemList", "numberOfItems", "info", 1), ("relative-url", "ItemList", "url", "warning", 1)}),
    ([ld('"@type":"WebSite","url":"https://e.com/","description":[]'), ld('"@type":"Product","name":"p","brand":{}')], {("empty-value", "WebSite", "description", "info", 1), ("empty-value", "Product", "brand", "warning", 1)}),
    ([ld('"@type":"Product","name":{"@type":"Person","name":"n"}')], {("value-type", "Product", "name", "error", 1)}),
    ([ld('"@type":"WebSite","url":"https://e.com/","potentialAction":{"@type":"SearchAction","target":"t","query-input":"q","x:y":1}')], set()),
    ([ld('"@graph":[1,{"@type":"Person","name":"n"}]'), "", "{"], {("not-an-object", "", "", "error", 1), ("empty-block", "", "", "error", 1), ("json-parse", "", "", "error", 1)}),
]


def test_structured_data_of_a_page(spark):
    pages = spark.createDataFrame([("s", str(i), blocks) for i, (blocks, _) in enumerate(SCHEMA_PAGES)], "site string, url string, jsonld array<string>")
    issues = structured.schema_issues(structured.jsonld_nodes(pages), structured.vocabulary(spark)).filter("code <> 'missing-recommended'").collect()
    for i, (_, want) in enumerate(SCHEMA_PAGES):
        assert {(r.code, r.type, r.prop, r.level, r.n) for r in issues if r.url == str(i)} == want, i


def test_records_are_judged_where_they_are_read(spark):
    blocks = [list(b) for b, _ in SCHEMA_PAGES]
    pages = spark.createDataFrame([("s", str(i), b) for i, b in enumerate([*blocks, None, [*blocks[0], None]])], "site string, url string, jsonld array<string>")
    found = structured.record_issues(pages, structured.vocabulary(spark))
    columns = ["site", "url", "type", "prop", "code", "level", "layer", "path", "n"]
    want = structured.schema_issues(structured.jsonld_nodes(pages.filter(F.col("url") < len(blocks))), structured.vocabulary(spark)).select(*columns).collect()
    assert sorted(found.filter(F.col("url") < len(blocks)).select(*columns).collect()) == sorted(want)
    assert {r[2:] for r in found.filter(F.col("url") == str(len(blocks) + 1)).collect()} == {r[2:] for r in found.filter("url = '0'").collect()}
    # nothing meets in a shuffle, and two records of one URL are two pages
    assert "Join" not in found.groupBy("code").count()._jdf.queryExecution().executedPlan().toString()
    twice = structured.record_issues(pages.filter("url = '1'").withColumn("i", F.explode(F.array(F.lit(1), F.lit(2)))), structured.vocabulary(spark))
    assert twice.filter("code = 'property-not-on-type'").agg(F.sum("n")).first()[0] == 2


def test_structured_data_advice_follows_the_feature(spark):
    pages = spark.createDataFrame([("s", "u", [ld('"@type":"Product","name":"p","offers":{"@type":"Offer","price":1,"priceCurrency":"EUR"},"author":{"@type":"Organization","name":"n"}')])], "site string, url string, jsonld array<string>")
    asked = structured.schema_issues(structured.jsonld_nodes(pages), structured.vocabulary(spark)).filter("code = 'missing-recommended'").collect()
    assert {(r.type, r.prop) for r in asked} == {("Product", p) for p in ("image", "description", "brand", "sku", "aggregateRating")} | {("Offer", "availability"), ("Offer", "url")}


def test_words_are_cut_out_of_texts_once(spark, tmp_path):
    rows = [(i, "the wheels of the town", "a", "en", 22) for i in range(150)] + [(150, "teh wheel of Teh town's wheels's wHeels", "b", "en", 30), (151, None, "b", "en", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES["spelling_suggestions"](spark, str(tmp_path))
    assert {(r.site, r.url, r.word, r.n, tuple(r.suggestions)) for r in found.collect()} == {("b", "150", "teh", 2, ("the",)), ("b", "150", "wheel", 1, ("wheels",))}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("Relation [") <= 3


def test_spelling(spark):
    words = spark.createDataFrame([("s", "u", "teh", 1, True), ("s", "u", "qwzx", 1, True), ("s", "u", "the", 1, True), ("s", "u", "dogs's", 1, True)], "site string, url string, word string, n long, lower boolean")
    dictionary = spark.createDataFrame([("the", 100), ("ten", 10), ("dogs", 5)], "word string, frequency long")
    assert {r.word: r.suggestions for r in blocks.spelling(words, dictionary).collect()} == {"teh": ["the", "ten"]}


def test_spelling_judges_every_word_outside_the_dictionary(spark, tmp_path):
    for copies in (1, 20):  # the same shares give the same words at every size
        texts = (["they receive the parcel"] * 5 + ["they recieve teh parcel"] + ["other words here"] * 194) * copies
        spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"file://{tmp_path}/{copies}/documents.parquet")
        got = catalog.spelling_suggestions(spark, f"file://{tmp_path}/{copies}").collect()
        assert {r.word: r.suggestions for r in got} == {"recieve": ["receive"], "teh": ["the"]} and len(got) == 2 * copies


def test_copy_rules_look_at_blocks(spark, tmp_path):
    html = "<html><body><h1>EVERYTHING ABOUT OUR DELIVERY SERVICE</h1><p>We bring (parcels to you.</p><p>They arrive) in a day.</p></body></html>"
    page = page_records(spark.createDataFrame([(1, "https://e.com/", html)], "page_id long, url string, html string"))
    assert {r.kind for r in rules.page_signals(page).collect()} == {"style", "punctuation"}
    text = "EVERYTHING ABOUT OUR DELIVERY SERVICE\nWe bring (parcels to you.\nThey arrive) in a day."
    spark.createDataFrame([(1, text, "s"), *((i, "they arrive", "s") for i in range(2, 50)), (50, "they arive", "s")], "doc_id long, text string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert {r.kind for r in catalog.copy_signal_counts(spark, f"file://{tmp_path}").collect()} == {"style", "punctuation"}
    # one in fifty documents puts a word into the dictionary, so the fault is put on the page
    page = page_records(spark.createDataFrame([(1, "https://e.com/", "<p>all arrve today</p>")], "page_id long, url string, html string"))
    found = catalog._spelling_signals(spark, f"file://{tmp_path}", page).collect()
    assert [(r.site, r.kind, r.detail) for r in found] == [("e.com", "spelling", "arrve")]


def test_sinks_and_sources(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    for value in (1, 2):
        sinks.write_run(spark.createDataFrame([("www.a.com", value)], "site string, v int"), path)
    sinks.write_run(spark.createDataFrame([("b.com", 7)], "site string, v int"), path)
    assert sorted((r.site, r.v) for r in spark.read.parquet(path).collect()) == [("b.com", 7), ("www.a.com", 2)]
    (tmp_path / "robots.txt").write_text("User-agent: *\nSitemap: https://e.com/s.xml\n")
    assert tables.robots_files(spark, f"file://{tmp_path}/robots.txt").first().sitemaps == ["https://e.com/s.xml"]


def test_streaming(spark, tmp_path):
    rows = [("https://e.com/a", HTML, "2024-01-01 00:00:00"), ("https://e.com/a/", HTML, "2024-01-01 00:01:00"), ("https://e.com/b/", "<html></html>", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "url string, html string, t string").select(F.lit(1).cast("long").alias("page_id"), "url", "html", F.to_timestamp("t").alias("fetched_at")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("page_id long, url string, html string, fetched_at timestamp").parquet(f"{tmp_path}/in")
    query = arrivals.page_hits(arrivals.once(stream)).writeStream.format("memory").queryName("hits").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    found = sorted((r.finding, r.url.rstrip("/")) for r in spark.table("hits").collect())
    assert found.count(("MET-01", "https://e.com/b")) == 1 and found.count(("CNT-09", "https://e.com/a")) == 1


def test_crawl(spark):
    seeds, pages = (spark.createDataFrame([("s", u) for u in us], "site string, url string") for us in (["https://s/a/"], [f"https://s/{c}/" for c in "abcd"]))
    edges = spark.createDataFrame([("s", f"https://s/{a}/", f"https://s/{b}/") for a, b in ("ab", "bc", "cd", "ax")], "site string, src string, dst string")
    got = {(r.url[-2], r.found, r["round"]) for r in crawl.expand_frontier(seeds, pages, edges, max_pages=3).collect()}
    assert got == {("a", "sitemap", 0), ("b", "link", 1), ("c", "link", 2)}
    records = spark.createDataFrame([("s", None, None, n) for n in (True, True, True)] + [("t", 200, True, n) for n in (True, True, False)], "site string, status int, is_html boolean, noindex boolean")
    assert [r.site for r in crawl.staging_sites(records).collect()] == ["s"]
    body = '{"data":{"attributes":{"last_analysis_stats":{"malicious":1},"last_analysis_results":{"B":{"category":"malicious","result":"x"},"A":{"category":"harmless","result":"clean"}},"reputation":-3}}}'
    r = crawl.vendor_report(spark.createDataFrame([("h", 200, body), ("g", 404, None)], "host string, status int, body string")).filter("host = 'h'").first()
    assert (r.engines, r.malicious, [v.vendor for v in r.verdicts], r.reputation) == (2, 1, ["B"], -3)


def test_first_wins_and_round_robin(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "g string, n int")
    assert sorted(r.n for r in links.first_wins(rows, ["g"], ["n"]).collect()) == [1, 3]
    assert [r.n for r in links.round_robin(rows, "g", ["n"], 3).collect()] == [1, 3, 2]


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute("set threads to 2")
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    frame = catalog.QUERIES[name](spark, folder)
    columns = sorted(frame.columns)
    found = con.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns

    def tidy(rows):
        return sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))

    want = tidy(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())
    assert tidy(tuple(r[c] for c in columns) for r in frame.collect()) == want


def test_txt_answers_in_quoted_chunks(spark):
    domains = spark.createDataFrame([("s", "a.com")], "site string, domain string")
    answers = spark.createDataFrame([("a.com", "TXT", ['"x"', '"v=spf1 mx " "-all"'])], "name string, rtype string, values array<string>")
    r = mail.mail_records(domains, answers).first()
    assert (r.spf_present, r.spf_count, r.spf_all, r.spf_cost) == (True, 1, "-", 1)


def test_references_against_a_base(spark):
    base = "https://e.com/a/b?q"
    for ref, want in (("c", "https://e.com/a/c"), ("/c#f", "https://e.com/c"), ("//x.com/", "https://x.com/"), ("?z", "https://e.com/a/b?z"), ("#f", base), ("mailto:x", "mailto:x")):
        assert one(spark, urls.absolute(F.lit(base), F.lit(ref))) == want
    html = "<html><head><base href='/sub/'><link rel='alternate' hreflang='DE' href='de/'><link rel=\"canonical\" href=\"x/\"></head><body><a href='y'>y</a></body></html>"
    page = page_records(spark.createDataFrame([(1, "https://e.com/p", html)], "page_id long, url string, html string"))
    r = page.first()
    assert (r.base_url, r.canonical, [tuple(h) for h in r.hreflang]) == ("https://e.com/sub/", "https://e.com/sub/x/", [("de", "https://e.com/sub/de/")])
    assert [x.target for x in page_links(page).collect()] == ["https://e.com/sub/y"]


def test_picture_sources():
    img, base = {"src": "/f.jpg", "srcset": "/i.jpg 2x"}, "https://e.com/p/"
    assert media.choice(img, [], base) == ("https://e.com/i.jpg", "", "", "https://e.com/f.jpg", None, 1, "x")
    sources = [{"srcset": "a.xyz", "type": "image/xyz"}, {"srcset": "m.webp", "media": "(max-width: 9px)"}, {"srcset": "s.webp 300w, l.webp 900w", "sizes": "200px", "type": "image/webp"}]
    assert media.choice(img, sources, base) == ("https://e.com/p/s.webp", "https://e.com/p/l.webp", "", "https://e.com/f.jpg", 200.0, 2, "picture-w")
    assert media.choice({"src": "data:image/png;base64,x"}, [], base) is None


def test_blocked_links_stand_on_their_pages(spark):
    status = spark.createDataFrame([("s", f"https://x/{i}", "blocked") for i in range(3)], "site string, url string, verdict string")
    found = spark.createDataFrame([("s", "https://s/a/", "https://x/0", "x", 1)], "site string, src string, target string, href string, pos int")
    frames = rules.Frames(status, links=found, link_status=status)
    assert sorted(r.url for r in rules.RULES["ERR-11"].find(frames).collect()) == ["https://s/a/", "https://x/1", "https://x/2"]


def test_retries_stay_within_their_site(spark):
    old = spark.createDataFrame([("a", "u", 503), ("b", "u", 503)], "site string, url string, status int")
    again = spark.createDataFrame([("a", "u", 200)], "site string, url string, status int")
    assert sorted((r.site, r.status) for r in links.retried(old, again).collect()) == [("a", 200), ("b", 503)]


def test_upper_median_and_points(spark):
    rows = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 4.0)] + [("b", 5.0), ("b", None)], "k string, v double")
    assert {r.k: r.upper_median for r in vitals.upper_median(rows, ["k"], "v").collect()} == {"a": 3.0, "b": 5.0}
    metrics = spark.createDataFrame([("s", "h1", "metadata", 4.0, 0.5), ("s", "title_present", "metadata", 5.0, 1.0), ("s", "lang", "metadata", 1.0, None)], "site string, metric string, group string, weight double, score double")
    got = scores.points(metrics).collect()
    assert [r.metric for r in got] == ["h1", "title_present"] and got[0].points == pytest.approx(got[0].lost) and got[1].lost == 0


def test_the_shared_folder_of_a_session(spark):
    from plumbline import session as S

    assert S.shared_dir(spark).startswith("file:/")
    assert S.spread(spark.range(5).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_reputation_sources(spark):
    from plumbline.operators import reputation as R

    def row(code, flag, host):
        return f')]}}\'\n\n[["sb.ssr",{code},{flag},false,false,false,false,1,"{host}",false]]'

    cases = [
        ("a.example", row(1, "false", "a.example"), False), ("www.a.example", row(3, "false", "a.example"), True), ("a.example", row(1, "true", "A.example"), True), ("a.example", row(2, "false", "a.example"), None),
        ("a.example", row(1, "false", "b.example"), None), ("a.example", "<html>", None), ("a.example", "[]", None), ("a.example", '[["sb.ssr",1]]', None), ("a.example", None, None),
    ]
    made = spark.createDataFrame([(i, h, b) for i, (h, b, _) in enumerate(cases)], "i int, host string, body string")
    assert [r.v for r in made.select("i", R.browsing_listed(F.col("body"), F.col("host")).alias("v")).orderBy("i").collect()] == [v for *_, v in cases]

    hidden = [(["0.0.0.0"], ["192.0.2.1"], True), (["0.0.0.0"], ["::"], False), (["0.0.0.0"], [], False), (["0.0.0.0"], None, None), (None, ["192.0.2.1"], None), (["192.0.2.1"], None, False), ([], [], False)]
    made = spark.createDataFrame([(i, s, p) for i, (s, p, _) in enumerate(hidden)], "i int, s array<string>, p array<string>")
    assert [r.v for r in made.select("i", R.resolver_listed(F.col("s"), F.col("p")).alias("v")).orderBy("i").collect()] == [v for *_, v in hidden]

    threats = [(200, "{}", False), (200, '{"threat":{"threatTypes":["MALWARE"]}}', True), (200, "no", None), (403, "{}", None), (None, "{}", None)]
    made = spark.createDataFrame([(i, s, b) for i, (s, b, _) in enumerate(threats)], "i int, s int, b string")
    assert [r.v for r in made.select("i", R.threat_listed(F.col("s"), F.col("b")).alias("v")).orderBy("i").collect()] == [v for *_, v in threats]


def test_reputation_needs_its_test_host(spark):
    from plumbline.operators import reputation as R

    test = dict(R.CONTROLS)["resolver"]
    judged = spark.createDataFrame([("a", "resolver", test, True), ("a", "resolver", "x", True), ("b", "resolver", test, None), ("b", "resolver", "x", False), ("c", "resolver", "x", True), ("c", "web_risk", "x", False)], "run string, source string, host string, listed boolean")
    held = R.believed(judged)
    assert {(r.run, r.source): r.listed for r in held.collect()} == {("a", "resolver"): True, ("b", "resolver"): None, ("c", "resolver"): None, ("c", "web_risk"): False}
    assert {r.run: r.web_risk_clean for r in R.browser_clean(held).collect()} == {"a": None, "b": None, "c": True}
    vendors = spark.createDataFrame([("g-data",), ("DR WEB",), ("someone",), ("fortinet",)], "vendor string")
    found = {r.vendor: (r.tier, r.review_url is not None) for r in R.consequences(vendors, R.vendor_tiers(spark)).collect()}
    assert found == {"g-data": ("endpoint", False), "DR WEB": ("endpoint", False), "someone": ("unknown", False), "fortinet": ("gateway", True)}


def test_mail_details(spark):
    from plumbline.operators import mail

    schema = "network string, name string, rtype string, values array<string>"
    rows = [
        ("n", "_spf.google.com", "TXT", ['"v=spf1 ~all"']), ("m", "_spf.google.com", "TXT", []), ("n", "A.example", "TXT", ['"v=spf1 A" " -all"']), ("m", "b.example", "TXT", ["v=spf1 mx -all"]),
        ("n", "_dmarc.a.example", "TXT", ["v=DMARC1; p=Reject; p=none ; adkim=s"]), ("n", "x._domainkey.a.example", "TXT", ["p="]), ("n", "y._domainkey.a.example", "TXT", ["p=AA"]), ("n", "_mta-sts.a.example", "TXT", None), ("n", "default._bimi.a.example", "TXT", ["v=BIMI1"]),
    ]
    domains = spark.createDataFrame([("s", "a.example"), ("s", "b.example")], "site string, domain string")
    a, b = sorted(mail.mail_details(domains, mail.controlled(spark.createDataFrame(rows, schema))).collect(), key=lambda r: r.domain)
    assert (a.spf_effective, a.spf_broad, a.dmarc_state, a.adkim, a.aspf, a.dkim_live, a.dkim_revoked, a.mta_sts, a.bimi) == (True, True, "monitor only", "s", "r", 1, 1, None, True)
    assert (b.spf_effective, b.dmarc_state, b.dkim_live, b.mta_sts) == (None, None, 0, None)


def test_page_issues(spark):
    from plumbline.operators import page_issues as P
    from plumbline.operators.records import page_records

    good = "<html><head><title>Same</title></head><body><h1>A</h1><script type='application/ld+json'>{\"@graph\":[{\"@type\":\"X\"}]}</script></body></html>"
    rows = [(1, "https://a.example/", good, 200), (2, "https://a.example/b", good.replace("@type", "name"), 200), (3, "https://a.example/c", "<p>no title</p>", 200), (4, "https://a.example/d", None, None)]
    found: dict[str, set] = {}
    for r in P.page_issues(page_records(spark.createDataFrame(rows, "page_id long, url string, html string, status int"))).collect():
        found.setdefault(r.issue, set()).add(r.url[-1])
    assert found["duplicate-title"] == found["duplicate-h1"] == found["thin-content"] == {"/", "b"}
    assert found["no-schema"] == {"b"} and found["fetch-failed"] == found["http-error"] == {"d"} and "missing-title" not in found


def test_vocabulary_file(spark, tmp_path):
    import json

    def term(name, kind, **more):
        return {"@id": f"schema:{name}", "@type": kind, **{k.replace("_", ":"): v for k, v in more.items()}}

    ref = lambda n: {"@id": f"schema:{n}"}
    graph = [
        {"@id": "other:X", "@type": "rdfs:Class"}, term("Thing", "rdfs:Class"), term("Enumeration", "rdfs:Class", rdfs_subClassOf=ref("Thing")), term("State", "rdfs:Class", rdfs_subClassOf=ref("Enumeration")), term("SubState", "rdfs:Class", rdfs_subClassOf=[ref("State"), ref("Thing")]),
        term("Old", "rdfs:Class", rdfs_subClassOf=ref("Thing"), schema_isPartOf={"@id": "https://attic.schema.org"}), term("New", "rdfs:Class", rdfs_subClassOf=ref("Thing"), schema_isPartOf={"@id": "https://pending.schema.org"}),
        term("state", "rdf:Property", schema_domainIncludes=ref("Thing"), schema_rangeIncludes=[ref("State"), ref("Number")]), term("stage", "rdf:Property", schema_domainIncludes=ref("Thing"), schema_rangeIncludes=ref("State"), schema_supersededBy=ref("state")),
        term("On", "schema:State"), term("Off", ["schema:SubState"]),
    ]
    (tmp_path / "v.jsonld").write_text(json.dumps({"@context": {}, "@graph": graph}))
    vocab = structured.read_vocabulary(spark, str(tmp_path / "v.jsonld"))
    assert {r.range: r.members for r in vocab.ranges.filter("prop = 'state'").collect()} == {"State": ["Off", "On"], "Number": None}
    assert ("SubState", "Enumeration") in {tuple(r) for r in vocab.types.collect()} and vocab.superseded.collect() == [("stage", "state")]
    values = ["On", "https://schema.org/Off", "3", "Broken", "https://schema.org/Broken", "https://other.example/x"]
    nodes = [{"@context": "https://schema.org", "@graph": [{"@type": "Thing", "state": v} for v in values] + [{"@type": "Old"}, {"@type": "New"}, {"@type": "Thing", "stage": "On"}]}]
    pages = spark.createDataFrame([("s", "u", [json.dumps(nodes[0])])], "site string, url string, jsonld array<string>")
    found = {(r.code, r.type): (r.level, r.n) for r in structured.schema_issues(structured.jsonld_nodes(pages), vocab).collect()}
    assert found == {("invalid-enum", "Thing"): ("error", 2), ("retired-type", "Old"): ("warning", 1), ("pending-type", "New"): ("info", 1), ("superseded-property", "Thing"): ("warning", 1)}
