"""What a page's markup says: copy rules on runs, blocks of damaged or deep markup, references and names of links."""

import time
from urllib.parse import urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

from plumbline.functions import copy, urls
from plumbline.operators import blocks, crawl, graph, media, rules, structured
from plumbline.operators.records import page_links, page_records
from plumbline.plans import catalog
from plumbline.session import cut

PAGES = "page_id long, url string, html string"


def records(spark, *html, **columns):
    rows = [(i, f"https://e.com/{i}", f"<html><body><main>{h}</main></body></html>") for i, h in enumerate(html)]
    return page_records(spark.createDataFrame(rows, PAGES).withColumns(columns))


def details(spark, html, prefix, kind="punctuation"):
    found = rules.page_signals(records(spark, html)).filter(F.col("kind") == kind).collect()
    return [r.detail.split("“", 1)[1].rstrip("”") for r in found if r.detail.startswith(prefix)]


CARD = "<a href='/blog/x'><span><span>The cover page</span><strong>How to read it</strong><span>The label is what anybody remembers.</span></span><span>March 3, 2031<!-- --> · <!-- -->5<!-- --> min</span></a>"
CLEAN = [
    "<p>a list <a href='#'>before it is sent</a>. New carriers follow</p>",
    "<p><strong>Wheels</strong>, formally known as wheels</p>",
    "<p>Sun<span>day</span>. Monday follows it</p>",
    "<p>Everyone is called within<!-- --> <!-- -->one hour<!-- -->.</p>",
    "<li>Hamburg<!-- -->, <!-- -->DE<!-- --> <!-- -->20095</li>",
    CARD,
    "<p>our processor, Contoso.Net. Our servers get a token</p>",
    "<p>published at haulage.Com for every route, inspection.PDF and image.PNG</p>",
    "<p><span>wheels.</span><span>Contract is yearly</span></p>",
    "<p>Who Wants to&amp;nbsp;Register With the Office</p>",
    "<p><span>..clears it.</span><span>March 3</span></p>",
]


def test_boundaries_hosts_and_entities_are_no_slips(spark):
    found = rules.page_signals(records(spark, *CLEAN)).filter("kind = 'punctuation'").collect()
    assert [(r.url, r.detail) for r in found] == []


@pytest.mark.parametrize(
    "html, rule, quoted",
    [
        ("<p>The tax is set , and the wheels arrive later that week</p>", "Space before", ["The tax is set , and the wheels arrive later that w…"]),
        ("<p>The <b>tax</b> is set , and the wheels</p>", "Space before", ["is set , and the wheels"]),
        ("<p><a href='#'>The tax is set , always</a> for all</p>", "Space before", ["The tax is set , always"]),
        ("<p>Each coast distributed tax equals 25% of its full tax . And so on</p>", "Space before", ["…ted tax equals 25% of its full tax . And so on"]),
        ("<p>Those subscriptions lapse.Returning a contract</p>", "Missing space", ["se.Returning"]),
        ("<p>depends on the season and routing.If the tractor</p><p>your tractor.Ordinary vans and email.Contact us.AMPM</p>", "Missing space", ["il.Contact", "ng.If", "or.Ordinary", "us.AMPM"]),
        ("<p><span>wheels.Contract is yearly</span></p>", "Missing space", ["ls.Contract"]),
        ("<p>open (bracket</p>", "Unbalanced", ["open (bracket"]),
    ],
)
def test_slips_within_a_run_are_quoted(spark, html, rule, quoted):
    assert sorted(details(spark, html, rule)) == quoted


@pytest.mark.parametrize("html, shown", [("<p>Wants to&amp;nbsp;Register here</p>", "&nbsp;"), ("<p>Fees &amp;amp; charges</p>", "&amp;"), ("<p>The code is &amp;#8212; and so</p>", "&#8212;"), ("<p>to&nbsp;Register, Fees &amp; charges, Rates & fees</p>", None)])
def test_entities_that_reached_the_text(spark, html, shown):
    found = details(spark, html, "HTML entity", "entity")
    assert (not found) if shown is None else shown in found[0]


@pytest.mark.parametrize("text, want", [("you’re re-opening a document", []), ("and you're re-sorting", []), ("the co-op op", []), ("the the plate", ["the"]), ("cost more more than", ["more"]), ("that that is fine", [])])
def test_a_repeated_word_is_a_whole_word(spark, text, want):
    assert [r.s.detail for r in spark.range(1).select(F.explode(copy.doubled_words(F.lit(text))).alias("s")).collect()] == want


def test_markers_are_not_made_up_by_markup(spark):
    found = rules.page_signals(records(spark, "<p><span>TO</span><span>DO</span> nothing, to do: this</p>", "<p>[TODO] write</p>", "<p>Lorem <b>Ipsum</b></p>")).filter("kind = 'placeholder'").collect()
    assert {(r.url[-1], r.detail) for r in found} == {("1", "'TODO' left in copy"), ("2", "Lorem ipsum filler text")}


def test_title_description_and_source_are_judged(spark):
    html = '<html><head><title>We recieve parcels</title><meta name="description" content="Two  spaces"></head><body><!-- cafÃ© --><p>Fine text here</p></body></html>'
    page = page_records(spark.createDataFrame([(1, "https://e.com/", html)], PAGES))
    assert {(r.kind, r.detail) for r in rules.page_signals(page).collect()} == {("misspelling", "recieve -> receive"), ("punctuation", "Double space inside a sentence: “Two  spaces”"), ("mojibake", "Ã© x 1")}


def test_context_at_the_ends_and_ties(spark):
    rows = [("x" * 34 + " , y",), ("x" * 35 + " , y",), ("a , b , c",), ("z , " + "y" * 40,)]
    got = spark.createDataFrame(rows, "t string").select(copy.matches_around(F.col("t"), r"\s+,(?:\s|$)", r"\s,").alias("m")).collect()
    assert [[x.around for x in r.m] for r in got] == [["x" * 34 + " , y"], ["…" + "x" * 34 + " , y"], ["a , b , c", "a , b , c"], ["z , " + "y" * 34 + "…"]]


def test_deeply_nested_text_is_read_once_and_said_to_be_deep():
    began = time.time()
    found = blocks.blocks_of("<span>x" * 16_000 + "end")
    assert time.time() - began < 5 and len(found) == blocks.MAX_NESTED + 1
    assert found[-1][2] == "error" and sum(len(b[4]) for b in found) < 40 * 16_000
    assert [b[2] for b in blocks.blocks_of("<p>flat text</p>" * 3)] == ["body"] * 3


def test_runs_are_text_nodes():
    assert [b[5] for b in blocks.blocks_of("<p>a &amp; b<!-- -->c <i>d</i><br>e < f</p>")] == [["a & b", "c ", "d", " ", "e < f"]]
    assert blocks.blocks_of("<p>one<script>var x</script> two</p>")[0][4] == "one two"
    assert [b[3] for b in blocks.blocks_of("<li>outer <p>inner text</p></li><li>plain item</li>")] == ["p", "li"]


def test_a_word_of_sixty_thousand_letters(spark):
    words = spark.createDataFrame([("s", "u", w, 1, True) for w in ("q" * 60_000, "teh", "thes")], "site string, url string, word string, n long, lower boolean")
    dictionary = spark.createDataFrame([("the", 100)], "word string, frequency long")
    assert {r.word: r.suggestions for r in blocks.spelling(words, dictionary).collect()} == {"teh": ["the"], "thes": ["the"]}


def test_nested_data_is_broken_data():
    for text in ("[" * 100_000, '{"a":' * 100_000, "[" * 100_000 + "]" * 100_000):
        assert structured.nodes_of(text, 0)[0][-1] == "json-parse"
    deep = '{"@context":"https://schema.org","@type":"Thing","name":' + "[" * 5_000 + "]" * 5_000 + "}"
    assert len(structured.nodes_of(deep, 0)) == 1


def test_searches_end_with_the_graph_and_not_before(spark, monkeypatch):
    monkeypatch.setattr(graph, "COMPACT_ROUNDS", 4)
    monkeypatch.setattr(crawl, "COMPACT_ROUNDS", 4)
    nodes = spark.createDataFrame([("s", f"https://s/{i:02}/") for i in range(12)], "site string, url string")
    edges = spark.createDataFrame([("s", f"https://s/{i:02}/", f"https://s/{i + 1:02}/") for i in range(11)] + [("s", "https://s/11/", "https://s/00/")], "site string, src string, dst string")
    home = nodes.filter("url = 'https://s/00/'")
    assert sorted(r.depth for r in graph.bfs_depth(nodes, edges, home).collect()) == list(range(12))
    assert sorted(r["round"] for r in crawl.expand_frontier(home, nodes, edges).collect()) == list(range(12))
    for search in (lambda: graph.bfs_depth(nodes, edges, home, most=4), lambda: crawl.expand_frontier(home, nodes, edges, most=4)):
        with pytest.raises(RuntimeError, match="deeper than 4"):
            search()
    assert graph.bfs_depth(nodes, edges, home, most=11).count() == 12


REFS = ["../x.png", "/a/../x.png", "./", "..", "../..", "../../../../z", "x", "x/./y/", "x/..", "#f", "//o.com/../a", "http://o.com/a/../b", "/", "/.", "a//b", "../a/.?x#y", "...", "/a/.../b", "a/b/../../c/../../d", "./a:b", "/..", "x/.../", "a.b/..c/d."]


def test_references_like_the_library(spark):
    rows = [(b, r) for b in ("https://h.com/a/b/c.html?q=1#f", "https://H.com", "http://h.com/a/", "http://h.com:8080/a") for r in REFS]
    got = spark.createDataFrame(rows, "b string, r string").select("b", "r", urls.absolute(F.col("b"), F.col("r")).alias("o")).collect()
    assert [(r.b, r.r, r.o) for r in got] == [(b, r, urldefrag(urljoin(b, r))[0].replace("https://H.com", "https://H.com")) for b, r in rows]


def test_the_base_is_the_served_url(spark):
    html = ["<a href='x/'>one</a>", "<head><base href='/b/'></head><a href='x/'>one</a>", "<head><base target='_top'><base href='https://o.com/q'></head><a href='x/'>one</a>"]
    rows = [(i, "http://e.com", "https://www.e.com/start/", f"<html>{h}</html>") for i, h in enumerate(html)]
    page = page_records(spark.createDataFrame(rows, "page_id long, url string, final_url string, html string"))
    assert [r.target for r in page_links(page).orderBy("target").collect()] == sorted(["https://www.e.com/start/x/", "https://www.e.com/b/x/", "https://o.com/x/"])


def test_pages_that_share_a_url_are_counted_each(spark, tmp_path):
    html = '<a href="/x">x</a><a href="/x">again</a>'
    spark.createDataFrame([(1, "https://e.com/p", html), (2, "https://e.com/p", html), (3, "https://e.com/q", html)], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    assert [tuple(r) for r in catalog.QUERIES["page_link_targets"](spark, str(tmp_path)).collect()] == [("e.com", "https://e.com/x", 6, 3)]


def test_a_link_may_be_named_by_its_picture(spark):
    html = "<a href='/a'><img src='x' alt='Home'></a><a href='/b'><img src='x' alt=' '></a><a href='/c' aria-label='C'></a><a href='/d' title=''> </a>"
    assert records(spark, html).first().links_no_anchor_text == 2


def test_one_image_by_many_references(spark):
    page = records(spark, "<img src='../i/x.png' alt='a'><img src='/i/./x.png'><img src='/i/y/../x-300x200.png'>")
    found = media.alt_inventory(page).collect()
    assert [(r.image, r.state, r.seen) for r in found] == [("https://e.com/i/x.png", "missing", 1)]


def test_plain_pages_are_read_like_any_other():
    plain = '<html><head><title>A &amp; b</title><meta name="description" content="x"></head><body class="menu"><nav><p>in  chrome</p></nav><main><p><span>one.</span> two<br>three</p><div class="Sidebar"><p>side text</p></div></main>&nbsp;</body></html>'
    for html in (plain, plain.replace("<br>", "<br/>"), plain.replace("<p>", "<p title='a>b'>"), plain + "<!-- x --><script>if (a<b) {}</script>", plain.replace("<body ", "<BODY\n"), "a < b", "<p>open", "", "<title><b>bold</b></title>", "<p>a</p x>"):
        slow = blocks._Blocks()
        slow.feed(html)
        slow.close()
        assert blocks.blocks_of(html) == slow.blocks()
    assert blocks._read_plain(blocks._Blocks(), plain) and not blocks._read_plain(blocks._Blocks(), plain + "<!-- x -->")
    assert [blocks.collapsed(t) for t in ("", " \n", " a\t b\u00a0", "a\x1c\x85b")] == ["", " ", " a b ", "a b"]


def test_copy_signals_are_made_once(spark, tmp_path):
    """One write of signals; no filter works a rule out a second time."""
    spark.createDataFrame([(30, "We recieve it , and TODO", "a")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES["copy_findings"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and {("CNT-01", "'TODO' left in copy", 1), ("CNT-02", "recieve -> receive", 1), ("CNT-05", "Space before a punctuation mark", 1)} <= {tuple(r) for r in found.collect()}
    signals = rules.page_signals(records(spark, "<p>We recieve it</p>"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in signals and "size(concat(" not in signals


def test_text_blocks_at_hand_are_not_read_again(spark):
    page = records(spark, "<p>We recieve it , and more</p>", "<p>fine</p>")
    text = cut(blocks.text_blocks(page))
    found = rules.page_signals(page, text)
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(found.collect()) == sorted(rules.page_signals(page).collect()) != []
