"""Microdata and RDFa against the trees they stand for; datatypes of a vocabulary file."""

import json
import time

from plumbline.operators import markup, structured
from plumbline.operators.records import page_records

PRODUCT = """<div itemscope itemtype="https://schema.org/Product" itemid="#p">
 <h2 itemprop="name alternateName">A <b>red</b>
 part</h2><img itemprop="image" src="../i.png"><img itemprop="image" src="/j.png">
 <div itemprop="offers" itemscope itemtype="http://schema.org/Offer"><meta itemprop="price" content=" 9.5 "><data itemprop="sku" value="77">seven</data><time itemprop="validFrom" datetime="2024-05-01">May</time>
  <div itemscope itemtype="https://schema.org/Person"><i itemprop="name">not the offer's</i></div></div>
 <script itemprop="description">var x</script><link itemprop="url" href="#top"></div>"""


def props(node):
    return [(p["prop"], p["kind"], p["value"]) for p in node[11]]


def test_scopes_own_their_properties():
    nodes = markup.markup_of(PRODUCT, "https://e.com/a/b/")
    assert [(n[1], n[5], n[4], n[3], n[7]) for n in nodes] == [("microdata:0", ["Product"], None, 0, "#p"), ("microdata:0.offers[0]", ["Offer"], "offers", 1, None)]
    assert props(nodes[0]) == [("name", "scalar", "A red part"), ("alternateName", "scalar", "A red part"), ("image", "scalar", "https://e.com/a/i.png"), ("image", "scalar", "https://e.com/j.png"), ("offers", "object", "Offer"), ("description", "blank", ""), ("url", "scalar", "https://e.com/a/b/#top")]
    assert props(nodes[1]) == [("price", "scalar", "9.5"), ("sku", "scalar", "77"), ("validFrom", "scalar", "2024-05-01")]


def test_both_syntaxes_give_the_same_rows():
    block = json.dumps({"@type": "https://schema.org/Product", "name": "N", "offers": {"@type": "Offer", "price": "9", "seller": {"@type": "Person", "name": ["A", "B"]}}})
    html = '<p itemscope itemtype="https://schema.org/Product"><i itemprop="name">N</i><span itemprop="offers" itemscope itemtype="Offer"><i itemprop="price">9</i><u itemprop="seller" itemscope itemtype="Person"><i itemprop="name">A</i><i itemprop="name">B</i></u></span></p>'
    # all but the block, the path and what JSON-LD says of its context
    assert [n[2:12] for n in markup.markup_of(html, "u")] == [n[2:12] for n in structured.nodes_of(block, 0)]


def test_rdfa_types_take_the_properties_below_them():
    html = '<div vocab="https://schema.org/" typeof="schema:Product http://schema.org/Thing"><b property="name">N</b><p typeof="Offer" property="offers"><i property="schema:price other:sku">9</i></p></div><i property="name">outside</i>'
    got = [(n[1], n[5], [p["prop"] for p in n[11]]) for n in markup.markup_of(html, "u")]
    assert got == [("rdfa:0", ["Product"], ["name", "offers", "price", "sku"]), ("rdfa:1", ["Thing"], ["name", "offers", "price", "sku"]), ("rdfa:2", ["Offer"], ["price", "sku"])]


def test_odd_markup_ends_and_says_what_it_left_out():
    assert markup.markup_of(None, "u") == markup.markup_of("", "u") == markup.markup_of("<p itemprop='name'>no scope</p></div>", "u") == []
    began = time.time()
    for html in ("<p itemscope>" + "<i itemprop='a'>x" * 20_000, "<p itemscope itemprop='a'>" * 20_000, "<p typeof='A'><i property='b'>" * 20_000):
        markup.markup_of(html, "u")
    assert time.time() - began < 30
    assert markup.markup_of("<p itemscope>" + "<i itemprop='a'>x" * 40, "u")[-1][-1] == "too-deep" == markup.markup_of("<p typeof='A'>" * 40, "u")[-1][-1]
    assert markup.markup_of("<a itemscope><a itemprop='url' href='http://['></a>", "http://e")[0][11][0]["value"] == "http://["


def test_issues_of_all_syntaxes_meet(spark):
    block = '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Product","@id":"#p","description":"d","offers":{"@type":"Offer","price":1,"priceCurrency":"EUR"}}</script>'
    html = block + '<p itemscope itemtype="https://schema.org/Product" itemid="#p"><i itemprop="name">N</i><i itemprop="color2">red</i></p><p typeof="Person"><b property="price">9</b><b property="nome">9</b></p><p typeof="Nobody"><b property="nome">9</b></p>'
    pages = page_records(spark.createDataFrame([(1, "https://e.com/", html), (2, "https://e.com/2", "<p>none</p>"), (3, "https://e.com/3", None)], "page_id long, url string, html string"))
    issues = structured.schema_issues(markup.page_nodes(pages), structured.vocabulary(spark)).filter("code <> 'missing-recommended'").collect()
    assert {(r.type, r.prop, r.code) for r in issues} == {("Product", "color2", "unknown-property"), ("Product", "", "id-merged"), ("Person", "price", "property-not-on-type"), ("Person", "nome", "unknown-property"), ("Nobody", "", "unknown-type")}


def test_datatypes_are_those_that_descend_from_one(spark, tmp_path):
    def term(name, kind, **more):
        return {"@id": f"schema:{name}", "@type": kind, **{("rdfs:" if k == "subClassOf" else "schema:") + k: [{"@id": f"schema:{x}"} for x in v.split()] for k, v in more.items()}}

    def verdict(derived):
        graph = [term("Thing", "rdfs:Class"), term("Text", ["schema:DataType", "rdfs:Class"]), term("Code", "rdfs:Class", subClassOf="Text" if derived else "Thing"), term("PostCode", "rdfs:Class", subClassOf="Code"), term("code", "rdf:Property", domainIncludes="Thing", rangeIncludes="PostCode")]
        path = tmp_path / f"vocab{derived}.jsonld"
        path.write_text(json.dumps({"@context": {}, "@graph": graph}))
        vocab = structured.read_vocabulary(spark, f"file://{path}")
        pages = spark.createDataFrame([("s", "u", ['{"@context":"https://schema.org","@type":"Thing","code":"AB 1"}'])], "site string, url string, jsonld array<string>")
        return {r.code for r in structured.schema_issues(structured.jsonld_nodes(pages), vocab).collect()}

    assert verdict(True) == set() and verdict(False) == {"value-type"}
