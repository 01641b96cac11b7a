"""Registered queries of structured data in all three syntaxes, beside their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import markup, structured
from plumbline.operators.records import page_records
from plumbline.plans.catalog import query
from plumbline.session import ship, spread
from plumbline.sources.tables import parquet


def marked_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page a part: Microdata of a product and its offer, RDFa of a person, and JSON-LD that completes the
    product of every other page under its @id; faults follow from the key."""
    ship(spark)
    k = F.col("p_partkey")

    def text(*parts: str | Column) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    def one(condition: Column, a: str, b: str = "") -> Column:
        return F.when(condition, a).otherwise(b)

    offer = text(
        '<div itemprop="offers" itemscope itemtype="http://schema.org/Offer"><meta itemprop="price" content="', one(k % 6 == 0, "about "), F.col("p_retailprice").cast("string"), '">', one(k % 4 != 0, '<span itemprop="priceCurrency">EUR</span>'),
        '<link itemprop="availability" href="https://schema.org/', one(k % 9 == 0, "Everywhere", "InStock"), '"></div>',
    )
    product = text(
        '<div itemscope itemtype="https://schema.org/Product"', one(k % 2 == 0, ' itemid="#p"'), ">", one(k % 7 != 0, '<h2 itemprop="name">A <b>part</b></h2>'), one(k % 5 == 0, '<i itemprop="colour">red</i>'),
        one(k % 8 == 0, '<time itemprop="datePublished" datetime="soon">now</time>'), '<p>of <a itemprop="url" href="../p">', "this", "</a></p>", offer, "</div>",
    )
    person = F.when(k % 3 == 0, '<p typeof="schema:Person"><b property="name">N</b><b property="schema:jobtitel">T</b></p>').when(k % 3 == 1, '<p typeof="Persona"><b property="nome">N</b></p>').otherwise('<p typeof="Person Thing"><b property="price">9</b></p>')
    block = one(k % 2 == 0, '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Product","@id":"#p","description":"d"}</script>')
    html = text("<html><head><title>Parts</title>", block, "</head><body>", product, one(k % 10 == 0, '<div itemscope><span itemprop="name">lost</span></div>'), person, "</body></html>")
    rows = spread(parquet(spark, d, "part")).select(k.alias("page_id"), text("https://", F.lower(F.translate("p_brand", "#", "-")), ".example.com/p/", k.cast("string")).alias("url"), html.alias("html"))
    return page_records(rows)


#: type, property, code, level, layer, of which parts.
_ISSUES = (
    ("Product", "colour", "unknown-property", "error", "schema", "k % 5 = 0"), ("Product", "datePublished", "invalid-date", "error", "schema", "k % 8 = 0"), ("Product", "datePublished", "property-not-on-type", "warning", "schema", "k % 8 = 0"),
    ("Offer", "price", "money-format", "warning", "google", "k % 6 = 0"), ("Offer", "priceCurrency", "missing-required", "error", "google", "k % 4 = 0"), ("Offer", "availability", "invalid-enum", "error", "schema", "k % 9 = 0"),
    ("Product", "", "id-merged", "info", "schema", "k % 2 = 0"), ("", "", "no-type", "error", "schema", "k % 10 = 0"), ("Product", "name", "missing-required", "error", "google", "k % 7 = 0"), ("Product", "description", "missing-recommended", "info", "google", "k % 2 = 1"),
    *((t, p, "missing-recommended", "info", "google", "true") for t, ps in (("Product", ("brand", "sku", "aggregateRating", "image")), ("Offer", ("url",))) for p in ps),
    ("Persona", "", "unknown-type", "error", "schema", "k % 3 = 1"), ("Person", "jobtitel", "unknown-property", "error", "schema", "k % 3 = 0"), *((t, "price", "property-not-on-type", "warning", "schema", "k % 3 = 2") for t in ("Person", "Thing")),
)


@query("WITH p AS (SELECT p_partkey AS k, lower(p_brand) AS site FROM part), hits AS (" + " UNION ALL ".join(f"SELECT '{t}' AS type, '{p}' AS prop, '{c}' AS code, '{level}' AS level, '{layer}' AS layer, k FROM p WHERE {cond}" for t, p, c, level, layer, cond in _ISSUES)
    + ") SELECT type, prop, code, level, layer, count(DISTINCT k) AS pages, count(*) AS n FROM hits GROUP BY ALL")
def markup_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issues of Microdata, RDFa and JSON-LD of one page, a row a kind."""
    issues = structured.schema_issues(markup.page_nodes(marked_pages(spark, d)), structured.vocabulary(spark))
    return issues.groupBy("type", "prop", "code", "level", "layer").agg(F.count_distinct("url").alias("pages"), F.sum("n").alias("n"))


@query("""WITH p AS (SELECT p_partkey AS k FROM part), items AS (
 SELECT 'json-ld' AS syntax, 'Product' AS type, 0 AS depth, 1 AS n FROM p WHERE k % 2 = 0 UNION ALL SELECT 'microdata', 'Product', 0, 2 + CAST(k % 7 <> 0 AS INT) + CAST(k % 5 = 0 AS INT) + CAST(k % 8 = 0 AS INT) FROM p
 UNION ALL SELECT 'microdata', 'Offer', 1, 2 + CAST(k % 4 <> 0 AS INT) FROM p UNION ALL SELECT 'microdata', '', 0, 1 FROM p WHERE k % 10 = 0 UNION ALL SELECT 'rdfa', 'Person', 0, 2 FROM p WHERE k % 3 = 0 UNION ALL SELECT 'rdfa', 'Persona', 0, 1 FROM p WHERE k % 3 = 1
 UNION ALL SELECT 'rdfa', unnest(['Person', 'Thing']), 0, 1 FROM p WHERE k % 3 = 2) SELECT syntax, type, depth, count(*) AS items, CAST(sum(n) AS BIGINT) AS props FROM items GROUP BY ALL""")
def markup_items(spark: SparkSession, d: str) -> DataFrame:
    """Items by syntax and type, with how many properties they have."""
    nodes = markup.page_nodes(marked_pages(spark, d))
    syntax = F.when(F.col("path").startswith("microdata"), "microdata").when(F.col("path").startswith("rdfa"), "rdfa").otherwise("json-ld")
    return nodes.groupBy(syntax.alias("syntax"), F.array_join("types", " ").alias("type"), "depth").agg(F.count(F.lit(1)).alias("items"), F.sum(F.size("props")).alias("props"))
