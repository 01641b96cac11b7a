"""Audit frames derived from the given tables, so that every operator runs on data that grows with them.

Pages are the crawl; links between parts that follow each other in an order are a link graph; orders are
link checks; line items are lab measurements; suppliers are mail domains; events are listings, DNS
answers and robots.txt lines; documents are copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import urls
from plumbline.operators.few import smallest
from plumbline.operators.records import page_records
from plumbline.session import ship, spread
from plumbline.sources.tables import parquet


def records(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return page_records(spread(parquet(spark, d, "pages")))


def documents_as_records(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages of their source."""
    docs = parquet(spark, d, "documents")
    return docs.select(F.col("source").alias("site"), F.col("doc_id").cast("string").alias("url"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.array().cast("array<string>").alias("mixed_content"))


def part_url(key: Column) -> Column:
    return F.concat(F.lit("https://shop.example.com/"), F.when(key % 10 == 0, "blog/").when(key % 10 == 1, "tag/").otherwise("item/"), key.cast("string"), F.lit("/"))


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "part").select(F.lit("shop.example.com").alias("site"), part_url(F.col("p_partkey")).alias("url"))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """A link each line item, from its part's page: returned ones lead to one of three menu pages, the others
    to the part of three times the number or the next one.  So the parts in between are orphans, what lies
    below them is out of reach, and depth grows with the logarithm of the number of parts.  Links of every
    seventh order are rendered ones."""
    part, n = F.col("l_partkey"), F.col("l_linenumber")
    to = F.when(F.col("l_returnflag") == "A", n % 3 + 1).otherwise(3 * part + n % 2)
    return parquet(spark, d, "lineitem").select(F.lit("shop.example.com").alias("site"), part_url(part).alias("src"), part_url(to).alias("dst"), F.col("l_returnflag").alias("anchor"), (F.col("l_orderkey") % 7 == 0).alias("rendered"))


def graph_home(spark: SparkSession, d: str) -> DataFrame:
    return home_of(graph_edges(spark, d))


def home_of(edges: DataFrame) -> DataFrame:
    return edges.groupBy("site").agg(F.min("src").alias("url"))


def shelves(spark: SparkSession, d: str) -> DataFrame:
    """A directory tree over customers, nation by nation and shelf by shelf: the customers' pages (those in
    debt are orphans), every other nation's index, a third of the shelves' indexes, home and blog."""
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    own = parquet(spark, d, "customer").filter("c_nationkey is not null").select(n.alias("n"), (k % 5).alias("s"), k.cast("string").alias("k"), (F.col("c_acctbal") < 0).alias("orphan"))
    top, crawled = F.lit("https://shop.example.com/"), F.lit(False).alias("orphan")
    nation = F.concat(top, F.lit("n"), F.col("n").cast("string"), F.lit("/"))
    shelf = F.concat(nation, F.col("s").cast("string"), F.lit("/"))
    pages = own.select(F.concat(shelf, "k", F.lit("/")).alias("url"), F.coalesce("orphan", F.lit(False)).alias("orphan"))
    for extra in (own.filter("n % 2 = 0").select(nation.alias("url"), crawled), own.filter("(n + s) % 3 = 0").select(shelf.alias("url"), crawled), own.select(F.explode(F.array(top, F.concat(top, F.lit("blog/")))).alias("url"), crawled)):
        pages = pages.union(extra.distinct())
    return pages.withColumn("site", F.lit("shop.example.com"))


def link_status(spark: SparkSession, d: str) -> DataFrame:
    """A checked link an order; its customer is the site."""
    o = F.col("o_orderkey")
    status = F.when(o % 17 == 0, 404).when(o % 23 == 0, 403).when(o % 29 == 0, 500).when(o % 31 == 0, 418).when(o % 37 == 0, F.lit(None).cast("int")).otherwise(200)
    site = F.concat(F.lit("c"), (F.col("o_custkey") % 100).cast("string"), F.lit(".example.com"))
    internal = F.col("o_orderstatus") != "F"
    url = F.concat(F.when(o % 5 == 0, "http://").otherwise("https://"), F.when(internal, site).otherwise(F.lit("other.example.net")), F.lit("/o/"), o.cast("string"))
    final = F.concat(F.lit("https://"), F.when(internal, site).otherwise(F.lit("new.example.net")), F.lit("/o/"), o.cast("string"), F.when(o % 2 == 0, "/").otherwise(""))
    return parquet(spark, d, "orders").select(site.alias("site"), url.alias("url"), final.alias("final_url"), status.alias("status"), (o % 4).cast("int").alias("hops"), internal.alias("internal"))


def link_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages that carry those links: one a line item of the order."""
    status = link_status(spark, d).withColumn("key", F.regexp_extract("url", r"/o/(\d+)", 1).cast("long"))
    lines = parquet(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_suppkey"), F.col("l_linenumber").alias("pos"))
    return lines.join(status.select("key", "site", "url"), "key").select("site", F.concat(F.lit("https://"), "site", F.lit("/p/"), F.col("l_suppkey").cast("string")).alias("src"), F.col("url").alias("target"), F.col("url").alias("href"), "pos")


def vitals(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "lineitem").select(
        F.concat(F.lit("s"), (F.col("l_suppkey") % 50).cast("string")).alias("site"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("url"),
        F.when(F.col("l_linenumber") == 7, 403).otherwise(200).alias("status"), (F.col("l_quantity") * 60).alias("fcp"), F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice") / 10).alias("lcp"), (F.col("l_discount") * 5000).alias("tbt"), (F.col("l_tax") * 3).alias("cls"),
    )


def images(spark: SparkSession, d: str) -> DataFrame:
    """Images of parts: weight, natural and displayed width, the pages that carry them."""
    pages = smallest(parquet(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.concat(F.lit("/p/"), F.col("l_suppkey").cast("string")).alias("pages")), ["k"], "pages", 60)
    part = parquet(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_size", "p_retailprice", "p_brand")
    kind = F.element_at(F.array(*map(F.lit, ("JPEG", "WebP", "SVG", "PNG"))), (F.col("k") % 4 + 1).cast("int"))
    return part.join(pages, "k").select(F.lower("p_brand").alias("site"), F.concat(F.lit("/i/"), F.col("k").cast("string")).alias("image"), kind.alias("kind"), (F.col("p_retailprice") * 200).cast("long").alias("bytes"), (F.col("p_size") * 40).alias("natural_width"), F.lit(400).alias("displayed_width"), "pages")


def mail_domains(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".example.com")).alias("site"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".example.com")).alias("domain"))


def dns_answers(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers include their nation's SPF record, nations their region's; the rest of the records
    follows from balances and keys."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    s = parquet(spark, d, "supplier").withColumn("name", F.concat(F.lit("s"), k.cast("string"), F.lit(".example.com")))
    qualifier = F.element_at(F.array(*map(F.lit, ("-", "~", "?", "+"))), (k % 4 + 1).cast("int"))
    spf = F.concat(F.lit("v=spf1 mx include:n"), n, F.lit(".example.net "), F.when(k % 6 == 0, F.concat(F.lit("redirect=n"), n, F.lit(".example.net"))).otherwise(F.concat(qualifier, F.lit("all"))))
    none = F.array().cast("array<string>")
    # as DNS-over-HTTPS gives TXT data: in quoted chunks
    own = s.withColumn("spf", spf).select("name", F.lit("TXT").alias("rtype"), F.when(k % 11 == 0, F.lit(None)).when(k % 5 == 0, none).when(k % 9 == 0, F.array(spf, F.lit("v=spf1 -all"))).otherwise(F.array(F.lit('"site-check=1"'), F.concat(F.lit('"'), F.substring(spf, 1, 20), F.lit('" "'), F.expr("substring(spf, 21)"), F.lit('"')))).alias("values"))
    policy = F.element_at(F.array(*map(F.lit, ("reject", "quarantine", "none"))), (k % 3 + 1).cast("int"))
    dmarc = s.select(F.concat(F.lit("_dmarc."), "name"), F.lit("TXT"), F.when(k % 4 == 0, none).otherwise(F.array(F.concat(F.lit("v=DMARC1; p="), policy, F.lit("; pct="), ((k % 2 + 1) * 50).cast("string"), F.when(k % 7 == 0, "").otherwise("; rua=mailto:d@example.com")))))
    dkim = s.filter(k % 3 != 0).select(F.concat(F.lit("default._domainkey."), "name"), F.lit("TXT"), F.array(F.concat(F.lit("v=DKIM1; p="), F.repeat(F.lit("A"), F.when(k % 8 == 0, 0).when(k % 2 == 0, 216).otherwise(392)))))
    mx = s.select("name", F.lit("MX"), F.when(k % 10 == 0, none).when(k % 13 == 0, F.array(F.lit("0 ."))).otherwise(F.array(F.concat(F.lit("10 mx."), "name"))))
    nations = parquet(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".example.net")), F.lit("TXT"), F.array(F.concat(F.lit("v=spf1 a include:r"), F.col("n_regionkey").cast("string"), F.lit(".example.net ~all"))))
    regions = parquet(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string"), F.lit(".example.net")), F.lit("TXT"), F.array(F.lit("v=spf1 ip4:192.0.2.0/24 exists:x.example.net -all")))
    out = own
    for part in (dmarc, dkim, mx, nations, regions):
        out = out.union(part)
    return out


def listings(spark: SparkSession, d: str) -> DataFrame:
    tier = F.element_at(F.array(*map(F.lit, ("browser", "gateway", "mail", "endpoint", "feed", "unknown"))), (F.floor("value") % 6 + 1).cast("int"))
    host = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".example.com"))
    return parquet(spark, d, "events").filter("user_id is not null").select(host.alias("site"), host.alias("host"), F.concat(F.lit("Vendor "), F.col("event_type")).alias("vendor"), F.coalesce(tier, F.lit("unknown")).alias("tier"), F.when((F.floor("value") % 7).isin(1, 2, 4, 5, 6), "suspicious").otherwise("malicious").alias("category"))


def robots_bodies(spark: SparkSession, d: str, sites: int = 500) -> DataFrame:
    """robots.txt files: a user's events in order, each a line."""
    e = F.col("event_id")
    line = F.when(e % 5 == 0, F.concat(F.lit("User-agent: "), F.when(e % 3 == 0, "*").otherwise(F.concat(F.lit("bot"), (e % 4).cast("string"))))).when(e % 5 == 1, "Disallow: /").when(e % 35 == 2, "Allow: /open").when(e % 5 == 2, "Disallow: /x").when(e % 5 == 3, "# a comment").otherwise("Sitemap: https://example.com/s.xml")
    rows = parquet(spark, d, "events").filter("user_id is not null").select((F.col("user_id") % sites).cast("string").alias("site"), e.alias("e"), line.alias("line"))
    return rows.groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("e", "line"))), lambda x: x.line), "\n").alias("body")).withColumn("status", F.lit(200))


def jsonld_records(spark: SparkSession, d: str) -> DataFrame:
    """A product's structured data a part, with faults that follow from its key."""
    k = F.col("p_partkey")
    offer = F.concat(F.lit('{"@type":"Offer","price":"'), F.when(k % 6 == 0, "about ").otherwise(""), F.col("p_retailprice").cast("string"), F.lit('"'), F.when(k % 4 == 0, "").otherwise(',"priceCurrency":"EUR"'), F.lit("}"))
    body = F.concat(
        F.when(k % 10 == 0, '{"@type":"').otherwise('{"@context":"https://schema.org","@type":"'), F.when(k % 15 == 0, "Produkt").otherwise("Product"), F.lit('"'), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit(',"name":"'), F.col("p_name"), F.lit('"'))),
        F.lit(',"datePublished":"'), F.when(k % 8 == 0, "soon").otherwise("2024-05-01"), F.lit('","offers":'), offer, F.lit(',"brand":""'), F.when(k % 9 == 0, "").otherwise("}"),
    )
    return parquet(spark, d, "part").select(F.lower("p_brand").alias("site"), F.concat(F.lit("/p/"), k.cast("string")).alias("url"), F.array(body).alias("jsonld"))


def jsonld_graphs(spark: SparkSession, d: str) -> DataFrame:
    """A page an order with three blocks: an organisation and its catalogue, a second description of the
    organisation (under another @id each fourth order), and an article that refers to it."""
    o = F.col("o_orderkey")

    def one(condition: Column, text: str, other: str = "") -> Column:
        return F.when(condition, text).otherwise(other)

    def block(*parts: str | Column) -> Column:
        return F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])

    offers = '[{"@type":"Offer","position":1},{"@type":"Offer","position":2}]'
    first = block('{"@context":"https://schema.org","@graph":[{"@type":"Organization","@id":"#org","name":"N"},{"@type":"OfferCatalog","name":"C","numberOfItems":', (o % 3).cast("string"), ',"itemListElement":', offers, "}]}")
    second = block('{"@context":"https://schema.org","@type":"LocalBusiness","@id":"', one(o % 4 == 0, "#other", "#org"), '"', one(o % 5 == 0, ',"email":"a@example.com","sku":""', ',"address":{"@type":"PostalAddress","addressLocality":"L","addressRegion":"R","streetAddress":"S","postalCode":"P"}'), "}")
    author = F.when(o % 7 == 0, '{"@type":"Offer"}').when(o % 7 == 1, '"A. Author"').otherwise('{"@type":"Person","name":"A. Author"}')
    third = block('{"@context":"https://schema.org","@type":"Article","headline":"H","datePublished":"', one(o % 8 == 0, "soon", "2024-05-01"), '","author":', author, ',"publisher":{"@id":"', one(o % 6 == 0, "#nobody", "#org"), '"}}')
    site = F.concat(F.lit("c"), (F.col("o_custkey") % 100).cast("string"))
    return parquet(spark, d, "orders").select(site.alias("site"), F.concat(F.lit("/o/"), o.cast("string")).alias("url"), F.array(first, second, third).alias("jsonld"))


def crawl_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages as a crawl measured them, with a head and a first paragraph that follow from page_id, so that
    what the extraction finds is known."""
    p = F.col("page_id")

    def tag(condition: Column, *parts: str | Column) -> Column:
        return F.when(condition, F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])).otherwise("")

    always = F.lit(True)
    head = F.concat(
        tag(p % 16 == 3, "<base href='/b/'>"), tag(p % 3 != 0, '<meta name="description" content="About', (p % 40).cast("string"), F.repeat(F.lit("d"), (p % 180).cast("int")), '">'),
        tag(p % 4 != 0, '<link rel="canonical" href="', F.when(p % 8 == 1, F.concat(F.when(p % 24 == 1, "../c/./").otherwise("/c/"), p.cast("string"), F.lit("/"))).otherwise(F.col("url")), '">'),
        tag(p % 7 == 0, '<meta name="robots" content="NoIndex, follow">'), tag(p % 5 != 0, "<meta content='/i/1.png' property='og:image'>"), tag(p % 6 != 0, '<meta property="og:description" content="od">'),
        tag(always, '<meta property="og:title" content="T"><meta name="twitter:card" content="', F.when(p % 2 == 0, "summary_large_image").otherwise("summary"), '">'), tag(p % 9 != 0, '<meta name="viewport" content="width=device-width">'),
    )
    body = F.concat(
        tag(always, '<img src="', F.when((p % 6 == 1) & (p % 5 != 0), "../img/").otherwise("/img/"), (p % 20).cast("string"), '-300x200.png"', F.when(p % 3 == 1, ' alt=" "').when(p % 3 == 2, " alt='a picture'").otherwise(""), F.when(p % 2 == 0, ' width="3" height="2"').otherwise(""), ">"),
        tag(always, '<picture><source media="(max-width: 600px)" srcset="/m/1.webp"><source type="image/webp" srcset="/w/', p.cast("string"), "-480.webp 480w, /w/", p.cast("string"), '-960.webp 960w" sizes="', (300 + p % 400).cast("string"), 'px"><img src="f/', p.cast("string"), '.jpg" alt="x" width="1" height="1"></picture>'),
        tag(always, '<a href="rel/', (p % 7).cast("string"), '">Relative</a><a href="../up#f">Up</a><a href="//cdn.example.com/c/">Other</a>'),
        tag(always, '<a href="tel:', F.when(p % 10 == 0, "+1-555-0100").otherwise("+15550100"), '">Call</a>'), tag(p % 6 == 0, '<a href="/x"> </a>'), tag(p % 6 == 5, '<a href="/y"><img src="/y.png" alt="Why" width="1" height="1"></a>'), tag(p % 12 == 0, '<script src="http://cdn.example.com/x.js"></script>'),
    )
    html = F.replace(F.replace("html", F.lit("</head>"), F.concat(head, F.lit("</head>"))), F.lit("<body>"), F.concat(F.lit("<body>"), body))
    status = F.when(p % 11 == 0, 404).when(p % 13 == 0, 403).otherwise(200)
    via = F.when(p % 3 == 0, "link").otherwise("sitemap")
    moved = F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.host(F.col("url")), F.lit("/moved"), F.when(urls.path(F.col("url")) == "", "/").otherwise(urls.path(F.col("url"))))
    return spread(parquet(spark, d, "pages")).select("page_id", "url", html.alias("html"), status.alias("status"), F.lit(True).alias("is_html"), (p * 37 % 3000).alias("elapsed_ms"), (p % 5 == 0).alias("redirected"), F.when(p % 5 == 0, moved).otherwise(F.col("url")).alias("final_url"), (status == 403).alias("refused"), via.alias("discovered_via"))


def crawl_records(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return page_records(crawl_pages(spark, d))


def runtime(spark: SparkSession, d: str) -> DataFrame:
    """A rendered page an order."""
    o = F.col("o_orderkey")

    def listed(condition: Column, value: Column) -> Column:
        return F.when(condition, F.array(value))

    def joined(*parts: Column) -> Column:
        return F.flatten(F.filter(F.array(*parts), lambda x: x.isNotNull()))

    response = lambda kind: F.struct(F.lit(kind).alias("type"), F.lit("/r").alias("url"))
    site = F.concat(F.lit("c"), (F.col("o_custkey") % 100).cast("string"), F.lit(".example.com"))
    return parquet(spark, d, "orders").select(
        site.alias("site"), F.concat(F.lit("https://"), site, F.lit("/o/"), o.cast("string")).alias("url"), F.when(o % 19 == 0, 503).otherwise(200).alias("status"),
        joined(listed(o % 7 == 0, F.lit("TypeError"))).alias("page_errors"), joined(listed(o % 11 == 0, response("document")), listed(o % 13 == 0, response("script"))).alias("bad_responses"),
        joined(listed(o % 17 == 0, F.lit("/x.png")), listed(o % 6 == 0, F.lit(""))).alias("broken_images"), joined(listed(o % 23 == 0, F.lit("q"))).alias("unlabeled_inputs"),
        (o % 9).cast("int").alias("h_overflow"), (F.col("o_totalprice") * 20).cast("long").alias("resource_bytes"),
    )


def probe_answers(spark: SparkSession, d: str) -> DataFrame:
    """A probe an event, before echoes are told apart."""
    e = F.col("event_id")

    def one_of(*values: str) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (e % len(values) + 1).cast("int"))

    site = F.concat(F.lit("e"), (e % 50).cast("string"), F.lit(".example.com"))
    bucket = one_of("nonexistent", "exposed", "users", "author", "cms", "exposed", "cms")
    path = one_of("/.env", "/xmlrpc.php", "/readme.html", "/wp-json/", "/wp-login.php", "/other")
    return parquet(spark, d, "events").select(
        site.alias("site"), F.concat(F.lit("https://"), site, path).alias("url"), path.alias("path"), bucket.alias("bucket"), F.when(e % 4 == 0, 404).otherwise(200).alias("status"), (F.coalesce("value", F.lit(0.0)) * 100).alias("bytes"),
        F.lit("").alias("title"), F.when(e % 5 == 0, F.array(F.lit("admin"))).otherwise(F.array().cast("array<string>")).alias("users"), F.when(e % 3 == 0, "confirmed").otherwise("unclear").alias("verdict"),
    )


def probe_baselines(spark: SparkSession, d: str) -> DataFrame:
    """What each site answers at home and for a path that does not exist."""
    sites = parquet(spark, d, "events").select((F.col("event_id") % 50).alias("s")).distinct()
    return sites.select(F.concat(F.lit("e"), F.col("s").cast("string"), F.lit(".example.com")).alias("site"), F.lit(3000.0).alias("home_bytes"), F.lit("Home").alias("home_title"), F.when(F.col("s") % 2 == 0, 200).otherwise(404).alias("missing_status"), F.lit(9000.0).alias("missing_bytes"))


def sitemap_totals(spark: SparkSession, d: str) -> DataFrame:
    """A sitemap a customer; its nation is the site."""
    k = F.col("c_custkey")
    return parquet(spark, d, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("site"), F.concat(F.lit("/s"), k.cast("string"), F.lit(".xml")).alias("sitemap"), (k % 50 + 1).alias("urls"), F.when(F.col("c_nationkey") % 3 == 0, 0).otherwise(k % 2).alias("host_urls"))


def entry_points(spark: SparkSession, d: str) -> DataFrame:
    """How many redirects each customer's address takes."""
    k = F.col("c_custkey")
    return parquet(spark, d, "customer").select(F.concat(F.lit("k"), k.cast("string")).alias("site"), F.concat(F.lit("http://k"), k.cast("string"), F.lit("/")).alias("url"), (k % 3).cast("int").alias("hops"))
