"""Registered queries of rules that the other frames never make fire, beside their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import graph, mail, probes, rules
from plumbline.operators.records import page_records
from plumbline.plans import frames as X
from plumbline.plans.catalog import query
from plumbline.plans.discovery import site_robots
from plumbline.plans.findings import _COUNTED, _family, _union
from plumbline.session import ship, spread
from plumbline.sources.tables import parquet


def head_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page a customer, of its nation's site: titles that are missing, long or short, headings that are missing,
    doubled or shared, languages and structured data that are missing."""
    ship(spark)
    k = F.col("c_custkey")

    def text(*parts: str | Column) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    title = F.when(k % 5 == 0, "").when(k % 5 == 1, text("<title>", F.col("c_name"), F.lit(" " + "and more " * 8), "</title>")).when(k % 5 == 2, "<title>Short</title>").otherwise(text("<title>The page of ", F.col("c_name"), "</title>"))
    heading = F.when(k % 4 == 0, "").when(k % 4 == 1, "<h1>One</h1><h1>Two</h1>").when(k % 4 == 2, text("<h1>Shared ", (k % 3).cast("string"), "</h1>")).otherwise(text("<h1>Own ", F.col("c_name"), "</h1>"))
    data = F.when((k % 8 < 3) | (F.col("c_nationkey") % 2 == 0), '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Thing"}</script>').otherwise("")
    html = text("<html", F.when(k % 6 != 0, ' lang="en"').otherwise(""), "><head>", title, data, "</head><body>", heading, "</body></html>")
    return page_records(spread(parquet(spark, d, "customer")).select(k.alias("page_id"), text("https://n", F.col("c_nationkey").cast("string"), ".example.com/c/", k.cast("string")).alias("url"), html.alias("html")))


_HEADS = """p AS (SELECT c_custkey AS k, c_nationkey AS n, 'https://n' || c_nationkey || '.example.com/c/' || c_custkey AS url, CASE WHEN c_custkey % 4 = 2 THEN 'Shared ' || c_custkey % 3 WHEN c_custkey % 4 = 1 THEN 'One' WHEN c_custkey % 4 = 3 THEN c_name END AS h1, c_custkey % 8 < 3 OR c_nationkey % 2 = 0 AS data FROM customer WHERE c_nationkey IS NOT NULL),
shared AS (SELECT n, h1 FROM p WHERE h1 IS NOT NULL GROUP BY ALL HAVING count(*) > 1), bare AS (SELECT n FROM p GROUP BY n HAVING avg(CAST(NOT data AS INT)) >= 0.5)"""


@query("WITH " + _HEADS + ", " + _union(
    "'MET-01' AS finding, 'high' AS severity, url FROM p WHERE k % 5 = 0", "'MET-02', 'medium', url FROM p WHERE k % 5 = 1", "'MET-03', 'low', url FROM p WHERE k % 5 = 2", "'MET-08', 'medium', url FROM p WHERE k % 4 = 0",
    "'MET-09', 'low', url FROM p WHERE k % 4 = 1", "'MET-10', 'low', url FROM p JOIN shared USING (n, h1)", "'MET-11', 'medium', url FROM p WHERE k % 6 = 0", "'SOC-03', 'medium', url FROM p JOIN bare USING (n) WHERE NOT data",
) + _COUNTED)
def head_findings(spark: SparkSession, d: str) -> DataFrame:
    """Rules over titles, headings, languages and missing structured data."""
    records = head_pages(spark, d)
    none = spark.createDataFrame([], "site string, url string, type string, prop string, code string, level string, layer string, path string, n long")
    return _family(rules.Frames(records, schema_issues=none), "MET-01", "MET-02", "MET-03", "MET-08", "MET-09", "MET-10", "MET-11", "SOC-03")


@query("""SELECT CASE WHEN s_suppkey % 11 = 0 THEN 'robots.txt was not served' || CASE WHEN s_suppkey % 3 <> 0 THEN '; no Sitemap line' ELSE '' END ELSE 'no Sitemap line' END AS problems, count(*) AS sites FROM supplier WHERE s_suppkey % 11 = 0 OR s_suppkey % 3 <> 0 GROUP BY ALL""")
def robots_problems(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each site's robots.txt."""
    hits = rules.run(rules.Frames(X.records(spark, d), robots=probes.robots_summary(site_robots(spark, d))), ["IDX-02"])
    return hits.groupBy(F.col("detail").alias("problems")).agg(F.count(F.lit(1)).alias("sites"))


@query("""WITH e AS (SELECT event_id % 3000 AS h, event_type, ['browser', 'gateway', 'mail', 'endpoint', 'feed', 'unknown'][event_id % 6 + 1] AS tier FROM events), w AS (SELECT h, any_value(tier) AS tier, count(*) AS n FROM e GROUP BY h),
hits AS (SELECT CASE WHEN tier = 'browser' THEN 'REP-01' WHEN tier IN ('gateway', 'mail', 'endpoint') THEN 'REP-02' ELSE 'REP-03' END AS finding, CASE WHEN tier = 'browser' THEN 'critical' WHEN tier IN ('gateway', 'mail') THEN CASE WHEN n >= 2 THEN 'high' ELSE 'medium' END WHEN tier = 'endpoint' THEN CASE WHEN n >= 2 THEN 'medium' ELSE 'low' END ELSE 'low' END AS severity, h AS url FROM w)""" + _COUNTED)
def listing_findings(spark: SparkSession, d: str) -> DataFrame:
    """Rules over listings of hosts that one kind of source names."""
    e = F.col("event_id")
    host = F.concat(F.lit("h"), (e % 3000).cast("string"), F.lit(".example.com"))
    tier = F.element_at(F.array(*map(F.lit, ("browser", "gateway", "mail", "endpoint", "feed", "unknown"))), (e % 6 + 1).cast("int"))
    named = parquet(spark, d, "events").select(host.alias("site"), host.alias("host"), F.concat(F.lit("Vendor "), "event_type").alias("vendor"), tier.alias("tier"), F.lit("malicious").alias("category"))
    return _family(rules.Frames(X.records(spark, d), reputation=probes.reputation_grade(named)), "REP-01", "REP-02", "REP-03")


@query("""WITH hits AS (SELECT 'MAIL-03' AS finding, 'high' AS severity, s_suppkey AS url FROM supplier WHERE s_suppkey % 16 > 10)""" + _COUNTED)
def spf_cost_findings(spark: SparkSession, d: str) -> DataFrame:
    """SPF records that cost more lookups than receivers spend: suppliers that include up to 15 others' records."""
    k = F.col("s_suppkey")
    domain = F.concat(F.lit("s"), k.cast("string"), F.lit(".example.com"))
    many = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), (k % 16).cast("int")), lambda i: i > 0), lambda i: F.concat(F.lit("include:i"), i.cast("string"), F.lit(".example.net "))), "")
    own = parquet(spark, d, "supplier").select(domain.alias("name"), F.lit("TXT").alias("rtype"), F.array(F.concat(F.lit("v=spf1 "), many, F.lit("-all"))).alias("values"))
    included = spark.range(1, 16).select(F.concat(F.lit("i"), F.col("id").cast("string"), F.lit(".example.net")), F.lit("TXT"), F.array(F.lit("v=spf1 ip4:192.0.2.0/24 -all")))
    domains = parquet(spark, d, "supplier").select(domain.alias("site"), domain.alias("domain"))
    return _family(rules.Frames(X.records(spark, d), mail=mail.mail_records(domains, own.union(included))), "MAIL-03")


@query("""WITH l AS (SELECT DISTINCT l_partkey AS p FROM lineitem), hits AS (SELECT 'ORP-07' AS finding, 'medium' AS severity, p AS url FROM l WHERE p % 4 = 0)""" + _COUNTED)
def rendered_findings(spark: SparkSession, d: str) -> DataFrame:
    """Pages that only rendered links lead to."""
    part, page = F.col("l_partkey"), F.lit("https://shop.example.com/")
    site = F.lit("shop.example.com").alias("site")
    url = F.concat(page, F.lit("p/"), part.cast("string"), F.lit("/"))
    edges = parquet(spark, d, "lineitem").select(site, F.concat(page, F.lit("s/"), F.col("l_suppkey").cast("string"), F.lit("/")).alias("src"), url.alias("dst"), (part % 4 == 0).alias("rendered"))
    nodes = parquet(spark, d, "part").select(site, F.concat(page, F.lit("p/"), F.col("p_partkey").cast("string"), F.lit("/")).alias("url"))
    homes = nodes.groupBy("site").agg(F.min("url").alias("url"))
    depths = homes.withColumn("depth", F.lit(0).cast("long"))
    classified = graph.classify(graph.inbound_counts(nodes, edges), depths, homes)
    return _family(rules.Frames(X.records(spark, d), graph=classified), "ORP-07")
