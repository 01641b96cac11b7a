"""Registered queries of sitemaps and discovery, beside their SQL.

A supplier is a site; its line items are what its sitemaps list, in order, with the pages it lists twice, some
assets and some pages of another host.  A third of the sites name their sitemap in robots.txt (every other one
of these an index with a leaf that is gone), a fifth of the others have it at an unusual path, a seventh of the
rest list nothing of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import sitemaps
from plumbline.plans.catalog import query
from plumbline.sources.tables import parquet


def _site() -> Column:
    return F.concat(F.lit("s"), F.col("k").cast("string"), F.lit(".example.com"))


def site_robots(spark: SparkSession, d: str) -> DataFrame:
    """A robots.txt a supplier."""
    k, site = F.col("k"), _site()
    body = F.when(k % 3 == 0, F.concat(F.lit("User-agent: *\nSitemap: https://"), site, F.lit("/named.xml\n"))).otherwise("User-agent: *\nDisallow: /x\n")
    return parquet(spark, d, "supplier").select(F.col("s_suppkey").alias("k")).select(site.alias("site"), F.when(k % 11 == 0, 404).otherwise(200).alias("status"), body.alias("body"))


def sitemap_documents(spark: SparkSession, d: str) -> DataFrame:
    """The sitemaps that those sites serve."""
    k, p, site = F.col("k"), F.col("p"), _site()
    index = (k % 3 == 0) & (k % 2 == 0)
    name = F.when(index, F.concat(F.lit("/sm-"), (p % 2).cast("string"), F.lit(".xml"))).when(k % 3 == 0, "/named.xml").when(k % 5 == 0, "/wp-sitemap.xml").otherwise("/sitemap.xml")
    foreign = (p % 17 == 0) | ((k % 3 != 0) & (k % 5 != 0) & (k % 7 == 0))
    host = F.when(foreign, "elsewhere.example.net").when(p % 4 == 1, F.concat(F.lit("www."), site)).otherwise(site)
    own = F.concat(F.lit("https://"), host, F.lit("/p/"), p.cast("string"), F.when(p % 13 == 0, ".pdf").when(p % 2 == 0, "/").otherwise(""))
    items = parquet(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("p"), F.struct("l_orderkey", "l_linenumber").alias("at"))
    lists = items.select("k", name.alias("name"), "at", own.alias("loc")).groupBy("k", "name").agg(F.array_sort(F.collect_list(F.struct("at", "loc"))).alias("list"))
    entries = F.array_join(F.transform("list", lambda x: F.concat(F.lit("<url><loc>"), x.loc, F.lit("</loc><lastmod>2024-05-01</lastmod></url>"))), "")
    leaves = lists.select("k", "name", F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), entries, F.lit("</urlset>")).alias("body"))
    named = '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>sm-0.xml</loc></sitemap><sitemap><loc>/x/../sm-1.xml</loc></sitemap><sitemap><loc>gone.xml</loc></sitemap></sitemapindex>'
    indexes = parquet(spark, d, "supplier").select(F.col("s_suppkey").alias("k")).filter(index).select("k", F.lit("/named.xml").alias("name"), F.lit(named).alias("body"))
    return leaves.unionByName(indexes).select(site.alias("site"), F.concat(F.lit("https://"), site, "name").alias("url"), F.lit(200).alias("status"), "body")


_LISTED = """s AS (SELECT s_suppkey AS k, 's' || s_suppkey || '.example.com' AS site, s_suppkey % 3 = 0 AS named, s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 AS indexed, s_suppkey % 33 = 0 AS lost FROM supplier),
items AS (SELECT s.*, l_partkey AS p, l_orderkey AS o, l_linenumber AS n, CASE WHEN indexed THEN 'sm-' || l_partkey % 2 WHEN named THEN 'named' WHEN k % 5 = 0 THEN 'wp-sitemap' ELSE 'sitemap' END AS leaf,
 l_partkey % 17 = 0 OR (NOT named AND k % 5 <> 0 AND k % 7 = 0) AS foreign_host FROM s JOIN lineitem ON l_suppkey = k WHERE NOT lost),
counted AS (SELECT site, k, leaf, count(*) AS urls, count(*) FILTER (NOT foreign_host) AS host_urls FROM items GROUP BY ALL), own AS (SELECT site FROM counted GROUP BY site HAVING sum(host_urls) > 0),
pages AS (SELECT site, 'https://' || CASE WHEN p % 4 = 1 THEN 'www.' ELSE '' END || site || '/p/' || p || CASE WHEN p % 2 = 0 THEN '/' ELSE '' END AS url, min(leaf) AS leaf, min((o, n)) AS place FROM items WHERE NOT foreign_host AND p % 13 <> 0 AND site IN (SELECT site FROM own) GROUP BY ALL),
placed AS (SELECT site, url, 1 + row_number() OVER (PARTITION BY site ORDER BY leaf, place, url) AS pos FROM pages
 UNION ALL SELECT site, 'https://' || site || '/', 1 FROM s)"""


@query("WITH " + _LISTED + """ SELECT site, 'https://' || site || '/' || leaf || '.xml' AS sitemap, '200' AS status, CAST(urls AS BIGINT) AS urls, CAST(host_urls AS BIGINT) AS host_urls FROM counted
 UNION ALL SELECT site, 'https://' || site || '/gone.xml', NULL, 0, 0 FROM s WHERE indexed AND NOT lost AND site IN (SELECT site FROM own) UNION ALL SELECT site, '(link crawl from homepage)', '200', 0, 0 FROM s WHERE site NOT IN (SELECT site FROM own)""")
def sitemap_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Sitemap indexes: what each leaf lists, and how much of it is the site's own."""
    _, _, summary = sitemaps.discover(sitemap_documents(spark, d), site_robots(spark, d))
    return summary.select("site", "sitemap", "status", F.col("urls").cast("long").alias("urls"), F.col("host_urls").cast("long").alias("host_urls"))


@query("WITH " + _LISTED + " SELECT site, CAST(pos AS BIGINT) AS pos, url FROM placed WHERE pos <= 300")
def discovered_pages(spark: SparkSession, d: str) -> DataFrame:
    """Discovery: the pages that each site's crawl begins from, in order."""
    pages, _, _ = sitemaps.discover(sitemap_documents(spark, d), site_robots(spark, d))
    return pages.select("site", F.col("pos").cast("long").alias("pos"), "url")


@query("WITH " + _LISTED + """ SELECT site, CASE WHEN site IN (SELECT site FROM own) THEN 'sitemap' ELSE 'crawl' END AS method, count(*) AS found, CAST(least(count(*), 300) AS BIGINT) AS kept, CAST(greatest(count(*) - 300, 0) AS BIGINT) AS left_out FROM placed GROUP BY ALL""")
def discovered_sites(spark: SparkSession, d: str) -> DataFrame:
    """Discovery: how each site's pages were found, and how many the limit left out."""
    _, sites, _ = sitemaps.discover(sitemap_documents(spark, d), site_robots(spark, d))
    return sites
