"""Sitemaps as tables: indexes are followed to their leaves, and each site's pages are chosen from the first
candidate that lists any.

files: what was fetched, a row a document of a site: site (its host), url (as asked for), status, body, and
optionally served (the URL that answered).  An index is joined with its children level by level, MAX_INDEXES
levels at most, as many as crawlers follow; that also ends loops.  Documents are parsed once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import urls
from plumbline.operators.probes import sitemap_lines
from plumbline.session import cut

# Fixed values.
CONVENTIONAL = ("/sitemap.xml", "/sitemap_index.xml", "/wp-sitemap.xml", "/sitemap-index.xml", "/sitemap/sitemap.xml")
MAX_INDEXES = 2
MAX_PAGES, SAMPLE = 300, 3
FROM_HOME = "(link crawl from homepage)"


def locations(body: Column, element: str) -> Column:
    """The addresses that the <url> or <sitemap> elements of a document name, in its order.  Elements of other
    vocabularies inside, such as pictures, have addresses of their own, which are not read."""
    entries = F.regexp_extract_all(body, F.lit(rf"(?is)<((?:[\w.-]+:)?){element}(?:\s[^>]*)?>(.*?)</\1{element}\s*>"), F.lit(0))
    found = F.transform(entries, lambda e: F.regexp_extract(e, r"(?is)^<((?:[\w.-]+:)?)\w+(?:\s[^>]*)?>.*?<\1loc(?:\s[^>]*)?>(.*?)</\1loc\s*>", 2))

    def plain(value: Column) -> Column:
        value = F.regexp_replace(value, r"(?is)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            value = F.replace(value, F.lit(entity), F.lit(char))
        return F.regexp_replace(value, r"^\s+|\s+$", "")

    return F.filter(F.transform(found, plain), lambda x: x != "")


def parsed(files: DataFrame) -> DataFrame:
    """site, url, status ('200', another code, or 'ERROR' for what is no sitemap), children, listed."""
    served = F.coalesce(F.col("served"), F.col("url")) if "served" in files.columns else F.col("url")
    bare = F.regexp_replace(F.coalesce("body", F.lit("")), r"(?s)<!--.*?-->", "")
    kind = F.regexp_extract(bare, r"(?is)^\s*(?:\x{feff})?(?:<\?.*?\?>\s*|<!doctype[^>]*>\s*)*<(?:[\w.-]+:)?(\w+)", 1)
    whole = bare.rlike(r"(?is)</(?:[\w.-]+:)?(urlset|sitemapindex)\s*>\s*$|<(?:[\w.-]+:)?(urlset|sitemapindex)[^>]*/>\s*$")
    good = (F.col("status") == 200) & F.lower(kind).isin("urlset", "sitemapindex") & whole
    status = F.when(F.col("status") != 200, F.col("status").cast("string")).when(F.coalesce(good, F.lit(False)), "200").otherwise("ERROR")

    def named(element: str) -> Column:
        return F.when(good, F.transform(locations(bare, element), lambda x: urls.absolute(served, x))).otherwise(F.array().cast("array<string>"))

    return files.select("site", "url", status.alias("status"), named("sitemap").alias("children"), named("url").alias("listed")).dropDuplicates(["site", "url"])


def candidates(robots: DataFrame, base: Column | None = None) -> DataFrame:
    """site, rank, sitemap: what robots.txt names, in its order, before the conventional paths; each once.
    robots: site, status, body (a row a site, with nulls where there is none)."""
    origin = F.concat(F.lit("https://"), F.col("site")) if base is None else base
    named = F.when(F.coalesce(F.col("status") == 200, F.lit(False)), sitemap_lines(F.coalesce("body", F.lit("")))).otherwise(F.array().cast("array<string>"))
    paths = F.transform(F.array(*map(F.lit, CONVENTIONAL)), lambda p: F.concat(origin, p))
    return robots.select("site", F.posexplode(F.array_distinct(F.concat(named, paths))).alias("rank", "sitemap"))


def followed(files: DataFrame, asked: DataFrame, levels: int = MAX_INDEXES) -> DataFrame:
    """site, rank, path (array of positions, which orders a candidate's leaves), sitemap, status, listed: the
    leaves that each candidate leads to.  asked: site, rank, sitemap.  What was not fetched has status null; an
    index below `levels` others is a leaf that lists nothing."""
    documents = cut(parsed(files), "sitemaps")
    at = asked.select("site", "rank", F.array().cast("array<int>").alias("path"), F.col("sitemap").alias("url"))
    leaves = []
    for level in range(levels + 1):
        met = at.join(documents, ["site", "url"], "left")
        index = F.coalesce(F.size("children") > 0, F.lit(False)) & F.lit(level < levels)
        leaves.append(met.filter(~index).select("site", "rank", "path", F.col("url").alias("sitemap"), "status", F.coalesce("listed", F.array().cast("array<string>")).alias("listed")))
        if level < levels:
            inner = met.filter(index).select("site", "rank", "path", F.posexplode("children").alias("pos", "url"))
            at = cut(inner.select("site", "rank", F.concat("path", F.array("pos")).alias("path"), "url"), f"sitemaps{level}")
    return reduce(DataFrame.unionByName, leaves)


def leaf_summary(leaves: DataFrame) -> DataFrame:
    """site, rank, path, sitemap, status, urls, host_urls, off_host (the first few URLs of other hosts)."""
    foreign = F.filter("listed", lambda u: ~urls.same_site(u, F.col("site")))
    return leaves.select("site", "rank", "path", "sitemap", "status", F.size("listed").alias("urls"), (F.size("listed") - F.size(foreign)).alias("host_urls"), F.slice(foreign, 1, SAMPLE).alias("off_host"))


def discover(files: DataFrame, robots: DataFrame, max_pages: int = MAX_PAGES, base: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What each site of `robots` is crawled from, as three tables.

    pages: site, pos, url (as the sitemap writes it), sitemap (null for the home page that is added), at most
    max_pages a site; sites: site, method (sitemap or crawl), found, kept, left_out; summary: the leaves that
    were used, or those of all candidates where none lists a page of the site.

    The first candidate with a page of the site's own is used and no other.  Of spellings of one page the first
    stays.  Where no root URL is listed, the home page comes first."""
    origin = F.concat(F.lit("https://"), F.col("site")) if base is None else base
    leaves = cut(followed(files, candidates(robots, base)), "sitemap-leaves")
    rows = leaf_summary(leaves)
    counted = rows.groupBy("site", "rank").agg(F.sum("urls").alias("urls"), F.sum("host_urls").alias("host_urls"))
    chosen = counted.filter("host_urls > 0").groupBy("site").agg(F.min("rank").alias("best"))
    sites = cut(robots.select("site", origin.alias("origin")).dropDuplicates(["site"]).join(chosen, "site", "left"), "sitemap-sites")

    lists = rows.join(counted.filter("urls > 0").select("site", "rank"), ["site", "rank"], "left_semi").join(sites.select("site", "best"), "site").filter("best is null or rank = best").drop("best")
    home = sites.filter("best is null").select("site", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("array<int>").alias("path"), F.lit(FROM_HOME).alias("sitemap"), F.lit("200").alias("status"), F.lit(0).alias("urls"), F.lit(0).alias("host_urls"), F.array().cast("array<string>").alias("off_host"))
    summary = lists.unionByName(home)

    used = leaves.join(sites.filter("best is not null").select("site", F.col("best").alias("rank")), ["site", "rank"])
    each = used.select("site", "path", "sitemap", F.posexplode("listed").alias("n", "url"))
    own = each.filter(urls.same_site(urls.normalise(F.col("url")), F.col("site")) & urls.is_page(urls.normalise(F.col("url"))))
    order = F.struct(F.lit(1).alias("tier"), "path", "n")
    once = cut(own.groupBy("site", urls.normalise(F.col("url")).alias("identity")).agg(F.min_by(F.struct(F.trim("url").alias("url"), "sitemap"), order).alias("u"), F.min(order).alias("at")).select("site", "u.url", "u.sitemap", "at"), "sitemap-pages")
    rooted = once.groupBy("site").agg(F.count(F.lit(1)).alias("listed"), F.bool_or(urls.path(F.col("url")).isin("", "/")).alias("rooted"))
    totals = cut(sites.join(rooted, "site", "left").select("site", "origin", "best", F.coalesce("listed", F.lit(0)).alias("listed"), F.coalesce("rooted", F.lit(False)).alias("rooted")), "sitemap-totals")
    first = F.struct(F.lit(0).alias("tier"), F.array().cast("array<int>").alias("path"), F.lit(0).alias("n"))
    added = totals.filter("not rooted").select("site", urls.normalise(F.concat("origin", F.lit("/"))).alias("url"), F.lit(None).cast("string").alias("sitemap"), first.alias("at"))
    pos = F.row_number().over(Window.partitionBy("site").orderBy("at"))  # of which Spark keeps max_pages a site before the shuffle
    pages = once.unionByName(added).withColumn("pos", pos).filter(F.col("pos") <= max_pages).select("site", "pos", "url", "sitemap")
    found = (F.col("listed") + F.when(F.col("rooted"), 0).otherwise(1)).cast("long")
    kept = F.least(found, F.lit(max_pages).cast("long"))
    per_site = totals.select("site", F.when(F.col("best").isNull(), "crawl").otherwise("sitemap").alias("method"), found.alias("found"), kept.alias("kept"), (found - kept).alias("left_out"))
    return pages, per_site, summary
