"""What a crawl decides with tables: frontier, page limits, staging, page picks, author and vendor verdicts."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import urls
from plumbline.operators.graph import COMPACT_ROUNDS
from plumbline.operators.probes import echoes
from plumbline.session import cut

MAX_PAGES, PICKS = 300, 6
VERDICT = "map<string, struct<category: string, result: string>>"
VENDOR = f"struct<data: struct<attributes: struct<last_analysis_stats: map<string, long>, last_analysis_results: {VERDICT}, reputation: long, last_analysis_date: long>>>"


def expand_frontier(seeds: DataFrame, available: DataFrame, edges: DataFrame, max_pages: int = MAX_PAGES, most: int | None = None) -> DataFrame:
    """site, url, found (sitemap or link), round: pages crawled from the seeds by following links until
    none is new or the site's limit is reached.

    available: site, url of pages that can be fetched; edges: site, src, dst.  A round joins only the
    pages of the one before, and its pages enter by URL up to the room that is left.  most: an error is raised
    if it takes more rounds, as the result would not be whole."""
    room = Window.partitionBy("site").orderBy("url")
    links = cut(edges.select("site", "src", "dst").filter(urls.is_page(F.col("dst"))).distinct(), "links")
    known = cut(seeds.select("site", "url").distinct().withColumn("_n", F.row_number().over(room)).filter(F.col("_n") <= max_pages).select("site", "url", F.lit("sitemap").alias("found"), F.lit(0).alias("round")), "seeds")
    last = known
    for step in count(1):
        reached = last.select("site", F.col("url").alias("src")).join(links, ["site", "src"]).select("site", F.col("dst").alias("url")).distinct()
        fresh = reached.join(known, ["site", "url"], "left_anti").join(available.select("site", "url"), ["site", "url"], "left_semi")
        used = known.groupBy("site").agg(F.count(F.lit(1)).alias("used"))
        fresh = fresh.join(used, "site").withColumn("_n", F.row_number().over(room)).filter(F.col("_n") + F.col("used") <= max_pages)
        last = cut(fresh.select("site", "url", F.lit("link").alias("found"), F.lit(step).alias("round")), f"round{step}")
        if last.isEmpty():
            return known
        if most is not None and step > most:
            raise RuntimeError(f"pages lie deeper than {most} links")
        known = known.unionByName(last)
        if step % COMPACT_ROUNDS == 0:
            known = cut(known, f"known{step}")


def staging_sites(records: DataFrame, least: int = 3) -> DataFrame:
    """Sites all of whose pages (three at least) ask not to be indexed."""
    pages = records.filter("coalesce(status, 200) = 200 and coalesce(is_html, true)")
    return pages.groupBy("site").agg(F.bool_and("noindex").alias("all"), F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least) & F.col("all")).select("site")


def pick_pages(counts: DataFrame, homes: DataFrame, most: int = PICKS) -> DataFrame:
    """The home page, then the pages with most inbound links: site, url, rank."""
    home = homes.select("site", "url").distinct().withColumn("home", F.lit(True))
    order = Window.partitionBy("site").orderBy(F.desc(F.coalesce("home", F.lit(False))), F.desc("inbound"), "url")
    return counts.join(home, ["site", "url"], "left").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("site", "url", "rank")


def author_verdict(status: Column, final_url: Column, size: Column, title: Column, home_size: Column, home_title: Column) -> Column:
    """confirmed where the redirect names an account, unclear for a page of its own, else no evidence."""
    named = F.regexp_extract(F.coalesce(final_url, F.lit("")), r"/author/([^/?#]+)", 1) != ""
    return F.when(named, "confirmed").when((status == 200) & ~echoes(size, title, home_size, home_title), "unclear").otherwise("no evidence")


def vendor_report(answers: DataFrame) -> DataFrame:
    """answers: host, status, body (JSON) -> engines, counts, and the verdicts that name a fault."""
    parsed = answers.withColumn("a", F.from_json("body", VENDOR)["data"]["attributes"])
    results = F.map_entries(F.col("a.last_analysis_results"))
    bad = F.filter(results, lambda e: e.value.category.isin("malicious", "suspicious"))
    return parsed.select(
        "host", F.when(F.col("status") == 404, True).otherwise(False).alias("no_record"), F.size(results).alias("engines"), F.coalesce(F.col("a.last_analysis_stats")["malicious"], F.lit(0)).alias("malicious"),
        F.array_sort(F.transform(bad, lambda e: F.struct(e.key.alias("vendor"), e.value.category.alias("category"), e.value.result.alias("result")))).alias("verdicts"), F.col("a.reputation").alias("reputation"),
    )


def nav_only(edges: DataFrame) -> DataFrame:
    """Pages linked from menus and footers (region chrome) but from no page's body."""
    into = edges.filter("src <> dst").groupBy("site", F.col("dst").alias("url")).agg(F.count_distinct("src").alias("inbound_all"), F.count_distinct(F.when(F.col("region") == "body", F.col("src"))).alias("inbound_body"))
    return into.filter("inbound_all > 0 and inbound_body = 0")


def resource_bytes(resources: DataFrame) -> DataFrame:
    """resources: site, url, type, bytes -> bytes a page, by type and in all."""
    by_type = resources.groupBy("site", "url", "type").agg(F.sum("bytes").alias("bytes"))
    return by_type.groupBy("site", "url").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "bytes")))).alias("by_type"), F.sum("bytes").alias("total"))
