"""Issues in the manner of a search console: pages grouped under an issue with a severity.

Every issue that looks at one page is an entry of one array, so a table of pages is read once; repeated
titles, descriptions and headings are counted by site and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits, and the severities in order.
TITLE_MAX, DESC_MAX, DESC_MIN, THIN_WORDS, SLOW_MS = 60, 160, 70, 300, 1500
SEVERITIES = ("error", "warning", "notice")


def _block_says(block: Column) -> Column:
    """Does a JSON-LD block name a type (or fail to parse, which is told elsewhere)?"""
    named = [F.get_json_object(block, path).isNotNull() for path in ("$['@type']", "$['@graph'][*]['@type']", "$[*]['@type']")]
    return F.get_json_object(block, "$").isNull() | named[0] | named[1] | named[2]


def _checks() -> list[tuple[str, str, Column]]:
    """(issue, severity, condition); the first three judge answers, the others HTML pages that came back."""
    c = F.col
    page = F.coalesce((c("status") == 200) & c("title").isNotNull(), F.lit(False))
    bare = lambda url: F.regexp_replace(url, "/+$", "")
    blank = lambda name: F.coalesce(c(name), F.lit("")) == ""
    return [
        ("http-error", "error", F.coalesce("status", F.lit(500)) >= 400),
        ("fetch-failed", "error", c("status").isNull()),
        ("redirect-in-sitemap", "warning", c("redirected")),
        ("indexable-staging", "error", page & ~c("noindex")),
        ("missing-description", "warning", page & blank("meta_description")),
        ("short-description", "notice", page & c("desc_len").between(1, DESC_MIN - 1)),
        ("long-description", "notice", page & (c("desc_len") > DESC_MAX)),
        ("missing-title", "error", page & blank("title")),
        ("long-title", "warning", page & (c("title_len") > TITLE_MAX)),
        ("no-h1", "warning", page & (c("h1_count") == 0)),
        ("multiple-h1", "notice", page & (c("h1_count") > 1)),
        ("missing-canonical", "warning", page & blank("canonical_href")),
        ("canonical-mismatch", "notice", page & ~blank("canonical_href") & (bare(c("canonical_href")) != bare(c("url")))),
        ("thin-content", "warning", page & (c("word_count") < THIN_WORDS)),
        ("missing-og-image", "warning", page & blank("og_image")),
        ("missing-og-description", "notice", page & blank("og_description")),
        ("images-missing-alt", "warning", page & ((c("img_no_alt") > 0) | (c("img_empty_alt") > 0))),
        ("images-no-dimensions", "notice", page & (c("img_no_dims") > 0)),
        ("links-no-anchor-text", "notice", page & (c("links_no_anchor_text") > 0)),
        ("no-schema", "notice", page & ~F.exists("jsonld", _block_says)),
        ("slow-response", "warning", page & (c("elapsed_ms") > SLOW_MS)),
    ]


#: Repeated fields.
REPEATED = (("duplicate-title", "warning", "title"), ("duplicate-meta_description", "warning", "meta_description"), ("duplicate-h1", "notice", "first_h1"))


def page_issues(records: DataFrame) -> DataFrame:
    """site, url, issue, severity: a row for each issue of each page."""
    hits = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(issue).alias("issue"), F.lit(severity).alias("severity"))) for issue, severity, test in _checks()])
    single = records.select("site", "url", F.explode(F.array_compact(hits)).alias("i")).select("site", "url", "i.*")
    pages = records.filter("status = 200 and title is not null").withColumn("first_h1", F.get("h1", F.lit(0)))
    fields = F.array(*[F.struct(F.lit(issue).alias("issue"), F.lit(severity).alias("severity"), F.trim(F.col(c)).alias("value")) for issue, severity, c in REPEATED])
    each = pages.select("site", "url", F.explode(fields).alias("f")).select("site", "url", "f.*").filter("value <> ''")
    often = each.groupBy("site", "issue", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return single.unionByName(each.join(often, ["site", "issue", "value"], "left_semi").select("site", "url", "issue", "severity"))


def issue_groups(issues: DataFrame) -> DataFrame:
    """site, issue, severity, pages, rank (the severity's place), worst and largest first within a site."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")) - 1
    return issues.groupBy("site", "issue", "severity").agg(F.count(F.lit(1)).alias("pages")).withColumn("rank", rank.cast("int")).orderBy("site", "rank", F.desc("pages"), "issue")
