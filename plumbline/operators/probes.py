"""Evaluators of collected answers: robots.txt, probe responses, DNS blocklists, reputation listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
SEARCH_AGENTS = ("*", "googlebot", "bingbot", "googlebot-image", "slurp", "duckduckbot", "yandexbot", "baiduspider")
PLATFORMS = (
    ("WordPress", r"(?i)/wp-content/|/wp-includes/|wp-json|name=\"generator\"[^>]*WordPress"),
    ("Next.js", r"(?i)/_next/static/|__NEXT_DATA__|id=\"__next\""),
    ("Shopify", r"(?i)cdn\.shopify\.com|Shopify\.theme"),
    ("Wix", r"(?i)static\.parastorage\.com|wixstatic\.com"),
    ("Squarespace", r"(?i)static1\.squarespace\.com|squarespace-cdn\.com"),
    ("Webflow", r"(?i)assets\.website-files\.com|uploads-ssl\.webflow\.com"),
    ("Drupal", r"(?i)/sites/default/files/|name=\"Generator\"[^>]*Drupal"),
    ("Joomla", r"(?i)/media/jui/|name=\"generator\"[^>]*Joomla"),
    ("Gatsby", r"(?i)___gatsby|/page-data/app-data\.json"),
    ("Nuxt", r"(?i)__NUXT__|/_nuxt/"),
)
ECHO_BYTES, SOFT_404_BYTES = 512, 2048
TIERS = ("browser", "gateway", "mail", "endpoint", "feed", "unknown")
STALE_DAYS = 90
ZONES = (
    ("dbl.spamhaus.org", r"^127\.0\.1\.(?:[2-9]|[1-9]\d)$", r"^127\.0\.1\.1(?:0[2-9]|[1-9]\d)$", r"^127\.(?:255\.255\.\d+|0\.1\.255)$"),
    ("multi.surbl.org", r"^127\.0\.0\.(?:[2-9]|[1-9]\d|1\d\d|2[0-4]\d|25[0-4])$", "", r"^127\.0\.0\.(?:1|255)$"),
    ("multi.uribl.com", r"^127\.0\.0\.(?:[2-9]|1[0-4])$", "", r"^127\.0\.0\.(?:1|255)$"),
)


def robots_groups(robots: DataFrame) -> DataFrame:
    """robots: site, body -> a row per user-agent group: agents, blocks (Disallow: / and no Allow),
    blocks_search.  A group begins with a User-agent line that follows a rule."""
    lines = robots.select("site", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("n", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", "#.*$", ""))).filter(F.col("line").contains(":"))
    parsed = lines.select("site", "n", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value")).filter(F.col("field").isin("user-agent", "disallow", "allow"))
    by_line = Window.partitionBy("site").orderBy("n")
    begins = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(by_line), F.lit("rule")) != "user-agent")
    grouped = parsed.withColumn("group", F.sum(begins.cast("int")).over(by_line)).filter("group > 0")
    out = grouped.groupBy("site", "group").agg(
        F.array_sort(F.collect_set(F.when(F.col("field") == "user-agent", F.lower("value")))).alias("agents"),
        F.bool_or((F.col("field") == "disallow") & (F.col("value") == "/")).alias("root"),
        F.bool_or((F.col("field") == "allow") & (F.col("value") != "")).alias("allowed"),
    )
    blocks = F.col("root") & ~F.col("allowed")
    return out.select("site", "group", "agents", blocks.alias("blocks"), (blocks & F.arrays_overlap("agents", F.array(*map(F.lit, SEARCH_AGENTS)))).alias("blocks_search"))


def robots_summary(robots: DataFrame) -> DataFrame:
    """site, status, has_sitemap, directives, disallow_all, blocked agents: the table rules and gates read."""
    groups = robots_groups(robots).groupBy("site").agg(F.bool_or("blocks_search").alias("disallow_all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("blocks"), F.col("agents")))))).alias("disallow_all_agents"))
    own = robots.select("site", F.col("url") if "url" in robots.columns else F.col("site").alias("url"), "status", (F.size(sitemap_lines(F.col("body"))) > 0).alias("has_sitemap"), F.regexp_extract_all("body", F.lit(r"(?im)^\s*(?:user-agent|disallow|allow)\s*:.*$"), F.lit(0)).alias("directives"))
    return own.join(groups, "site", "left").na.fill(False, ["disallow_all"])


def sitemap_lines(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"(?im)^[ \t]*sitemap:[ \t]*(\S+)"), F.lit(1))


def sitemap_urls(body: Column) -> Column:
    """The <loc> values of a sitemap or sitemap index."""
    return F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<(?:\w+:)?loc[^>]*>(.*?)</(?:\w+:)?loc>"), F.lit(1)), lambda x: F.trim(x))


def platforms(body: Column, headers: Column | None = None) -> Column:
    own = F.substring(body, 1, 400_000)
    by_body = [F.when(own.rlike(p), F.lit(name)) for name, p in PLATFORMS]
    powered = F.lower(F.coalesce(headers["x-powered-by"], F.lit(""))) if headers is not None else F.lit("")
    by_header = [F.when(powered.contains(name.lower()), F.lit(name)) for name, _ in PLATFORMS]
    return F.array_distinct(F.filter(F.array(*by_body, *by_header), lambda x: x.isNotNull()))


def echoes(size: Column, title: Column, other_size: Column, other_title: Column) -> Column:
    """Is one response just the other again: sizes near, or the same title?"""
    near = (size > 0) & (other_size > 0) & (F.abs(size - other_size) <= ECHO_BYTES)
    return F.coalesce(near, F.lit(False)) | F.coalesce((title != "") & (title == other_title), F.lit(False))


def suppressed_probes(probes: DataFrame, baselines: DataFrame) -> DataFrame:
    """probes with suppressed: true where the response echoes the site's home or its answer to a path
    that does not exist.  baselines: site, home_bytes, home_title, missing_status, missing_bytes."""
    joined = probes.join(baselines, "site", "left")
    soft = (F.col("missing_status") == 200) & (F.abs(F.col("bytes") - F.col("missing_bytes")) <= SOFT_404_BYTES)
    return joined.withColumn("suppressed", echoes(F.col("bytes"), F.col("title"), F.col("home_bytes"), F.col("home_title")) | F.coalesce(soft, F.lit(False)))


def blocklist_verdict(zone: Column, addresses: Column) -> Column:
    """clean, refused, advisory or listed; null addresses were never read; odd answers are no listing."""
    chain = F.when(addresses.isNull(), F.lit(None).cast("string")).when(F.size(addresses) == 0, "clean")

    def answered(pattern: str) -> Column:
        return F.exists(addresses, lambda a: a.rlike(pattern))

    for name, listed, advisory, refused in ZONES:
        chain = chain.when((zone == name) & answered(refused), "refused")
        if advisory:
            chain = chain.when((zone == name) & answered(advisory), "advisory")
        chain = chain.when((zone == name) & answered(listed), "listed")
    return chain.otherwise("refused")


def vendor_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def reputation_grade(listings: DataFrame, tiers: DataFrame | None = None) -> DataFrame:
    """listings: site, host, vendor, tier (or looked up by vendor), category -> worst tier, vendors at
    it, severity by consequence and agreement."""
    if tiers is not None:
        known = tiers.select(vendor_key(F.col("vendor")).alias("_key"), F.col("tier").alias("_tier"))
        listings = listings.withColumn("_key", vendor_key(F.col("vendor"))).join(known, "_key", "left").withColumn("tier", F.coalesce("_tier", F.lit("unknown"))).drop("_key", "_tier")
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier")), F.lit(0)), F.lit(9))
    bad = listings.filter("coalesce(category, 'malicious') = 'malicious'").groupBy("site", "host", "tier", rank.alias("rank")).agg(F.count(F.lit(1)).alias("agree"), F.array_sort(F.collect_set("vendor")).alias("vendors"))
    worst = bad.groupBy("site", "host").agg(F.min_by(F.struct("tier", "agree", "vendors"), "rank").alias("w")).select("site", "host", F.col("w.tier").alias("worst_tier"), "w.agree", "w.vendors")
    t, n = F.col("worst_tier"), F.col("agree")
    grade = F.when(t == "browser", "critical").when(t.isin("gateway", "mail"), F.when(n >= 2, "high").otherwise("medium")).when(t == "endpoint", F.when(n >= 2, "medium").otherwise("low")).otherwise("low")
    return worst.withColumn("grade", grade)


def feed_hits(feed: DataFrame, hosts: DataFrame, most: int = 25) -> DataFrame:
    """Lines of a feed whose host is one of ours, at most `most` a host."""
    order = Window.partitionBy("host").orderBy("line")
    own = feed.withColumn("host", F.lower(F.regexp_extract("line", r"^(?:https?://)?([^/:\s#]+)", 1))).join(hosts.select("host").distinct(), "host", "left_semi")
    return own.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).drop("nth")
