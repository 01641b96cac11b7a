"""Link graph of any number of sites: inbound counts, depth by breadth-first search, classes, hubs.

Inputs: nodes (site, url, and optionally schema_types, is_home) and edges (site, src, dst, and
optionally anchor, rendered).  Every join is on (site, url); all sites are searched together, a level a
round.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import urls
from plumbline.operators.few import smallest
from plumbline.session import cut

MAX_DEPTH = 3
NAV_SHARE = 0.5
HUB_SEGMENTS = ("blog", "blogs", "news", "articles", "insights", "resources")


def canonical_edges(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges between canonical pages.  aliases: site, alias, url (every spelling of a page: its URL,
    final URL, duplicates).  A target without alias stands for itself; links to the page itself go."""
    named = aliases.select("site", "alias", F.col("url").alias("_to"))
    out = edges.withColumn("alias", urls.normalise(F.col("dst"))).join(named, ["site", "alias"], "left")
    return out.withColumn("dst", F.coalesce("_to", "dst")).drop("_to", "alias").filter("src <> dst")


def inbound_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node: distinct HTML sources, distinct rendered sources, their sum (a source in both counts
    twice), outbound targets.  What the links say is anchor_examples()."""
    edges = edges if "rendered" in edges.columns else edges.withColumn("rendered", F.lit(False))
    # a pair is counted once a kind; distinct first, so that a hub's sources are summed map-side
    pairs = edges.filter("src <> dst").select("site", "src", "dst", "rendered").distinct()
    into = pairs.groupBy("site", F.col("dst").alias("url")).agg(
        F.count_if(~F.col("rendered")).alias("inbound_html"),
        F.count_if(F.col("rendered")).alias("inbound_rendered"),
    )
    out = pairs.select("site", F.col("src").alias("url"), "dst").distinct().groupBy("site", "url").agg(F.count(F.lit(1)).alias("outbound"))
    joined = nodes.join(into, ["site", "url"], "left").join(out, ["site", "url"], "left")
    filled = joined.na.fill(0, ["inbound_html", "inbound_rendered", "outbound"])
    return filled.withColumn("inbound", F.col("inbound_html") + F.col("inbound_rendered"))


def anchor_examples(edges: DataFrame, most: int = 5) -> DataFrame:
    """site, url, anchors: some of the texts by which other pages link to a page."""
    named = edges.filter("src <> dst and anchor <> ''").select("site", F.col("dst").alias("url"), F.col("anchor").alias("anchors"))
    return smallest(named, ["site", "url"], "anchors", most)


#: Rounds of a search after which the tables of visited pages are written as one.
COMPACT_ROUNDS = 16


def bfs_depth(nodes: DataFrame, edges: DataFrame, homes: DataFrame, most: int | None = None) -> DataFrame:
    """site, url, depth of the nodes that can be reached from their site's home.  Edges lead between
    nodes only.  Each round joins the frontier alone and is cut off in the shared folder; the search ends when
    a round finds nothing.  most: an error is raised if it takes more rounds, as the result would not be whole."""
    inside = edges.select("site", "src", "dst").distinct().join(nodes.select("site", F.col("url").alias("dst")), ["site", "dst"], "left_semi")
    inside = cut(inside, "edges")
    seen = cut(homes.select("site", "url").distinct().join(nodes.select("site", "url"), ["site", "url"], "left_semi").withColumn("depth", F.lit(0).cast("long")), "depth0")
    frontier = seen
    for depth in count(1):
        step = frontier.select("site", F.col("url").alias("src")).join(inside, ["site", "src"]).select("site", F.col("dst").alias("url")).distinct()
        frontier = cut(step.join(seen, ["site", "url"], "left_anti").withColumn("depth", F.lit(depth).cast("long")), f"depth{depth}")
        if frontier.isEmpty():
            return seen
        if most is not None and depth > most:
            raise RuntimeError(f"pages lie deeper than {most} links")
        seen = seen.unionByName(frontier)
        if depth % COMPACT_ROUNDS == 0:
            seen = cut(seen, f"seen{depth}")


def classify(counts: DataFrame, depths: DataFrame, homes: DataFrame) -> DataFrame:
    """Per node the class its links put it in, and its reach.

    orphan (true_orphan or feed_orphan) before global_nav before single_inbound; a home is never an
    orphan and, with nothing linking to it, is in no class."""
    size = counts.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    home = homes.select("site", "url").distinct().withColumn("is_home", F.lit(True))
    out = counts.join(depths.select("site", "url", "depth"), ["site", "url"], "left").join(home, ["site", "url"], "left").join(size, "site")
    feed = urls.is_feed_item(F.col("url"), F.col("schema_types") if "schema_types" in counts.columns else None)
    least_nav = F.greatest(F.lit(2.0), F.col("n") * NAV_SHARE)
    link_class = (
        F.when((F.col("inbound") == 0) & F.col("is_home").isNull(), F.when(feed, "feed_orphan").otherwise("true_orphan"))
        .when(F.col("inbound") >= least_nav, "global_nav")
        .when(F.col("inbound") == 1, "single_inbound")
        .otherwise("linked")
    )
    reach = F.when(F.col("depth").isNull(), "unreachable").when(F.col("depth") > MAX_DEPTH, "deep").otherwise("near")
    return out.withColumns({"link_class": link_class, "reach": reach, "rendered_only": (F.col("inbound_html") == 0) & (F.col("inbound") > 0)}).drop("n", "is_home")


def depth_histogram(classified: DataFrame) -> DataFrame:
    return classified.groupBy("site", F.coalesce(F.col("depth").cast("string"), F.lit("unreachable")).alias("depth")).agg(F.count(F.lit(1)).alias("pages"))


def linked_not_crawled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.select("site", F.col("dst").alias("url")).distinct().join(nodes.select("site", "url"), ["site", "url"], "left_anti")


def ancestors(url: Column) -> Column:
    """Directories above a URL, nearest first, with their distance: array<struct<n, dir>>."""
    parts = F.filter(F.split(urls.path(url), "/"), lambda s: s != "")
    origin = F.concat(urls.scheme(url), F.lit("://"), urls.host(url), F.lit("/"))
    cuts = F.when(F.size(parts) > 0, F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.transform(cuts, lambda c: F.struct((F.size(parts) - c).alias("n"), F.when(c == 0, origin).otherwise(F.concat(origin, F.array_join(F.slice(parts, F.lit(1), c), "/"), F.lit("/"))).alias("dir")))


def hub_candidates(nodes: DataFrame, orphans: DataFrame, homes: DataFrame, most: int = 8) -> DataFrame:
    """Crawled pages most likely to link to the orphans: site, url, orphans; at most `most` a site.
    Each orphan votes for its nearest crawled ancestor; archive indexes and the home get a vote."""
    have = nodes.select("site", "url").distinct().join(orphans.select("site", "url"), ["site", "url"], "left_anti").select("site", F.col("url").alias("page"), urls.normalise(F.col("url")).alias("dir"))
    steps = orphans.select("site", "url", F.explode(ancestors(F.col("url"))).alias("a")).select("site", "url", "a.n", "a.dir")
    nearest = steps.join(have, ["site", "dir"]).groupBy("site", "url").agg(F.min_by("page", "n").alias("page"))
    votes = nearest.groupBy("site", "page").agg(F.count(F.lit(1)).alias("votes"))
    indexes = have.filter(urls.path(F.col("dir")).isin(*[f"/{s}/" for s in HUB_SEGMENTS])).select("site", "page", F.lit(1).cast("long").alias("votes"))
    counted = votes.unionByName(indexes).groupBy("site", "page").agg(F.sum("votes").alias("votes"))
    roots = homes.select("site", F.col("url").alias("page"), F.lit(1).cast("long").alias("votes")).join(counted, ["site", "page"], "left_anti")
    from pyspark.sql import Window

    order = Window.partitionBy("site").orderBy(F.desc("votes"), "page")
    ranked = counted.unionByName(roots).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= most).select("site", F.col("page").alias("url"), "votes", "rank")
