"""Link health: verdicts, chains, and findings fanned out to the pages that carry a link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import urls


def link_sources(links: DataFrame) -> DataFrame:
    """target -> on how many pages a link to it stands, and the href of the first of them.  The pages themselves
    are the rows of fan_out()."""
    return links.groupBy("site", "target").agg(F.count_distinct("src").alias("sources"), F.min_by("href", F.struct("src", "pos")).alias("href"))


def fan_out(status: DataFrame, links: DataFrame) -> DataFrame:
    """Each link's status on each page that carries it; on the link itself where none is known."""
    # of all links, only those to the targets in question are told apart
    wanted = links.select("site", F.col("target").alias("url"), "src").join(status.select("site", "url").distinct(), ["site", "url"], "left_semi")
    pairs = wanted.distinct()
    return status.join(pairs, ["site", "url"], "left").withColumn("page", F.coalesce("src", "url")).drop("src")


def with_verdicts(status: DataFrame) -> DataFrame:
    return status.withColumn("verdict", urls.verdict(F.col("status")))


def chains(status: DataFrame, links: DataFrame, canonical_hosts: DataFrame, least: int, most: int | None = None) -> DataFrame:
    """Targets that redirect `least` times or more, with whose redirect it is, most hops first."""
    hops = (F.col("hops") >= least) & (F.col("hops") <= most if most is not None else F.lit(True))
    found = status.filter(hops).join(link_sources(links).withColumnRenamed("target", "url"), ["site", "url"], "left").join(canonical_hosts, "site", "left")
    return found.withColumn("cause", urls.hop_cause(F.col("href"), F.col("url"), F.coalesce("final_url", "url"), F.col("canonical_host")))


def link_totals(status: DataFrame) -> DataFrame:
    """Per site: checked, verified (ok, dead, error), ok, direct, unverified."""
    v = F.col("verdict")
    verified = v.isin("ok", "dead", "error")
    return status.groupBy("site").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(verified).alias("verified"), F.count_if(v == "ok").alias("ok"), F.count_if(verified & (F.col("hops") == 0)).alias("direct"), F.count_if(~verified).alias("unverified")
    )


def canonical_hosts(records: DataFrame) -> DataFrame:
    """The most frequent host of served pages, a site; ties go to the smallest."""
    counted = records.filter("coalesce(status, 200) = 200").groupBy("site", urls.host(F.coalesce("final_url", "url")).alias("canonical_host")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("site").agg(F.min_by("canonical_host", F.struct(-F.col("n"), F.col("canonical_host"))).alias("canonical_host"))


def retried(records: DataFrame, again: DataFrame) -> DataFrame:
    """Records whose page was throttled or failed are replaced by their retry where that was served; pages
    are told apart by site where both tables have it."""
    throttled = F.col("o.status").isNull() | F.col("o.status").isin(408, 429, 500, 502, 503, 504)
    better = throttled & (F.col("r.status") == 200)
    same = F.col("o.url") == F.col("r.url")
    if "site" in records.columns and "site" in again.columns:
        same &= F.col("o.site").eqNullSafe(F.col("r.site"))
    joined = records.alias("o").join(again.alias("r"), same, "left")
    return joined.select(*[F.when(better, F.col(f"r.`{c}`")).otherwise(F.col(f"o.`{c}`")).alias(c) for c in records.columns])


def duplicate_spellings(records: DataFrame) -> DataFrame:
    """duplicate_of: of the records served as one page, the owner (the page at its own served URL, else
    the first by URL); null for the owner itself."""
    served = urls.normalise(F.coalesce("final_url", "url"))
    order = Window.partitionBy("site", "_served").orderBy(F.desc(urls.normalise(F.col("url")) == F.col("_served")), "url")
    out = records.withColumn("_served", served).withColumn("_owner", F.first("url").over(order))
    return out.withColumn("duplicate_of", F.when(F.col("_owner") != F.col("url"), F.col("_owner"))).drop("_served", "_owner")


def first_wins(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row a key: the first in the given order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def round_robin(df: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """Rows dealt out in turns over groups: the first of each group, then the second of each, ..."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    # no group gives more than `most` rows, and Spark stops each there before the rows are shuffled
    return df.withColumn("turn", nth).filter(F.col("turn") <= most).orderBy("turn", group).limit(most)
