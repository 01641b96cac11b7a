"""Lab performance: page scores on log-normal curves, their median as the site's score, opportunities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scoring as S
from plumbline.functions import urls

# Fixed values.
RESPONSE_GOOD_MS, WEIGHT_GOOD, LEGACY_SHARE, LEGACY_LEAST = 500, 1_500_000, 0.6, 20_000


def page_scores(vitals: DataFrame, profile: str = "desktop") -> DataFrame:
    """vitals: site, url, status, fcp, lcp, tbt, cls -> each metric's score and the page's (0 to 1) over
    what was measured.  Refused pages (status from 400) are not pages of the site."""
    served = vitals.filter("coalesce(status, 200) < 400")
    points = S.VITAL_POINTS.get(profile, S.VITAL_POINTS["desktop"])
    out = served.withColumns({f"{m}_score": S.lognormal_score(*points[m])(F.col(m).cast("double")) for m in S.VITAL_WEIGHTS})
    weight = sum((F.when(F.col(f"{m}_score").isNotNull(), F.lit(w)).otherwise(0.0) for m, w in S.VITAL_WEIGHTS.items()), F.lit(0.0))
    got = sum((F.coalesce(F.col(f"{m}_score"), F.lit(0.0)) * w for m, w in S.VITAL_WEIGHTS.items()), F.lit(0.0))
    return out.withColumns({"weight_measured": weight, "score": got / F.nullif(weight, F.lit(0.0))})


def site_vitals(scored: DataFrame) -> DataFrame:
    """The median page is the site's score; medians of metrics are there for diagnosis."""
    return scored.groupBy("site").agg(F.median("score").alias("score"), *[F.median(m).alias(f"median_{m}") for m in S.VITAL_WEIGHTS], F.count("score").alias("pages"), (F.max("weight_measured") / 100).alias("coverage"))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """sorted[n // 2] a key: the value at which half of the rows, from above, are reached.  Equal values
    are counted map-side."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.expr(f"percentile_disc(0.5) within group (order by `{value}` desc)").alias("upper_median"))


def opportunities(images: DataFrame, records: DataFrame, runtime: DataFrame | None = None, limit_kb: int = 180) -> DataFrame:
    """Bytes and time that could be saved, a site: sized images, formats, images over the limit, the median
    page's weight (where pages were rendered), response."""
    ratio = F.col("displayed_width") / F.nullif(F.col("natural_width"), F.lit(0))
    sized = F.when((ratio < 0.5) & ~urls.is_vector(F.col("kind")), F.col("bytes") * (1 - ratio * ratio))
    legacy = F.when(~urls.is_modern(F.col("kind")) & (F.col("bytes") > LEGACY_LEAST), F.col("bytes") * LEGACY_SHARE)
    saved = images.groupBy("site").agg(F.sum(sized).alias("sized_bytes"), F.sum(legacy).alias("format_bytes"), F.sum(F.when(F.col("bytes") > limit_kb * 1024, F.col("bytes") - limit_kb * 1024)).cast("double").alias("heavy_bytes"))
    slow = records.groupBy("site").agg(F.greatest(F.median("elapsed_ms") - RESPONSE_GOOD_MS, F.lit(0.0)).alias("response_ms"))
    rows = saved.join(slow, "site", "full_outer").unpivot("site", ["sized_bytes", "format_bytes", "heavy_bytes", "response_ms"], "opportunity", "amount")
    if runtime is not None:
        weight = runtime.filter("resource_bytes > 0").groupBy("site").agg((F.median("resource_bytes") - WEIGHT_GOOD).alias("amount"))
        rows = rows.unionByName(weight.select("site", F.lit("page_bytes").alias("opportunity"), "amount"))
    return rows.filter("amount > 0").withColumn("rank_value", F.when(F.col("opportunity") == "response_ms", F.col("amount") * 1000).otherwise(F.col("amount")))


def accessibility(passed: DataFrame, weights: dict[str, float]) -> DataFrame:
    """passed: site, url, results map<rule, boolean> -> share of pages that pass each rule, and the
    site's weighted mean over the rules that applied anywhere."""
    each = passed.select("site", "url", F.explode("results").alias("rule", "ok"))
    shares = each.filter("ok is not null").groupBy("site", "rule").agg(F.avg(F.col("ok").cast("double")).alias("share"))
    weight = F.create_map(*[F.lit(x) for p in weights.items() for x in p])[F.col("rule")]
    return shares.withColumn("w", weight).groupBy("site").agg((100 * S.weighted_mean(F.col("share"), F.col("w"))).alias("score"))
