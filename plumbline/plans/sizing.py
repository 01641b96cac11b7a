"""Registered queries of image weights, categories and their effective weights, citations, feed snapshots and
saved runs, beside their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scoring as S
from plumbline.operators import scores, weights
from plumbline.operators import vitals as lab
from plumbline.plans.catalog import query
from plumbline.session import ship
from plumbline.sources import feeds
from plumbline.sources.tables import parquet

# --- images -----------------------------------------------------------------------------------------


def _image(k: Column, suffix: str = "") -> Column:
    return F.concat(F.lit("/i/"), k.cast("string"), F.lit(suffix))


def image_markup(spark: SparkSession, d: str) -> DataFrame:
    """An image a part: every other one has a retina rendition, every third a widest one, which a ninth share."""
    k = F.col("p_partkey")
    return parquet(spark, d, "part").select(F.concat(F.lit("b"), (k % 20).cast("string")).alias("site"), _image(k).alias("image"), F.when(k % 2 == 0, _image(k, "@2")).otherwise("").alias("retina"), F.when(k % 9 == 0, "/i/all").when(k % 3 == 0, _image(k, "@3")).otherwise(_image(k)).alias("widest"))


def fetched_images(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return parquet(spark, d, "part").filter(k % 7 != 0).select(F.concat(F.lit("b"), (k % 20).cast("string")).alias("site"), _image(k).alias("image"), (k * 37 % 100_000 + 20_000).alias("bytes"), F.lit(200).alias("status"))


def fetched_renditions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    own = parquet(spark, d, "part").select(F.concat(F.lit("b"), (k % 20).cast("string")).alias("site"), k.alias("k"))
    return own.filter("k % 4 = 0").select("site", _image(F.col("k"), "@2").alias("image"), (F.col("k") * 53 % 90_000).alias("bytes")).union(own.select("site", F.lit("/i/all"), F.lit(5_000)).distinct())


def image_loads(spark: SparkSession, d: str) -> DataFrame:
    """What browsers transferred on suppliers' pages: the image, its retina rendition, a background, or nothing."""
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    url = F.when(n == 2, _image(k, "@2")).when(n == 3, F.concat(F.lit("/bg/"), (k % 50).cast("string"))).otherwise(_image(k))
    return parquet(spark, d, "lineitem").select(F.concat(F.lit("b"), (k % 20).cast("string")).alias("site"), F.concat(F.lit("/p/"), F.col("l_suppkey").cast("string")).alias("page"), url.alias("url"), F.when(n >= 4, 0).otherwise(F.col("l_quantity") * 1000).cast("long").alias("bytes"))


_IMAGES = """markup AS (SELECT p_partkey AS k, 'b' || p_partkey % 20 AS site, '/i/' || p_partkey AS image, CASE WHEN p_partkey % 2 = 0 THEN '/i/' || p_partkey || '@2' END AS retina, CASE WHEN p_partkey % 9 = 0 THEN '/i/all' WHEN p_partkey % 3 = 0 THEN '/i/' || p_partkey || '@3' END AS widest FROM part),
fetched AS (SELECT k, site, image, k * 37 % 100000 + 20000 AS bytes FROM markup WHERE k % 7 <> 0), extra AS (SELECT DISTINCT site, '/i/all' AS image, 5000 AS bytes FROM markup UNION ALL SELECT site, retina, k * 53 % 90000 FROM markup WHERE k % 4 = 0),
found AS (SELECT site, image, 0 AS rank, retina AS rendition FROM markup WHERE retina IS NOT NULL UNION ALL SELECT site, image, 1, widest FROM markup WHERE widest IS NOT NULL), alias AS (SELECT site, rendition AS url, min(image) AS of FROM found GROUP BY ALL),
loads AS (SELECT 'b' || l_partkey % 20 AS site, '/p/' || l_suppkey AS page, CASE l_linenumber WHEN 2 THEN '/i/' || l_partkey || '@2' WHEN 3 THEN '/bg/' || l_partkey % 50 ELSE '/i/' || l_partkey END AS url, CAST(l_quantity * 1000 AS BIGINT) AS bytes FROM lineitem WHERE l_linenumber < 4),
seen AS (SELECT site, page, url, bytes, CASE WHEN (site, url) IN (SELECT (site, image) FROM fetched) THEN url ELSE coalesce(of, url) END AS image FROM loads LEFT JOIN alias USING (site, url) WHERE bytes > 0),
last AS (SELECT site, image, url, bytes FROM seen QUALIFY row_number() OVER (PARTITION BY site, image ORDER BY page DESC, url DESC, bytes DESC) = 1),
weights AS (SELECT site, image, coalesce(b.bytes, f.bytes) AS bytes, CASE WHEN b.bytes IS NULL THEN 'head' ELSE 'browser' END AS how, CASE WHEN abs(f.bytes - b.bytes) > 0.1 * b.bytes THEN f.bytes END AS head_bytes, nullif(b.url, image) AS browser_url FROM fetched f FULL JOIN last b USING (site, image))"""


@query("WITH " + _IMAGES + """ SELECT w.*, CASE WHEN f.image IS NOT NULL THEN m.retina END AS retina, CASE WHEN f.image IS NOT NULL THEN nullif(r.bytes, 0) END AS retina_bytes, CASE WHEN f.image IS NOT NULL THEN m.widest END AS widest, CASE WHEN f.image IS NOT NULL THEN x.bytes END AS widest_bytes FROM weights w LEFT JOIN fetched f USING (site, image) LEFT JOIN markup m USING (site, image)
 LEFT JOIN extra r ON w.site = r.site AND m.retina = r.image LEFT JOIN extra x ON w.site = x.site AND m.widest = x.image""")
def image_weights(spark: SparkSession, d: str) -> DataFrame:
    """Browser's sizes over fetched ones, a row an image, with the sizes of its other renditions."""
    markup = image_markup(spark, d)
    measured = weights.with_variants(fetched_images(spark, d), markup, fetched_renditions(spark, d))
    out, _ = weights.merged(measured, image_loads(spark, d), weights.aliases(weights.variants(markup)))
    return out.select("site", "image", "bytes", "how", "head_bytes", "browser_url", "retina", "retina_bytes", "widest", "widest_bytes")


@query("WITH " + _IMAGES + " SELECT site, count(*) AS images, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (how = 'browser') AS replaced, (SELECT count(*) FROM (SELECT DISTINCT image, page FROM seen s WHERE s.site = w.site)) AS places FROM weights w GROUP BY site")
def site_image_weights(spark: SparkSession, d: str) -> DataFrame:
    """What each site's images weigh, and on how many pages browsers saw them."""
    out, places = weights.merged(fetched_images(spark, d), image_loads(spark, d), weights.aliases(weights.variants(image_markup(spark, d))))
    return weights.site_weight(out).join(places.groupBy("site").agg(F.count(F.lit(1)).alias("places")), "site", "left")


@query("WITH " + _IMAGES + """, once AS (SELECT site, rendition, min((rank, image)) AS first FROM found WHERE (site, rendition) NOT IN (SELECT (site, image) FROM fetched) GROUP BY ALL)
SELECT site, rendition, CAST(place AS BIGINT) AS place FROM (SELECT site, rendition, row_number() OVER (PARTITION BY site ORDER BY first, rendition) AS place FROM once) WHERE place <= 40""")
def variant_requests(spark: SparkSession, d: str) -> DataFrame:
    """Which renditions are worth a request: retina ones first, 40 a site."""
    out = weights.variant_targets(weights.variants(image_markup(spark, d)), fetched_images(spark, d), 40)
    return out.select("site", "rendition", F.col("place").cast("long").alias("place"))


# --- categories -------------------------------------------------------------------------------------


def _site() -> Column:
    return F.concat(F.lit("c"), (F.col("o_custkey") % 100).cast("string"))


def site_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Orders as measured metrics; a seventh of the sites have no browser and no structured data."""
    names = list(S.METRICS)
    metric = F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % len(names) + 1).cast("int"))
    known = F.create_map(*[F.lit(x) for m in names for x in (m, S.METRICS[m][0])])
    out = parquet(spark, d, "orders").select(_site().alias("site"), (F.col("o_custkey") % 100).alias("c"), metric.alias("metric"), F.least(F.col("o_totalprice") / 600_000, F.lit(1.0)).alias("score"))
    out = out.groupBy("site", "c", "metric").agg(F.avg("score").alias("score")).withColumn("group", known[F.col("metric")])
    weight = F.create_map(*[F.lit(x) for m in names for x in (m, S.METRICS[m][1])])
    return out.select("site", "metric", "group", weight[F.col("metric")].alias("weight"), F.when((F.col("c") % 7 != 0) | ~F.col("group").isin("structured", "trust"), F.col("score")).alias("score"))


def lab_loads(spark: SparkSession, d: str) -> DataFrame:
    """A browser load an order: each metric at one of three points of its curve, which score 0.9, 0.5 and 0.1."""
    ship(spark)
    o = F.col("o_orderkey")

    def value(metric: str, shift: int) -> Column:
        p10, median = S.VITAL_POINTS["desktop"][metric]
        return F.element_at(F.array(*[F.lit(float(x)) for x in (p10, median, median * median / p10)]), ((o + shift) % 3 + 1).cast("int"))

    kept = parquet(spark, d, "orders").filter(F.col("o_custkey") % 100 % 5 != 0)
    return kept.select(_site().alias("site"), o.cast("string").alias("url"), F.when(o % 19 == 0, 403).otherwise(200).alias("status"), value("fcp", 0).alias("fcp"), F.when(o % 4 != 0, value("lcp", 1)).alias("lcp"), value("tbt", 2).alias("tbt"), value("cls", 0).alias("cls"))


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    groups = scores.group_scores(site_metrics(spark, d))
    performance = scores.performance_category(lab.site_vitals(lab.page_scores(lab_loads(spark, d))))
    capped = parquet(spark, d, "orders").filter("o_custkey % 100 % 9 = 0").select(_site().alias("site"), F.lit(40).alias("cap")).distinct()
    return groups, performance, capped


def _case(values: dict, column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


_NAMES = "[" + ", ".join(f"'{m}'" for m in S.METRICS) + "]"
_CATEGORIES = f"""own AS (SELECT 'c' || o_custkey % 100 AS site, o_custkey % 100 AS c, {_NAMES}[o_orderkey % {len(S.METRICS)} + 1] AS metric, avg(least(o_totalprice / 600000, 1.0)) AS score FROM orders GROUP BY ALL),
metrics AS (SELECT site, metric, {_case({m: f"'{g}'" for m, (g, _) in S.METRICS.items()}, "metric")} AS grp, {_case({m: w for m, (_, w) in S.METRICS.items()}, "metric")} AS weight, CASE WHEN c % 7 <> 0 OR grp NOT IN ('structured', 'trust') THEN score END AS score FROM own),
groups AS (SELECT site, grp, 100 * sum(score * weight) / sum(weight) FILTER (score IS NOT NULL) AS score, least(coalesce(sum(weight) FILTER (score IS NOT NULL), 0) / {_case(S.DECLARED_WEIGHTS, "grp")}, 1.0) AS coverage, {_case(S.GROUP_WEIGHTS, "grp")} AS weight FROM metrics GROUP BY site, grp),
seo AS (SELECT site, sum(score * weight) / sum(weight) FILTER (score IS NOT NULL) AS score, sum(CASE WHEN score IS NOT NULL THEN coverage * weight ELSE 0 END) / {sum(S.GROUP_WEIGHTS.values())} AS coverage FROM groups GROUP BY site),
loads AS (SELECT 'c' || o_custkey % 100 AS site, [0.9, 0.5, 0.1][o_orderkey % 3 + 1] AS fcp, CASE WHEN o_orderkey % 4 <> 0 THEN [0.9, 0.5, 0.1][(o_orderkey + 1) % 3 + 1] END AS lcp, [0.9, 0.5, 0.1][(o_orderkey + 2) % 3 + 1] AS tbt FROM orders WHERE o_custkey % 100 % 5 <> 0 AND o_orderkey % 19 <> 0),
perf AS (SELECT site, 100 * median((10 * fcp + coalesce(25 * lcp, 0) + 30 * tbt + 25 * fcp) / (65 + CASE WHEN lcp IS NULL THEN 0 ELSE 25 END)) AS score, max(65 + CASE WHEN lcp IS NULL THEN 0 ELSE 25 END) / 100.0 AS coverage FROM loads GROUP BY site)"""


@query("WITH " + _CATEGORIES + """, totals AS (SELECT s.site, s.score AS seo, p.score AS performance, (60 * s.score + coalesce(40 * p.score, 0)) / (60 + CASE WHEN p.score IS NULL THEN 0 ELSE 40 END) AS raw, (60 * s.coverage + coalesce(40 * p.coverage, 0)) / 100 AS coverage, CASE WHEN CAST(substr(s.site, 2) AS INT) % 9 = 0 THEN 40 END AS cap FROM seo s LEFT JOIN perf p USING (site))
SELECT site, round(seo, 2) AS seo, round(performance, 2) AS performance, round(raw, 2) AS raw, round_even(least(raw, coalesce(cap, 100)), 0) AS overall, cap, round(coverage, 6) AS coverage, CASE WHEN coverage >= 0.9 THEN 'high' WHEN coverage >= 0.7 THEN 'medium' ELSE 'low' END AS confidence FROM totals""")
def overall_scores(spark: SparkSession, d: str) -> DataFrame:
    """Both categories, the overall score under the lowest cap, how much of the model was measured."""
    groups, performance, capped = _both(spark, d)
    seo = scores.seo_category(groups)
    out = scores.overall(seo, performance, capped).join(seo.select("site", F.round("score", 2).alias("seo")), "site").join(performance.select("site", F.round("score", 2).alias("performance")), "site", "left")
    return out.select("site", "seo", "performance", F.round("raw", 2).alias("raw"), "overall", "cap", F.round("coverage", 6).alias("coverage"), scores.confidence(F.col("coverage"), F.lit(1.0)).alias("confidence"))


@query("WITH " + _CATEGORIES + """ SELECT site, grp AS "group", round(score, 2) AS score, round(CASE WHEN score IS NULL THEN 0 ELSE 100 * weight / sum(CASE WHEN score IS NOT NULL THEN weight END) OVER (PARTITION BY site) END, 6) AS effective FROM groups""")
def effective_weights(spark: SparkSession, d: str) -> DataFrame:
    """What each group counts for once the groups that were not scored are left out."""
    out = scores.effective_weights(scores.group_scores(site_metrics(spark, d)))
    return out.select("site", "group", F.round("score", 2).alias("score"), F.round("effective", 6).alias("effective"))


_FIRED = ("IDX-01", "IDX-06", "ORP-05", "MET-03", "MET-09", "MET-12", "CNT-05", "ERR-03", "SDV-04", "SEC-01", "REP-01")


@query("WITH " + _CATEGORIES + f", cited AS (SELECT metric, unnest(string_split(ids, ' ')) AS finding FROM (VALUES {', '.join(repr((m, f)) for m, f in scores.CITED.items())}) v(metric, ids)), "
    + "fired AS (SELECT DISTINCT 'c' || o_custkey % 100 AS site, [" + ", ".join(f"'{f}'" for f in _FIRED) + f"][o_orderkey % {len(_FIRED)} + 1] AS finding FROM orders WHERE o_orderkey % 3 = o_custkey % 3) "
    + "SELECT m.site, m.metric, coalesce(string_agg(f.finding, ' ' ORDER BY f.finding), '') AS findings FROM metrics m LEFT JOIN cited c USING (metric) LEFT JOIN fired f ON m.site = f.site AND c.finding = f.finding GROUP BY ALL")
def metric_findings(spark: SparkSession, d: str) -> DataFrame:
    """Metrics and the findings that explain them, of those that fired on the site."""
    o = F.col("o_orderkey")
    fired = parquet(spark, d, "orders").filter("o_orderkey % 3 = o_custkey % 3").select(_site().alias("site"), F.element_at(F.array(*map(F.lit, _FIRED)), (o % len(_FIRED) + 1).cast("int")).alias("finding"))
    return scores.explained(site_metrics(spark, d), fired).select("site", "metric", F.array_join("findings", " ").alias("findings"))


# --- feeds ------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT event_id, event_type AS feed, ts AS started FROM events), s AS (SELECT feed, taken, max(kept) AS kept FROM (SELECT event_type AS feed, ts AS taken, event_id AS kept FROM events WHERE event_id % 40 = 7 AND event_id % 3 <> 0 AND event_type <> 'error' AND user_id % 7 <> 0) GROUP BY ALL)
SELECT event_id, kept, CASE WHEN taken IS NULL THEN 'absent' WHEN CAST(epoch(started) AS BIGINT) - CAST(epoch(taken) AS BIGINT) < 43200 THEN 'fresh' ELSE 'stale' END AS state FROM (SELECT r.*, s.taken, s.kept FROM r ASOF LEFT JOIN s ON r.feed = s.feed AND r.started >= s.taken)""")
def feed_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Events as runs that read a feed: the latest snapshot that was kept before each, fresh, stale or absent."""
    e = parquet(spark, d, "events")
    taken = e.filter("event_id % 40 = 7 and event_type <> 'error'").select(F.col("event_type").alias("feed"), F.col("ts").alias("taken"), ((F.col("event_id") % 3 == 0) | ~F.coalesce(F.col("user_id") % 7 != 0, F.lit(False))).alias("failed"), F.col("event_id").alias("kept"))
    out = feeds.chosen(e.select("event_id", F.col("event_type").alias("feed"), F.col("ts").alias("started")), taken)
    return out.select("event_id", F.col("snapshot.kept").alias("kept"), "state")
