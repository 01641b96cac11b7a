"""Registered queries of the rule families and of the score metrics, each beside its SQL.

A row of a family is a finding and severity, with how many URLs and hits it has over all sites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.copy import ENTITY, MOJIBAKE, TYPOS
from plumbline.operators import graph, links, mail, media, probes, rules, scores, structured
from plumbline.operators import vitals as lab
from plumbline.operators.records import page_links
from plumbline.plans import catalog
from plumbline.plans import frames as X
from plumbline.plans.catalog import query
from plumbline.session import ship

_COUNTED = " SELECT finding, severity, count(DISTINCT url) AS urls, count(*) AS hits FROM hits GROUP BY ALL"


def _family(frames: rules.Frames, *ids: str) -> DataFrame:
    return rules.run(frames, list(ids)).groupBy("finding", "severity").agg(F.count_distinct("url").alias("urls"), F.count(F.lit(1)).alias("hits"))


def _union(*parts: str) -> str:
    return "hits AS (" + " UNION ALL ".join(f"SELECT {p}" for p in parts) + ")"


# --- pages of a crawl -------------------------------------------------------------------------------

_CRAWL = """p AS (SELECT page_id AS p, regexp_replace({host}, '^www\\.', '') AS site, url, {scheme} || '://' || {host} AS origin, {path} AS path, html, {title} AS title,
 CASE WHEN page_id % 11 = 0 THEN 404 WHEN page_id % 13 = 0 THEN 403 ELSE 200 END AS status, CASE WHEN page_id % 3 = 0 THEN 'link' ELSE 'sitemap' END AS via, page_id % 7 = 0 AS noindex,
 CASE WHEN page_id % 3 <> 0 THEN 'About' || (page_id % 40) || repeat('d', CAST(page_id % 180 AS INT)) END AS descr, CASE WHEN page_id % 4 <> 0 THEN CASE WHEN page_id % 24 = 1 THEN '../' WHEN page_id % 8 = 1 THEN '/c/' || page_id || '/' ELSE url END END AS canon FROM pages),
moved AS (SELECT *, CASE WHEN p % 5 = 0 THEN '/moved' || CASE WHEN path = '' THEN '/' ELSE path END ELSE path END AS served FROM p), dirs AS (SELECT *, CASE WHEN p % 16 = 3 THEN '/b/' WHEN served = '' THEN '/' ELSE regexp_replace(served, '[^/]*$', '') END AS dir FROM moved),
parents AS (SELECT *, CASE WHEN dir = '/' THEN '/' ELSE regexp_replace(dir, '[^/]+/$', '') END AS parent FROM dirs),
q AS (SELECT *, regexp_replace(CASE WHEN canon = '../' THEN origin || parent || 'c/' || p || '/' WHEN canon LIKE '/%' THEN origin || canon ELSE canon END, '#.*$', '') AS canonical FROM parents), ok AS (SELECT * FROM q WHERE status = 200),
refused AS (SELECT site, bool_and(status = 403) AS every FROM q GROUP BY ALL), titles AS (SELECT site, title FROM ok WHERE title <> '' GROUP BY ALL HAVING count(*) > 1), descrs AS (SELECT site, descr FROM ok WHERE descr <> '' GROUP BY ALL HAVING count(*) > 1),
marked AS (SELECT site, url, origin || dir || 'f/' || p AS image, 0 AS rank FROM ok UNION ALL SELECT site, url, origin || CASE WHEN p % 6 = 1 AND p % 5 <> 0 THEN parent ELSE '/' END || 'img/' || (p % 20), CASE p % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END FROM ok
 UNION ALL SELECT site, url, origin || '/y', 0 FROM ok WHERE p % 6 = 5), images AS (SELECT site, image, max(rank) AS rank, count(DISTINCT CASE WHEN rank > 0 THEN url END) AS lacking, min(CASE WHEN rank > 0 THEN url END) AS url FROM marked GROUP BY ALL)"""
_ARCHIVE = "regexp_matches(path, '(?i)/(page|tag|category|author|attachment|comment-page-\\d+)/')"
_CRAWL_HITS = _union(
    "'ERR-01' AS finding, 'high' AS severity, url FROM q WHERE status = 404",
    "'ERR-14', CASE WHEN every THEN 'high' ELSE 'medium' END, url FROM q JOIN refused USING (site) WHERE status = 403",
    "'ERR-03', 'medium', url FROM q WHERE p % 5 = 0 AND via <> 'link'",
    f"'ORP-05', CASE WHEN {_ARCHIVE} OR noindex THEN 'low' ELSE 'medium' END, url FROM ok WHERE via = 'link'",
    "'MED-04', 'medium', url FROM ok WHERE p * 37 % 3000 > 1500",
    "'IDX-01', 'critical', url FROM ok WHERE noindex",
    "'IDX-04', 'medium', url FROM ok WHERE canonical IS NULL",
    "'IDX-05', 'medium', url FROM ok WHERE regexp_replace(canonical, '/+$', '') <> CASE WHEN p % 5 = 0 THEN regexp_replace(origin || served, '/+$', '') ELSE regexp_replace(url, '/+$', '') END",
    "'SOC-01', 'medium', url FROM ok WHERE p % 5 = 0",
    "'SOC-02', 'low', url FROM ok WHERE p % 6 = 0",
    "'MET-04', 'medium', url FROM ok JOIN titles USING (site, title)",
    "'MET-05', 'medium', url FROM ok WHERE descr IS NULL",
    "'MET-06', 'low', url FROM ok WHERE length(descr) > 160",
    "'MET-07', 'low', url FROM ok JOIN descrs USING (site, descr)",
    "'MET-12', 'high', url FROM ok WHERE p % 9 = 0",
    "'CNT-08', 'low', url FROM ok WHERE p % 10 = 0",
    "'MED-01', 'medium', url FROM images WHERE rank > 0",
    "'MED-02', 'low', url FROM ok WHERE p % 2 = 1",
    "'MED-03', 'low', url FROM ok WHERE p % 6 = 0 OR regexp_matches(html, '(?is)<a\\s[^>]*>\\s*</a>')",
    "'SEC-04', 'medium', url FROM q WHERE p % 12 = 0",
    "'SEC-04', 'medium', url FROM q WHERE canon LIKE 'http://%'",
)


@query("WITH " + _CRAWL + ", " + _CRAWL_HITS + _COUNTED)
def crawl_findings(spark: SparkSession, d: str) -> DataFrame:
    """Rules over a crawl's pages: errors, refusals, redirects, indexing, metadata, social, media."""
    records = X.crawl_records(spark, d)
    ids = ("ERR-01", "ERR-14", "ERR-03", "ORP-05", "MED-04", "IDX-01", "IDX-04", "IDX-05", "SOC-01", "SOC-02", "MET-04", "MET-05", "MET-06", "MET-07", "MET-12", "CNT-08", "MED-01", "MED-02", "MED-03", "SEC-04")
    mixed = records.select("site", "url", F.lit("mixed-content").alias("kind"), F.explode("mixed_content").alias("detail"))
    return _family(rules.Frames(records, signals=mixed), *ids)


def _metric_sql(source: str, **values: str) -> str:
    """site, metric, value of aggregates over a source, null where nothing was measured."""
    each = ", ".join(f"{v} AS {k}" for k, v in values.items())
    rows = " UNION ALL ".join(f"SELECT site, '{k}' AS metric, round({k}, 6) AS value FROM m" for k in values)
    return f", m AS (SELECT site, {each} FROM {source} GROUP BY site) {rows}"


def _share(condition: str, within: str | None = None) -> str:
    return f"avg(CAST(coalesce({condition}, false) AS INT))" + (f" FILTER ({within})" if within else "")


_CRAWL_METRICS = {
    "indexable": _share("NOT noindex"), "noindex_expected": _share("noindex"), "canonical": _share("canonical IS NOT NULL"), "canonical_self": _share("regexp_replace(canonical, '/+$', '') = regexp_replace(url, '/+$', '')", "canonical IS NOT NULL"),
    "desc_present": _share("descr IS NOT NULL"), "desc_length": _share("length(descr) BETWEEN 70 AND 160", "descr IS NOT NULL"), "social": _share("p % 5 <> 0 AND p % 6 <> 0"), "mixed_content": _share("p % 12 <> 0 AND coalesce(canon NOT LIKE 'http://%', true)"),
    "sitemap_coverage": _share("via <> 'link'"), "https": _share("url LIKE 'https://%'"),
}


@query("WITH " + _CRAWL + _metric_sql("ok", **_CRAWL_METRICS) + """ UNION ALL SELECT site, 'http_200', round(avg(CAST(status = 200 AS INT)) FILTER (status <> 403), 6) FROM q WHERE site IN (SELECT site FROM ok) GROUP BY site
 UNION ALL SELECT o.site, 'desc_unique', u FROM (SELECT DISTINCT site FROM ok) o LEFT JOIN (SELECT site, round(count(*) FILTER (n = 1) / sum(n), 6) AS u FROM (SELECT site, descr, count(*) AS n FROM ok WHERE descr <> '' GROUP BY ALL) GROUP BY site) v ON o.site = v.site
 UNION ALL SELECT site, 'img_alt', round(avg(CAST(rank = 0 AS INT)), 6) FROM images GROUP BY site""")
def crawl_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Score metrics of a crawl's pages before their windows."""
    records = X.crawl_records(spark, d)
    out = scores.page_metrics(records).unionByName(scores.image_metrics(records)).filter(F.col("metric").isin(*_CRAWL_METRICS, "http_200", "desc_unique", "img_alt"))
    return out.select("site", "metric", F.round("value", 6).alias("value"))


@query("WITH " + _CRAWL + """, t AS (SELECT site, origin || dir || 'rel/' || (p % 7) AS target FROM q UNION ALL SELECT site, origin || parent || 'up' FROM q UNION ALL SELECT site, {scheme} || '://cdn.example.com/c/' FROM q UNION ALL SELECT site, origin || '/x' FROM q WHERE p % 6 = 0 UNION ALL SELECT site, origin || '/y' FROM q WHERE p % 6 = 5
 UNION ALL SELECT site, origin || regexp_replace(regexp_replace(trim(href), '#.*$', ''), '^/\\.{1,2}$', '/') FROM (SELECT site, origin, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"[^>]*>.*?</a>', 1)) AS href FROM q) WHERE href LIKE '/%') SELECT site, target, count(*) AS links FROM t GROUP BY ALL""")
def resolved_links(spark: SparkSession, d: str) -> DataFrame:
    """Every href against its document's base, the served URL where nothing else is said."""
    found = page_links(X.crawl_records(spark, d))
    return found.groupBy("site", "target").agg(F.count(F.lit(1)).alias("links"))


_PICTURES = """b AS (SELECT *, 300 + p % 400 AS slot FROM q)"""


@query("WITH " + _CRAWL + ", " + _PICTURES + """ SELECT url, origin || '/w/' || p || CASE WHEN slot <= 480 THEN '-480.webp' ELSE '-960.webp' END AS typical, CASE WHEN slot <= 480 THEN origin || '/w/' || p || '-960.webp' ELSE '' END AS retina, origin || dir || 'f/' || p || '.jpg' AS fallback, CAST(slot AS DOUBLE) AS slot_px FROM b""")
def picture_choices(spark: SparkSession, d: str) -> DataFrame:
    """What a browser takes of each page's picture element."""
    return media.page_images(X.crawl_records(spark, d)).filter("how = 'picture-w'").select("url", "typical", "retina", "fallback", "slot_px")


@query("WITH " + _CRAWL + " SELECT site, ['text', 'empty', 'missing'][rank + 1] AS state, count(*) AS images, CAST(sum(lacking) AS BIGINT) AS lacking FROM images GROUP BY ALL")
def alt_states(spark: SparkSession, d: str) -> DataFrame:
    """Images of each site by their worst alt state."""
    return media.alt_groups(media.alt_inventory(X.crawl_records(spark, d))).select("site", "state", "images", "lacking")


# --- links ------------------------------------------------------------------------------------------

_LINK_URL = "CASE WHEN o % 5 = 0 THEN 'http://' ELSE 'https://' END || host || '/o/' || o"
_CARRIED = ", carried AS (SELECT DISTINCT site, o, 'https://' || site || '/p/' || l_suppkey AS page FROM judged JOIN lineitem ON l_orderkey = o), many AS (SELECT site FROM judged WHERE verdict IN ('blocked', 'unreachable') GROUP BY site HAVING count(*) >= 3)"
_ON_PAGES = f"coalesce(page, {_LINK_URL}) AS url FROM judged LEFT JOIN carried USING (site, o)"


@query("WITH {links}" + _CARRIED + ", " + _union(
    f"'ERR-02' AS finding, 'high' AS severity, {_ON_PAGES} WHERE verdict = 'dead' AND internal", f"'ERR-09', 'medium', {_ON_PAGES} WHERE verdict = 'dead' AND NOT internal",
    f"'ERR-11', 'low', {_ON_PAGES} WHERE verdict IN ('blocked', 'unreachable') AND site IN (SELECT site FROM many)", f"'ERR-10', 'medium', {_LINK_URL} FROM judged WHERE internal AND hops >= 2",
    f"'ERR-13', 'low', {_LINK_URL} FROM judged WHERE NOT internal AND hops >= 2", f"'ERR-12', 'low', {_LINK_URL} FROM judged WHERE internal AND hops = 1",
) + _COUNTED)
def link_findings(spark: SparkSession, d: str) -> DataFrame:
    """Rules over checked links: dead, refusing and redirecting ones, on the pages that carry them."""
    f = rules.Frames(X.records(spark, d), links=X.link_pages(spark, d), link_status=links.with_verdicts(X.link_status(spark, d)))
    return _family(f, "ERR-02", "ERR-09", "ERR-10", "ERR-11", "ERR-12", "ERR-13")


@query("WITH {links}" + _metric_sql("judged WHERE internal", links_resolve=_share("verdict = 'ok'", "verdict IN ('ok', 'dead', 'error')"), links_direct=_share("hops = 0", "verdict IN ('ok', 'dead', 'error')")))
def link_metrics(spark: SparkSession, d: str) -> DataFrame:
    return scores.link_metrics(links.with_verdicts(X.link_status(spark, d))).select("site", "metric", F.round("value", 6).alias("value"))


# --- graph ------------------------------------------------------------------------------------------

_CLASSES = catalog._BFS + """, counts AS (SELECT nodes.url, count(dst) AS inbound, count(dst) FILTER (NOT rendered) AS html FROM nodes LEFT JOIN pairs ON dst = nodes.url GROUP BY ALL),
c AS (SELECT counts.url, CASE WHEN inbound = 0 AND counts.url <> (SELECT url FROM home) THEN CASE WHEN counts.url LIKE '%/blog/%' THEN 'feed_orphan' ELSE 'true_orphan' END WHEN inbound >= greatest(2.0, 0.5 * (SELECT count(*) FROM nodes)) THEN 'global_nav' WHEN inbound = 1 THEN 'single_inbound' ELSE 'linked' END AS link_class,
 CASE WHEN depth IS NULL THEN 'unreachable' WHEN depth > 3 THEN 'deep' ELSE 'near' END AS reach, html = 0 AND inbound > 0 AS rendered_only FROM counts LEFT JOIN depths USING (url))"""


@query(_CLASSES + ", " + _union(
    "'ORP-01' AS finding, 'high' AS severity, url FROM c WHERE link_class = 'true_orphan'", "'ORP-06', 'low', url FROM c WHERE link_class = 'feed_orphan'", "'ORP-07', 'medium', url FROM c WHERE rendered_only",
    "'ORP-02', 'high', url FROM c WHERE reach = 'unreachable' AND link_class NOT LIKE '%orphan'", "'ORP-04', 'medium', url FROM c WHERE reach = 'deep'",
    "'ORP-03', 'medium', url FROM c WHERE link_class = 'single_inbound' AND (SELECT count(*) FILTER (link_class = 'single_inbound') >= greatest(5.0, 0.15 * count(*)) FROM c)",
) + _COUNTED)
def orphan_findings(spark: SparkSession, d: str) -> DataFrame:
    """Rules over the link graph."""
    return _family(rules.Frames(X.records(spark, d), graph=catalog._classified(spark, d)), "ORP-01", "ORP-02", "ORP-03", "ORP-04", "ORP-06", "ORP-07")


@query(_CLASSES + ", s AS (SELECT 'shop.example.com' AS site, * FROM c)" + _metric_sql(
    "s", linked="1 - avg(CASE link_class WHEN 'true_orphan' THEN 1.0 WHEN 'feed_orphan' THEN 0.35 ELSE 0 END)", links_in_html=_share("NOT rendered_only"), reachable=_share("reach <> 'unreachable'"), click_depth=_share("reach <> 'deep'"),
    inbound_depth=_share("link_class NOT IN ('single_inbound', 'true_orphan', 'feed_orphan')"),
))
def graph_metrics(spark: SparkSession, d: str) -> DataFrame:
    return scores.graph_metrics(catalog._classified(spark, d)).select("site", "metric", F.round("value", 6).alias("value"))


@query("WITH {edges}, " + "out_ AS (SELECT DISTINCT dst AS url FROM edges) SELECT url FROM out_ WHERE url NOT IN (SELECT url FROM nodes)")
def linked_not_crawled(spark: SparkSession, d: str) -> DataFrame:
    """Link targets that no crawled page is."""
    return graph.linked_not_crawled(X.graph_nodes(spark, d), X.graph_edges(spark, d)).select("url")


# --- rendered pages, probes, sitemaps, robots -------------------------------------------------------

_RUNTIME = "r AS (SELECT 'c' || (o_custkey % 100) || '.example.com' AS site, o_orderkey AS url, o_orderkey AS o, CAST(trunc(o_totalprice * 20) AS BIGINT) AS bytes FROM orders WHERE o_orderkey % 19 <> 0)"


@query("WITH " + _RUNTIME + ", " + _union(
    "'ERR-04' AS finding, 'high' AS severity, url FROM r WHERE o % 7 = 0", "'ERR-05', 'medium', url FROM r WHERE o % 13 = 0", "'ERR-06', 'medium', url FROM r WHERE o % 17 = 0", "'ERR-07', 'medium', url FROM r WHERE o % 23 = 0", "'ERR-08', 'low', url FROM r WHERE o % 9 > 4",
    "'MED-05', 'medium', url FROM r WHERE bytes > 2500000",
) + _COUNTED)
def runtime_findings(spark: SparkSession, d: str) -> DataFrame:
    """Rules over rendered pages."""
    return _family(rules.Frames(X.records(spark, d), runtime=X.runtime(spark, d)), "ERR-04", "ERR-05", "ERR-06", "ERR-07", "ERR-08", "MED-05")


@query("WITH " + _RUNTIME + _metric_sql("r", js_errors=_share("o % 7 <> 0"), no_overflow=_share("o % 9 <= 2"), images_load=_share("o % 17 <> 0 AND o % 6 <> 0")))
def runtime_metrics(spark: SparkSession, d: str) -> DataFrame:
    return scores.runtime_metrics(X.runtime(spark, d)).select("site", "metric", F.round("value", 6).alias("value"))


_PROBES = """e AS (SELECT event_id AS e, 'https://e' || (event_id % 50) || '.example.com' || path AS url, path, ['nonexistent', 'exposed', 'users', 'author', 'cms', 'exposed', 'cms'][event_id % 7 + 1] AS bucket, CASE WHEN event_id % 4 = 0 THEN 404 ELSE 200 END AS status,
 (bytes > 0 AND abs(bytes - 3000) <= 512) OR (event_id % 50 % 2 = 0 AND abs(bytes - 9000) <= 2048) AS suppressed FROM (SELECT event_id, ['/.env', '/xmlrpc.php', '/readme.html', '/wp-json/', '/wp-login.php', '/other'][event_id % 6 + 1] AS path, coalesce(value, 0) * 100 AS bytes FROM events))"""


@query("WITH " + _PROBES + ", " + _union(
    "'SEC-01' AS finding, 'critical' AS severity, url FROM e WHERE bucket = 'exposed' AND status = 200 AND NOT suppressed", "'SEC-02', 'high', url FROM e WHERE bucket = 'users' AND e % 5 = 0 OR bucket = 'author' AND e % 3 = 0",
    "'SEC-03', 'low', url FROM e WHERE bucket = 'cms' AND status = 200 AND path IN ('/xmlrpc.php', '/readme.html', '/wp-json/', '/wp-login.php')", "'IDX-03', 'medium', url FROM e WHERE bucket = 'nonexistent' AND status = 200",
) + _COUNTED)
def probe_findings(spark: SparkSession, d: str) -> DataFrame:
    """Rules over probe answers, those that echo the home page or a missing path left out."""
    probed = probes.suppressed_probes(X.probe_answers(spark, d), X.probe_baselines(spark, d))
    return _family(rules.Frames(X.records(spark, d), probes=probed), "SEC-01", "SEC-02", "SEC-03", "IDX-03")


@query("WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_custkey % 50 + 1 AS urls, CASE WHEN c_nationkey % 3 = 0 THEN 0 ELSE c_custkey % 2 END AS own FROM customer), n AS (SELECT n AS url, sum(urls) AS urls, sum(own) AS own FROM c GROUP BY ALL), " + _union(
    "'IDX-06' AS finding, 'medium' AS severity, CAST(url AS VARCHAR) AS url FROM n WHERE urls > own AND own = 0", "'ERR-15', 'low', CAST(k AS VARCHAR) FROM c WHERE k % 3 >= 1",
) + _COUNTED)
def entry_findings(spark: SparkSession, d: str) -> DataFrame:
    """Rules over sitemaps' totals and over the redirects in front of a site."""
    return _family(rules.Frames(X.records(spark, d), sitemaps=X.sitemap_totals(spark, d), extra={"entry_point": X.entry_points(spark, d)}), "IDX-06", "ERR-15")


@query("""WITH s AS (SELECT user_id % 500 AS url, bool_or(event_id % 5 = 4) AS has_map, bool_or(event_id % 5 IN (0, 1, 2)) AS rules FROM events WHERE user_id IS NOT NULL GROUP BY ALL),
hits AS (SELECT 'IDX-02' AS finding, 'medium' AS severity, url FROM s WHERE NOT has_map OR NOT rules)""" + _COUNTED)
def robots_findings(spark: SparkSession, d: str) -> DataFrame:
    """robots.txt files without rules or sitemaps."""
    return _family(rules.Frames(X.records(spark, d), robots=probes.robots_summary(X.robots_bodies(spark, d))), "IDX-02")


@query("""WITH s AS (SELECT 'n' || c_nationkey AS site, sum(CASE WHEN c_nationkey % 3 = 0 THEN 0 ELSE c_custkey % 2 END) AS own, count(*) AS n FROM customer GROUP BY ALL), r AS (SELECT 'n' || (user_id % 40) AS site, bool_or(event_id % 5 = 4) AS has_map, bool_or(event_id % 5 IN (0, 1, 2)) AS rules FROM events WHERE user_id IS NOT NULL GROUP BY ALL),
j AS (SELECT coalesce(s.site, r.site) AS site, own, n, has_map, rules FROM s FULL JOIN r ON s.site = r.site)
SELECT site, 'sitemap' AS metric, CASE WHEN own > 0 THEN 1.0 WHEN n > 0 THEN 0 WHEN has_map THEN 0.5 ELSE 0 END::DOUBLE AS value FROM j UNION ALL SELECT site, 'robots', round((1 - CASE WHEN rules THEN 0 ELSE 0.3 END - CASE WHEN has_map THEN 0 ELSE 0.3 END)::DOUBLE, 6) FROM j WHERE has_map IS NOT NULL
UNION ALL SELECT site, 'robots', NULL FROM j WHERE has_map IS NULL""")
def file_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Score metrics of sitemaps and robots.txt."""
    robots = probes.robots_summary(X.robots_bodies(spark, d, 40).withColumn("site", F.concat(F.lit("n"), "site")))
    return scores.file_metrics(X.sitemap_totals(spark, d), robots).select("site", "metric", F.round("value", 6).alias("value"))


@query("WITH " + _PROBES + """, s AS (SELECT 'e' || (e % 50) || '.example.com' AS site, bool_and(status <> 200) FILTER (bucket = 'nonexistent') AS soft_404, NOT bool_or(bucket = 'exposed' AND status = 200 AND NOT suppressed) AS exposed, NOT bool_or(bucket = 'users' AND e % 5 = 0 OR bucket = 'author' AND e % 3 = 0) AS enumeration FROM e GROUP BY ALL)
SELECT site, 'soft_404' AS metric, soft_404::INT::DOUBLE AS value FROM s UNION ALL SELECT site, 'exposed', exposed::INT::DOUBLE FROM s UNION ALL SELECT site, 'enumeration', enumeration::INT::DOUBLE FROM s""")
def probe_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Score metrics of probe answers."""
    return scores.probe_metrics(probes.suppressed_probes(X.probe_answers(spark, d), X.probe_baselines(spark, d))).select("site", "metric", "value")


# --- mail, reputation -------------------------------------------------------------------------------

_MAIL = """m AS (SELECT s_suppkey AS k, 's' || s_suppkey AS url, CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN 0 WHEN s_suppkey % 9 = 0 THEN 2 ELSE 1 END AS n, CASE WHEN s_suppkey % 6 = 0 THEN '~' ELSE ['-', '~', '?', '+'][s_suppkey % 4 + 1] END AS q, CASE WHEN s_suppkey % 6 = 0 THEN 9 ELSE 5 END AS cost,
 s_suppkey % 4 <> 0 AS dmarc, ['reject', 'quarantine', 'none'][s_suppkey % 3 + 1] AS policy, (s_suppkey % 2 + 1) * 50 AS pct, s_suppkey % 3 <> 0 AND s_suppkey % 8 <> 0 AS live FROM supplier)"""


@query("WITH " + _MAIL + ", " + _union(
    "'MAIL-01' AS finding, 'high' AS severity, url FROM m WHERE n = 0", "'MAIL-02', 'high', url FROM m WHERE n > 1", "'MAIL-03', 'high', url FROM m WHERE n > 0 AND cost > 10", "'MAIL-10', CASE WHEN q = '~' THEN 'low' ELSE 'medium' END, url FROM m WHERE n > 0 AND q <> '-'",
    "'MAIL-04', 'medium', url FROM m WHERE NOT live", "'MAIL-05', 'low', url FROM m WHERE live AND k % 2 = 0", "'MAIL-06', 'medium', url FROM m WHERE NOT dmarc", "'MAIL-08', CASE WHEN policy = 'none' THEN 'medium' ELSE 'low' END, url FROM m WHERE dmarc AND NOT (policy = 'reject' AND pct = 100)",
    "'MAIL-09', 'low', url FROM m WHERE dmarc AND k % 7 = 0", "'MAIL-07', 'medium', url FROM m WHERE k % 10 = 0",
) + _COUNTED)
def mail_findings(spark: SparkSession, d: str) -> DataFrame:
    """Rules over mail authentication."""
    f = rules.Frames(X.records(spark, d), mail=mail.mail_records(X.mail_domains(spark, d), X.dns_answers(spark, d)))
    return _family(f, *[r for r in rules.RULES if r.startswith("MAIL")])


_POSTURE = """w AS (SELECT url, CASE WHEN n IS NOT NULL THEN CAST(n > 0 AS INT) END AS present, CASE WHEN n > 0 THEN CAST(n = 1 AS INT) END AS single, CASE WHEN n > 0 THEN CAST(cost <= 10 AS INT) END AS lookups, CASE WHEN live THEN 1 END AS key, CASE WHEN live THEN CAST(k % 2 <> 0 AS INT) END AS strong, CAST(dmarc AS INT) AS dmarc,
 CASE WHEN k % 10 = 0 THEN 0 WHEN k % 13 = 0 THEN 0.5 ELSE 1 END AS mx, CASE WHEN dmarc THEN CASE policy WHEN 'reject' THEN 1.0 WHEN 'quarantine' THEN 0.6 ELSE 0 END * pct / 100 ELSE 0 END AS enforced, CASE WHEN dmarc AND k % 7 <> 0 THEN 1 ELSE 0 END AS reporting,
 CASE WHEN n = 1 THEN CASE q WHEN '-' THEN 1.0 WHEN '~' THEN 0.5 WHEN '?' THEN 0.1 ELSE 0 END WHEN n IS NOT NULL THEN 0 END AS strict FROM m)"""


def _weighted(**weights: int) -> str:
    top, low = (" + ".join(x) for x in zip(*[(f"coalesce({c}, 0) * {w}.0", f"CASE WHEN {c} IS NULL THEN 0 ELSE {w}.0 END") for c, w in weights.items()], strict=True))
    return f"round_even(CAST(100 * ({top}) / ({low}) AS DOUBLE), 0)"


@query("WITH " + _MAIL + ", " + _POSTURE + f""" SELECT url || '.example.com' AS site, url || '.example.com' AS domain, {_weighted(present=22, single=8, lookups=10, key=20, strong=5, dmarc=15, mx=5)} AS spam,
 {_weighted(enforced=35, reporting=10, strict=20, key=15)} AS phishing FROM w""")
def mail_posture(spark: SparkSession, d: str) -> DataFrame:
    """Spam and phishing posture, with the arithmetic of each part."""
    return scores.posture_scores(mail.mail_records(X.mail_domains(spark, d), X.dns_answers(spark, d)))


catalog.ORACLE_SQL["posture_scores"] = catalog.ORACLE_SQL["mail_posture"]


@query(catalog.ORACLE_SQL["reputation_grades"].replace("SELECT host, tier AS worst_tier", ", hits AS (SELECT CASE WHEN tier = 'browser' THEN 'REP-01' WHEN tier IN ('gateway', 'mail', 'endpoint') THEN 'REP-02' ELSE 'REP-03' END AS finding, grade AS severity, host AS url FROM (SELECT host, tier AS worst_tier, tier", 1) + "))" + _COUNTED)
def reputation_findings(spark: SparkSession, d: str) -> DataFrame:
    """Rules over listings by consequence."""
    return _family(rules.Frames(X.records(spark, d), reputation=probes.reputation_grade(X.listings(spark, d))), "REP-01", "REP-02", "REP-03")


# --- structured data, media, copy -------------------------------------------------------------------


@query("""WITH k AS (SELECT p_partkey AS k FROM part), ok AS (SELECT k, k % 15 <> 0 AS product FROM k WHERE k % 9 <> 0),
n AS (SELECT k, 'SDV-01' AS finding, 'high' AS severity, CAST(k % 9 = 0 OR k % 10 = 0 AS INT) AS n FROM k UNION ALL SELECT k, 'SDV-02', 'medium', CAST(NOT product AS INT) FROM ok UNION ALL SELECT k, 'SDV-03', 'medium', CAST(k % 8 = 0 AS INT) FROM ok
 UNION ALL SELECT k, 'SDV-04', 'medium', CAST(product AND k % 7 = 0 AS INT) + CAST(product AND k % 4 = 0 AS INT) FROM ok UNION ALL SELECT k, 'SDV-05', 'low', CAST(product AS INT) FROM ok UNION ALL SELECT k, 'SDV-06', 'low', 1 + CAST(k % 6 = 0 AS INT) FROM ok UNION ALL SELECT k, 'SDV-07', 'low', CASE WHEN product THEN 7 ELSE 0 END FROM ok)
SELECT finding, severity, count(*) AS urls, CAST(sum(n) AS BIGINT) AS hits FROM n WHERE n > 0 GROUP BY ALL""")
def schema_findings(spark: SparkSession, d: str) -> DataFrame:
    """Rules over structured data."""
    ship(spark)
    issues = structured.record_issues(X.jsonld_records(spark, d), structured.vocabulary(spark))
    return _family(rules.Frames(X.records(spark, d), schema_issues=issues), *rules.SCHEMA_CODES)


@query("""WITH o AS (SELECT o_orderkey AS o, 'c' || (o_custkey % 100) AS site FROM orders),
i AS (SELECT site, 'missing-required' AS code, 'address' AS prop FROM o WHERE o % 4 = 0 AND o % 5 = 0 UNION ALL SELECT site, 'missing-required', 'name' FROM o WHERE o % 4 = 0 UNION ALL SELECT site, 'id-merged', '' FROM o WHERE o % 4 <> 0 UNION ALL SELECT site, 'list-count', 'numberOfItems' FROM o WHERE o % 3 <> 2
 UNION ALL SELECT site, 'list-item-position', unnest(['position', 'position']) FROM o UNION ALL SELECT site, unnest(['property-not-on-type', 'empty-value']), 'sku' FROM o WHERE o % 5 = 0 UNION ALL SELECT site, 'unresolved-id', 'publisher' FROM o WHERE o % 6 = 0 UNION ALL SELECT site, 'value-type', 'author' FROM o WHERE o % 7 IN (0, 1)
 UNION ALL SELECT site, 'missing-recommended', unnest(['telephone', 'url', 'image', 'openingHours', 'geo', 'priceRange']) FROM o WHERE o % 4 = 0 UNION ALL SELECT site, 'missing-recommended', unnest(['url', 'logo', 'sameAs', 'contactPoint', 'image', 'dateModified']) FROM o UNION ALL SELECT site, 'invalid-date', 'datePublished' FROM o WHERE o % 8 = 0)
SELECT site, code, prop, count(*) AS issues FROM i GROUP BY ALL""")
def schema_graph_issues(spark: SparkSession, d: str) -> DataFrame:
    """Structured data of several blocks: nodes that share an @id, references, lists and features."""
    ship(spark)
    found = structured.record_issues(X.jsonld_graphs(spark, d), structured.vocabulary(spark))
    return found.groupBy("site", "code", "prop").agg(F.sum("n").alias("issues"))


@query("""WITH i AS (SELECT p_partkey AS k, CAST(trunc(p_retailprice * 200) AS BIGINT) AS bytes, p_size * 40 AS wide FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)) SELECT 'MED-07' AS finding, 'low' AS severity, count(*) AS hits FROM i WHERE bytes <= 180 * 1024 AND k % 4 <> 2 AND wide >= 800 HAVING count(*) > 0""")
def oversized_images(spark: SparkSession, d: str) -> DataFrame:
    """Raster images twice as wide as their box."""
    return _family(rules.Frames(X.records(spark, d), images=X.images(spark, d)), "MED-07").drop("urls")


@query("""WITH i AS (SELECT lower(p_brand) AS site, p_partkey AS k, CAST(trunc(p_retailprice * 200) AS BIGINT) AS bytes, 400.0 / nullif(p_size * 40, 0) AS ratio FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)),
s AS (SELECT site, 'sized_bytes' AS opportunity, sum(CASE WHEN ratio < 0.5 AND k % 4 <> 2 THEN bytes * (1 - ratio * ratio) END) AS amount FROM i GROUP BY ALL UNION ALL SELECT site, 'format_bytes', sum(CASE WHEN k % 4 NOT IN (1, 2) AND bytes > 20000 THEN bytes * 0.6 END) FROM i GROUP BY ALL UNION ALL SELECT site, 'heavy_bytes', sum(CASE WHEN bytes > 184320 THEN bytes - 184320.0 END) FROM i GROUP BY ALL
 UNION ALL SELECT 'c' || (o_custkey % 100) || '.example.com', 'page_bytes', median(CAST(trunc(o_totalprice * 20) AS BIGINT)) - 1500000 FROM orders WHERE trunc(o_totalprice * 20) > 0 GROUP BY ALL)
SELECT site, opportunity, round(amount, 3) AS amount FROM s WHERE amount > 0""")
def image_savings(spark: SparkSession, d: str) -> DataFrame:
    """Bytes that sized images and modern formats would save."""
    out = lab.opportunities(X.images(spark, d), X.records(spark, d), X.runtime(spark, d)).filter("opportunity <> 'response_ms'")
    return out.select("site", "opportunity", F.round("amount", 3).alias("amount"))


# `savings` takes no rendered pages, and pages without times lose no response time
catalog.ORACLE_SQL["savings"] = f"SELECT * FROM ({catalog.ORACLE_SQL['image_savings']}) WHERE opportunity <> 'page_bytes'"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_DAMAGED = " OR ".join(f"contains(line, {_quoted(m)})" for m in MOJIBAKE)
_LETTERS = "regexp_replace(line, '[^A-Za-z]', '', 'g')"


@query("WITH l AS (SELECT source AS site, doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\n\\x0B\\f\\r\\x{85}\\x{2028}\\x{2029}]')) AS line FROM documents), hits AS (" + f"""SELECT 'mojibake' AS kind, site, doc_id FROM l WHERE {_DAMAGED} UNION ALL SELECT 'entity', site, doc_id FROM l WHERE regexp_matches(line, {_quoted(ENTITY)})
 UNION ALL SELECT 'style', site, doc_id FROM l WHERE length({_LETTERS}) > 25 AND upper({_LETTERS}) = {_LETTERS} UNION ALL SELECT 'misspelling', site, doc_id FROM l WHERE regexp_matches(lower(line), {_quoted('|'.join(p for p, _ in TYPOS))})) SELECT site, kind, count(DISTINCT doc_id) AS documents FROM hits GROUP BY ALL""")
def copy_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source with damaged, misspelt, entity-ridden or capital lines."""
    own = catalog._document_signals(spark, d).filter(F.col("kind").isin("mojibake", "entity", "style", "misspelling"))
    return own.groupBy("site", "kind").agg(F.count_distinct("url").alias("documents"))


@query("""WITH {edges}, o AS (SELECT url FROM nodes WHERE url NOT IN (SELECT dst FROM edges WHERE src <> dst)), home AS (SELECT min(src) AS url FROM edges) SELECT split_part(url, '/', 4) AS segment, count(*) AS orphans FROM o WHERE url <> (SELECT url FROM home) GROUP BY ALL""")
def orphan_segments(spark: SparkSession, d: str) -> DataFrame:
    """Orphans by their first path segment."""
    g = catalog._classified(spark, d).filter("link_class like '%orphan'")
    return g.groupBy(F.split("url", "/")[3].alias("segment")).agg(F.count(F.lit(1)).alias("orphans"))
