"""Registered queries of collected answers (mail records, reputation sources) and of page issues, with the
frames they read and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import mail, page_issues, reputation
from plumbline.plans import catalog, findings
from plumbline.plans import frames as X
from plumbline.plans.catalog import query
from plumbline.sources.tables import parquet


def _named(prefix: str, key: Column, suffix: str = ".example.com") -> Column:
    return F.concat(F.lit(prefix), key.cast("string"), F.lit(suffix))


# --- mail -------------------------------------------------------------------------------------------


def mail_answers(spark: SparkSession, d: str) -> DataFrame:
    """What one of seven networks was told of each supplier's domain; the fourth sees no records at all."""
    k = F.col("s_suppkey")
    s = parquet(spark, d, "supplier").select("s_suppkey", _named("s", k).alias("name"), _named("net", k % 7, "").alias("network"))
    none = F.array().cast("array<string>")
    unread = F.lit(None).cast("array<string>")

    def records(name: Column, values: Column) -> DataFrame:
        return s.select("network", name.alias("name"), F.lit("TXT").alias("rtype"), values.alias("values"))

    spf = F.when(k % 3 == 0, "v=spf1 +a -all").when(k % 3 == 1, "v=spf1 include:a.example.net mx:x.example ~all").otherwise("v=spf1 ip4:192.0.2.1 mx")
    policy = F.element_at(F.array(*map(F.lit, ("reject", "quarantine", "none", "p"))), (k % 4 + 1).cast("int"))
    dmarc = F.concat(F.lit("V=DMARC1; p="), policy, F.lit("; sp=None"), F.when(k % 2 == 0, "; adkim = s; aspf=s; adkim=r").otherwise("; ruf=mailto:f@example.com"))
    out = records(F.col("name"), F.when(k % 11 == 0, unread).when(k % 5 == 0, none).when(k % 9 == 0, F.array(spf, F.lit("v=spf1 -all"))).otherwise(F.array(F.lit('"site=1"'), spf)))
    for part in (
        records(F.concat(F.lit("_dmarc."), "name"), F.when(k % 6 == 0, none).otherwise(F.array(dmarc))),
        records(F.concat(F.lit("default._domainkey."), "name"), F.when(k % 3 == 0, none).otherwise(F.array(F.lit("note"), F.concat(F.lit("v=DKIM1; p="), F.when(k % 8 == 0, "").otherwise("AAAA"))))),
        records(F.concat(F.lit("k1._domainkey."), "name"), F.when(k % 6 == 1, F.array(F.lit("p="))).otherwise(none)),
        records(F.concat(F.lit("_mta-sts."), "name"), F.when(k % 5 == 1, F.array(F.lit("v=STSv1; id=1"))).when(k % 5 == 2, unread).otherwise(none)),
        records(F.concat(F.lit("default._bimi."), "name"), F.when(k % 6 == 1, F.array(F.lit("v=BIMI1"))).otherwise(none)),
    ):
        out = out.unionByName(part)
    control = s.select("network").distinct().select("network", F.lit(mail.CONTROL).alias("name"), F.lit("TXT").alias("rtype"), F.when(F.col("network") == "net3", none).otherwise(F.array(F.lit('"v=spf1 include:x ~all"'))).alias("values"))
    return out.unionByName(control)


@query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 7 <> 3 AS seen, CASE WHEN s_suppkey % 7 = 3 OR s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN 0 WHEN s_suppkey % 9 = 0 THEN 2 ELSE 1 END AS n, s_suppkey % 7 <> 3 AND s_suppkey % 6 <> 0 AS dmarc FROM supplier)
SELECT 's' || k || '.example.com' AS domain, CASE WHEN n > 0 THEN n = 1 END AS spf_effective, CASE WHEN n > 0 THEN k % 3 <> 1 END AS spf_broad, CASE WHEN dmarc THEN ['enforcing', 'partial', 'monitor only', 'unrecognised'][k % 4 + 1] END AS dmarc_state, CASE WHEN dmarc THEN 'none' END AS dmarc_subdomains,
 CASE WHEN dmarc THEN 'r' END AS adkim, CASE WHEN dmarc THEN CASE WHEN k % 2 = 0 THEN 's' ELSE 'r' END END AS aspf, CASE WHEN dmarc THEN CASE WHEN k % 2 = 0 THEN '' ELSE 'mailto:f@example.com' END END AS dmarc_ruf,
 CAST(seen AND k % 3 <> 0 AND k % 8 <> 0 AS BIGINT) AS dkim_live, CAST(seen AND k % 3 <> 0 AND k % 8 = 0 AS BIGINT) + CAST(seen AND k % 6 = 1 AS BIGINT) AS dkim_revoked, CASE WHEN seen AND k % 5 <> 2 THEN k % 5 = 1 END AS mta_sts, CASE WHEN seen THEN k % 6 = 1 END AS bimi FROM s""")
def mail_details(spark: SparkSession, d: str) -> DataFrame:
    """Effect, breadth, alignment, revoked keys, MTA-STS and BIMI, from networks that see the control."""
    return mail.mail_details(X.mail_domains(spark, d), mail.controlled(mail_answers(spark, d))).drop("site")


# --- reputation -------------------------------------------------------------------------------------


def source_answers(spark: SparkSession, d: str) -> DataFrame:
    """An answer an event; a user is a run, each tenth question is about the source's test host."""
    e = F.col("event_id")
    source = F.element_at(F.array(*map(F.lit, ("safe_browsing", "resolver", "web_risk"))), (e % 3 + 1).cast("int"))
    test = F.try_element_at(F.create_map(*[F.lit(x) for pair in reputation.CONTROLS for x in pair]), source)
    host = F.when((e % 10 == 0) & test.isNotNull(), test).otherwise(_named("www.h", e % 20))
    status_row = F.concat(F.lit(')]}\'\n\n[["sb.ssr",'), F.when(e % 10 == 0, "3").when(e % 17 == 0, "2").when(e % 7 == 0, "3").otherwise("1"), F.lit(","), F.when(e % 14 == 0, "true").otherwise("false"), F.lit(',false,false,false,false,1700000000,"'), F.when(e % 13 == 0, "other.example").otherwise(F.regexp_replace(host, r"^www\.", "")), F.lit('",false]]'))
    threats = F.when(e % 13 == 0, "x").when(e % 7 == 0, '{"threat":{"threatTypes":["MALWARE"],"expireTime":"2030-01-01T00:00:00Z"}}').otherwise("{}")
    address, sentinel = F.array(F.lit("192.0.2.1")), F.array(F.lit("0.0.0.0"))
    return parquet(spark, d, "events").filter("user_id is not null").select(
        _named("u", F.col("user_id"), "").alias("run"), source.alias("source"), host.alias("host"), F.when(e % 11 == 0, 403).otherwise(200).alias("status"),
        F.when(source == "safe_browsing", F.when(e % 19 == 0, "<html>").otherwise(status_row)).when(source == "web_risk", threats).alias("body"),
        F.when(e % 11 != 0, F.when(e % 5 == 0, sentinel).otherwise(address)).alias("secure"), F.when(e % 13 != 0, F.when(e % 7 == 0, F.array().cast("array<string>")).otherwise(address)).alias("plain"),
    )


_SOURCES = """e AS (SELECT event_id AS e, 'u' || user_id AS run, ['safe_browsing', 'resolver', 'web_risk'][event_id % 3 + 1] AS source, event_id % 10 = 0 AND event_id % 3 <> 2 AS test FROM events WHERE user_id IS NOT NULL),
v AS (SELECT *, CASE source WHEN 'safe_browsing' THEN CASE WHEN e % 11 = 0 OR e % 19 = 0 OR e % 13 = 0 THEN NULL WHEN e % 10 = 0 OR e % 14 = 0 THEN true WHEN e % 17 = 0 THEN NULL ELSE e % 7 = 0 END WHEN 'resolver' THEN CASE WHEN e % 11 = 0 THEN NULL WHEN e % 5 <> 0 THEN false WHEN e % 13 = 0 THEN NULL ELSE e % 7 <> 0 END ELSE CASE WHEN e % 11 = 0 OR e % 13 = 0 THEN NULL ELSE e % 7 = 0 END END AS said FROM e),
proven AS (SELECT run, source, bool_and(coalesce(said, false)) AS proven FROM v WHERE test GROUP BY ALL), held AS (SELECT run, source, 'www.h' || (e % 20) || '.example.com' AS host, CASE WHEN source = 'web_risk' OR proven THEN said END AS listed FROM v LEFT JOIN proven USING (run, source) WHERE NOT test)"""


@query("WITH " + _SOURCES + " SELECT source, host, count(*) FILTER (listed) AS listed, count(*) FILTER (NOT listed) AS clean, count(*) FILTER (listed IS NULL) AS unread FROM held GROUP BY ALL")
def source_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Safe Browsing, filtering resolver and threat lists, each behind its own test host."""
    held = reputation.believed(reputation.verdicts(source_answers(spark, d)))
    return held.groupBy("source", "host").agg(F.count_if("listed").alias("listed"), F.count_if(~F.col("listed")).alias("clean"), F.count_if(F.col("listed").isNull()).alias("unread"))


@query("WITH " + _SOURCES + " SELECT run, NOT bool_or(CASE WHEN source <> 'resolver' THEN listed END) AS web_risk_clean FROM held GROUP BY run")
def browser_clean(spark: SparkSession, d: str) -> DataFrame:
    """Would a browser warn, by run."""
    return reputation.browser_clean(reputation.believed(reputation.verdicts(source_answers(spark, d))))


@query("""WITH o AS (SELECT 'c' || o_custkey AS site, CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0 THEN greatest(0, epoch(TIMESTAMP '2024-06-01') - floor(epoch(o_orderdate))) END AS age FROM orders), a AS (SELECT site, CAST(floor(min(age) / 86400) AS BIGINT) AS age_days FROM o GROUP BY ALL)
SELECT site, age_days, coalesce(age_days > 90, false) AS stale FROM a""")
def report_ages(spark: SparkSession, d: str) -> DataFrame:
    """Age of each customer's youngest report; orders are reports."""
    k = F.col("o_orderkey")
    dated = F.concat(F.lit('{"data":{"attributes":{'), F.when(k % 5 != 0, F.concat(F.lit('"last_analysis_date":'), F.unix_timestamp("o_orderdate").cast("string"))).otherwise(""), F.lit("}}}"))
    answers = parquet(spark, d, "orders").select(_named("c", F.col("o_custkey"), "").alias("site"), k.cast("string").alias("host"), F.when(k % 4 == 0, 404).otherwise(200).alias("status"), dated.alias("body"))
    return reputation.report_ages(answers, F.lit("2024-06-01 00:00:00").cast("timestamp"))


_VENDOR_NAMES = [v for names in reputation.VENDORS.values() for v in names.split(", ")] + ["Google Web Risk", "Nobody Knows"]
_VENDOR_ROWS = ", ".join(
    f"({i}, {findings._quoted(v)}, {findings._quoted(next((t for t, names in reputation.VENDORS.items() if v in names.split(', ')), 'unknown'))}, {findings._quoted(reputation.REVIEW[v]) if v in reputation.REVIEW else 'NULL'})" for i, v in enumerate(_VENDOR_NAMES)
)


@query(f"WITH n(i, name, tier, review_url) AS (VALUES {_VENDOR_ROWS}) SELECT CASE WHEN event_id % 2 = 0 THEN upper(name) ELSE replace(name, ' ', '-') END AS vendor, tier, review_url, count(*) AS listings FROM events JOIN n ON event_id % {len(_VENDOR_NAMES)} = i GROUP BY ALL")
def vendor_consequences(spark: SparkSession, d: str) -> DataFrame:
    """What a vendor's listing does, whatever its name's spelling; an event is a listing."""
    e = F.col("event_id")
    name = F.get(F.array(*map(F.lit, _VENDOR_NAMES)), (e % len(_VENDOR_NAMES)).cast("int"))
    listings = parquet(spark, d, "events").select(F.when(e % 2 == 0, F.upper(name)).otherwise(F.replace(name, F.lit(" "), F.lit("-"))).alias("vendor"))
    return reputation.consequences(listings, reputation.vendor_tiers(spark)).groupBy("vendor", "tier", "review_url").agg(F.count(F.lit(1)).alias("listings"))


# --- page issues ------------------------------------------------------------------------------------

_H1 = catalog._tag("regexp_extract(coalesce(html, ''), '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1>', 1)").replace('\\"', '"')


@query("WITH " + findings._CRAWL + ", t AS (SELECT page_id AS p, {text} AS text, " + _H1 + """ AS h1, len(regexp_extract_all(html, '(?is)<h1(?:\\s[^>]*)?>.*?</h1>')) AS h1s, regexp_matches(html, '(?is)<title(?:\\s[^>]*)?>.*?</title>') AS titled, regexp_matches(html, '(?is)<script[^>]*application/ld\\+json') AS typed, html FROM pages),
a AS (SELECT q.*, t.h1, h1s, typed, coalesce(titled, false) AND status = 200 AS page, (CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END) AS words FROM q JOIN t USING (p)), h AS (SELECT * FROM a WHERE page),
""" + findings._union(
    "'http-error' AS issue, 'error' AS severity, site, url FROM a WHERE status >= 400", "'redirect-in-sitemap', 'warning', site, url FROM a WHERE p % 5 = 0", "'indexable-staging', 'error', site, url FROM h WHERE NOT noindex", "'missing-description', 'warning', site, url FROM h WHERE descr IS NULL",
    "'short-description', 'notice', site, url FROM h WHERE length(descr) BETWEEN 1 AND 69", "'long-description', 'notice', site, url FROM h WHERE length(descr) > 160", "'missing-title', 'error', site, url FROM h WHERE title = ''", "'long-title', 'warning', site, url FROM h WHERE length(title) > 60",
    "'no-h1', 'warning', site, url FROM h WHERE h1s = 0", "'multiple-h1', 'notice', site, url FROM h WHERE h1s > 1", "'missing-canonical', 'warning', site, url FROM h WHERE canon IS NULL", "'canonical-mismatch', 'notice', site, url FROM h WHERE regexp_replace(canon, '/+$', '') <> regexp_replace(url, '/+$', '')",
    "'thin-content', 'warning', site, url FROM h WHERE words + 4 < 300", "'missing-og-image', 'warning', site, url FROM h WHERE p % 5 = 0", "'missing-og-description', 'notice', site, url FROM h WHERE p % 6 = 0",
    "'images-missing-alt', 'warning', site, url FROM h WHERE p % 3 <> 2", "'images-no-dimensions', 'notice', site, url FROM h WHERE p % 2 = 1", "'links-no-anchor-text', 'notice', site, url FROM h WHERE p % 6 = 0 OR regexp_matches(html, '(?is)<a\\s[^>]*>\\s*</a>')",
    "'no-schema', 'notice', site, url FROM h WHERE NOT typed", "'slow-response', 'warning', site, url FROM h WHERE p * 37 % 3000 > 1500",
    "'duplicate-title', 'warning', site, url FROM h JOIN (SELECT site, title FROM h WHERE title <> '' GROUP BY ALL HAVING count(*) > 1) USING (site, title)", "'duplicate-meta_description', 'warning', site, url FROM h JOIN (SELECT site, descr FROM h WHERE descr <> '' GROUP BY ALL HAVING count(*) > 1) USING (site, descr)",
    "'duplicate-h1', 'notice', site, url FROM h JOIN (SELECT site, h1 FROM h WHERE h1 <> '' GROUP BY ALL HAVING count(*) > 1) USING (site, h1)",
) + " SELECT site, issue, severity, count(*) AS pages, list_position(['error', 'warning', 'notice'], severity) - 1 AS rank FROM hits GROUP BY ALL")
def page_issue_groups(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each site by issue."""
    return page_issues.issue_groups(page_issues.page_issues(X.crawl_records(spark, d)))
