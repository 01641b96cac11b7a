"""Answers of reputation sources: what each says of a host, and whether it may be believed.

Null is unread: an answer of unknown shape, a refused key or a source whose own test host does not come
back listed says nothing about a site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.probes import STALE_DAYS, vendor_key
from plumbline.session import small

# Markers and codes of the sources, and the hosts that each source lists as a test.
GUARD, ROW, CLEAN, UNSAFE = r"^\)\]\}'", "sb.ssr", 1, 3
BLOCKED_ADDRESSES = ("0.0.0.0", "::")
CONTROLS = (("safe_browsing", "testsafebrowsing.appspot.com"), ("resolver", "malware.testcategory.com"))
BROWSER_SOURCES = ("safe_browsing", "web_risk")
# What a vendor's listing does to visitors, and where it can be disputed.
VENDORS = {
    "browser": "Google Safebrowsing, Yandex Safebrowsing",
    "gateway": "Forcepoint ThreatSeeker, Fortinet, Sophos, Trustwave, Netcraft, zvelo, Webroot, Phishtank, OpenPhish, Sucuri SiteCheck",
    "mail": "Spamhaus, Abusix, Mimecast",
    "endpoint": "Kaspersky, ESET, BitDefender, Dr.Web, Emsisoft, G-Data, Avira, Quick Heal, K7AntiVirus, Antiy-AVL, Rising, Bkav, VIPRE, Acronis, Gridinsoft, Heimdal Security, Lionic, ESTsecurity, Xcitium Verdict Cloud, Comodo Valkyrie Verdict",
    "feed": "CRDF, Criminal IP, Bfore.Ai PreCrime, alphaMountain.ai, Seclookup, SOCRadar, Quttera, Scumware.org, AutoShun, Snort IP sample list, ArcSight Threat Intelligence, VX Vault, ViriBack, PREBYTES, Phishing Database, PhishLabs, MalwarePatrol, MalwareURL, Malwared, "
    "GreenSnow, IPsum, CINS Army, AlienVault, Blueliv, benkow.cc, Certego, CyRadar, Cyan, Cyble, Cluster25, EmergingThreats, Feodo Tracker, ThreatHive, Threatsourcing, URLQuery, Underworld, desenmascara.me, malwares.com URL checker, securolytics, ADMINUSLabs, "
    "Chong Lua Dao, CyberCrime, DNS8, Ermes, Hunt.io Intelligence, Lumu, PhishFort, PrecisionSec, SafeToOpen, Sansec eComscan, Segasec, Viettel Threat Intelligence, ZeroCERT, ZeroFox",
}
REVIEW = {
    "Google Safebrowsing": "https://search.google.com/search-console",
    "Google Web Risk": "https://search.google.com/search-console",
    "Fortinet": "https://www.fortiguard.com/webfilter",
    "Spamhaus": "https://check.spamhaus.org/",
    "Webroot": "https://support.threatintel.opentext.com/tools/url-ip-lookup.php",
}


def browsing_listed(body: Column, host: Column) -> Column:
    """Does a Safe Browsing status answer list the host?  Null unless it is a row of the known form, about
    this host, with one of the two known codes."""
    text = F.trim(body)
    row = F.get(F.from_json(F.regexp_replace(text, GUARD, ""), "array<array<string>>"), F.lit(0))
    bare = lambda c: F.regexp_replace(F.lower(c), r"^[w.]+", "")
    about = bare(F.get(row, F.lit(8))).isin(F.lower(host), bare(host))
    flagged, code = F.exists(F.slice(row, 3, 5), lambda x: x == "true"), F.get(row, F.lit(1)).try_cast("int")
    known = (F.size(row) >= 9) & (F.get(row, F.lit(0)) == ROW) & about
    return F.when(known & ((code == UNSAFE) | flagged), True).when(known & (code == CLEAN), False)


def resolver_listed(secure: Column, plain: Column) -> Column:
    """Does a filtering resolver hide an address that a plain one gives?  Null where an answer is missing."""

    def hidden(a: Column) -> Column:
        return a.isin(*BLOCKED_ADDRESSES)

    return F.when(secure.isNotNull() & ~F.exists(secure, hidden), False).when(secure.isNotNull() & plain.isNotNull(), F.exists(plain, lambda a: ~hidden(a)))


def threat_listed(status: Column, body: Column) -> Column:
    """Does a threat list name the URL?  Null unless the source answered 200 with JSON."""
    kinds = F.from_json(body, "threat struct<threatTypes: array<string>>")["threat"]["threatTypes"]
    return F.when((status == 200) & F.get_json_object(body, "$").isNotNull(), F.coalesce(F.size(kinds) > 0, F.lit(False)))


def verdicts(answers: DataFrame) -> DataFrame:
    """answers: run, source, host, status, body, secure, plain -> listed by the source's own rule."""
    s = F.col("source")
    listed = F.when(s == "safe_browsing", F.when(F.col("status") == 200, browsing_listed(F.col("body"), F.col("host")))).when(s == "resolver", resolver_listed(F.col("secure"), F.col("plain"))).when(s == "web_risk", threat_listed(F.col("status"), F.col("body")))
    return answers.select("run", "source", "host", listed.alias("listed"))


def believed(judged: DataFrame) -> DataFrame:
    """The verdicts without the test hosts; listed is null where the run's own question about the source's
    test host was not answered by a listing."""
    tests = F.create_map(*[F.lit(x) for pair in CONTROLS for x in pair])
    test = F.try_element_at(tests, F.col("source"))
    asked = judged.withColumns({"test": test, "is_test": F.coalesce(F.col("host") == test, F.lit(False))})
    proven = asked.filter("is_test").groupBy("run", "source").agg(F.bool_and(F.coalesce("listed", F.lit(False))).alias("proven")).filter("proven")
    out = asked.filter("not is_test").join(proven, ["run", "source"], "left")
    return out.select("run", "source", "host", F.when(F.col("test").isNull() | F.coalesce("proven", F.lit(False)), F.col("listed")).alias("listed"))


def browser_clean(held: DataFrame) -> DataFrame:
    """run, web_risk_clean: would no browser warn?  Null where no list that browsers read has answered."""
    read = F.when(F.col("source").isin(*BROWSER_SOURCES), F.col("listed"))
    return held.groupBy("run").agg((~F.bool_or(read)).alias("web_risk_clean"))


def report_ages(answers: DataFrame, now: Column) -> DataFrame:
    """answers: site, host, status, body -> age_days of the youngest report of the site's hosts at `now` (a
    timestamp), stale beyond the limit; null without a dated report."""
    date = F.when(F.col("status") == 200, F.get_json_object("body", "$.data.attributes.last_analysis_date").try_cast("double"))
    age = F.floor(F.greatest(F.lit(0.0), F.unix_timestamp(now) - date) / 86400)
    out = answers.groupBy("site").agg(F.min(F.when(date.isNotNull(), age)).alias("age_days"))
    return out.withColumn("stale", F.coalesce(F.col("age_days") > STALE_DAYS, F.lit(False)))


def vendor_tiers(spark: SparkSession) -> DataFrame:
    """vendor, tier, review_url of the vendors known by name."""
    tiers = {v: t for t, names in VENDORS.items() for v in names.split(", ")}
    return small(spark, [(v, tiers.get(v), REVIEW.get(v)) for v in {**tiers, **REVIEW}], "vendor string, tier string, review_url string")


def consequences(listings: DataFrame, vendors: DataFrame) -> DataFrame:
    """Listings with tier (unknown for vendors not named) and review_url, whatever the spelling's case and
    punctuation."""
    known = vendors.select(vendor_key(F.col("vendor")).alias("_key"), F.coalesce("tier", F.lit("unknown")).alias("_tier"), "review_url")
    out = listings.drop("tier", "review_url").withColumn("_key", vendor_key(F.col("vendor"))).join(known, "_key", "left")
    return out.withColumn("tier", F.coalesce("_tier", F.lit("unknown"))).drop("_key", "_tier")
