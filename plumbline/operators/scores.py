"""Scores of any number of sites: metrics in long form, rolled up to groups, categories and overall.

A metric is (site, metric, score), score null where it could not be measured; weights of unmeasured
metrics and groups renormalise over what was.  Rounding is half-even.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scoring as S
from plumbline.functions import urls
from plumbline.operators import media
from plumbline.operators.rules import DESC_MAX, DESC_MIN, THIN_WORDS, TITLE_MAX, TITLE_MIN
from plumbline.session import small

# Fixed values: (worst tier, vendors at least, score).
REPUTATION_BANDS = (("browser", 1, 0), ("gateway", 2, 35), ("gateway", 1, 60), ("mail", 2, 35), ("mail", 1, 60), ("endpoint", 2, 70), ("endpoint", 1, 85), ("feed", 1, 92), ("unknown", 1, 92))
GATES = {"https": 60, "noindex": 25, "robots": 30, "browser": 20, "home": 45}
FEED_ORPHAN_WEIGHT = 0.35
POSTURE_WEIGHTS = {
    "spam": {"spf_present": 22, "spf_single": 8, "spf_lookups": 10, "dkim_present": 20, "dkim_strength": 5, "dmarc_present": 15, "mx_present": 5, "not_blocklisted": 15},
    "phishing": {"dmarc_enforced": 35, "dmarc_reporting": 10, "spf_strict": 20, "dkim_key": 15, "not_phish_listed": 20},
}


def _set(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) != ""


def _share(predicate: Column, within: Column | None = None) -> Column:
    value = F.coalesce(predicate, F.lit(False)).cast("double")
    return F.avg(F.when(within, value) if within is not None else value)


def unpivot(df: DataFrame, metrics: list[str]) -> DataFrame:
    return df.unpivot("site", metrics, "metric", "value")


#: The findings that carry what a metric counts.
CITED = {
    "noindex_expected": "IDX-01", "indexable": "IDX-01", "sitemap": "IDX-02 IDX-06", "sitemap_coverage": "ORP-05", "robots": "IDX-02", "canonical": "IDX-04", "canonical_self": "IDX-05", "soft_404": "IDX-03",
    "title_present": "MET-01", "title_unique": "MET-04", "title_length": "MET-02 MET-03", "desc_present": "MET-05", "desc_unique": "MET-08", "desc_length": "MET-06 MET-07", "h1": "MET-09 MET-10 MET-11 MET-12", "social": "SOC-01 SOC-02",
    "no_placeholder": "CNT-01", "encoding": "CNT-04", "word_depth": "CNT-09", "spelling": "CNT-02", "img_alt": "MED-01", "hygiene": "CNT-03 CNT-05 CNT-06", "linked": "ORP-01 ORP-06", "links_in_html": "ORP-07", "reachable": "ORP-02", "click_depth": "ORP-04",
    "inbound_depth": "ORP-03", "http_200": "ERR-01 ERR-03", "links_resolve": "ERR-02", "links_direct": "ERR-12 ERR-10", "js_errors": "ERR-04", "no_overflow": "ERR-08", "images_load": "MED-04", "mixed_content": "SEC-04", "schema_coverage": "SOC-03", "schema_valid": "SDV-01 SDV-02 SDV-03 SDV-04", "schema_complete": "SDV-04 SDV-05 SDV-06", "exposed": "SEC-01", "enumeration": "SEC-02",
}


def page_metrics(records: DataFrame) -> DataFrame:
    """Ratios that pages alone tell: site, metric, value (0 to 1, null if not measured)."""
    pages = records.filter("is_page")

    def unique_share(column: str, name: str) -> DataFrame:
        """Share of values that one page alone has; counted by value first."""
        values = pages.select("site", F.trim(column).alias("v")).filter("v <> ''").groupBy("site", "v").agg(F.count(F.lit(1)).alias("n"))
        return values.groupBy("site").agg((F.count_if(F.col("n") == 1) / F.sum("n")).alias(name))

    canonical = F.regexp_replace("canonical", "/+$", "") == F.regexp_replace("url", "/+$", "")
    ratios = pages.groupBy("site").agg(
        _share(~F.col("noindex")).alias("indexable"),
        _share(F.col("noindex")).alias("noindex_expected"),
        _share(_set("canonical")).alias("canonical"),
        _share(canonical, _set("canonical")).alias("canonical_self"),
        _share(_set("title")).alias("title_present"),
        _share(F.col("title_len").between(TITLE_MIN, TITLE_MAX), _set("title")).alias("title_length"),
        _share(_set("meta_description")).alias("desc_present"),
        _share(F.col("desc_len").between(DESC_MIN, DESC_MAX), _set("meta_description")).alias("desc_length"),
        _share(F.col("h1_count") == 1).alias("h1"),
        _share(_set("og_title") & _set("og_description") & _set("og_image")).alias("social"),
        _share(_set("lang") & _set("viewport")).alias("html_basics"),
        _share(F.col("word_count") >= THIN_WORDS).alias("word_depth"),
        _share(F.size("mixed_content") == 0).alias("mixed_content"),
        F.when(F.count("discovered_via") > 0, _share(F.coalesce("discovered_via", F.lit("")) != "link")).alias("sitemap_coverage"),
        _share(F.col("url").startswith("https://")).alias("https"),
    )
    served = records.groupBy("site").agg(_share(F.col("status") == 200, F.col("status").isNotNull() & ~F.coalesce("refused", F.lit(False))).alias("http_200"))
    out = ratios.join(unique_share("title", "title_unique"), "site", "left").join(unique_share("meta_description", "desc_unique"), "site", "left").join(served, "site", "left")
    return unpivot(out, [c for c in out.columns if c != "site"])


def signal_metrics(records: DataFrame, signals: DataFrame) -> DataFrame:
    """Shares of pages without faults of a kind.  Pages with a signal are found among all records, and
    the number of pages counts pages only, so a value may fall below 0 before its window."""
    n = records.filter("is_page").groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    kinds = {"no_placeholder": ("placeholder",), "encoding": ("mojibake",), "spelling": ("misspelling",), "hygiene": ("punctuation", "doubled-word", "style")}
    found = signals.groupBy("site").agg(*[F.count_distinct(F.when(F.col("kind").isin(*k), F.col("url"))).alias(m) for m, k in kinds.items()])
    joined = n.join(found, "site", "left").na.fill(0)
    return unpivot(joined.select("site", *[((F.col("n") - F.col(m)) / F.col("n")).alias(m) for m in kinds]), list(kinds))


def graph_metrics(graph: DataFrame) -> DataFrame:
    """Only for complete crawls: a truncated one leaves the group out."""
    c, reach = F.col("link_class"), F.col("reach")
    lost = F.when(c == "true_orphan", 1.0).when(c == "feed_orphan", FEED_ORPHAN_WEIGHT).otherwise(0.0)
    out = graph.groupBy("site").agg(
        (1 - F.avg(lost)).alias("linked"), _share(~F.col("rendered_only")).alias("links_in_html"), _share(reach != "unreachable").alias("reachable"), _share(reach != "deep").alias("click_depth"),
        _share(~c.isin("single_inbound", "true_orphan", "feed_orphan")).alias("inbound_depth"),
    )
    return unpivot(out, ["linked", "links_in_html", "reachable", "click_depth", "inbound_depth"])


def link_metrics(status: DataFrame) -> DataFrame:
    v = F.col("verdict")
    verified = v.isin("ok", "dead", "error")
    out = status.filter("internal").groupBy("site").agg(_share(v == "ok", verified).alias("links_resolve"), _share(F.col("hops") == 0, verified).alias("links_direct"))
    return unpivot(out, ["links_resolve", "links_direct"])


def runtime_metrics(runtime: DataFrame) -> DataFrame:
    served = runtime.filter("coalesce(status, 200) < 400")
    out = served.groupBy("site").agg(_share(F.size("page_errors") == 0).alias("js_errors"), _share(F.coalesce("h_overflow", F.lit(0)) <= 2).alias("no_overflow"), _share(F.size("broken_images") == 0).alias("images_load"))
    return unpivot(out, ["js_errors", "no_overflow", "images_load"])


def image_metrics(records: DataFrame) -> DataFrame:
    """Share of distinct images whose worst state on any page is a text."""
    worst = media.alt_inventory(records)
    return unpivot(worst.groupBy("site").agg(F.avg((F.col("rank") == 0).cast("double")).alias("img_alt")), ["img_alt"])


def schema_metrics(pages: DataFrame) -> DataFrame:
    """pages: site, items, error_paths, warning_paths (arrays of paths, layer schema / completeness)."""
    items = F.nullif(F.sum("items"), F.lit(0))
    out = pages.groupBy("site").agg(
        F.avg((F.col("items") > 0).cast("double")).alias("schema_coverage"),
        ((F.sum("items") - F.sum(F.size(F.array_distinct("error_paths")))) / items).alias("schema_valid"),
        ((F.sum("items") - F.sum(F.size(F.array_except("warning_paths", "error_paths")))) / items).alias("schema_complete"),
    )
    return unpivot(out, ["schema_coverage", "schema_valid", "schema_complete"])


def file_metrics(sitemaps: DataFrame, robots: DataFrame, staging: bool = False) -> DataFrame:
    """What robots.txt and sitemaps tell, 0 to 1.  sitemaps: site, urls, host_urls; robots: site, status,
    directives, has_sitemap.  A sitemap that lists another host alone is none of the site's."""
    listed = sitemaps.groupBy("site").agg(F.sum("host_urls").alias("own"), F.sum(F.col("urls") - F.col("host_urls")).alias("foreign"))
    out = listed.join(robots.select("site", "status", "directives", "has_sitemap"), "site", "full_outer")
    named = F.when(F.col("has_sitemap"), 0.5).otherwise(0.0)
    sitemap = F.when(F.col("own") > 0, 1.0).when(F.col("foreign") > 0, 0.0).otherwise(named)
    served = F.col("status") == 200
    lost = F.when(~served | F.col("status").isNull(), 0.4).when(F.size("directives") == 0, 0.3).otherwise(0.0) + F.when(served & ~F.col("has_sitemap") & F.lit(not staging), 0.3).otherwise(0.0)
    return unpivot(out.select("site", sitemap.alias("sitemap"), F.when(F.col("has_sitemap").isNotNull(), F.greatest(1 - lost, F.lit(0.0))).alias("robots")), ["sitemap", "robots"])


def probe_metrics(answers: DataFrame) -> DataFrame:
    """answers: probes of suppressed_probes().  1 where no missing path is served, no file lies open, and no
    account is named."""
    bucket, status = F.col("bucket"), F.col("status")
    named = ((bucket == "users") & (F.size("users") > 0)) | ((bucket == "author") & (F.col("verdict") == "confirmed"))
    out = answers.groupBy("site").agg(
        F.bool_and(F.when(bucket == "nonexistent", status != 200)).cast("double").alias("soft_404"),
        (~F.bool_or(F.coalesce((bucket == "exposed") & (status == 200) & ~F.col("suppressed"), F.lit(False)))).cast("double").alias("exposed"),
        (~F.bool_or(F.coalesce(named, F.lit(False)))).cast("double").alias("enumeration"),
    )
    return unpivot(out, ["soft_404", "exposed", "enumeration"])


def points(metrics: DataFrame) -> DataFrame:
    """What each metric gives and loses of its group's declared weight, most lost first: a site's worst
    metrics."""
    declared = F.create_map(*[F.lit(x) for p in S.DECLARED_WEIGHTS.items() for x in p])[F.col("group")]
    share = 100 * F.col("weight") / declared
    return metrics.filter("score is not null").withColumns({"points": F.col("score") * share, "lost": (1 - F.col("score")) * share}).orderBy("site", F.desc("lost"), "metric")


def scored(values: DataFrame) -> DataFrame:
    """Values through their windows: site, metric, group, weight, value, score."""
    known = values.filter(F.col("metric").isin(*S.METRICS))

    def lookup(pick) -> Column:
        return F.create_map(*[F.lit(x) for m in S.METRICS for x in (m, pick(m))])[F.col("metric")]

    floor, target = (lookup(lambda m, i=i: float(S.WINDOWS.get(m, (0.0, 1.0))[i])) for i in (0, 1))
    return known.select("site", "metric", lookup(lambda m: S.METRICS[m][0]).alias("group"), lookup(lambda m: S.METRICS[m][1]).alias("weight"), "value", S.ramp(F.col("value"), floor, target).alias("score"))


def group_scores(metrics: DataFrame) -> DataFrame:
    """site, group, score (0 to 100, null if nothing was measured), coverage of the declared weight."""
    declared = F.create_map(*[F.lit(x) for p in S.DECLARED_WEIGHTS.items() for x in p])[F.col("group")]
    return metrics.groupBy("site", "group").agg((100 * S.weighted_mean(F.col("score"), F.col("weight"))).alias("score"), F.sum(F.when(F.col("score").isNotNull(), F.col("weight"))).alias("measured")).select(
        "site", "group", "score", F.least(F.coalesce("measured", F.lit(0.0)) / declared, F.lit(1.0)).alias("coverage")
    )


def seo_category(groups: DataFrame) -> DataFrame:
    """site, score, total, coverage: groups by weight, over those that were scored."""
    weight = F.create_map(*[F.lit(x) for p in S.GROUP_WEIGHTS.items() for x in p])[F.col("group")]
    own = groups.withColumn("w", weight).filter("w is not null")
    out = own.groupBy("site").agg(S.weighted_mean(F.col("score"), F.col("w")).alias("score"), (F.sum(F.col("w") * F.when(F.col("score").isNotNull(), F.col("coverage")).otherwise(0.0)) / F.lit(sum(S.GROUP_WEIGHTS.values()))).alias("coverage"))
    return out.withColumn("total", F.bround("score", 0))


def effective_weights(groups: DataFrame) -> DataFrame:
    """groups with weight and effective: each group's share of its category, in hundredths, over the groups that
    were scored; 0 for one that was not, so a run without a browser is graded out of a hundred all the same."""
    weight = F.create_map(*[F.lit(x) for p in S.GROUP_WEIGHTS.items() for x in p])[F.col("group")]
    own = groups.withColumn("weight", weight).filter("weight is not null")
    live = own.groupBy("site").agg(F.sum(F.when(F.col("score").isNotNull(), F.col("weight"))).alias("live"))
    return own.join(live, "site").withColumn("effective", F.when(F.col("score").isNotNull(), 100 * F.col("weight") / F.col("live")).otherwise(0.0)).drop("live")


def performance_category(vitals: DataFrame) -> DataFrame:
    """site, score, total, coverage from site_vitals(): the median page, not the mean of the metrics' medians, and
    the share of the declared weight that was measured.  A site none of whose pages was rendered has no row."""
    return vitals.filter("score is not null").select("site", (100 * F.col("score")).alias("score"), F.bround(100 * F.col("score"), 0).alias("total"), "coverage")


def explained(metrics: DataFrame, fired: DataFrame) -> DataFrame:
    """metrics (site, metric, ...) with findings: which of the findings that a metric cites fired on its site.  A
    rule that did not fire has nothing to show and is not cited.  fired: site, finding."""
    cited = small(metrics.sparkSession, [(m, f) for m, fs in CITED.items() for f in fs.split()], "metric string, finding string")
    hit = metrics.select("site", "metric").distinct().join(cited, "metric").join(fired.select("site", "finding").distinct(), ["site", "finding"], "left_semi")
    found = hit.groupBy("site", "metric").agg(F.array_sort(F.collect_set("finding")).alias("findings"))  # at most those that are cited
    return metrics.join(found, ["site", "metric"], "left").withColumn("findings", F.coalesce("findings", F.array().cast("array<string>")))


def gates(records: DataFrame, robots: DataFrame | None = None, reputation: DataFrame | None = None, staging: bool = False) -> DataFrame:
    """site, gate, cap: faults that no mean expresses."""
    pages = records.filter("is_page").groupBy("site").agg(F.bool_and(F.col("url").startswith("https://")).alias("https"), F.count_if("noindex").alias("noindex"), F.count(F.lit(1)).alias("n"))
    parts = [pages.filter(~F.col("https")).select("site", F.lit("https").alias("gate"))]
    if not staging:
        parts.append(pages.filter(F.col("noindex") >= F.col("n") * 0.5).select("site", F.lit("noindex").alias("gate")))
        if robots is not None:
            parts.append(robots.filter("status = 200 and disallow_all").select("site", F.lit("robots").alias("gate")))
    if reputation is not None:
        parts.append(reputation.filter("worst_tier = 'browser'").select("site", F.lit("browser").alias("gate")))
    home = records.filter((urls.path(F.col("url")).isin("", "/")) & F.col("status").isNotNull() & (F.col("status") != 200) & ~F.coalesce("refused", F.lit(False)))
    parts.append(home.select("site", F.lit("home").alias("gate")).distinct())
    cap = F.create_map(*[F.lit(x) for p in GATES.items() for x in p])[F.col("gate")]
    return reduce(DataFrame.unionByName, parts).withColumn("cap", cap)


def overall(seo: DataFrame, performance: DataFrame | None, gated: DataFrame) -> DataFrame:
    """site, raw, overall, band, coverage: unrounded categories by weight, then the lowest gate's cap.  A category
    without a score does not count in the mean, but all its weight is missing from the coverage."""
    parts = seo.select("site", F.lit("seo").alias("category"), "score", "coverage")
    if performance is not None:
        parts = parts.unionByName(performance.select("site", F.lit("performance").alias("category"), "score", "coverage"))
    weight = F.create_map(*[F.lit(x) for p in S.CATEGORY_WEIGHTS.items() for x in p])[F.col("category")]
    total = parts.withColumn("w", weight).groupBy("site").agg(S.weighted_mean(F.col("score"), F.col("w")).alias("raw"), (F.sum(F.col("w") * F.when(F.col("score").isNotNull(), F.col("coverage")).otherwise(0.0)) / F.lit(sum(S.CATEGORY_WEIGHTS.values()))).alias("coverage"))
    capped = total.join(gated.groupBy("site").agg(F.min("cap").alias("cap")), "site", "left")
    final = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("raw"), F.coalesce(F.col("cap").cast("double"), F.lit(100.0)))), 0)
    return capped.select("site", "raw", F.when(F.col("raw").isNotNull(), final).alias("overall"), "cap", "coverage").withColumn("band", S.band(F.col("overall"))["word"])


def confidence(coverage: Column, crawled: Column) -> Column:
    return F.when((coverage >= 0.9) & (crawled >= 0.95), "high").when((coverage >= 0.7) & (crawled >= 0.6), "medium").otherwise("low")


def reputation_score(graded: DataFrame) -> DataFrame:
    """graded: site, worst_tier, agree, sources -> score: null without sources, 100 if clean."""
    chain = F.when(F.col("sources") == 0, F.lit(None).cast("int")).when(F.col("worst_tier").isNull(), 100)
    for tier, least, score in REPUTATION_BANDS:
        chain = chain.when((F.col("worst_tier") == tier) & (F.col("agree") >= least), score)
    return graded.withColumn("score", chain.otherwise(92))


def posture_scores(mail: DataFrame) -> DataFrame:
    """Spam and phishing posture per domain from its mail records (and mail_listed, phish_listed where a
    source answered); unmeasured parts drop out."""

    def listed(column: str) -> Column:
        return 1 - F.col(column).cast("double") if column in mail.columns else F.lit(None).cast("double")

    live = F.when(F.col("dkim_live") > 0, 1.0)
    strict = F.create_map(*[F.lit(x) for p in (("-", 1.0), ("~", 0.5), ("?", 0.1), ("+", 0.0)) for x in p])
    policy = F.create_map(*[F.lit(x) for p in (("reject", 1.0), ("quarantine", 0.6), ("none", 0.0)) for x in p])
    percent = F.least(F.greatest(F.col("dmarc_pct").cast("double"), F.lit(0.0)), F.lit(100.0)) / 100
    present = F.col("spf_present").cast("double")
    measures = {
        "spf_present": present,
        "spf_single": F.when(F.col("spf_present"), (F.col("spf_count") == 1).cast("double")),
        "spf_lookups": F.when(F.col("spf_present"), (F.col("spf_cost") <= 10).cast("double")),
        "dkim_present": live,
        "dkim_strength": F.when(F.col("dkim_live") > 0, (F.col("dkim_weak") == 0).cast("double")),
        "dmarc_present": F.col("dmarc_present").cast("double"),
        "mx_present": F.when(F.col("mx_null"), 0.5).otherwise(F.col("mx_present").cast("double")),
        "not_blocklisted": listed("mail_listed"),
        "dmarc_enforced": F.when(F.col("dmarc_present"), F.coalesce(policy[F.col("dmarc_policy")], F.lit(0.0)) * percent).when(~F.col("dmarc_present"), 0.0),
        "dmarc_reporting": F.when(F.col("dmarc_present").isNotNull(), (F.coalesce("dmarc_rua", F.lit("")) != "").cast("double")),
        "spf_strict": F.when(F.col("spf_count") == 1, F.coalesce(strict[F.col("spf_all")], F.lit(0.0))).when(F.col("spf_present").isNotNull(), 0.0),
        "dkim_key": live,
        "not_phish_listed": listed("phish_listed"),
    }
    out = mail.select("site", "domain", *[m.alias(f"_{name}") for name, m in measures.items()])

    def mean(weights: dict[str, int]) -> Column:
        total = sum((F.when(F.col(f"_{m}").isNotNull(), F.lit(float(w))).otherwise(0.0) for m, w in weights.items()), F.lit(0.0))
        return F.bround(100 * sum((F.coalesce(F.col(f"_{m}"), F.lit(0.0)) * float(w) for m, w in weights.items()), F.lit(0.0)) / F.nullif(total, F.lit(0.0)), 0)

    return out.select("site", "domain", *[mean(w).alias(name) for name, w in POSTURE_WEIGHTS.items()])
