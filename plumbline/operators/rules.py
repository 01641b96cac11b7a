"""The rule catalogue: each rule is a query over the audit frames that yields hits.

A rule registers itself with its id, severity and category; run() unions the hits of all rules whose
frames are there.  A frame that was not measured is absent (None), and its rules stay silent: absent is
never the same as clean.  Hits: site, finding, severity, category, url, detail.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import urls
from plumbline.functions.copy import mojibake
from plumbline.operators import blocks, media
from plumbline.operators import links as L
from plumbline.session import cut, small, unnest

# Fixed values.
TITLE_MIN, TITLE_MAX, DESC_MIN, DESC_MAX, THIN_WORDS, SLOW_MS, IMAGE_MAX_KB, OVERSIZED = 15, 60, 70, 160, 300, 1500, 180, 2.0
HEAVY_PAGE_BYTES, NAV_DEPTH = 2_500_000, 3
SEVERITIES = ("critical", "high", "medium", "low")
VITAL_LIMITS = {"lcp": 2500.0, "cls": 0.1, "tbt": 200.0}
SCHEMA_CODES = {
    "SDV-01": ("json-parse", "no-context", "no-type", "not-an-object", "empty-block"),
    "SDV-02": ("unknown-type", "unknown-property"),
    "SDV-03": ("invalid-number", "invalid-date", "invalid-time", "invalid-duration", "invalid-boolean", "invalid-enum", "value-type"),
    "SDV-04": ("missing-required",),
    "SDV-05": ("property-not-on-type", "superseded-property", "retired-type", "untyped-object", "list-item-position"),
    "SDV-06": ("empty-value", "relative-url", "unresolved-id", "bad-context", "http-context", "money-format", "list-count"),
    "SDV-07": ("missing-recommended",),
}


@dataclass
class Frames:
    """What an audit has measured; frames left None were not."""

    records: DataFrame
    signals: DataFrame | None = None
    links: DataFrame | None = None
    graph: DataFrame | None = None
    link_status: DataFrame | None = None
    runtime: DataFrame | None = None
    vitals: DataFrame | None = None
    images: DataFrame | None = None
    probes: DataFrame | None = None
    mail: DataFrame | None = None
    reputation: DataFrame | None = None
    schema_issues: DataFrame | None = None
    sitemaps: DataFrame | None = None
    robots: DataFrame | None = None
    complete: bool = True
    expect_noindex: bool = False
    extra: dict[str, DataFrame] = field(default_factory=dict)

    def staged(self) -> Frames:
        """The same frames, written once and read by all rules."""
        own = {f.name: getattr(self, f.name) for f in fields(self)}
        return Frames(**{k: cut(v.drop("html"), k) if isinstance(v, DataFrame) else v for k, v in own.items()})

    @property
    def pages(self) -> DataFrame:
        return self.records.filter("is_page")


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    category: str
    needs: tuple[str, ...]
    find: Callable[[Frames], DataFrame]


RULES: dict[str, Rule] = {}


def rule(id: str, severity: str, category: str, *needs: str):
    """Register fn(frames) -> DataFrame(site, url, detail[, severity])."""

    def register(fn: Callable[[Frames], DataFrame]) -> Callable[[Frames], DataFrame]:
        RULES[id] = Rule(id, severity, category, needs, fn)
        return fn

    return register


def _hits(df: DataFrame, detail: Column | str = "", severity: Column | None = None) -> DataFrame:
    own = [F.col("site"), F.col("url"), (F.lit(detail) if isinstance(detail, str) else detail).cast("string").alias("detail")]
    return df.select(*own, *([severity.alias("severity")] if severity is not None else []))


def _blank(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


#: Rules that look at one page at a time: what they ask, and what they say.
PAGE_RULES: dict[str, tuple[Callable[[], Column], Callable[[], Column] | str]] = {}


def page_rule(id: str, severity: str, category: str, predicate: Callable[[], Column], detail: Callable[[], Column] | str = "") -> None:
    """A rule that looks at one page at a time."""
    PAGE_RULES[id] = predicate, detail
    rule(id, severity, category)(lambda f: _hits(f.pages.filter(predicate()), detail if isinstance(detail, str) else detail()))


def page_hits(frames: Frames, ids: list[str]) -> DataFrame:
    """Hits of page rules, all of them in one pass over the pages."""

    def judged(id: str) -> Column:
        predicate, detail = PAGE_RULES[id]
        text = F.lit(detail) if isinstance(detail, str) else detail()
        own = RULES[id]
        return F.when(predicate(), F.struct(F.lit(id).alias("finding"), F.lit(own.severity).alias("severity"), F.lit(own.category).alias("category"), F.substring(text.cast("string"), 1, 300).alias("detail")))

    found = F.filter(F.array(*map(judged, ids)), lambda h: h.isNotNull())
    return frames.pages.select("site", "url", F.explode(found).alias("h")).select("site", "h.finding", "h.severity", "h.category", "url", "h.detail")


page_rule("MET-01", "high", "metadata", lambda: _blank("title"), "no title")
page_rule("MET-02", "medium", "metadata", lambda: F.col("title_len") > TITLE_MAX, lambda: F.col("title_len"))
page_rule("MET-03", "low", "metadata", lambda: F.col("title_len").between(1, TITLE_MIN - 1), lambda: F.col("title"))
page_rule("MET-05", "medium", "metadata", lambda: _blank("meta_description"), "no description")
page_rule("MET-06", "low", "metadata", lambda: F.col("desc_len") > DESC_MAX, lambda: F.col("desc_len"))
page_rule("MET-08", "medium", "metadata", lambda: F.col("h1_count") == 0, "no h1")
page_rule("MET-09", "low", "metadata", lambda: F.col("h1_count") > 1, lambda: F.col("h1_count"))
page_rule("MET-11", "medium", "metadata", lambda: _blank("lang"), "no lang")
page_rule("MET-12", "high", "metadata", lambda: _blank("viewport"), "no viewport")
page_rule("SOC-01", "medium", "social", lambda: _blank("og_image"), lambda: F.concat(F.lit("no og:image"), F.when(F.col("twitter_card") == "summary_large_image", ", large card asked for").otherwise("")))
page_rule("SOC-02", "low", "social", lambda: _blank("og_description"), "no og:description")
page_rule("IDX-04", "medium", "indexing", lambda: _blank("canonical"), "no canonical")
page_rule("IDX-05", "medium", "indexing", lambda: ~_blank("canonical") & (F.rtrim(F.regexp_replace("canonical", "/+$", "")) != F.regexp_replace(F.coalesce("final_url", "url"), "/+$", "")), lambda: F.col("canonical"))
page_rule("CNT-08", "low", "content", lambda: F.size("tel_malformed") > 0, lambda: F.array_join("tel_malformed", ", "))
page_rule("CNT-09", "medium", "content", lambda: F.col("word_count") < THIN_WORDS, lambda: F.col("word_count"))
page_rule("MED-02", "low", "media", lambda: F.col("img_no_dims") > 0, lambda: F.col("img_no_dims"))
page_rule("MED-03", "low", "media", lambda: F.col("links_no_anchor_text") > 0, lambda: F.col("links_no_anchor_text"))
page_rule("MED-04", "medium", "media", lambda: F.col("elapsed_ms") > SLOW_MS, lambda: F.col("elapsed_ms"))


def duplicate_rule(id: str, severity: str, value: Callable[[], Column]) -> None:
    """Pages that share a value.  Values are counted before they are joined back, so one that a third of
    all pages share costs no more than others."""

    def find(f: Frames) -> DataFrame:
        own = f.pages.select("site", "url", F.trim(value()).alias("value")).filter("value <> ''")
        shared = own.groupBy("site", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        return _hits(own.join(shared, ["site", "value"]), F.concat_ws(" x ", F.col("n").cast("string"), "value"))

    rule(id, severity, "metadata")(find)


duplicate_rule("MET-04", "medium", lambda: F.col("title"))
duplicate_rule("MET-07", "low", lambda: F.col("meta_description"))
duplicate_rule("MET-10", "low", lambda: F.try_element_at("h1", F.lit(1)))


def signal_rule(id: str, severity: str, category: str, kind: str) -> None:
    rule(id, severity, category, "signals")(lambda f: _hits(f.signals.filter(F.col("kind") == kind), F.col("detail")))


for _id, _severity, _kind in (("CNT-01", "critical", "placeholder"), ("CNT-02", "medium", "misspelling"), ("CNT-03", "low", "doubled-word"), ("CNT-04", "high", "mojibake"), ("CNT-05", "low", "punctuation"), ("CNT-06", "low", "style"), ("CNT-10", "medium", "entity")):
    signal_rule(_id, _severity, "content", _kind)
signal_rule("SEC-04", "medium", "security", "mixed-content")


@rule("CNT-07", "medium", "content")
def phone_outliers(f: Frames) -> DataFrame:
    """Numbers on fewer than half of a site's pages, where another is on at least half."""
    pages = f.pages.select("site", "url", "phones")
    size = pages.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    each = pages.select("site", "url", F.explode("phones").alias("phone"))
    counted = each.groupBy("site", "phone").agg(F.count(F.lit(1)).alias("k")).join(size, "site").withColumn("common", F.col("k") >= F.col("n") * 0.5)
    usual = counted.filter("common").select("site").distinct()
    return _hits(each.join(counted.filter("not common").join(usual, "site", "left_semi"), ["site", "phone"]), F.col("phone"))


@rule("CNT-11", "low", "content", "signals")
def dictionary_typos(f: Frames) -> DataFrame:
    """Spelling signals whose word no URL path of the site holds."""
    known = f.records.select("site", F.explode(F.regexp_extract_all(F.lower(urls.path(F.col("url"))), F.lit("[a-z]{3,}"), F.lit(0))).alias("word")).distinct()
    own = f.signals.filter("kind = 'spelling'").withColumn("word", F.lower("detail"))
    return _hits(own.join(known, ["site", "word"], "left_anti"), F.col("detail"))


@rule("IDX-01", "critical", "indexing")
def indexability(f: Frames) -> DataFrame:
    """Production: pages that forbid indexing.  Staging: pages that allow it."""
    return _hits(f.pages.filter(~F.col("noindex") if f.expect_noindex else F.col("noindex")), "indexable" if f.expect_noindex else "noindex")


@rule("IDX-02", "medium", "indexing", "robots")
def robots_problems(f: Frames) -> DataFrame:
    problems = F.array(F.when(F.col("status") != 200, "robots.txt was not served"), F.when(F.size("directives") == 0, "no directives"), F.when(~F.col("has_sitemap") & F.lit(not f.expect_noindex), "no Sitemap line"))
    found = f.robots.withColumn("problems", F.filter(problems, lambda p: p.isNotNull())).filter(F.size("problems") > 0)
    return _hits(found, F.array_join("problems", "; "))


@rule("IDX-03", "medium", "indexing", "probes")
def soft_404(f: Frames) -> DataFrame:
    return _hits(f.probes.filter("bucket = 'nonexistent' and status = 200"), "served for a path that does not exist")


@rule("IDX-06", "medium", "indexing", "sitemaps")
def foreign_sitemap(f: Frames) -> DataFrame:
    totals = f.sitemaps.groupBy("site").agg(F.min("sitemap").alias("url"), F.sum("urls").alias("urls"), F.sum("host_urls").alias("own"))
    return _hits(totals.filter("urls > own and own = 0"), F.col("urls"))


@rule("SOC-03", "medium", "social", "schema_issues")
def no_structured_data(f: Frames) -> DataFrame:
    """Pages without structured data, where they are at least half of the site's."""
    none = F.size("jsonld") == 0
    share = f.pages.groupBy("site").agg(F.avg(none.cast("double")).alias("share")).filter("share >= 0.5")
    return _hits(f.pages.filter(none).join(share, "site"), "no structured data")


def graph_rule(id: str, severity: str, predicate: str, detail: str = "inbound") -> None:
    """Rules on the link graph need a complete crawl: a truncated one cannot tell an orphan."""

    def find(f: Frames) -> DataFrame:
        return _hits(f.graph.filter(predicate if f.complete else "false"), F.col(detail))

    rule(id, severity, "links", "graph")(find)


graph_rule("ORP-01", "high", "link_class = 'true_orphan'")
graph_rule("ORP-06", "low", "link_class = 'feed_orphan'")
graph_rule("ORP-07", "medium", "rendered_only")
graph_rule("ORP-02", "high", "reach = 'unreachable' and link_class not in ('true_orphan', 'feed_orphan')")
graph_rule("ORP-04", "medium", "reach = 'deep'", "depth")


@rule("ORP-03", "medium", "links", "graph")
def single_inbound(f: Frames) -> DataFrame:
    own = f.graph.filter("link_class = 'single_inbound'")
    size = f.graph.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("link_class") == "single_inbound").alias("k"))
    many = size.filter((F.col("k") >= F.greatest(F.lit(5.0), F.col("n") * 0.15)) & F.lit(f.complete))
    return _hits(own.join(many.select("site"), "site", "left_semi"), "one inbound link")


@rule("ORP-05", "medium", "links")
def not_in_sitemap(f: Frames) -> DataFrame:
    """Pages found by links alone; archives and noindex pages are a low note."""
    own = f.pages.filter("discovered_via = 'link'")
    why = F.when(urls.is_archive(F.col("url")), "archive").when(F.col("noindex"), "noindex").otherwise("not in sitemap")
    return _hits(own, why, F.when(why == "not in sitemap", "medium").otherwise("low"))


@rule("ERR-01", "high", "errors")
def http_errors(f: Frames) -> DataFrame:
    return _hits(f.records.filter("status >= 400 and not coalesce(refused, false)"), F.col("status"))


@rule("ERR-14", "medium", "errors")
def host_refused(f: Frames) -> DataFrame:
    size = f.records.groupBy("site").agg(F.bool_and(F.coalesce("refused", F.lit(False))).alias("all"))
    return _hits(f.records.filter("refused").join(size, "site"), F.col("status"), F.when(F.col("all"), "high").otherwise("medium"))


@rule("ERR-03", "medium", "errors")
def redirect_in_sitemap(f: Frames) -> DataFrame:
    return _hits(f.records.filter("redirected and coalesce(discovered_via, '') <> 'link'"), F.col("final_url"))


def link_rule(id: str, severity: str, predicate: str) -> None:
    def find(f: Frames) -> DataFrame:
        spread = L.fan_out(f.link_status.filter(predicate), f.links)
        return spread.select("site", F.col("page").alias("url"), F.concat_ws(" ", "url", F.col("status").cast("string")).alias("detail"))

    rule(id, severity, "errors", "link_status", "links")(find)


link_rule("ERR-02", "high", "verdict = 'dead' and internal")
link_rule("ERR-09", "medium", "verdict = 'dead' and not internal")


def chain_rule(id: str, severity: str, internal: bool, least: int, most: int | None) -> None:
    def find(f: Frames) -> DataFrame:
        own = f.link_status.filter(F.col("internal") if internal else ~F.col("internal"))
        return _hits(L.chains(own, f.links, L.canonical_hosts(f.records), least, most), F.concat_ws(" ", F.col("hops").cast("string"), "cause"))

    rule(id, severity, "errors", "link_status", "links")(find)


chain_rule("ERR-10", "medium", True, 2, None)
chain_rule("ERR-13", "low", False, 2, None)
chain_rule("ERR-12", "low", True, 1, 1)


@rule("ERR-11", "low", "errors", "link_status", "links")
def blocked_links(f: Frames) -> DataFrame:
    """Links that refuse us, on the pages that carry them, where a site has three or more."""
    own = f.link_status.filter("verdict in ('blocked', 'unreachable')")
    many = own.groupBy("site").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    spread = L.fan_out(own.join(many.select("site"), "site", "left_semi"), f.links)
    return spread.select("site", F.col("page").alias("url"), F.concat_ws(" ", "url", "verdict").alias("detail"))


def runtime_rule(id: str, severity: str, category: str, array: str, keep: Callable[[Column], Column] | None = None) -> None:
    def find(f: Frames) -> DataFrame:
        values = F.filter(array, keep) if keep else F.col(array)
        return _hits(f.runtime.filter("coalesce(status, 200) < 400").select("site", "url", F.explode(values).alias("v")), F.to_json(F.struct("v")))

    rule(id, severity, category, "runtime")(find)


runtime_rule("ERR-04", "high", "errors", "page_errors")
runtime_rule("ERR-05", "medium", "errors", "bad_responses", lambda r: r.type != "document")
runtime_rule("ERR-06", "medium", "errors", "broken_images", lambda s: F.coalesce(s, F.lit("")) != "")
runtime_rule("ERR-07", "medium", "errors", "unlabeled_inputs")


@rule("ERR-08", "low", "errors", "runtime")
def horizontal_overflow(f: Frames) -> DataFrame:
    return _hits(f.runtime.filter("coalesce(status, 200) < 400 and h_overflow > 4"), F.col("h_overflow"))


@rule("MED-05", "medium", "media", "runtime")
def heavy_pages(f: Frames) -> DataFrame:
    return _hits(f.runtime.filter(f"coalesce(status, 200) < 400 and resource_bytes > {HEAVY_PAGE_BYTES}"), F.col("resource_bytes"))


@rule("ERR-15", "low", "errors")
def entry_point_chain(f: Frames) -> DataFrame:
    entry = f.extra.get("entry_point")
    return _hits(entry.filter("hops >= 1"), F.col("hops")) if entry is not None else _hits(f.records.limit(0))


@rule("SEC-01", "critical", "security", "probes")
def exposed_files(f: Frames) -> DataFrame:
    return _hits(f.probes.filter("bucket = 'exposed' and status = 200 and not suppressed"), F.col("path"))


@rule("SEC-02", "high", "security", "probes")
def user_enumeration(f: Frames) -> DataFrame:
    return _hits(f.probes.filter("bucket = 'users' and size(users) > 0 or bucket = 'author' and verdict = 'confirmed'"), F.array_join("users", ", "))


@rule("SEC-03", "low", "security", "probes")
def cms_surface(f: Frames) -> DataFrame:
    return _hits(f.probes.filter("bucket = 'cms' and status = 200 and path in ('/xmlrpc.php', '/readme.html', '/wp-json/', '/wp-login.php')"), F.col("path"))


def schema_rule(id: str, severity: str) -> None:
    rule(id, severity, "structured data", "schema_issues")(lambda f: _hits(f.schema_issues.filter(F.col("code").isin(*SCHEMA_CODES[id])), F.concat_ws(" ", "code", "type", "prop")))


for _id, _severity in (("SDV-01", "high"), ("SDV-02", "medium"), ("SDV-03", "medium"), ("SDV-04", "medium"), ("SDV-05", "low"), ("SDV-06", "low"), ("SDV-07", "low")):
    schema_rule(_id, _severity)


@rule("MED-01", "medium", "media")
def image_alt(f: Frames) -> DataFrame:
    """Images, by identity, whose worst state on any page is missing or empty."""
    worst = media.alt_inventory(f.records).filter("rank > 0").withColumn("url", F.col("first_page"))
    return _hits(worst, F.concat_ws(" ", "state", "image"))


@rule("MED-06", "medium", "media", "images")
def heavy_images(f: Frames) -> DataFrame:
    """Images over the limit, on the first twelve pages that carry each."""
    nth = F.row_number().over(Window.partitionBy("site", "image").orderBy("url"))
    own = f.images.filter(F.col("bytes") > IMAGE_MAX_KB * 1024).select("site", "image", "bytes", F.explode("pages").alias("url"))
    return _hits(own.withColumn("nth", nth).filter("nth <= 12"), F.concat_ws(" ", "image", F.col("bytes").cast("string")))


@rule("MED-07", "low", "media", "images")
def oversized_images(f: Frames) -> DataFrame:
    """Raster images at least twice as wide as any box they are painted into, unless already too heavy."""
    own = f.images.filter((F.coalesce("bytes", F.lit(0)) <= IMAGE_MAX_KB * 1024) & ~urls.is_vector(F.col("kind")) & (F.col("displayed_width") > 0) & (F.col("natural_width") >= OVERSIZED * F.col("displayed_width")))
    return _hits(own.withColumn("url", F.try_element_at("pages", F.lit(1))), F.concat_ws(" ", "image", F.round(F.col("natural_width") / F.col("displayed_width"), 1).cast("string")))


@rule("MED-08", "medium", "media", "vitals")
def core_web_vitals(f: Frames) -> DataFrame:
    """Pages over a limit; high where most failures are of the largest paint."""
    long = f.vitals.filter("coalesce(status, 200) < 400").select("site", "url", F.expr("stack(3, 'lcp', lcp, 'cls', cls, 'tbt', tbt) as (metric, value)"))
    limit = F.create_map(*[F.lit(x) for pair in VITAL_LIMITS.items() for x in pair])[F.col("metric")]
    over = long.filter(F.col("value") > limit)
    most = over.groupBy("site", "metric").agg(F.count(F.lit(1)).alias("n")).groupBy("site").agg(F.max_by("metric", F.struct("n", F.col("metric") == "lcp")).alias("worst"))
    return _hits(over.join(most, "site"), F.concat_ws(" ", "metric", F.col("value").cast("string")), F.when(F.col("worst") == "lcp", "high").otherwise("medium"))


def mail_rule(id: str, severity: str, predicate: str, computed: Callable[[], Column] | None = None) -> None:
    rule(id, severity, "mail", "mail")(lambda f: _hits(f.mail.filter(predicate).withColumn("url", F.col("domain")), predicate, computed() if computed else None))


mail_rule("MAIL-01", "high", "spf_present = false")
mail_rule("MAIL-02", "high", "spf_count > 1")
mail_rule("MAIL-03", "high", "spf_cost > 10")
mail_rule("MAIL-10", "medium", "spf_present and spf_all in ('~', '?', '+', '')", lambda: F.when(F.col("spf_all") == "~", "low").otherwise("medium"))
mail_rule("MAIL-04", "medium", "dkim_live = 0")
mail_rule("MAIL-05", "low", "dkim_weak > 0")
mail_rule("MAIL-06", "medium", "dmarc_present = false")
mail_rule("MAIL-08", "medium", "dmarc_present and not (dmarc_policy = 'reject' and dmarc_pct = 100)", lambda: F.when(F.col("dmarc_policy") == "none", "medium").otherwise("low"))
mail_rule("MAIL-09", "low", "dmarc_present and dmarc_rua = ''")
mail_rule("MAIL-07", "medium", "mx_present = false and not mx_null")


def reputation_rule(id: str, severity: str, tiers: tuple[str, ...]) -> None:
    rule(id, severity, "reputation", "reputation")(lambda f: _hits(f.reputation.filter(F.col("worst_tier").isin(*tiers)).withColumn("url", F.col("host")), F.array_join("vendors", ", "), F.col("grade")))


reputation_rule("REP-01", "critical", ("browser",))
reputation_rule("REP-02", "medium", ("gateway", "mail", "endpoint"))
reputation_rule("REP-03", "low", ("feed", "unknown"))


def page_signals(records: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """site, url, kind, detail of copy rules over each text block of a page, of characters damaged anywhere in its
    source, and of mixed content.  found: the records' text blocks, where they are at hand."""
    mixed = unnest(records, "detail", F.col("mixed_content"), "site", "url", F.lit("mixed-content").alias("kind"))
    damaged = unnest(records, "s", mojibake(F.coalesce("html", F.lit(""))), "site", "url").select("site", "url", "s.kind", "s.detail")
    return blocks.block_signals(blocks.text_blocks(records) if found is None else found).select("site", "url", "kind", "detail").unionByName(mixed).unionByName(damaged)


def run(frames: Frames, only: list[str] | None = None) -> DataFrame:
    """Hits of all rules whose frames were measured."""
    at_once = [id for id in PAGE_RULES if only is None or id in only]
    parts = [page_hits(frames, at_once)] if at_once else []
    for r in RULES.values():
        if r.id not in PAGE_RULES and (only is None or r.id in only) and all(getattr(frames, need) is not None for need in r.needs):
            found = r.find(frames)
            severity = F.col("severity") if "severity" in found.columns else F.lit(r.severity)
            parts.append(found.select("site", F.lit(r.id).alias("finding"), severity.alias("severity"), F.lit(r.category).alias("category"), "url", F.substring("detail", 1, 300).alias("detail")))
    return reduce(DataFrame.unionByName, parts)


def findings(hits: DataFrame) -> DataFrame:
    """One row a finding and site: distinct URLs, hits, severity (the worst of its hits), in report order."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    out = hits.withColumn("_rank", rank).groupBy("site", "finding", "category").agg(F.min_by("severity", "_rank").alias("severity"), F.min("_rank").alias("rank"), F.count_distinct("url").alias("urls"), F.count(F.lit(1)).alias("hits"))
    return out.orderBy("site", "rank", F.desc("urls"), "finding")


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("site").pivot("severity", list(SEVERITIES)).agg(F.count(F.lit(1))).na.fill(0)


def clean_rules(spark, found: DataFrame) -> DataFrame:
    """Rules that no site's findings hold."""
    registry = small(spark, [(r.id, r.category) for r in RULES.values()], "finding string, category string")
    return registry.join(found.select("finding").distinct(), "finding", "left_anti")
