"""URL filters whose decisions follow redirects and canonical links.

A rule names a host and the beginning of a path; it fits the host and all its subdomains, and of the rules
that fit the longest decides.  URLs that redirect to each other, or name each other as canonical, are one
resource: connected components of these links are classes of equivalent URLs, found by distributed label
propagation.  A URL without a rule of its own takes its class's decision: allow if any member of the class
is explicitly allowed, else block if any member is blocked, else allow.  A URL's own rule always holds.

Links come from the pages themselves (canonical links, refreshes, a measured final_url where the table has
that column), from a table of redirects, and from the rewriting that servers do by convention: scheme,
`www.`, default port, fragment, index file, slash at the end and tracking parameters lead to one normal form.
Targets need not be pages; rules judge them too.

Hosts meet the rules as hosts, each once, however many URLs they have; classes with a decision meet the
URLs by hash.  Keys that many rows share (hosts, repeated URLs, hub targets) are broadcast or dealt evenly.

Defined results: a null URL, or one without `://`, has empty host and path, no rule and no aliases, and is
allowed; rows that repeat a URL are judged alike; a null html has no links; links to themselves, without a
host or of other schemes than http and https are left out; an empty table gives an empty table; other
columns, whatever their names, are left behind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.urls import absolute
from plumbline.session import small

from .common import keyed_join, prepare, staged, table
from .components import components

#: Host and path, and what the rule decides.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
# Fixed values.
TRACKING = r"(utm_[a-z]+|gclid|fbclid|msclkid|mc_cid|mc_eid)"
INDEX_FILES = r"/(index|default)\.(html?|php|aspx?)$"

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty if there is none."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), *_LOWER)


def path_of(url: Column) -> Column:
    """Behind the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def normal_form(url: Column) -> Column:
    """The URL that servers lead equivalent spellings to, by convention; null without a host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), f"(?i){INDEX_FILES}", "/"), "/+$", "")
    asked = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike(f"(?i)^{TRACKING}(=|$)")), "&")
    return F.when(host != "", F.concat(F.lit("http://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def declared_targets(url: Column, html: Column) -> Column:
    """Absolute URLs that a page says it stands for: its first canonical link, its first refresh."""
    from plumbline.operators.records import attribute, elements

    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script>", " ")
    base = F.coalesce(absolute(url, attribute(F.try_element_at(elements(bare, "base"), F.lit(1)), "href")), url)
    canonical = F.filter(elements(bare, "link"), lambda e: F.coalesce(F.lower(attribute(e, "rel")), F.lit("")).rlike(r"(^|\s)canonical(\s|$)"))
    refresh = F.filter(elements(bare, "meta"), lambda e: F.lower(F.coalesce(attribute(e, "http-equiv"), F.lit(""))) == "refresh")
    to = F.regexp_extract(F.coalesce(attribute(F.try_element_at(refresh, F.lit(1)), "content"), F.lit("")), r"""(?is)^\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"']*)""", 1)
    found = F.array(attribute(F.try_element_at(canonical, F.lit(1)), "href"), to)
    named = F.transform(F.filter(found, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), lambda x: absolute(base, F.replace(x, F.lit("&amp;"), F.lit("&"))))
    says = html.rlike(r"(?i)canonical|http-equiv")  # most pages need no search for elements
    return F.when(says, named).otherwise(F.array().cast("array<string>"))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """host, path, rule, action from (host and path, action) pairs."""
    rows = [(r.partition("/")[0], "/" + r.partition("/")[2], r, action) for r, action in rules]
    return small(spark, rows, "host string, path string, rule string, action string")


def with_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (host, path, ...) with rule and action, null where no rule fits.  A host and its parents meet the
    rules once, however many rows it has; all rules that fit one host are held together."""
    parts = F.split("host", r"\.")
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1  # one number
    hosts = rows.filter("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    parents = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(deepest))), lambda i: F.array_join(F.slice(parts, -i, i), "."))
    asked = hosts.select(F.col("host").alias("key"), "n", F.explode(parents).alias("host"))
    fits = asked.join(rules, "host").groupBy("key").agg(F.first("n").alias("n"), F.collect_list(F.struct((-F.length("rule")).alias("less"), "rule", "path", "action")).alias("rules"))
    fits = staged(fits.withColumn("rules", F.sort_array("rules")), "url-rules")
    judged = keyed_join(rows, F.when(F.col("host") != "", F.col("host")), fits, ["rules"])
    first = F.try_element_at(F.filter("rules", lambda r: F.col("path").startswith(r.path)), F.lit(1))
    return judged.withColumn("_rule", first).select(*[F.col(f"`{c}`") for c in rows.columns], F.col("_rule.rule").alias("rule"), F.col("_rule.action").alias("action"))


def _node(url: Column) -> Column:
    return F.md5(F.regexp_replace(url, "(?s)#.*$", ""))


def judged(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, class_rule (a row per row of pages; class_rule: a rule whose decision
    came by way of aliases, else null).  pages: page_id, url, html, and final_url if it was measured; rules:
    host, path, rule, action; redirects: src, dst."""
    spark, url = pages.sparkSession, F.col("url")
    final = F.array(F.col("final_url")) if "final_url" in pages.columns else F.array().cast("array<string>")
    targets = F.filter(F.concat(final, declared_targets(url, F.coalesce("html", F.lit("")))), lambda x: x.isNotNull() & x.rlike("(?i)^https?://[^/?#]"))
    targets = F.concat(targets, F.filter(F.array(normal_form(url)), lambda x: x.isNotNull()))
    own = pages.select("page_id", url, targets.alias("targets")).select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.when(host_of(url) != "", _node(url)).alias("node"), "targets")
    own = staged(with_rules(own, rules), "url-pages")

    links = own.filter("node is not null").select(F.col("node").alias("a"), F.explode("targets").alias("url"))
    if redirects is not None:
        pairs = redirects.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
        links = links.union(pairs.select(_node(F.col("src")), "dst")).union(pairs.select(_node(F.col("src")), "src"))
    # a target's normal form is a link of its own
    links = links.select("a", F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("url")), F.struct(_node(F.col("url")).alias("a"), normal_form(F.col("url")).alias("url")))).alias("l")).select("l.a", "l.url")
    links = links.filter(F.col("url").isNotNull()).select("a", _node(F.col("url")).alias("b"), "url")
    links = staged(links.filter("a <> b").distinct(), "url-links")
    targets_judged = with_rules(links.select(F.col("b").alias("node"), "url").distinct().select("node", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    decided = own.select("node", "rule", "action").unionByName(targets_judged.select("node", "rule", "action")).filter("node is not null and action is not null")

    # allow comes before block, so the smallest decision of a class is the one that holds
    decision = F.min(F.struct("action", "rule")).alias("decision")
    classes = components(links, "url-classes")
    of_class = decided.groupBy("node").agg(decision).join(classes.withColumnRenamed("doc", "node"), "node").groupBy("class").agg(F.min("decision").alias("decision"))
    blocked = of_class.filter("decision.action = 'block'").select("class", F.col("decision.rule").alias("class_rule"))
    size = own.filter("node is not null and action is null").groupBy(F.col("node").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    aliases = size.join(classes.withColumnRenamed("doc", "key"), "key").join(blocked, "class").select("key", "n", "class_rule")
    out = keyed_join(own, F.when(F.col("action").isNull(), F.col("node")), staged(aliases, "url-aliases"), ["class_rule"])
    verdict = F.coalesce("action", F.when(F.col("class_rule").isNotNull(), F.lit("block")), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "class_rule")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every page's URL."""
    prepare(spark)
    return judged(table(spark, sf_dir, "pages"), rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


def _sql_normal(url: str) -> str:
    host = f"regexp_replace(regexp_replace({_sql_host(url)}, ':(80|443)$', ''), '^www\\.', '')"
    path = f"regexp_replace(regexp_replace({_sql_path(url)}, '/(index|default)\\.(html?|php|aspx?)$', '/', 'i'), '/+$', '')"
    kept = f"list_filter(string_split(regexp_extract({url}, '(?s)^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^{TRACKING}(=|$)'))"
    return f"CASE WHEN {_sql_host(url)} <> '' THEN 'http://' || {host} || {path} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END END"


def _sql_host(url: str) -> str:
    return f"translate(regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)', 1), '{_LOWER[0]}', '{_LOWER[1]}')"


def _sql_path(url: str) -> str:
    return f"regexp_extract(coalesce({url}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


#: Canonical links with absolute references, and normal forms; the rest of what a page declares is tested by a
#: plain loop.
SQL = f"""
WITH RECURSIVE rules(host, path, rule, action) AS (VALUES {", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}', '{a}')" for r, a in RULES)}),
named AS (SELECT page_id, url, regexp_extract(html, '(?is)<link\\s[^>]*rel\\s*=\\s*"canonical"[^>]*>', 0) AS tag FROM pages),
declared AS (SELECT url AS a, regexp_extract(tag, '(?is)\\shref\\s*=\\s*"(https?://[^"]*)"', 1) AS b FROM named),
first_links AS (SELECT regexp_replace(a, '(?s)#.*$', '') AS a, regexp_replace(b, '(?s)#.*$', '') AS b FROM declared WHERE b <> '' AND {_sql_host("a")} <> ''),
urls AS (SELECT url FROM pages WHERE {_sql_host("url")} <> '' UNION SELECT b FROM first_links),
links AS (SELECT a, b FROM first_links UNION SELECT regexp_replace(url, '(?s)#.*$', ''), {_sql_normal("url")} FROM urls),
ways AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
nodes AS (SELECT a AS node FROM links UNION SELECT b FROM links),
reach AS (SELECT node AS root, node FROM nodes UNION SELECT r.root, b.b FROM reach r JOIN ways b ON r.node = b.a),
judged AS (SELECT node, min_by(action, -length(rule)) AS action FROM nodes, rules r WHERE ({_sql_host("node")} = r.host OR ends_with({_sql_host("node")}, '.' || r.host)) AND starts_with({_sql_path("node")}, r.path) GROUP BY node),
class AS (SELECT root AS node, min(action) AS action FROM reach JOIN judged USING (node) GROUP BY root),
own AS (SELECT page_id, url, {_sql_host("url")} AS host, {_sql_path("url")} AS path FROM pages),
fits AS (SELECT DISTINCT o.host, o.path, r.rule, r.action FROM own o JOIN rules r ON (o.host = r.host OR ends_with(o.host, '.' || r.host)) AND starts_with(o.path, r.path)),
best AS (SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(action, length(rule)) AS action FROM fits GROUP BY ALL)
SELECT page_id, o.host, o.path, b.rule, coalesce(b.action, c.action, 'allow') AS verdict
FROM own o LEFT JOIN best b ON o.host = b.host AND o.path = b.path LEFT JOIN class c ON o.host <> '' AND c.node = regexp_replace(o.url, '(?s)#.*$', '')
"""
