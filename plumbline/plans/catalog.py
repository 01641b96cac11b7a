"""Registered queries of the audit engine, one an operator or group of operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import images as I
from plumbline.functions import scoring as S
from plumbline.functions import urls as U
from plumbline.functions.copy import copy_signals, mojibake
from plumbline.operators import blocks, corpus, crawl, graph, links, mail, probes, rules, scores, structured
from plumbline.operators import vitals as lab
from plumbline.operators.records import page_links
from plumbline.plans import frames as X
from plumbline.session import cut, ship, spread, unnest
from plumbline.sources.sinks import slug
from plumbline.sources.tables import parquet

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "page_report"
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name; {..} parts of its SQL are shared fragments."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            for name, text in FRAGMENTS.items():
                sql_ = ORACLE_SQL.get(fn.__name__, sql).replace(f"{{{name}}}", text)
                ORACLE_SQL[fn.__name__] = sql_
        return fn

    return register


_TEXT = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '[\s\x{a0}]+', ' ', 'g'))"


def _tag(inner: str) -> str:
    return rf"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({inner}, '(?s)<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))"


FRAGMENTS = {
    # host, path and query of a URL column named url
    "host": r"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?', 2))",
    "path": r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?', 3)",
    "scheme": r"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?', 1))",
    "text": _TEXT.replace('\\"', '"'),
    "title": _tag(r"regexp_extract(coalesce(html, ''), '(?is)<title(?:\s[^>]*)?>(.*?)</title>', 1)").replace('\\"', '"'),
    "part_url": "'https://shop.example.com/' || CASE WHEN KEY % 10 = 0 THEN 'blog/' WHEN KEY % 10 = 1 THEN 'tag/' ELSE 'item/' END || KEY || '/'",
}
_EDGES = """nodes AS (SELECT {part_url_p} AS url FROM part),
edges AS (SELECT {part_url_s} AS src, {part_url_d} AS dst, l_returnflag AS anchor, l_orderkey % 7 = 0 AS rendered FROM lineitem),
pairs AS (SELECT DISTINCT src, dst, rendered FROM edges WHERE src <> dst)"""
for _name, _key in (("p", "p_partkey"), ("s", "l_partkey"), ("d", "(CASE WHEN l_returnflag = 'A' THEN l_linenumber % 3 + 1 ELSE 3 * l_partkey + l_linenumber % 2 END)")):
    _EDGES = _EDGES.replace("{part_url_%s}" % _name, FRAGMENTS["part_url"].replace("KEY", _key))
FRAGMENTS = {"edges": _EDGES} | FRAGMENTS
FRAGMENTS["links"] = """status AS (SELECT 'c' || (o_custkey % 100) || '.example.com' AS site, o_orderkey AS o, o_orderstatus <> 'F' AS internal,
  CASE WHEN o_orderkey % 17 = 0 THEN 404 WHEN o_orderkey % 23 = 0 THEN 403 WHEN o_orderkey % 29 = 0 THEN 500 WHEN o_orderkey % 31 = 0 THEN 418 WHEN o_orderkey % 37 = 0 THEN NULL ELSE 200 END AS status, CAST(o_orderkey % 4 AS INT) AS hops FROM orders),
judged AS (SELECT *, CASE WHEN internal THEN site ELSE 'other.example.net' END AS host, CASE WHEN status IN (404, 410) THEN 'dead' WHEN status >= 500 OR status IN (401, 403, 405, 429, 999) THEN 'blocked' WHEN status >= 400 THEN 'error' WHEN status IS NOT NULL THEN 'ok' ELSE 'unreachable' END AS verdict FROM status)"""


# --- pages -----------------------------------------------------------------------------------------


@query("""SELECT page_id, regexp_replace({host}, '^www\\.', '') AS site, url, {title} AS title, CAST(length({title}) AS BIGINT) AS title_len,
 regexp_extract(html, '(?is)<html[^>]*\\slang\\s*=\\s*"([^"]*)"', 1) AS lang, CAST(len(regexp_extract_all(html, '(?is)<h1(?:\\s[^>]*)?>')) AS BIGINT) AS n_h1, CAST(len(regexp_extract_all(html, '(?is)<h2(?:\\s[^>]*)?>')) AS BIGINT) AS n_h2,
 CAST(len(regexp_extract_all(html, '(?is)<a\\s[^>]*>.*?</a>')) AS BIGINT) AS n_anchors, CAST(len(regexp_extract_all(html, '(?is)<img(?:\\s[^>]*)?>')) AS BIGINT) AS n_images,
 CASE WHEN {text} = '' THEN 0 ELSE CAST(len(string_split({text}, ' ')) AS BIGINT) END AS word_count FROM pages""")
def page_report(spark: SparkSession, d: str) -> DataFrame:
    """Extraction: what each page says about itself."""
    r = X.records(spark, d)
    return r.select("page_id", "site", "url", "title", F.col("title_len").cast("long").alias("title_len"), "lang", F.col("h1_count").cast("long").alias("n_h1"), F.col("h2_count").cast("long").alias("n_h2"), F.size("anchors").cast("long").alias("n_anchors"), F.col("img_total").cast("long").alias("n_images"), F.col("word_count").cast("long").alias("word_count"))


@query("""WITH p AS (SELECT page_id, url, {host} AS host, CASE WHEN {path} = '' THEN '/' ELSE {path} END AS path, {scheme} AS scheme FROM pages)
SELECT page_id, host, scheme || '://' || host || CASE WHEN path LIKE '%/' OR contains(regexp_extract(path, '([^/]*)$', 1), '.') THEN path ELSE path || '/' END AS identity,
 NOT regexp_matches(path, '(?i)\\.(jpe?g|png|gif|webp|avif|svg|ico|css|js|mjson|json|pdf|zip|gz|rar|mp4|webm|mp3|wav|woff2?|ttf|eot|xml|txt|csv|xlsx?|docx?)$') AND NOT regexp_matches(path, '(?i)^/(cdn-cgi|wp-json|xmlrpc\\.php|feed)(/|$)') AS is_page,
 regexp_matches(path, '(?i)/(page|tag|category|author|attachment|comment-page-\\d+)/') AS is_archive,
 regexp_matches(host, '(?i)(^|[.\\-])(staging|stage|test|testing|dev|develop|uat|preview|demo|qa|sandbox)([.\\-]|$)|\\.local$|\\.test$|localhost') AS is_staging,
 trim(regexp_replace(regexp_replace(lower(host), '^www\\.', ''), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM p""")
def url_identity(spark: SparkSession, d: str) -> DataFrame:
    """URL functions: identity, page or asset, archive, staging host, partition key."""
    u = F.col("url")
    return parquet(spark, d, "pages").select("page_id", U.host(u).alias("host"), U.normalise(u).alias("identity"), U.is_page(u).alias("is_page"), U.is_archive(u).alias("is_archive"), U.is_staging_host(U.host(u)).alias("is_staging"), slug(U.host(u)).alias("slug"))


@query("""WITH p AS (SELECT page_id, regexp_replace({host}, '^www\\.', '') AS site, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) || '://' || {host} AS origin, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"[^>]*>.*?</a>', 1)) AS href FROM pages)
SELECT site, origin || regexp_replace(regexp_replace(href, '#.*$', ''), '^/\\.{1,2}$', '/') AS target, count(*) AS links, count(DISTINCT page_id) AS pages FROM p WHERE href LIKE '/%' GROUP BY ALL""")
def page_link_targets(spark: SparkSession, d: str) -> DataFrame:
    """Link extraction: targets of each site, how often and on how many pages; pages may share a URL."""
    found = page_links(X.records(spark, d))
    return found.groupBy("site", "target").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("page_id").alias("pages"))


@query()
def text_block_counts(spark: SparkSession, d: str) -> DataFrame:
    """HTML block walk: blocks and characters of body and chrome by tag."""
    return blocks.text_blocks(X.records(spark, d)).groupBy("site", "region", "tag").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).alias("chars"))


@query("""WITH p AS (SELECT regexp_replace({host}, '^www\\.', '') AS site, url, {title} AS title FROM pages), shared AS (SELECT site, title, count(*) AS n FROM p WHERE title <> '' GROUP BY ALL HAVING count(*) > 1)
SELECT p.site, p.url, p.title, n FROM p JOIN shared USING (site, title)""")
def duplicate_titles(spark: SparkSession, d: str) -> DataFrame:
    """Duplicate groups: titles that several pages of a site share."""
    own = X.records(spark, d).select("site", "url", "title").filter("title <> ''")
    shared = own.groupBy("site", "title").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return own.join(shared, ["site", "title"])


_PAGE_RULES = """WITH p AS (SELECT page_id, regexp_replace({host}, '^www\\.', '') AS site, url, {title} AS title, {text} AS text, html, regexp_extract(html, '(?is)<html[^>]*\\slang\\s*=\\s*"([^"]*)"', 1) AS lang, len(regexp_extract_all(html, '(?is)<h1(?:\\s[^>]*)?>.*?</h1>')) AS h1 FROM pages),
hits AS (
 SELECT 'MET-01' AS finding, url FROM p WHERE title = '' UNION ALL SELECT 'MET-02', url FROM p WHERE length(title) > 60 UNION ALL SELECT 'MET-03', url FROM p WHERE length(title) BETWEEN 1 AND 14
 UNION ALL SELECT 'MET-08', url FROM p WHERE h1 = 0 UNION ALL SELECT 'MET-09', url FROM p WHERE h1 > 1 UNION ALL SELECT 'MET-11', url FROM p WHERE lang = ''
 UNION ALL SELECT 'MET-05', url FROM p WHERE NOT regexp_matches(html, '(?is)<meta\\s[^>]*(?:name|property)\\s*=\\s*["'']description["'']')
 UNION ALL SELECT 'MET-12', url FROM p WHERE NOT regexp_matches(html, '(?is)<meta\\s[^>]*(?:name|property)\\s*=\\s*["'']viewport["'']')
 UNION ALL SELECT 'CNT-09', url FROM p WHERE (CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END) < 300)
SELECT finding, count(DISTINCT url) AS urls, count(*) AS hits FROM hits GROUP BY ALL"""


@query(_PAGE_RULES)
def page_rule_findings(spark: SparkSession, d: str) -> DataFrame:
    """Rule engine: rules that look at one page at a time."""
    hits = rules.run(rules.Frames(X.records(spark, d)), ["MET-01", "MET-02", "MET-03", "MET-05", "MET-08", "MET-09", "MET-11", "MET-12", "CNT-09"])
    return hits.groupBy("finding").agg(F.count_distinct("url").alias("urls"), F.count(F.lit(1)).alias("hits"))


@query()
def all_findings(spark: SparkSession, d: str) -> DataFrame:
    """Rule engine: every rule over every frame, a row a finding and site."""
    records = cut(X.crawl_records(spark, d), "records")
    text = cut(blocks.text_blocks(records), "blocks")  # read by copy rules and spelling
    signals = rules.page_signals(records, text).unionByName(_document_signals(spark, d)).unionByName(_spelling_signals(spark, d, records, text))
    g = _classified(spark, d)
    f = rules.Frames(records, signals=signals, links=X.link_pages(spark, d), graph=g, link_status=links.with_verdicts(X.link_status(spark, d)), vitals=X.vitals(spark, d), images=X.images(spark, d), mail=mail.mail_records(X.mail_domains(spark, d), X.dns_answers(spark, d)), reputation=probes.reputation_grade(X.listings(spark, d)),
        runtime=X.runtime(spark, d), probes=probes.suppressed_probes(X.probe_answers(spark, d), X.probe_baselines(spark, d)), sitemaps=X.sitemap_totals(spark, d), extra={"entry_point": X.entry_points(spark, d)})
    f.schema_issues = structured.record_issues(X.jsonld_records(spark, d), structured.vocabulary(spark))
    f.robots = probes.robots_summary(X.robots_bodies(spark, d))
    return rules.findings(rules.run(f.staged()))


# --- copy ------------------------------------------------------------------------------------------


def _document_signals(spark: SparkSession, d: str) -> DataFrame:
    """Copy faults of each line of a document, once a document for each kind and detail."""
    lines = spread(X.documents_as_records(spark, d)).select("site", "url", F.explode(F.split("text", r"\R")).alias("line"))
    return unnest(lines, "s", F.concat(copy_signals(F.col("line")), mojibake(F.col("line"))), "site", "url").select("site", "url", "s.kind", "s.detail").distinct()


def _spelling_signals(spark: SparkSession, d: str, records: DataFrame, text: DataFrame | None = None) -> DataFrame:
    """Words of pages and documents one edit from a word of the documents' dictionary.  text: the pages' text blocks,
    where they are at hand."""
    docs = X.documents_as_records(spark, d).withColumn("region", F.lit("body"))
    words = cut(blocks.page_words(spread(docs)), "words")
    asked = words.unionByName(blocks.page_words(blocks.text_blocks(records) if text is None else text))
    return blocks.spelling(asked, _dictionary(words, docs)).select("site", "url", F.lit("spelling").alias("kind"), F.col("word").alias("detail"))


@query()
def copy_signal_counts(spark: SparkSession, d: str) -> DataFrame:
    """Copy rules over documents: signals and documents by kind and source."""
    return _document_signals(spark, d).groupBy("site", "kind").agg(F.count(F.lit(1)).alias("signals"), F.count_distinct("url").alias("documents"))


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, regexp_matches(trim(text), '\\S {2,}\\S') AS double_space, length(text) - length(replace(text, '(', '')) <> length(text) - length(replace(text, ')', '')) AS unbalanced,
 length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 25 AND upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) = regexp_replace(text, '[^A-Za-z]', '', 'g') AS capitals,
 regexp_matches(text, '\\S\\s+[,.;:!?](?:\\s|$)') AS space_before, CAST(len(regexp_extract_all(text, '[a-z]{2}[.,;!?][A-Z][a-zA-Z]*')) AS BIGINT) AS missing_space, regexp_matches(text, '&(?:nbsp|amp|quot|apos|lt|gt|ndash|mdash|hellip|#\\d{2,5}|#x[0-9a-fA-F]{2,5});') AS entity FROM t""")
def copy_flags(spark: SparkSession, d: str) -> DataFrame:
    """Style and punctuation rules as flags a document."""
    from plumbline.functions import copy as C

    t = F.coalesce("text", F.lit(""))
    letters = F.regexp_replace(t, "[^A-Za-z]", "")
    return parquet(spark, d, "documents").select(
        "doc_id", F.trim(t).rlike(r"\S {2,}\S").alias("double_space"), (F.regexp_count(t, F.lit(r"\(")) != F.regexp_count(t, F.lit(r"\)"))).alias("unbalanced"), ((F.length(letters) > 25) & (F.upper(letters) == letters)).alias("capitals"),
        t.rlike(C.SPACE_BEFORE).alias("space_before"), F.size(F.regexp_extract_all(t, F.lit(C.MISSING_SPACE), F.lit(0))).cast("long").alias("missing_space"), t.rlike(C.ENTITY).alias("entity"),
    )


@query("""WITH w AS (SELECT doc_id, string_split(regexp_replace(trim(lower(coalesce(text, ''))), '\\s+', ' ', 'g'), ' ') AS w FROM documents)
SELECT doc_id, CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS BIGINT) AS doubled FROM w""")
def doubled_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring equal tokens a document."""
    w = F.split(F.regexp_replace(F.trim(F.lower(F.coalesce("text", F.lit("")))), r"\s+", " "), " ")
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w")), lambda a, b: a == b)
    return parquet(spark, d, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size(F.filter(F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<boolean>")), lambda x: x)).cast("long").alias("doubled"))


@query("""WITH t AS (SELECT source AS site, doc_id, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '\\+?\\(?[0-9]{3}\\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}'))) AS phone FROM documents)
SELECT site, phone, count(*) AS documents FROM t GROUP BY ALL""")
def phone_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Phone numbers of each source and how many documents hold them."""
    from plumbline.operators.records import PHONE

    each = X.documents_as_records(spark, d).select("site", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(PHONE), F.lit(0)))).alias("phone"))
    return each.groupBy("site", "phone").agg(F.count(F.lit(1)).alias("documents"))


#: Words of at least this share of the documents are the dictionary, at any size of the corpus.
DICTIONARY_SHARE = 0.01


def _dictionary(words: DataFrame, docs: DataFrame) -> DataFrame:
    counted = words.groupBy("word").agg(F.sum("n").alias("frequency"), F.count(F.lit(1)).alias("documents"))
    total = docs.agg(F.count_distinct("site", "url").alias("total"))
    return counted.crossJoin(F.broadcast(total)).filter(F.col("documents") >= DICTIONARY_SHARE * F.col("total")).select("word", "frequency")


@query()
def spelling_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Words of documents outside the dictionary with a dictionary word one edit away."""
    docs = X.documents_as_records(spark, d).withColumn("region", F.lit("body"))
    words = cut(blocks.page_words(spread(docs)), "words")
    return blocks.spelling(words, _dictionary(words, docs))


# --- graph -----------------------------------------------------------------------------------------


@query("""WITH {edges}, into_ AS (SELECT dst AS url, count(*) FILTER (NOT rendered) AS inbound_html, count(*) FILTER (rendered) AS inbound_rendered FROM pairs GROUP BY ALL), out_ AS (SELECT src AS url, count(DISTINCT dst) AS outbound FROM pairs GROUP BY ALL)
SELECT url, coalesce(inbound_html, 0) AS inbound_html, coalesce(inbound_rendered, 0) AS inbound_rendered, coalesce(inbound_html, 0) + coalesce(inbound_rendered, 0) AS inbound, coalesce(outbound, 0) AS outbound FROM nodes LEFT JOIN into_ USING (url) LEFT JOIN out_ USING (url)""")
def inbound_counts(spark: SparkSession, d: str) -> DataFrame:
    """Link graph: distinct sources and targets of every node."""
    return graph.inbound_counts(X.graph_nodes(spark, d), X.graph_edges(spark, d)).select("url", "inbound_html", "inbound_rendered", "inbound", "outbound")


_BFS = """WITH RECURSIVE {edges}, home AS (SELECT min(src) AS url FROM edges), inside AS (SELECT DISTINCT src, dst FROM edges WHERE dst IN (SELECT url FROM nodes)),
walk(url, depth) USING KEY (url) AS (SELECT url, 0 FROM home UNION SELECT dst, min(depth) + 1 FROM walk JOIN inside ON src = url WHERE dst NOT IN (SELECT url FROM recurring.walk) GROUP BY dst), depths AS (SELECT url, CAST(depth AS BIGINT) AS depth FROM walk)"""


@query(_BFS + " SELECT url, depth FROM depths")
def bfs_depth(spark: SparkSession, d: str) -> DataFrame:
    """Breadth-first search from the home page."""
    return graph.bfs_depth(X.graph_nodes(spark, d), X.graph_edges(spark, d), X.graph_home(spark, d)).select("url", "depth")


def _classified(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = X.graph_nodes(spark, d), cut(X.graph_edges(spark, d).distinct(), "edges")  # read by each step
    home = X.home_of(edges)
    return graph.classify(graph.inbound_counts(nodes, edges), graph.bfs_depth(nodes, edges, home), home)


@query(_BFS + """, counts AS (SELECT nodes.url, count(dst) AS inbound, count(dst) FILTER (NOT rendered) AS html FROM nodes LEFT JOIN pairs ON dst = nodes.url GROUP BY ALL)
SELECT c.url, CASE WHEN inbound = 0 AND c.url <> (SELECT url FROM home) THEN CASE WHEN c.url LIKE '%/blog/%' THEN 'feed_orphan' ELSE 'true_orphan' END WHEN inbound >= greatest(2.0, 0.5 * (SELECT count(*) FROM nodes)) THEN 'global_nav' WHEN inbound = 1 THEN 'single_inbound' ELSE 'linked' END AS link_class,
 CASE WHEN depth IS NULL THEN 'unreachable' WHEN depth > 3 THEN 'deep' ELSE 'near' END AS reach, html = 0 AND inbound > 0 AS rendered_only FROM counts c LEFT JOIN depths USING (url)""")
def graph_classes(spark: SparkSession, d: str) -> DataFrame:
    """Orphans, navigation, single links, reach."""
    return _classified(spark, d).select("url", "link_class", "reach", "rendered_only")


@query(_BFS + " SELECT coalesce(CAST(depth AS VARCHAR), 'unreachable') AS depth, count(*) AS pages FROM nodes LEFT JOIN depths USING (url) GROUP BY ALL")
def depth_histogram(spark: SparkSession, d: str) -> DataFrame:
    return graph.depth_histogram(_classified(spark, d)).select("depth", "pages")


@query("""WITH c AS (SELECT c_nationkey AS n, c_custkey % 5 AS s, coalesce(c_acctbal < 0, false) AS orphan FROM customer WHERE c_nationkey IS NOT NULL),
v AS (SELECT CASE WHEN (n + s) % 3 = 0 THEN 'n' || n || '/' || s || '/' WHEN n % 2 = 0 THEN 'n' || n || '/' ELSE '' END AS page FROM c WHERE orphan UNION ALL SELECT 'blog/'),
t AS (SELECT page, count(*) AS votes FROM v GROUP BY ALL), h AS (SELECT * FROM t UNION ALL SELECT '', 1 WHERE '' NOT IN (SELECT page FROM t)), r AS (SELECT 'shop.example.com' AS site, 'https://shop.example.com/' || page AS url, votes, row_number() OVER (ORDER BY votes DESC, page) AS rank FROM h) SELECT * FROM r WHERE rank <= 8""")
def hub_pages(spark: SparkSession, d: str) -> DataFrame:
    """Crawled pages most likely to explain the orphans."""
    pages = X.shelves(spark, d)
    home = pages.filter("url = 'https://shop.example.com/'").select("site", "url")
    return graph.hub_candidates(pages.select("site", "url"), pages.filter("orphan").select("site", "url"), home).select("site", "url", "votes", F.col("rank").cast("long").alias("rank"))


# --- links -----------------------------------------------------------------------------------------


@query("WITH {links} SELECT site, count(*) AS checked, count(*) FILTER (verdict IN ('ok', 'dead', 'error')) AS verified, count(*) FILTER (verdict = 'ok') AS ok, count(*) FILTER (verdict IN ('ok', 'dead', 'error') AND hops = 0) AS direct, count(*) FILTER (verdict NOT IN ('ok', 'dead', 'error')) AS unverified FROM judged GROUP BY ALL")
def link_totals(spark: SparkSession, d: str) -> DataFrame:
    return links.link_totals(links.with_verdicts(X.link_status(spark, d)))


@query("""WITH {links}, carried AS (SELECT DISTINCT site, o, 'https://' || site || '/p/' || l_suppkey AS page FROM judged JOIN lineitem ON l_orderkey = o WHERE verdict = 'dead')
SELECT j.site, CASE WHEN o % 5 = 0 THEN 'http://' ELSE 'https://' END || host || '/o/' || o AS url, coalesce(page, CASE WHEN o % 5 = 0 THEN 'http://' ELSE 'https://' END || host || '/o/' || o) AS page FROM judged j LEFT JOIN carried c USING (o) WHERE verdict = 'dead'""")
def dead_link_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Dead links on each page that carries them."""
    status = links.with_verdicts(X.link_status(spark, d)).filter("verdict = 'dead'")
    return links.fan_out(status, X.link_pages(spark, d)).select("site", "url", "page")


@query("""WITH {links} SELECT site, CASE WHEN o % 5 = 0 THEN 'http' WHEN NOT internal THEN 'domain' WHEN o % 2 = 0 THEN 'slash' ELSE 'moved' END AS cause, count(*) AS n FROM judged WHERE hops >= 2 GROUP BY ALL""")
def redirect_causes(spark: SparkSession, d: str) -> DataFrame:
    """Why links redirect twice or more."""
    status = X.link_status(spark, d)
    own = status.filter("hops >= 2").withColumn("cause", U.hop_cause(F.col("url"), F.col("url"), F.col("final_url"), F.lit("")))
    return own.groupBy("site", "cause").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT o_orderkey AS url, CASE WHEN o_orderkey % 9 = 0 THEN 503 WHEN o_orderkey % 10 = 0 THEN NULL ELSE 200 END AS status, o_totalprice AS bytes FROM orders), again AS (SELECT o_orderkey AS url, CASE WHEN o_orderkey % 4 = 0 THEN 200 ELSE 503 END AS status, 1.0 AS bytes FROM orders WHERE o_orderkey % 3 <> 1)
SELECT r.url, CASE WHEN (r.status IS NULL OR r.status IN (408, 429, 500, 502, 503, 504)) AND a.status = 200 THEN a.status ELSE r.status END AS status, CASE WHEN (r.status IS NULL OR r.status IN (408, 429, 500, 502, 503, 504)) AND a.status = 200 THEN a.bytes ELSE r.bytes END AS bytes FROM r LEFT JOIN again a USING (url)""")
def retry_merge(spark: SparkSession, d: str) -> DataFrame:
    """Throttled records are replaced by a retry that was served."""
    o = F.col("o_orderkey")
    orders = parquet(spark, d, "orders")
    first = orders.select(o.alias("url"), F.when(o % 9 == 0, 503).when(o % 10 == 0, F.lit(None).cast("int")).otherwise(200).alias("status"), F.col("o_totalprice").alias("bytes"))
    again = orders.filter(o % 3 != 1).select(o.alias("url"), F.when(o % 4 == 0, 200).otherwise(503).alias("status"), F.lit(1.0).alias("bytes"))
    return links.retried(first, again)


@query("""WITH r AS (SELECT 'https://e.com/' || (o_custkey) || '/' || o_orderkey AS url, 'https://e.com/' || o_custkey || '/' || (o_orderkey - o_orderkey % 3) || '/' AS final_url FROM orders),
s AS (SELECT url, final_url AS served, url || '/' = final_url AS own FROM r), f AS (SELECT *, first_value(url) OVER (PARTITION BY served ORDER BY own DESC, url) AS owner FROM s) SELECT url, CASE WHEN owner <> url THEN owner END AS duplicate_of FROM f""")
def duplicate_spellings(spark: SparkSession, d: str) -> DataFrame:
    """Pages that are served as another."""
    c, o = F.col("o_custkey").cast("string"), F.col("o_orderkey")
    records = parquet(spark, d, "orders").select(F.lit("e.com").alias("site"), F.concat(F.lit("https://e.com/"), c, F.lit("/"), o.cast("string")).alias("url"), F.concat(F.lit("https://e.com/"), c, F.lit("/"), (o - o % 3).cast("string"), F.lit("/")).alias("final_url"))
    return links.duplicate_spellings(records).select("url", "duplicate_of")


# --- scores ----------------------------------------------------------------------------------------

_METRICS = """p AS (SELECT regexp_replace({host}, '^www\\.', '') AS site, url, {title} AS title, {text} AS text FROM pages),
m AS (SELECT site, avg(CAST(title <> '' AS INT)) AS title_present, avg(CAST(length(title) BETWEEN 15 AND 60 AS INT)) FILTER (title <> '') AS title_length, avg(CAST((CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END) >= 300 AS INT)) AS word_depth FROM p GROUP BY ALL),
u AS (SELECT site, count(*) FILTER (n = 1) / sum(n) AS title_unique FROM (SELECT site, title, count(*) AS n FROM p WHERE title <> '' GROUP BY ALL) GROUP BY ALL),
long AS (SELECT site, 'title_present' AS metric, title_present AS value, 0.9 AS lo, 1.0 AS hi FROM m UNION ALL SELECT site, 'title_length', title_length, 0.4, 0.95 FROM m UNION ALL SELECT site, 'word_depth', word_depth, 0.65, 0.98 FROM m UNION ALL SELECT site, 'title_unique', title_unique, 0.8, 0.99 FROM u)"""


@query("WITH " + _METRICS + " SELECT site, metric, round(value, 6) AS value, round(greatest(0, least(1, (value - lo) / (hi - lo))), 6) AS score FROM long")
def metric_scores(spark: SparkSession, d: str) -> DataFrame:
    """Pass-ratios through their windows."""
    out = scores.scored(scores.page_metrics(X.records(spark, d))).filter(F.col("metric").isin("title_present", "title_length", "word_depth", "title_unique"))
    return out.select("site", "metric", F.round("value", 6).alias("value"), F.round("score", 6).alias("score"))


@query()
def site_scores(spark: SparkSession, d: str) -> DataFrame:
    """Groups, category, gates and overall score of every site."""
    records = X.records(spark, d)
    signals = rules.page_signals(records)
    records = cut(records.drop("html", "text", "anchors", "images", "jsonld"), "records")  # read by each metric
    metrics = scores.scored(scores.page_metrics(records).unionByName(scores.signal_metrics(records, signals)))
    seo = scores.seo_category(scores.group_scores(metrics))
    return scores.overall(seo, None, scores.gates(records)).select("site", F.round("raw", 6).alias("raw"), "overall", "cap", F.round("coverage", 6).alias("coverage"), "band")


@query("""WITH g AS (SELECT o_custkey AS site, o_orderpriority AS metric, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice / 600000 END AS score, CAST(o_orderkey % 5 + 1 AS DOUBLE) AS weight FROM orders)
SELECT site, round(sum(score * weight) / sum(weight) FILTER (score IS NOT NULL), 6) AS score, CASE WHEN sum(score * weight) IS NULL THEN 'not scored' WHEN sum(score * weight) / sum(weight) FILTER (score IS NOT NULL) >= 0.9 THEN 'excellent' WHEN sum(score * weight) / sum(weight) FILTER (score IS NOT NULL) >= 0.8 THEN 'strong' WHEN sum(score * weight) / sum(weight) FILTER (score IS NOT NULL) >= 0.65 THEN 'needs work' WHEN sum(score * weight) / sum(weight) FILTER (score IS NOT NULL) >= 0.45 THEN 'weak' ELSE 'critical' END AS band FROM g GROUP BY ALL""")
def weighted_scores(spark: SparkSession, d: str) -> DataFrame:
    """Weighted means that renormalise over what was measured, and their band."""
    o = parquet(spark, d, "orders").select(F.col("o_custkey").alias("site"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 600000).alias("score"), (F.col("o_orderkey") % 5 + 1).cast("double").alias("weight"))
    out = o.groupBy("site").agg(S.weighted_mean(F.col("score"), F.col("weight")).alias("s"))
    return out.select("site", F.round("s", 6).alias("score"), S.band(F.col("s") * 100)["word"].alias("band"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(CASE WHEN l_extendedprice <= 10000 THEN 1.0 WHEN l_extendedprice >= 60000 THEN 0.0 ELSE (60000 - l_extendedprice) / 50000 END, 6) AS score FROM lineitem")
def falling_scores(spark: SparkSession, d: str) -> DataFrame:
    """Lower-is-better measures."""
    return parquet(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.round(S.falling(F.col("l_extendedprice"), 10000, 60000), 6).alias("score"))


@query("""WITH v AS (SELECT source AS site, avg(CAST(length(text) >= 1000 AS INT)) AS word_depth, avg(CAST(lang = 'en' AS INT)) AS title_length, avg(CAST(n_chars >= 400 AS INT)) AS desc_length FROM documents GROUP BY ALL),
l AS (SELECT site, 'word_depth' AS metric, word_depth AS value, 0.65 AS lo, 0.98 AS hi FROM v UNION ALL SELECT site, 'title_length', title_length, 0.4, 0.95 FROM v UNION ALL SELECT site, 'desc_length', desc_length, 0.55, 0.97 FROM v),
a AS (SELECT metric, count(*) AS sites, min(value) AS low, median(value) AS middle, max(value) AS high, any_value(lo) AS lo, any_value(hi) AS hi FROM l GROUP BY metric)
SELECT metric, sites, round(low, 6) AS low, round(middle, 6) AS middle, round(high, 6) AS high, CASE WHEN high - low < 0.08 THEN 'compliance check' WHEN greatest(0, least(1, (low - lo) / (hi - lo))) > 0.9 THEN 'too generous' WHEN middle > 0.95 AND low < 0.5 THEN 'bimodal' WHEN greatest(0, least(1, (middle - lo) / (hi - lo))) > 0.95 THEN 'top-heavy' WHEN greatest(0, least(1, (middle - lo) / (hi - lo))) < 0.15 THEN 'too harsh' ELSE 'working' END AS verdict FROM a""")
def calibration(spark: SparkSession, d: str) -> DataFrame:
    """What the corpus says about windows; sources are the sites."""
    per = parquet(spark, d, "documents").groupBy(F.col("source").alias("site")).agg(F.avg((F.length("text") >= 1000).cast("int")).alias("word_depth"), F.avg((F.col("lang") == "en").cast("int")).alias("title_length"), F.avg((F.col("n_chars") >= 400).cast("int")).alias("desc_length"))
    out = corpus.calibration(per.unpivot("site", ["word_depth", "title_length", "desc_length"], "metric", "value"))
    return out.select("metric", "sites", *[F.round(c, 6).alias(c) for c in ("low", "middle", "high")], "verdict")


@query("SELECT o_custkey AS site, max(o_orderkey) AS runs_last, count(*) AS runs FROM orders GROUP BY ALL")
def run_history(spark: SparkSession, d: str) -> DataFrame:
    """Latest run and number of runs of every site; orders are runs."""
    runs = parquet(spark, d, "orders").select(F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("finished"), F.col("o_totalprice").alias("overall"))
    return corpus.history(runs).select("site", F.col("finished").alias("runs_last"), "runs")


# --- lab, media ------------------------------------------------------------------------------------


@query()
def site_vitals(spark: SparkSession, d: str) -> DataFrame:
    """Median page score on the log-normal curves."""
    ship(spark)
    out = lab.site_vitals(lab.page_scores(X.vitals(spark, d)))
    return out.select("site", *[F.round(c, 6).alias(c) for c in ("score", "median_fcp", "median_lcp", "median_tbt", "median_cls")], "pages")


@query("""WITH v AS (SELECT l_suppkey % 50 AS site, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey % 50 ORDER BY l_extendedprice) - 1 AS n, count(*) OVER (PARTITION BY l_suppkey % 50) AS k FROM lineitem) SELECT site, v AS upper_median FROM v WHERE n = k // 2""")
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    return lab.upper_median(parquet(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("site"), "l_extendedprice"), ["site"], "l_extendedprice")


@query("""WITH v AS (SELECT 's' || (l_suppkey % 50) AS site, l_tax * 3 AS cls, l_discount * 5000 AS tbt, CASE WHEN l_linenumber <> 3 THEN l_extendedprice / 10 END AS lcp FROM lineitem WHERE l_linenumber <> 7)
SELECT site, metric, count(*) AS hits FROM (SELECT site, 'lcp' AS metric FROM v WHERE lcp > 2500 UNION ALL SELECT site, 'cls' FROM v WHERE cls > 0.1 UNION ALL SELECT site, 'tbt' FROM v WHERE tbt > 200) GROUP BY ALL""")
def vitals_over_limits(spark: SparkSession, d: str) -> DataFrame:
    """Core web vitals rule: pages over each limit."""
    found = rules.RULES["MED-08"].find(rules.Frames(X.records(spark, d), vitals=X.vitals(spark, d)))
    return found.groupBy("site", F.substring_index("detail", " ", 1).alias("metric")).agg(F.count(F.lit(1)).alias("hits"))


@query("""WITH p AS (SELECT l_partkey AS k, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY ALL) SELECT lower(p_brand) AS site, '/i/' || p_partkey AS image, CAST(least(n, 12) AS BIGINT) AS pages FROM part JOIN p ON k = p_partkey WHERE CAST(trunc(p_retailprice * 200) AS BIGINT) > 180 * 1024""")
def heavy_images(spark: SparkSession, d: str) -> DataFrame:
    """Images over the weight limit, twelve pages each at most."""
    found = rules.RULES["MED-06"].find(rules.Frames(X.records(spark, d), images=X.images(spark, d)))
    return found.groupBy("site", F.substring_index("detail", " ", 1).alias("image")).agg(F.count(F.lit(1)).alias("pages"))


@query("""WITH s AS (SELECT p_partkey, p_size * 20.0 AS slot FROM part) SELECT p_partkey, '/i/' || p_partkey || '/' || CASE WHEN 320 >= slot THEN 320 WHEN 640 >= slot THEN 640 ELSE 960 END || '.webp' AS typical, '/i/' || p_partkey || '/' || CASE WHEN 320 >= slot * 2 THEN 320 WHEN 640 >= slot * 2 THEN 640 ELSE 960 END || '.webp' AS retina FROM s""")
def srcset_choice(spark: SparkSession, d: str) -> DataFrame:
    """Candidates a browser takes at one and two pixels a CSS pixel."""
    ship(spark)
    base = F.concat(F.lit("/i/"), F.col("p_partkey").cast("string"), F.lit("/"))
    srcset = F.concat_ws(", ", *[F.concat(base, F.lit(f"{w}.webp {w}w")) for w in (640, 320, 960)])
    rows = parquet(spark, d, "part").select("p_partkey", I.parse_srcset(srcset).alias("c"), I.parse_sizes(F.concat(F.lit("(max-width: 300px) 100vw, "), (F.col("p_size") * 20).cast("string"), F.lit("px"))).alias("slot"))
    return rows.select("p_partkey", I.pick(F.col("c"), F.col("slot"), 1.0).alias("typical"), I.pick(F.col("c"), F.col("slot"), 2.0).alias("retina"))


@query()
def savings(spark: SparkSession, d: str) -> DataFrame:
    """Opportunities, largest first."""
    out = lab.opportunities(X.images(spark, d), X.records(spark, d))
    return out.select("site", "opportunity", F.round("amount", 3).alias("amount")).orderBy(F.desc("amount"), "site", "opportunity")


# --- robots, mail, reputation, structured data -----------------------------------------------------

_ROBOTS = """lines AS (SELECT user_id % 500 AS site, event_id AS e, CASE WHEN event_id % 5 = 0 THEN 'user-agent' WHEN event_id % 5 IN (1, 2) THEN CASE WHEN event_id % 35 = 2 THEN 'allow' ELSE 'disallow' END END AS field,
 CASE WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 3 = 0 THEN '*' ELSE 'bot' || (event_id % 4) END WHEN event_id % 5 = 1 THEN '/' WHEN event_id % 35 = 2 THEN '/open' WHEN event_id % 5 = 2 THEN '/x' END AS value FROM events WHERE user_id IS NOT NULL),
own AS (SELECT *, CASE WHEN field = 'user-agent' AND coalesce(lag(field) OVER (PARTITION BY site ORDER BY e), 'rule') <> 'user-agent' THEN 1 ELSE 0 END AS begins FROM lines WHERE field IS NOT NULL),
grouped AS (SELECT *, sum(begins) OVER (PARTITION BY site ORDER BY e) AS grp FROM own), g AS (SELECT site, grp, bool_or(field = 'disallow' AND value = '/') AND NOT bool_or(field = 'allow' AND value <> '') AS blocks, bool_or(field = 'user-agent' AND value = '*') AS star FROM grouped WHERE grp > 0 GROUP BY ALL)"""


@query("WITH " + _ROBOTS + " SELECT CAST(site AS VARCHAR) AS site, count(*) AS groups, count(*) FILTER (blocks) AS blocking, count(*) FILTER (blocks AND star) AS blocking_search FROM g GROUP BY ALL")
def robots_groups(spark: SparkSession, d: str) -> DataFrame:
    """robots.txt groups: gaps and islands over lines."""
    g = probes.robots_groups(X.robots_bodies(spark, d))
    return g.groupBy("site").agg(F.count(F.lit(1)).alias("groups"), F.count_if("blocks").alias("blocking"), F.count_if("blocks_search").alias("blocking_search"))


@query("""WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN 0 WHEN s_suppkey % 9 = 0 THEN 2 ELSE 1 END AS n FROM supplier)
SELECT 's' || k || '.example.com' AS domain, n > 0 AS spf_present, CAST(n AS BIGINT) AS spf_count, CASE WHEN n > 0 THEN CASE WHEN k % 6 = 0 THEN '~' ELSE ['-', '~', '?', '+'][k % 4 + 1] END END AS spf_all, CASE WHEN n > 0 THEN CASE WHEN k % 6 = 0 THEN 9 ELSE 5 END END::BIGINT AS spf_cost,
 CASE WHEN k % 4 <> 0 THEN ['reject', 'quarantine', 'none'][k % 3 + 1] ELSE '' END AS dmarc_policy, (CASE WHEN k % 3 <> 0 AND k % 8 <> 0 THEN 1 ELSE 0 END)::BIGINT AS dkim_live, (CASE WHEN k % 3 <> 0 AND k % 8 <> 0 AND k % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS dkim_weak, k % 10 <> 0 AND k % 13 <> 0 AS mx_present FROM s""")
def mail_records(spark: SparkSession, d: str) -> DataFrame:
    """SPF with includes and redirects, DMARC, DKIM, MX from DNS answers."""
    out = mail.mail_records(X.mail_domains(spark, d), X.dns_answers(spark, d))
    return out.select("domain", "spf_present", F.col("spf_count").cast("long").alias("spf_count"), "spf_all", "spf_cost", "dmarc_policy", F.col("dkim_live").cast("long").alias("dkim_live"), F.col("dkim_weak").cast("long").alias("dkim_weak"), "mx_present")


@query()
def posture_scores(spark: SparkSession, d: str) -> DataFrame:
    """Spam and phishing posture of every mail domain."""
    return scores.posture_scores(mail.mail_records(X.mail_domains(spark, d), X.dns_answers(spark, d)))


@query("""WITH l AS (SELECT 'u' || user_id || '.example.com' AS host, ['browser', 'gateway', 'mail', 'endpoint', 'feed', 'unknown'][CAST(floor(value) AS BIGINT) % 6 + 1] AS tier, 'Vendor ' || event_type AS vendor FROM events WHERE user_id IS NOT NULL AND coalesce(CAST(floor(value) AS BIGINT) % 7 NOT IN (1, 2, 4, 5, 6), true)),
r AS (SELECT host, coalesce(tier, 'unknown') AS tier, list_position(['browser', 'gateway', 'mail', 'endpoint', 'feed', 'unknown'], coalesce(tier, 'unknown')) AS rank FROM l), w AS (SELECT host, min(rank) AS rank FROM r GROUP BY ALL)
SELECT host, tier AS worst_tier, count(*) AS agree, CASE WHEN tier = 'browser' THEN 'critical' WHEN tier IN ('gateway', 'mail') THEN CASE WHEN count(*) >= 2 THEN 'high' ELSE 'medium' END WHEN tier = 'endpoint' THEN CASE WHEN count(*) >= 2 THEN 'medium' ELSE 'low' END ELSE 'low' END AS grade FROM r JOIN w USING (host, rank) GROUP BY host, tier""")
def reputation_grades(spark: SparkSession, d: str) -> DataFrame:
    """Worst tier, agreement and severity of listings."""
    return probes.reputation_grade(X.listings(spark, d)).select("host", "worst_tier", "agree", "grade")


@query("""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'clean' WHEN event_id % 250 IN (1, 255) THEN 'refused' WHEN event_id % 250 BETWEEN 2 AND 14 THEN 'listed' ELSE 'refused' END AS verdict FROM events""")
def blocklist_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """DNS blocklist answers."""
    e = F.col("event_id")
    addresses = F.when(e % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("127.0.0."), (e % 250).cast("string"))))
    return parquet(spark, d, "events").select("event_id", probes.blocklist_verdict(F.lit("multi.uribl.com"), addresses).alias("verdict"))


@query("""WITH p AS (SELECT p_partkey AS k, lower(p_brand) AS site FROM part), ok AS (SELECT * FROM p WHERE k % 9 <> 0)
SELECT site, code, count(*) AS issues FROM (SELECT site, 'json-parse' AS code FROM p WHERE k % 9 = 0 UNION ALL SELECT site, 'no-context' FROM ok WHERE k % 10 = 0 UNION ALL SELECT site, 'unknown-type' FROM ok WHERE k % 15 = 0 UNION ALL SELECT site, 'money-format' FROM ok WHERE k % 6 = 0 UNION ALL SELECT site, 'invalid-date' FROM ok WHERE k % 8 = 0) GROUP BY ALL""")
def schema_issue_counts(spark: SparkSession, d: str) -> DataFrame:
    """Structured data: issues by code."""
    ship(spark)
    found = structured.record_issues(X.jsonld_records(spark, d), structured.vocabulary(spark))
    return found.filter(F.col("code").isin("json-parse", "no-context", "unknown-type", "money-format", "invalid-date")).groupBy("site", "code").agg(F.count(F.lit(1)).alias("issues"))


# --- windows, top-k, pivots, sets ------------------------------------------------------------------


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_quantity) AS nth FROM lineitem) SELECT l_suppkey, nth, l_orderkey, l_linenumber, l_extendedprice FROM r WHERE nth <= 3""")
def topk_per_key(spark: SparkSession, d: str) -> DataFrame:
    """Per-key caps: the three dearest lines of a supplier."""
    order = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return parquet(spark, d, "lineitem").withColumn("nth", F.row_number().over(order).cast("long")).filter("nth <= 3").select("l_suppkey", "nth", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT user_id, max(value) AS most, arg_max(event_id, (value, -event_id)) AS event_id FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY ALL")
def argmax_per_key(spark: SparkSession, d: str) -> DataFrame:
    e = parquet(spark, d, "events").filter("user_id is not null and value is not null")
    return e.groupBy("user_id").agg(F.max("value").alias("most"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"))


@query("""SELECT user_id, count(*) FILTER (s = 'critical') AS critical, count(*) FILTER (s = 'high') AS high, count(*) FILTER (s = 'medium') AS medium, count(*) FILTER (s = 'low') AS low FROM (SELECT user_id, CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS s FROM events) GROUP BY ALL""")
def severity_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Findings by severity, a column each."""
    e = F.col("event_id") % 4
    rows = parquet(spark, d, "events").select(F.col("user_id").alias("site"), F.when(e == 0, "critical").when(e == 1, "high").when(e == 2, "medium").otherwise("low").alias("severity"))
    return rules.severity_counts(rows).withColumnRenamed("site", "user_id")


@query("""WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS turn FROM events) SELECT event_id, event_type, turn FROM r ORDER BY turn, event_type LIMIT 50""")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    """Quota in turns over groups."""
    out = links.round_robin(parquet(spark, d, "events").select("event_id", "event_type"), "event_type", ["event_id"], 50)
    return out.select("event_id", "event_type", F.col("turn").cast("long").alias("turn"))


@query("""SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY ALL""")
def json_field_histogram(spark: SparkSession, d: str) -> DataFrame:
    """JSON projection and a histogram over it."""
    k = F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')")
    return parquet(spark, d, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"))


@query("SELECT DISTINCT o_custkey AS custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def anti_join_targets(spark: SparkSession, d: str) -> DataFrame:
    """Targets that were not read yet."""
    seen = parquet(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("custkey"))
    return parquet(spark, d, "orders").select(F.col("o_custkey").alias("custkey")).distinct().join(seen, "custkey", "left_anti")


# --- crawl -----------------------------------------------------------------------------------------


@query(_BFS + ", inb AS (SELECT nodes.url, count(dst) AS inbound FROM nodes LEFT JOIN pairs ON dst = nodes.url GROUP BY ALL), r AS (SELECT url, row_number() OVER (ORDER BY url = (SELECT url FROM home) DESC, inbound DESC, url) AS rank FROM inb) SELECT url, rank FROM r WHERE rank <= 6")
def picked_pages(spark: SparkSession, d: str) -> DataFrame:
    """Home page and the most linked pages."""
    counts = graph.inbound_counts(X.graph_nodes(spark, d), X.graph_edges(spark, d))
    return crawl.pick_pages(counts, X.graph_home(spark, d)).select("url", F.col("rank").cast("long").alias("rank"))


@query(_BFS + " SELECT url, CASE WHEN depth = 0 THEN 'sitemap' ELSE 'link' END AS found, depth AS round FROM depths")
def frontier_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Crawl loop: pages found by links, round by round; no site reaches the limit here."""
    out = crawl.expand_frontier(X.graph_home(spark, d), X.graph_nodes(spark, d), X.graph_edges(spark, d), max_pages=1_000_000_000)
    return out.select("url", "found", F.col("round").cast("long").alias("round"))


@query("WITH {edges}, p AS (SELECT DISTINCT src, dst, anchor = 'N' AS body FROM edges WHERE src <> dst) SELECT dst AS url, count(DISTINCT src) AS inbound_all FROM p GROUP BY ALL HAVING count(*) FILTER (body) = 0")
def nav_only_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages that menus alone link to; the anchor column tells body from chrome."""
    edges = X.graph_edges(spark, d).withColumn("region", F.when(F.col("anchor") == "N", "body").otherwise("chrome"))
    return crawl.nav_only(edges).select("url", "inbound_all")


@query("SELECT l_orderkey AS page, round(sum(l_extendedprice), 4) AS total, round(sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END), 4) AS a FROM lineitem GROUP BY ALL")
def resource_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of a page by resource type."""
    rows = parquet(spark, d, "lineitem").select(F.lit("s").alias("site"), F.col("l_orderkey").alias("url"), F.col("l_returnflag").alias("type"), F.col("l_extendedprice").alias("bytes"))
    return crawl.resource_bytes(rows).select(F.col("url").alias("page"), F.round("total", 4).alias("total"), F.round(F.col("by_type")["A"], 4).alias("a"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'https://e.com/author/u' || event_id || '/' ELSE 'https://e.com/' END AS final_url, CASE WHEN event_id % 5 = 0 THEN 404 ELSE 200 END AS status, coalesce(value, 0) * 100 AS bytes FROM events)
SELECT event_id, CASE WHEN final_url LIKE '%/author/%' THEN 'confirmed' WHEN status = 200 AND NOT (bytes > 0 AND abs(bytes - 3000) <= 512) THEN 'unclear' ELSE 'no evidence' END AS verdict FROM e""")
def author_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """User-enumeration probes."""
    e = F.col("event_id")
    final = F.when(e % 3 == 0, F.concat(F.lit("https://e.com/author/u"), e.cast("string"), F.lit("/"))).otherwise("https://e.com/")
    verdict = crawl.author_verdict(F.when(e % 5 == 0, 404).otherwise(200), final, F.coalesce("value", F.lit(0.0)) * 100, F.lit(""), F.lit(3000.0), F.lit("Home"))
    return parquet(spark, d, "events").select("event_id", verdict.alias("verdict"))


from plumbline.plans import answers as _answers  # noqa: E402,F401  registers its queries and those of findings
from plumbline.plans import heads as _heads  # noqa: E402,F401  registers its queries
from plumbline.plans import sizing as _sizing  # noqa: E402,F401  registers its queries
from plumbline.plans import markups as _markups  # noqa: E402,F401  registers its queries
from plumbline.plans import discovery as _discovery  # noqa: E402,F401  registers its queries
from plumbline.plans import copying as _copying  # noqa: E402,F401  registers its queries
