"""Registered queries of the copy rules over text blocks of pages, beside their SQL.

The pages are the documents: a line is a paragraph, whose first sentence is an element of its own, so that
two runs meet without a blank.  Faults that the documents lack are planted by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.copy import DOUBLED_FINE, ENTITY, MOJIBAKE, NOT_A_SENTENCE, PLACEHOLDERS, TYPOS
from plumbline.operators import blocks, rules
from plumbline.operators.records import page_records
from plumbline.plans.catalog import query
from plumbline.session import cut, ship, spread
from plumbline.sources.tables import parquet

#: doc_id is divisible by the number -> a paragraph in runs, joined without blanks.
PLANTED = {
    4: ["The tax is set , and the wheels arrive later"],
    5: ["Those subscriptions lapse.", "Returning a contract is required.If not, see Contoso.Net today"],
    6: ["Who wants to&nbsp;Register with the office"],
    7: ["Distributed wheels cost more more than a permit"],
    9: ["TO", "DO nothing here"],
    11: ["TODO write this paragraph"],
    12: ["Wheels are sent (within a week"],
    13: ["EVERYTHING ABOUT OUR DELIVERY SERVICE"],
    16: ["Dispatched", ". New carriers follow"],
}
_TITLE, _DESCRIPTION, _DAMAGED, _PHONE = 8, 14, 15, "555-010-0199"


def _escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def copy_pages(spark: SparkSession, d: str) -> DataFrame:
    """page_id, url, html."""
    ship(spark)
    k = F.col("doc_id")

    def element(runs: list[Column]) -> Column:
        inner = [F.concat(F.lit("<span>"), _escaped(r), F.lit("</span>")) for r in runs] if len(runs) > 1 else [_escaped(runs[0])]
        return F.concat(F.lit("<p>"), *inner, F.lit("</p>"))

    def paragraph(line: Column) -> Column:
        at = F.locate(". ", line)
        return F.when(at > 0, element([F.substring(line, F.lit(1), at), F.substring(line, at + 2, F.length(line))])).otherwise(element([line]))

    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), paragraph)
    planted = F.concat(*[F.when(k % n == 0, element([F.lit(r) for r in runs])).otherwise("") for n, runs in PLANTED.items()], F.when(k % 3 != 0, f"<p>Call {_PHONE} today</p>").otherwise(""))
    title = F.when(k % _TITLE == 0, "We recieve parcels").otherwise("Parcels")
    description = F.when(k % _DESCRIPTION == 0, "Wheels  sent today").otherwise("Wheels sent today")
    damaged = F.when(k % _DAMAGED == 0, f"<!-- {MOJIBAKE[0]} -->").otherwise("")
    html = F.concat(F.lit("<html><head><title>"), title, F.lit('</title><meta name="description" content="'), description, F.lit('"></head><body>'), damaged, F.lit("<main>"), F.array_join(lines, ""), planted, F.lit("</main></body></html>"))
    return spread(parquet(spark, d, "documents")).select(k.alias("page_id"), F.concat(F.lit("https://"), "source", F.lit("/"), k.cast("string")).alias("url"), html.alias("html"))


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "(" + ", ".join(map(_quote, values)) + ")"


_RUNS = (
    r"""src AS (SELECT doc_id AS k, source, coalesce(text, '') AS text FROM documents),
lines AS (SELECT k, source, row_number() OVER () AS block, line FROM (SELECT k, source, unnest(string_split(text, chr(10))) AS line FROM src)),
halves AS (SELECT k, source, block, 0 AS run, CASE WHEN contains(line, '. ') THEN substr(line, 1, instr(line, '. ')) ELSE line END AS raw FROM lines
 UNION ALL SELECT k, source, block, 1, substr(line, instr(line, '. ') + 2) FROM lines WHERE contains(line, '. ')
 """
    + " ".join(f"UNION ALL SELECT k, source, -{n}, {i}, {_quote(r)} FROM src WHERE k % {n} = 0" for n, runs in PLANTED.items() for i, r in enumerate(runs))
    + rf""" UNION ALL SELECT k, source, -98, 0, 'Call {_PHONE} today' FROM src WHERE k % 3 <> 0),
runs AS (SELECT k, source, block, run, regexp_replace(raw, '\s+', ' ', 'g') AS run_text FROM halves),
blocks AS (SELECT k, source, trim(regexp_replace(string_agg(run_text, '' ORDER BY run), '\s+', ' ', 'g')) AS text, trim(regexp_replace(string_agg(run_text, ' ' ORDER BY run), '\s+', ' ', 'g')) AS spaced FROM runs GROUP BY k, source, block
 UNION ALL SELECT k, source, trim(run_text), trim(run_text) FROM runs SEMI JOIN (SELECT k, block FROM runs WHERE run = 1) USING (k, block)
 UNION ALL SELECT k, source, t, t FROM (SELECT k, source, CASE WHEN k % {_TITLE} = 0 THEN 'We recieve parcels' ELSE 'Parcels' END AS t FROM src) UNION ALL SELECT k, source, t, t FROM (SELECT k, source, CASE WHEN k % {_DESCRIPTION} = 0 THEN 'Wheels  sent today' ELSE 'Wheels sent today' END AS t FROM src)),
long AS (SELECT * FROM blocks WHERE length(text) >= 3),
judged AS (SELECT r.* FROM runs r JOIN (SELECT k, block FROM runs GROUP BY k, block HAVING length(trim(regexp_replace(string_agg(run_text, '' ORDER BY run), '\s+', ' ', 'g'))) >= 3) USING (k, block)),
slips AS (SELECT k, source, unnest(regexp_extract_all(regexp_replace(run_text, '{ENTITY}', '', 'g'), '[a-z]{{2}}[.,;!?][A-Z][a-zA-Z]*')) AS slip FROM judged),
pairs AS (SELECT k, source, w[i] AS a, w[i + 1] AS b FROM (SELECT k, source, w, unnest(range(1, len(w))) AS i FROM (SELECT k, source, string_split(lower(text), ' ') AS w FROM long)))"""
)
_PROSE = [(p, label) for p, label in PLACEHOLDERS if p.startswith("(?i)")]
_TOKENS = [(p.replace("(?<![A-Za-z0-9])", "(?:^|[^A-Za-z0-9])").replace("(?![A-Za-z0-9])", "(?:[^A-Za-z0-9]|$)"), label) for p, label in PLACEHOLDERS if not p.startswith("(?i)")]


def _values(rows: list[tuple[str, str]]) -> str:
    return "(VALUES " + ", ".join(f"({_quote(a)}, {_quote(b)})" for a, b in rows) + ")"


_HITS = rf"""hits AS (
 SELECT 'CNT-01' AS finding, label AS what, source, k FROM long, {_values(_PROSE)} v(p, label) WHERE regexp_matches(text, p) UNION ALL SELECT 'CNT-01', label, source, k FROM long, {_values(_TOKENS)} v(p, label) WHERE regexp_matches(spaced, p)
 UNION ALL SELECT 'CNT-02', regexp_extract(lower(text), p, 0) || ' -> ' || fix, source, k FROM long, {_values(list(TYPOS))} v(p, fix) WHERE regexp_matches(lower(text), p)
 UNION ALL SELECT 'CNT-03', w, source, k FROM (SELECT k, source, b, regexp_extract(a, '(?:^|[^-''’\p{{L}}\p{{N}}\p{{M}}_])(\p{{L}}{{2,}})$', 1) AS w FROM pairs) WHERE w <> '' AND regexp_extract(b, '^(\p{{L}}{{2,}})(?:[^-''’\p{{L}}\p{{N}}\p{{M}}_]|$)', 1) = w AND w NOT IN {_list(DOUBLED_FINE)}
 UNION ALL SELECT 'CNT-04', '{MOJIBAKE[0]}', source, k FROM src WHERE k % {_DAMAGED} = 0 UNION ALL SELECT 'CNT-04', m, source, k FROM src, (SELECT unnest({list(MOJIBAKE)}) AS m) WHERE contains(text, m) OR (k % {_DAMAGED} = 0 AND contains('{MOJIBAKE[0]}', m))
 UNION ALL SELECT 'CNT-05', 'Space before a punctuation mark', source, k FROM judged WHERE regexp_matches(run_text, '.\s+[,.;:!?](?:\s|$)')
 UNION ALL SELECT 'CNT-05', 'Missing space after punctuation', source, k FROM slips WHERE lower(substr(slip, 4)) NOT IN {_list(NOT_A_SENTENCE)}
 UNION ALL SELECT 'CNT-05', 'Double space inside a sentence', source, k FROM long WHERE regexp_matches(text, '\S {{2,}}\S')
 UNION ALL SELECT 'CNT-05', 'Unbalanced parentheses', source, k FROM long WHERE length(text) - length(replace(text, '(', '')) <> length(text) - length(replace(text, ')', ''))
 UNION ALL SELECT 'CNT-06', 'Sentence set entirely in capitals', source, k FROM long WHERE length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 25 AND upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) = regexp_replace(text, '[^A-Za-z]', '', 'g')
 UNION ALL SELECT 'CNT-10', 'HTML entity left in the text', source, k FROM long WHERE regexp_matches(text, '{ENTITY}'))"""


@query("WITH " + _RUNS + ", " + _HITS + " SELECT finding, what, count(DISTINCT source || '/' || k) AS urls FROM hits GROUP BY ALL")
def copy_findings(spark: SparkSession, d: str) -> DataFrame:
    """Copy rules over the text blocks of pages, over their runs where a rule asks what stands side by side."""
    records = page_records(copy_pages(spark, d))
    signals = cut(rules.page_signals(records), "signals")  # read by each rule
    hits = rules.run(rules.Frames(records, signals=signals), ["CNT-01", "CNT-02", "CNT-03", "CNT-04", "CNT-05", "CNT-06", "CNT-10"])
    what = F.regexp_replace(F.regexp_replace("detail", "(?s): “.*", ""), " x [0-9]+$", "")
    return hits.groupBy("finding", what.alias("what")).agg(F.count_distinct("url").alias("urls"))


@query("WITH " + _RUNS + """, n AS (SELECT source, count(*) AS pages FROM src GROUP BY ALL),
each AS (SELECT DISTINCT source, k, unnest(regexp_extract_all(text || ' x ' || CASE WHEN k % 3 <> 0 THEN 'Call 555-010-0199 today' ELSE '' END, '\\+?\\(?[0-9]{3}\\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}')) AS phone FROM src),
counted AS (SELECT source, phone, count(*) AS k, 2 * count(*) >= any_value(pages) AS common FROM each JOIN n USING (source) GROUP BY source, phone)
SELECT source AS site, phone, c.k AS urls FROM counted c WHERE NOT common AND source IN (SELECT source FROM counted WHERE common)""")
def phone_outlier_findings(spark: SparkSession, d: str) -> DataFrame:
    """Phone numbers of few pages of a site whose others name another one."""
    from plumbline.operators.records import PHONE

    k = F.col("doc_id")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" x "), F.when(k % 3 != 0, f"Call {_PHONE} today").otherwise(""))
    phones = F.array_distinct(F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)))
    pages = parquet(spark, d, "documents").select(F.col("source").alias("site"), k.cast("string").alias("url"), phones.alias("phones"), F.lit(True).alias("is_page"))
    return rules.run(rules.Frames(pages), ["CNT-07"]).groupBy("site", F.col("detail").alias("phone")).agg(F.count_distinct("url").alias("urls"))


@query("WITH " + _RUNS + """ SELECT source AS site, CAST(count(*) AS BIGINT) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars FROM long GROUP BY source""")
def copy_block_counts(spark: SparkSession, d: str) -> DataFrame:
    """HTML block walk: text blocks of those pages, title and description among them."""
    found = blocks.text_blocks(page_records(copy_pages(spark, d)))
    return found.groupBy("site").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).alias("chars"))
