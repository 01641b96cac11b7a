"""Text blocks of pages with their region, by an HTML parser in Arrow batches, and spelling over them."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut, spread, unnest

# Fixed values.
BLOCK_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p li td th figcaption blockquote button label a span".split())
HOLDING = frozenset("p li h1 h2 h3 h4 h5 h6".split())
CHROME_TAGS = frozenset(("nav", "header", "footer"))
CHROME_HINTS = ("menu", "navbar", "site-header", "site-footer", "breadcrumb", "sidebar")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(("script", "style", "template"))
#: Block elements that may lie in each other.
MAX_NESTED = 32
BLOCK = "site string, url string, block_no int, region string, tag string, text string, runs array<string>"


class _Blocks(HTMLParser):
    """Keeps a stack of open elements over one list of text runs (a run a text node), in which an element is a
    range.  A block closes with its element unless a block-holding element lay inside.  Blocks of the first
    main or article are kept apart, as they replace the page's.

    Of block elements nested in each other only the outer MAX_NESTED are blocks, so the output is at most so
    many times the page's text; a page that goes deeper says so in a row of its own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # tag, chrome above?, chrome within?, in main?, order, first run (None: no block), holders seen before
        self.stack: list[tuple] = []
        self.open: Counter = Counter()
        self.runs: list[str] = []
        self.hidden = self.order = self.main = self.holders = self.nested = 0
        self.joins = self.too_deep = False
        self.done: list[tuple] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.joins = False
        if tag == "br" and not self.hidden:
            self.runs.append(" ")
        if tag in VOID:
            return
        self.hidden += tag in HIDDEN
        own = tag in CHROME_TAGS
        if attrs and not own and tag not in ("body", "html"):
            names = dict(attrs)
            ident = f"{names.get('class') or ''} {names.get('id') or ''}".lower()
            own = any(h in ident for h in CHROME_HINTS)
        above, root = (self.stack[-1][2], self.stack[-1][3]) if self.stack else (False, 0)
        if tag in ("main", "article") and not root and not self.main:
            root = self.main = 1
        self.holders += tag in HOLDING
        first = None
        if tag in BLOCK_TAGS:
            self.nested += 1
            first = len(self.runs) if self.nested <= MAX_NESTED else None
            self.too_deep |= first is None
        self.order += 1
        self.open[tag] += 1
        self.stack.append((tag, above, above or own, root, self.order, first, self.holders))

    def handle_endtag(self, tag: str) -> None:
        self.joins = False
        if not self.open[tag]:
            return
        while self.stack:
            if self._close(self.stack.pop()) == tag:
                return

    def _close(self, element: tuple) -> str:
        tag, above, _, root, order, first, holders = element
        self.open[tag] -= 1
        self.hidden -= tag in HIDDEN
        self.nested -= tag in BLOCK_TAGS
        if first is not None and holders == self.holders:
            runs = self.runs[first:]
            text = " ".join("".join(runs).split())
            if len(text) >= 3:
                self.done.append((order, root, "chrome" if above else "body", tag, text, runs))
        return tag

    def handle_comment(self, data: str) -> None:
        self.joins = False

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if self.joins and self.runs:
            self.runs[-1] = collapsed(self.runs[-1] + data)
        else:
            self.runs.append(collapsed(data))
        self.joins = True

    def blocks(self) -> list[tuple]:
        while self.stack:
            self._close(self.stack.pop())
        kept = sorted(b for b in self.done if b[1] or not self.main)
        return kept + [(self.order + 1, 0, "error", "nesting", f"more than {MAX_NESTED} text elements lie in each other", [])] * self.too_deep


def collapsed(text: str) -> str:
    """White space as single blanks."""
    inner = " ".join(text.split())
    if not inner:
        return " " if text else ""
    return (" " if text[0].isspace() else "") + inner + (" " if text[-1].isspace() else "")


#: Text and the tag behind it, both of a kind that reads the same to any parser.
_PLAIN = re.compile(r"""([^<]*)<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s+[A-Za-z][A-Za-z-]*="[^"<>&]*")*)\s*>""", re.ASCII)
_ATTRIBUTE = re.compile(r"""([A-Za-z-]+)="([^"]*)\"""", re.ASCII)
#: Elements whose text a parser reads by other rules.
_RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript plaintext svg math".split())


def _read_plain(parser: _Blocks, html: str) -> bool:
    """Hand a page that is made of plain tags and text to the parser's handlers; false, and a parser to be thrown
    away, if any part of it is not."""
    at, end, step = 0, len(html), _PLAIN.match
    raw = ""
    while at < end:
        found = step(html, at)
        if not found:
            break
        text, closing, tag, attributes = found.groups()
        tag = tag.lower()
        if raw and not (closing and tag == raw):
            return False
        if text:
            parser.handle_data(unescape(text) if "&" in text else text)
        if closing:
            if attributes:
                return False
            raw = ""
            parser.handle_endtag(tag)
        else:
            if tag in _RAW:
                if tag != "title":
                    return False
                raw = tag
            parser.handle_starttag(tag, [(k.lower(), v) for k, v in _ATTRIBUTE.findall(attributes)] if attributes else ())
        at = found.end()
    if raw or html.find("<", at) >= 0:
        return False
    if at < end:
        parser.handle_data(unescape(html[at:]))
    return True


def blocks_of(html: str | None) -> list[tuple]:
    parser = _Blocks()
    if not _read_plain(parser, html or ""):
        parser = _Blocks()
        parser.feed(html or "")
        parser.close()
    return parser.blocks()


def text_blocks(records: DataFrame) -> DataFrame:
    """site, url, block_no, region (body, chrome, meta; error: the page could not be read as a whole), tag, text,
    runs of every page.  Title and description are blocks, behind those of the page."""

    def extract(batches):
        for batch in batches:
            found = [blocks_of(html) for html in batch["html"].to_pylist()]
            page = pa.array(np.repeat(np.arange(len(found)), [len(own) for own in found]))
            numbers = pa.array([n for own in found for n in range(len(own))], pa.int32())
            columns = [pa.array([b[i] for own in found for b in own], kind) for i, kind in ((2, pa.string()), (3, pa.string()), (4, pa.string()), (5, pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([batch["site"].take(page), batch["url"].take(page), numbers, *columns], names=["site", "url", "block_no", "region", "tag", "text", "runs"])

    found = spread(records.select("site", "url", "html")).mapInArrow(extract, BLOCK)
    metas = [(n, tag, F.col(c)) for n, tag, c in ((-2, "title", "title"), (-1, "description", "meta_description")) if c in records.columns]
    if not metas:
        return found
    parts = F.array(*[F.struct(F.lit(n).alias("block_no"), F.lit(tag).alias("tag"), text.alias("text")) for n, tag, text in metas])
    rows = records.select("site", "url", F.explode(F.filter(parts, lambda m: F.coalesce(m.text, F.lit("")) != "")).alias("m"))
    return found.unionByName(rows.select("site", "url", "m.block_no", F.lit("meta").alias("region"), "m.tag", "m.text", F.array("m.text").alias("runs")))


def block_signals(blocks: DataFrame) -> DataFrame:
    """Copy faults of blocks, once a page for each kind and key (what is quoted, and where a rule judges places):
    site, url, kind, detail, block, block_no.  A paragraph and the span inside it are two blocks, so what is
    quoted from a run counts once a page, wherever it stands."""
    from plumbline.functions.copy import copy_signals

    own = blocks.filter("region <> 'error'")
    each = unnest(own, "s", copy_signals(F.col("text"), F.col("runs")), "site", "url", "block_no", F.concat_ws(":", "region", "tag").alias("block"))
    key = F.concat(F.when(F.col("s.placed"), F.col("block")).otherwise(F.lit("")), F.lit("|"), "s.key")
    first = F.min(F.struct(F.when(F.col("block_no") < 0, F.col("block_no") + (1 << 30)).otherwise(F.col("block_no")).alias("at"), F.col("block_no"), F.col("s.detail").alias("detail"), F.col("block")))
    return each.groupBy("site", "url", "s.kind", key.alias("key")).agg(first.alias("f")).select("site", "url", "kind", "f.detail", "f.block", "f.block_no")


def deletions(word: Column) -> Column:
    """The word and all forms with one letter less: words within one edit share one of them."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), cut))


def within_one_edit(a: Column, b: Column) -> Column:
    """One insertion, deletion, replacement or exchange of neighbours apart (or equal)."""
    swapped = F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b)
    return (F.levenshtein(a, b) <= 1) | ((F.length(a) == F.length(b)) & swapped)


def spelling(words: DataFrame, dictionary: DataFrame, most: int = 3) -> DataFrame:
    """words: site, url, word, n, lower (seen in lower case?) -> words of no dictionary with a
    dictionary word one edit away: site, url, word, suggestions (by frequency).

    dictionary: word, frequency.  Candidates meet on shared deletions, so no pair of words is compared
    that has none; distinct unknown words are judged once, whatever the number of pages.  A word more than a
    letter longer than the dictionary's longest is one edit from none of them and is not cut."""
    # written once: Spark knows the dictionary's size, and no word is cut out of a text again
    dictionary = cut(dictionary.select("word", "frequency"), "dictionary")
    known = dictionary.select("word")
    longest = dictionary.agg(F.max(F.length("word"))).first()[0] or 0  # one number
    asked = words.filter("lower and length(word) >= 2").join(known, "word", "left_anti")
    bare = F.regexp_replace("word", "'s$", "")
    asked = asked.withColumn("_bare", bare).join(known.select(F.col("word").alias("_bare")).withColumn("_known", F.lit(True)), "_bare", "left").filter("not (word like '%\\'s' and _known)").drop("_bare", "_known")
    asked = cut(asked.select("site", "url", "word", "n"), "asked")
    unknown = unnest(asked.select("word").filter(F.length("word") <= longest + 1).distinct(), "form", deletions(F.col("word")), "word")
    near = cut(unnest(dictionary, "form", deletions(F.col("word")), F.col("word").alias("near"), "frequency"), "near")
    pairs = unknown.join(near, "form").select("word", "near", "frequency").distinct().filter(within_one_edit(F.col("word"), F.col("near")))
    ranked = pairs.groupBy("word").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("frequency")).alias("f"), F.col("near")))), lambda x: x.near), 1, most).alias("suggestions"))
    return asked.join(ranked, "word").select("site", "url", "word", "n", "suggestions")


def page_words(blocks: DataFrame) -> DataFrame:
    """Candidate words of the body copy, a row a page and word: site, url, word, n, lower."""
    tokens = unnest(blocks.filter("region = 'body'"), "w", F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z'’-]*[A-Za-z]"), F.lit(0)), "site", "url")
    each = tokens.select("site", "url", F.lower(F.translate("w", "’", "'")).alias("word"), F.substring("w", 1, 1).rlike("[a-z]").alias("low"), F.expr("substring(w, 2)").rlike("[A-Z]").alias("camel"))
    return each.groupBy("site", "url", "word").agg(F.count(F.lit(1)).alias("n"), (F.bool_or("low") & ~F.bool_or("camel")).alias("lower"))
