"""Structured data written into markup, Microdata and RDFa, as the same node rows that JSON-LD gives.

An item of Microdata is a tree of scopes: an element with itemscope owns the itemprop elements below it down
to the next scopes.  RDFa is read as far as names go: each element with typeof, with the properties of all
elements inside it, those of items in it included.  One pass over a page keeps a stack of open elements and
one list of text pieces, in which the text of a property is a range.

Properties whose text is collected may lie MAX_NESTED deep in each other, typed RDFa elements likewise; what
lies deeper is left out, and a row with the code too-deep says so.
"""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.blocks import HIDDEN, VOID
from plumbline.operators.structured import NODE, NODE_COLUMNS, term_name, walk_node
from plumbline.session import spread

# Attributes that hold a property's value, by element.
LINKED = {"a": "href", "area": "href", "link": "href", "audio": "src", "embed": "src", "iframe": "src", "img": "src", "source": "src", "track": "src", "video": "src", "object": "data"}
SAID = {"data": "value", "meter": "value", "time": "datetime"}
MAX_NESTED = 32
#: Block numbers of markup begin here, behind those of a page's JSON-LD.
FIRST_BLOCK = 1 << 20


class _Items(HTMLParser):
    """roots: Microdata items in the form of JSON-LD objects; typed: (types, properties) of RDFa elements."""

    def __init__(self, base: str) -> None:
        super().__init__(convert_charrefs=True)
        self.base = base
        self.stack: list[tuple] = []  # tag, innermost scope, typed elements around, place of a text property
        self.open: Counter = Counter()
        self.pieces: list[str] = []
        self.hidden = self.nested = 0
        self.deep = False
        self.roots: list[dict] = []
        self.typed: list[tuple[list[str], list[str]]] = []

    def _resolved(self, ref: str) -> str:
        try:
            return urljoin(self.base, ref.strip())
        except ValueError:
            return ref.strip()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        names = {k: v or "" for k, v in reversed(attrs)}  # the first of equal attributes counts
        scope, around = (self.stack[-1][1], self.stack[-1][2]) if self.stack else (None, ())
        item, text_at = None, None
        if "itemscope" in names:
            item = {}
            if types := names.get("itemtype", "").split():
                item["@type"] = types
            if names.get("itemid"):
                item["@id"] = names["itemid"]
            if scope is None:
                self.roots.append(item)
        if scope is not None and (props := names.get("itemprop", "").split()):
            text_at = self._property(tag, names, scope, props, item)
        for prop in names.get("property", "").split():
            for _, own in around:
                own.append(prop)
        if types := names.get("typeof", "").split():
            if len(around) < MAX_NESTED:
                around = (*around, (types, []))
                self.typed.append(around[-1])
            else:
                self.deep = True
        if tag not in VOID:
            self.hidden += tag in HIDDEN
            self.open[tag] += 1
            self.nested += text_at is not None
            self.stack.append((tag, item if item is not None else scope, around, text_at))

    def _property(self, tag: str, names: dict, scope: dict, props: list[str], item: dict | None) -> tuple | None:
        """Give a scope a property's value, or say where its text begins."""
        if item is not None:
            value = item
        elif names.get(LINKED.get(tag, "")) is not None:
            value = self._resolved(names[LINKED[tag]])
        elif tag == "meta":
            value = names.get("content", "").strip()
        elif names.get(SAID.get(tag, "")) is not None:
            value = names[SAID[tag]].strip()
        else:
            value = ""
            if tag not in VOID:
                self.deep |= self.nested >= MAX_NESTED
                places = [(p, len(scope.setdefault(p, []))) for p in props]
                for p in props:
                    scope[p].append("")
                return (scope, places, len(self.pieces)) if self.nested < MAX_NESTED else None
        for p in props:
            scope.setdefault(p, []).append(value)
        return None

    def handle_endtag(self, tag: str) -> None:
        if not self.open[tag]:
            return
        while self.stack:
            if self._close(self.stack.pop()) == tag:
                return

    def _close(self, element: tuple) -> str:
        tag, _, _, text_at = element
        self.open[tag] -= 1
        self.hidden -= tag in HIDDEN
        if text_at is not None:
            self.nested -= 1
            scope, places, first = text_at
            text = " ".join(self.pieces[first:])
            for prop, i in places:
                scope[prop][i] = text
        return tag

    def handle_data(self, data: str) -> None:
        if not self.hidden and (own := data.strip()):
            self.pieces.append(own)

    def close(self) -> None:
        super().close()
        while self.stack:
            self._close(self.stack.pop())


def markup_of(html: str | None, base: str) -> list[tuple]:
    """The nodes of a page's Microdata and RDFa, in the order of NODE, without site and url."""
    parser = _Items(base)
    parser.feed(html or "")
    parser.close()
    out: list[tuple] = []
    for n, root in enumerate(parser.roots):
        nodes: list[tuple] = []
        walk_node(nodes, FIRST_BLOCK + n, root, f"microdata:{n}", 0, None, [], True, None)
        out += nodes
    numbered = ((name, props) for types, props in parser.typed for name in types)
    for n, (raw, props) in enumerate(numbered, FIRST_BLOCK + len(parser.roots)):
        if name := term_name(raw):
            own = [{"prop": term_name(p), "kind": "name", "value": ""} for p in props if term_name(p)]
            out.append((n, f"rdfa:{n - FIRST_BLOCK - len(parser.roots)}", 0, 0, None, [name], [[name]], None, True, False, False, own, None))
    if parser.deep:
        out.append((FIRST_BLOCK + len(out), "markup", 0, 0, None, [], [], None, False, False, False, [], "too-deep"))
    return out


def markup_nodes(records: DataFrame) -> DataFrame:
    """A row per node of the pages that hold Microdata or RDFa; others are not parsed."""

    def extract(batches):
        for frame in batches:
            rows = [(site, url, *node) for site, url, html, base in zip(frame["site"], frame["url"], frame["html"], frame["base_url"], strict=True) for node in markup_of(html, base or url or "")]
            yield pd.DataFrame(rows, columns=NODE_COLUMNS)

    held = records.filter(F.col("html").rlike(r"(?i)\sitemscope|\stypeof")).select("site", "url", "html", "base_url")
    return spread(held).mapInPandas(extract, NODE)


def page_nodes(records: DataFrame) -> DataFrame:
    """The nodes of all three syntaxes."""
    from plumbline.operators.structured import jsonld_nodes

    return jsonld_nodes(records).unionByName(markup_nodes(records))
