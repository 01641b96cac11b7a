"""Responsive images: srcset and sizes attributes, and the candidate a browser takes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VIEWPORT = (1440.0, 900.0)
CANDIDATES = T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("width", T.DoubleType()), T.StructField("density", T.DoubleType())]))
_NUMBER = re.compile(r"([0-9]*\.?[0-9]+)([wx])", re.I)
_LENGTH = re.compile(r"([-+]?[0-9]*\.?[0-9]+)([a-z%]*)", re.I)
_FEATURE = re.compile(r"\(\s*(min|max)-(width|height)\s*:\s*([0-9]*\.?[0-9]+)(px|em|rem)\s*\)", re.I)
_PX = {"px": 1.0, "": 1.0, "em": 16.0, "rem": 16.0, "pt": 4 / 3, "in": 96.0, "cm": 96 / 2.54, "mm": 9.6 / 2.54, "vw": VIEWPORT[0] / 100, "vh": VIEWPORT[1] / 100, "%": VIEWPORT[0] / 100}


def _top_level(text: str, at: str = ",") -> list[str]:
    out, depth, begin = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == at and depth <= 0:
            out.append(text[begin:i])
            begin = i + 1
    return [*out, text[begin:]]


def candidates_of(value: str | None) -> list[dict]:
    """Candidates in order.  URLs run to the next white space, so they may hold commas; a comma ends a
    URL without descriptor; `h` descriptors are ignored."""
    out, rest = [], (value or "").strip(" \t\r\n,")
    while rest:
        url, _, tail = rest.partition(" ") if not (m := re.search(r"\s", rest)) else (rest[: m.start()], "", rest[m.end() :])
        if url.endswith(","):
            descriptor, rest = "", tail
        else:
            descriptor = _top_level(tail)[0]
            rest = tail[len(descriptor) + 1 :]
        rest = rest.lstrip(" \t\r\n,")
        found = {m[2].lower(): float(m[1]) for t in descriptor.split() if (m := _NUMBER.fullmatch(t))}
        if url.strip(","):
            out.append({"url": url.rstrip(","), "width": found.get("w") or None, "density": found.get("x") or None})
    return out


def length_px(text: str) -> float | None:
    """A CSS length in px; calc() with sums, differences and factors."""
    text = text.strip().lower()
    if m := re.fullmatch(r"(?:-webkit-|-moz-)?calc\((.*)\)", text, re.S):
        text = m[1]
    elif not _LENGTH.fullmatch(text):
        return None
    tokens = re.findall(r"[0-9]*\.?[0-9]+[a-z%]*|[-+*/()]", text)

    def total(i: int) -> tuple[float | None, int]:
        value, i = product(i)
        while i < len(tokens) and tokens[i] in "+-":
            other, j = product(i + 1)
            value = None if value is None or other is None else value + other if tokens[i] == "+" else value - other
            i = j
        return value, i

    def product(i: int) -> tuple[float | None, int]:
        value, i = atom(i)
        while i < len(tokens) and tokens[i] in "*/":
            other, j = atom(i + 1)
            value = None if value is None or other is None or (tokens[i] == "/" and not other) else value * other if tokens[i] == "*" else value / other
            i = j
        return value, i

    def atom(i: int) -> tuple[float | None, int]:
        if i >= len(tokens):
            return None, i
        if tokens[i] == "(":
            value, i = total(i + 1)
            return value, i + 1
        if tokens[i] == "-":
            value, i = atom(i + 1)
            return None if value is None else -value, i
        m = _LENGTH.fullmatch(tokens[i])
        return (float(m[1]) * _PX[m[2]] if m and m[2] in _PX else None), i + 1

    return total(0)[0]


def media_matches(condition: str) -> bool | None:
    """Media condition at the nominal viewport: True, False, or None where it cannot be told."""
    text = condition.strip().lower()
    if not text or text in ("all", "screen"):
        return True
    if text == "print":
        return False
    if len(parts := _top_level(text)) > 1:
        return _any([media_matches(p) for p in parts])
    if text.startswith("not "):
        inner = media_matches(text[4:])
        return None if inner is None else not inner
    for word, join in (("or", _any), ("and", _all)):
        parts = re.split(rf"\s+{word}\s+(?![^()]*\))", text)
        if len(parts) > 1:
            return join([media_matches(p) for p in parts])
    if m := _FEATURE.fullmatch(text):
        size, own = float(m[3]) * _PX[m[4]], VIEWPORT[m[2] == "height"]
        return own >= size if m[1] == "min" else own <= size
    if text.startswith("(") and text.endswith(")") and "(" in text[1:]:
        return media_matches(text[1:-1])
    return None


def _any(values: list[bool | None]) -> bool | None:
    return True if True in values else None if None in values else False


def _all(values: list[bool | None]) -> bool | None:
    return False if False in values else None if None in values else True


def slot_of(value: str | None) -> float | None:
    """Slot width of a sizes attribute: the first entry whose condition holds."""
    for entry in _top_level(value or ""):
        m = re.search(r"((?:-webkit-|-moz-)?calc\((?:[^()]|\([^()]*\))*\)|[-+]?[0-9]*\.?[0-9]+[a-z%]*)\s*$", entry.strip(), re.I)
        if not m or not (px := length_px(m[1])) or px <= 0:
            continue
        if media_matches(entry.strip()[: m.start()]) is True:
            return px
    return None


@F.pandas_udf(CANDIDATES)
def parse_srcset(values: pd.Series) -> pd.Series:
    return values.map(candidates_of)


@F.pandas_udf(T.DoubleType())
def parse_sizes(values: pd.Series) -> pd.Series:
    return values.map(slot_of).astype("float64")


def pick(candidates: Column, slot: Column, density: float) -> Column:
    """The URL a browser takes: the narrowest candidate that fills the slot at this density, else the
    widest; without widths, the least density that reaches it, else the greatest."""
    wide = F.filter(candidates, lambda c: c.width.isNotNull())
    need = F.coalesce(slot, F.lit(VIEWPORT[0])) * density

    def chosen(options: Column, key, least) -> Column:
        ranked = F.transform(options, lambda c: F.struct(key(c).alias("k"), c.url.alias("url")))
        fits = F.filter(ranked, lambda r: r.k >= least)
        return F.coalesce(F.array_min(fits)["url"], F.array_max(ranked)["url"])

    return F.when(F.size(wide) > 0, chosen(wide, lambda c: c.width, need)).otherwise(chosen(candidates, lambda c: F.coalesce(c.density, F.lit(1.0)), F.lit(density)))


def widest(candidates: Column) -> Column:
    wide = F.filter(candidates, lambda c: c.width.isNotNull())
    return F.coalesce(F.array_max(F.transform(wide, lambda c: F.struct(c.width, c.url)))["url"], F.array_max(F.transform(candidates, lambda c: F.struct(F.coalesce(c.density, F.lit(1.0)).alias("k"), c.url)))["url"])
