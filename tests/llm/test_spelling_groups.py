"""Spelling variants against all pairs, on odd rows, long words and blocks of few words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import spelling_groups

DOCS = "doc_id long, text string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counts(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def grouped(n):
    near = {w: [o for o in n if abs(len(o) - len(w)) < 2 and one_edit(w, o)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n.get(form[w], 0)) for w in n)


def found(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def query(spark, docs):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(spelling_groups, "table", lambda *_: docs)
        return found(spelling_groups.op12_spelling_groups(spark, ""))


def test_query_is_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = grouped(counts(rows))
    assert found(spelling_groups.op12_spelling_groups(spark, "/root/testdata/sf0.001")) == want
    assert any(w[1] for w in want)


def test_odd_rows_and_small_blocks(spark, monkeypatch):
    long = "ab" * 15_000
    rows = [(1, None), (2, ""), (3, "12 .. ×÷ €uro"), (None, "Straße straße STRAßE strasse strasse strasse"), (4, f"{long} {long} {long} {long}c {long}c {long}c"), (5, "Größe größe grösse grösse grösse großse"), (5, "Größe größe gröse gröse gröse"), (6, "ÀÉÎÕÜ àéîõü " * 3), (7, "hotel " * 500 + "hotle hotle hotle hotell hotell hotell otel hotelx " * 2)]
    rows += [(100 + i, f"{'warehouse ' * 4}{'warehouses ' * 2}warehose") for i in range(400)]  # damage by checksum
    monkeypatch.setattr(spelling_groups, "BLOCK_WORDS", 2)
    monkeypatch.setattr(spelling_groups, "TALLY_WORDS", 3)
    monkeypatch.setattr(spelling_groups, "CUT_BYTES", 100)
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("word", "n", "key", "piece", "length", "class", "root", "form")})
    got = query(spark, docs)
    assert got == grouped(counts(rows))
    assert sum(w[0].startswith("war") or "house" in w[0] for w in got) > 4


def test_empty(spark):
    assert query(spark, spark.createDataFrame([], DOCS)) == []


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text(alphabet="abÿz", min_size=4, max_size=6), max_size=30))
def test_close_pairs_are_one_edit(words):
    by_length = {k: sorted(w for w in words if len(w) == k) for k in (4, 5, 6)}
    codes = {k: np.frombuffer("".join(ws).encode("latin-1"), np.uint8).reshape(-1, k) for k, ws in by_length.items()}
    for a, b in ((4, 4), (4, 5), (5, 5), (5, 6)):
        i, j = spelling_groups.close_pairs(codes[a], codes[b], a == b)
        want = {(x, y) for p, x in enumerate(by_length[a]) for q, y in enumerate(by_length[b]) if (a != b or p < q) and one_edit(x, y)}
        assert {(by_length[a][p], by_length[b][q]) for p, q in zip(i, j, strict=True)} == want


def test_letter_classes_lose_no_pair(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("etaoinñz") for _ in range(rng.randint(5, 7))) for _ in range(300)})
    words = sorted({*words, *(w[:2] + rng.choice("aeñq") + w[3:] for w in words), *(w[:3] + w[4:] for w in words if len(w) > 5)})
    n = {w: i + 3 for i, w in enumerate(words)}
    got = found(spelling_groups.variant_groups(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == grouped(n)
