"""The Merkle manifest against a plain loop, on odd rows and on trees of many shapes."""

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
OUT = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def fields(values) -> str:
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and for each leaf what stands left and right of it, level by level."""
    steps, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, place in enumerate(at):
            run = place // 3 * 3
            steps[i].append(("".join(level[run:place]), "".join(level[place + 1 : run + 3])))
        level, at = [h(*level[i : i + 3]) for i in range(0, len(level), 3)], [place // 3 for place in at]
    return level[0], steps


def brute(rows):
    groups, out = {}, []
    for doc_id, text, lang, source, n_chars in rows:
        even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        changed = text.replace("\n", "") if even and text is not None else text
        own = (doc_id is not None, doc_id or 0, fields((doc_id, source, lang, n_chars, text)), fields((doc_id, source, lang, n_chars, changed)), doc_id)
        groups.setdefault((source is not None, (source or "").encode()), []).append(own)
    if not groups:
        return []
    keys = sorted(groups)
    trees = [tree([r[2] for r in sorted(groups[k], key=lambda r: r[:3])]) for k in keys]
    root, tops = tree([t[0] for t in trees])
    for k, (subroot, steps), top in zip(keys, trees, tops, strict=True):
        for (_, _, leaf, claimed, doc_id), step in zip(sorted(groups[k], key=lambda r: r[:3]), steps, strict=True):
            d = claimed
            for left, right in step + top:
                d = h(left, d, right)
            out.append((doc_id, leaf, subroot, root, h(*(a + b for a, b in step + top)), d, d == root))
    return out


def found(df):
    return sorted((tuple(r[c] for c in OUT) for r in df.collect()), key=str)


def run(spark, rows, monkeypatch=None, **clash):
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(v) for c, v in clash.items()})
    seen = {}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(merkle, "table", lambda *_: docs)
        seen["out"] = found(merkle.op13_merkle_manifest(spark, ""))
    return seen["out"]


def test_query_is_the_plain_loop(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    assert found(merkle.op13_merkle_manifest(spark, "/root/testdata/sf0.001")) == sorted(brute([tuple(r) for r in rows]), key=str)


def test_odd_rows_many_ranges_and_clashing_names(spark, monkeypatch):
    rows = [(1, None, "en", None, None), (2, "", None, "a", 0), (3, "a\nb\n", "en", "a", 3), (3, "a\nb\n", "en", "a", 3), (3, "other\n", "en", "a", 3), (4, "x\n" * 30_000, "en", "b", 60_000), (None, "no id\n", "en", "b", 10), (None, None, None, None, None), (5, "é😀\n", "", "", 3), (-7, "\n", "e n", "é", 1)]
    rows += [(100 + i, f"t{i}\n", "en", "hot", i) for i in range(40)]  # a group over all ranges
    monkeypatch.setattr(merkle, "RANGE_ROWS", 5)
    got = run(spark, rows, **{c: "clash" for c in ("key", "n", "lo", "hi", "digest", "kids", "rank", "path", "_piece", "_tie", "claimed", "group")})
    assert got == sorted(brute(rows), key=str)
    assert {r[6] for r in got} == {True, False}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.sampled_from([None, "", "a", "b\n"]), st.sampled_from([None, "", "s", "é", "z"])), min_size=1, max_size=14))
def test_any_shape(spark, parts):
    rows = [(i, t, "en", s, 1) for i, t, s in parts]
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_empty(spark):
    assert run(spark, []) == []


def test_intervals_nest_and_rank_the_leaves(spark):
    docs = spark.createDataFrame([(i, "t", "en", "a" if i % 3 else "b", 1) for i in range(29)], DOCS)
    rows = merkle.manifest(docs, [F.col(c) for c in merkle.FIELDS], F.col("source"), [F.col("doc_id")], carry={"doc_id": F.col("doc_id"), "source": F.col("source")}).collect()
    for source in "ab":
        own = sorted((r for r in rows if r.source == source), key=lambda r: r.doc_id)
        assert [r["rank"] for r in own] == list(range(len(own)))
        assert all(r.claimed == r.leaf for r in own)
