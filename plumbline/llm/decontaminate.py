"""Benchmark decontamination by spaced-seed hashing.

A seed is the hash of the words at a mask's fixed positions; the positions it leaves out may differ.
Seeds of benchmark items and of documents are joined, and around every hit the two texts are compared
word by word on that alignment.  A document leaks an item if some window of WINDOW consecutive words of
the item meets at least SIMILARITY of equal words.  The masks find every such window: each way to
substitute two of 13 words leaves one placement of one mask whole (a test goes through all 78).

Items of 8 to 12 words are one window of their own length and need the same share of equal words: one
substitution for 8 and 9 words, two for 10 to 12.  Their masks cut the item into two blocks more than it
may have substitutions and use two whole blocks, so some mask is always left whole.  Items of fewer than 8
words have to stand as they are.  With short=False items of 8 to 12 words are looked for as they are, and
shorter ones not at all.

The seeds of a benchmark of at most BROADCAST_SEEDS go to all tasks (their number is counted first) and
are looked up in one pass over the texts.  Beyond that, a sieve of fixed size goes to all tasks: a bit for
every value that the first bits of a benchmark seed have.  Seeds of documents that pass it carry the words
around them, as every window that leaks has a seed of its own within it; so texts are read once and never
shuffled, and a hit is judged by what its two rows carry.  Seeds that many documents share are split.

Defined results: null and empty texts or items never match; rows without doc_id or item_id are left
out; items that repeat an item_id are matched each and the best match counts; repeated rows of documents
give repeated rows; an empty table on either side gives an empty table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, keyed_join, mix, prepare, staged, table, text_slices, texts_of, trim, word_hashes

MASKS = ("11110111", "11001001111", "11111101")
WINDOW = 13
SIMILARITY = 0.8
#: Shorter items have to stand as they are.
LEAST_WORDS = 8
#: At 24 bytes each 12 MB at most.
BROADCAST_SEEDS = 500_000

_U64 = np.uint64
_STEP = _U64(0xA24BAED4963EE407)
_SIEVE_BITS = 22
#: Bits of the sieve of a large benchmark: 16 MB, whatever its size.
LARGE_SIEVE_BITS = 27
#: Rows of one seed that one task joins.
SEED_ROWS = 100_000


def least_equal(n: int, short: bool = True) -> int:
    """How many words of a window of n have to be equal."""
    exact = n < (LEAST_WORDS if short else WINDOW)
    return n if exact else int(np.ceil(SIMILARITY * n))


def short_masks(n: int) -> tuple[str, ...]:
    """Masks of an item of n words, fewer than a window's."""
    blocks = n - least_equal(n) + 2
    block = np.arange(n) * blocks // n
    return tuple(dict.fromkeys("".join("01"[b in kept] for b in block) for kept in combinations(range(blocks), 2)) if blocks > 2 else ("1" * n,))


#: All masks by number: those of a window, then those of items of 1, 2, .. words.
_BY_LENGTH = [(), *(short_masks(n) for n in range(1, WINDOW))]
ALL_MASKS = (*MASKS, *(m for masks in _BY_LENGTH for m in masks))


def masks_for(n: int) -> range:
    """The numbers of the masks of an item of n words."""
    if n >= WINDOW:
        return range(len(MASKS))
    begin = len(MASKS) + sum(map(len, _BY_LENGTH[:n]))
    return range(begin, begin + len(_BY_LENGTH[n]))


def seeds_of(hashes: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of one mask at all places where it lies within one text: hash, first word."""
    span = len(mask)
    if len(hashes) < span:
        return np.zeros(0, _U64), np.zeros(0, np.int64)
    value = np.full(len(hashes) - span + 1, _U64(int(mask, 2)))
    for j, used in enumerate(mask):
        if used == "1":
            value = value * _STEP + hashes[j : j + len(value)]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[: len(value)] == doc[span - 1 :])
    return mix(value[at]), at


def _item_seeds(hashes: np.ndarray) -> list[tuple[int, int, int]]:
    """(mask, seed, first word) of one item."""
    out = []
    for m in masks_for(len(hashes)):
        value, at = seeds_of(hashes, np.array([0, len(hashes)]), ALL_MASKS[m])
        out += [(m, int(v), int(a)) for v, a in zip(value, at, strict=True)]
    return out


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, short: bool = True) -> tuple[int, int, int]:
    """Best window of the item laid over the document with item word 0 at document word `shift`:
    equal words, item word it begins with, words compared.  0 equal words: no window fits the rule."""
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    width = min(WINDOW, len(item))
    if high - low < width:
        return 0, 0, width
    total = np.concatenate([[0], np.cumsum(item[low:high] == doc[low + shift : high + shift])])
    equal = total[width:] - total[:-width]
    best = int(equal.argmax())
    return (int(equal[best]), low + best, width) if equal[best] >= least_equal(width, short) else (0, 0, width)


class _Index:
    """Seeds of all items, sorted, with a sieve of bits before the search."""

    def __init__(self, ids: list[int], items: list[np.ndarray], short: bool = True):
        self.ids, self.items, self.short = ids, items, short
        rows = [(m, seed, i, at) for i, words in enumerate(items) for m, seed, at in _item_seeds(words)]
        self.by_mask = []
        for m in sorted({r[0] for r in rows}):
            own = sorted(r[1:] for r in rows if r[0] == m)
            seed = np.array([r[0] for r in own], _U64)
            sieve = np.zeros(1 << _SIEVE_BITS, bool)
            sieve[(seed >> _U64(64 - _SIEVE_BITS)).astype(np.int64)] = True
            self.by_mask.append((ALL_MASKS[m], seed, np.array([r[1] for r in own], np.int64), np.array([r[2] for r in own], np.int64), sieve))

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (text, item, shift) alignments of a slice that share a seed."""
        found = []
        for mask, seed, item, at, sieve in self.by_mask:
            value, place = seeds_of(hashes, first, mask)
            near = sieve[(value >> _U64(64 - _SIEVE_BITS)).astype(np.int64)]
            value, place = value[near], place[near]
            low, high = np.searchsorted(seed, value, "left"), np.searchsorted(seed, value, "right")
            times = high - low
            one = np.repeat(np.arange(len(value)), times)
            entry = np.arange(len(one)) - np.repeat(np.cumsum(times) - times, times) + low[one]
            doc = np.searchsorted(first, place[one], "right") - 1
            found.append(np.stack([doc, item[entry], place[one] - first[doc] - at[entry]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def matches(self, texts: pa.Array):
        """(text, item, equal words, document word, item word, words compared), best per pair."""
        for begin, _, raw, offsets in text_slices(texts):
            hashes, first = word_hashes(raw, offsets)
            best: dict[tuple[int, int], tuple] = {}
            for doc, item, shift in self.hits(hashes, first).tolist():
                equal, at, width = overlap(hashes[first[doc] : first[doc + 1]], self.items[item], shift, self.short)
                if equal:
                    key, own = (doc, self.ids[item]), (-equal, at + shift, at, width)
                    best[key] = min(best.get(key, own), own)
            for (doc, item), (equal, word, at, width) in sorted(best.items()):
                yield begin + doc, item, -equal, word, at, width


def _item_hashes(benchmark: DataFrame, short: bool = True) -> DataFrame:
    @F.arrow_udf("array<long>")
    def hashes_of(texts: pa.Array) -> pa.Array:
        parts, ends = [], [0]
        for _, _, raw, offsets in text_slices(texts):
            hashes, first = word_hashes(raw, offsets)
            parts.append(hashes.view(np.int64))
            ends += (ends[-1] + first[1:]).tolist()
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text")).filter("item_id is not null").distinct()
    return items.select("item_id", hashes_of("text").alias("words")).filter(F.size("words") >= (1 if short else LEAST_WORDS))


def _lowered(docs: DataFrame) -> DataFrame:
    """Texts in lower case beyond A-Z too: passages may be found in documents all in capitals."""
    return texts_of(docs).filter("doc_id is not null").withColumn("text", F.lower("text"))


MATCH = "item_id long, n_equal int, doc_word int, item_word int, n_compared int"


def leaks(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS, short: bool = True) -> DataFrame:
    """A row for each document and item it leaks: doc_id, item_id, and the best window: n_equal of
    n_compared words, from doc_word of the document and item_word of the item."""
    prepare(docs.sparkSession)
    items = staged(_item_hashes(benchmark, short), "items")
    docs = _lowered(docs)
    n_seeds = _seeds_at_most(items)
    if n_seeds > broadcast_seeds:
        # a match belongs to the text; every row of that text has it, whatever its doc_id
        keyed = docs.select("doc_id", _text_key("text").alias("_text"))
        found = _matches_by_join(docs.select("text"), items, short)
        per_text = found.groupBy(F.col("key").alias("_text")).agg(F.collect_list(F.struct(*[c for c in found.columns if c != "key"])).alias("found"))
        rows_of = keyed.join(per_text.select("_text"), "_text", "left_semi").groupBy("_text").agg(F.count(F.lit(1)).alias("n"))
        table_ = staged(per_text.join(rows_of, "_text").select(F.hex("_text").alias("key"), "n", "found"), "leaks")
        joined = keyed_join(keyed, F.hex("_text"), table_, ["found"])
        return joined.select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.*")
    index = _small_index(items, short)

    def find(batches):
        for batch in batches:
            rows = list(index.matches(batch["text"]))
            at = pa.array([r[0] for r in rows], pa.int64())
            own = [pa.array([r[c] for r in rows], pa.int64() if c == 1 else pa.int32()) for c in range(1, 6)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(at), own[0], own[1], own[2], own[3], own[4]], names=["doc_id", "item_id", "n_equal", "doc_word", "item_word", "n_compared"])

    return docs.mapInArrow(find, "doc_id long, " + MATCH)


def _seeds_at_most(items: DataFrame) -> int:
    return items.agg(F.sum(F.size("words") * len(MASKS))).first()[0] or 0


def _small_index(items: DataFrame, short: bool = True) -> _Index:
    rows = sorted((r.item_id, r.words) for r in items.toLocalIterator())
    return _Index([r[0] for r in rows], [np.array(r[1], np.int64).view(_U64) for r in rows], short)


def _text_key(text: str | Column) -> Column:
    return F.unhex(F.md5(text))


def _sieve(seeds: DataFrame) -> np.ndarray:
    """One bit for each value of the first LARGE_SIEVE_BITS bits of a seed.  What is collected has the sieve's
    size at most."""
    bit = F.shiftrightunsigned("seed", 64 - LARGE_SIEVE_BITS)
    packed = seeds.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - LARGE_SIEVE_BITS}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(max(1, 1 << (LARGE_SIEVE_BITS - 6)), _U64)
    out[packed["at"].to_numpy()] = packed["bits"].to_numpy().view(_U64)
    return out


def _around(words: np.ndarray, at: int, span: int, begin: int, end: int) -> tuple[int, np.ndarray]:
    """How many words are carried before a seed, and all that are: those of the windows that hold it, within
    [begin, end)."""
    first = max(begin, at - (WINDOW - span))
    return at - first, words[first : min(end, at + WINDOW)]


def _matches_by_join(texts: DataFrame, items: DataFrame, short: bool = True) -> DataFrame:
    """The same for benchmarks of any size, a row for each distinct text (by its digest, `key`) and item."""
    spark = texts.sparkSession
    lengths = [r[0] for r in items.select(F.least(F.size("words"), F.lit(WINDOW))).distinct().collect()]  # WINDOW at most
    used = sorted({m for n in lengths for m in masks_for(n)})
    names = ["mask", "seed", "word", "lead", "words"]

    def carried(mask: list[int], seed: list[int], word: list[int], held: list[tuple[int, np.ndarray]]) -> list[pa.Array]:
        ends = np.concatenate([[0], np.cumsum([len(w) for _, w in held], dtype=np.int64)])
        flat = np.concatenate([*(w for _, w in held), np.zeros(0, _U64)]).view(np.int64)
        return [pa.array(mask, pa.int32()), pa.array(np.array(seed, _U64).view(np.int64)), pa.array(word, pa.int32()), pa.array([a for a, _ in held], pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]

    def item_seeds(batches):
        for batch in batches:
            for item, words in zip(batch["item_id"].to_pylist(), batch["words"].to_pylist(), strict=True):
                own = np.array(words, np.int64).view(_U64)
                rows = _item_seeds(own)
                whole = len(own) < WINDOW
                held = [(a, own) if whole else _around(own, a, len(ALL_MASKS[m]), 0, len(own)) for m, _, a in rows]
                columns = carried([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], held)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(rows), pa.int64()), *columns], names=["item_id", *names])

    shape = "mask int, seed long, word int, lead int, words array<long>"
    right = staged(items.mapInArrow(item_seeds, f"item_id long, {shape}"), "item-seeds")
    sieve = spark.sparkContext.broadcast(_sieve(right))

    def seeds(batches):
        bits = sieve.value
        for batch in batches:
            for begin, _, raw, offsets in text_slices(batch["text"]):
                hashes, first = word_hashes(raw, offsets)
                for m in used:
                    value, place = seeds_of(hashes, first, ALL_MASKS[m])
                    at = value >> _U64(64 - LARGE_SIEVE_BITS)
                    passed = (bits[(at >> _U64(6)).astype(np.int64)] >> (at & _U64(63))) & _U64(1) != 0
                    value, place = value[passed], place[passed]
                    doc = np.searchsorted(first, place, "right") - 1
                    held = [_around(hashes, p, len(ALL_MASKS[m]), first[d], first[d + 1]) for p, d in zip(place.tolist(), doc.tolist(), strict=True)]
                    columns = carried([m] * len(value), value, place - first[doc], held)
                    yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(begin + doc)), *columns], names=["key", *names])
            trim()

    left = staged(texts.select(_text_key("text").alias("key"), "text").mapInArrow(seeds, f"key binary, {shape}").distinct(), "seeds")
    # a seed of many documents meets copies of its items' rows; at most a row for SEED_ROWS seeds
    many = staged(left.groupBy("mask", "seed").agg(F.ceil(F.count(F.lit(1)) / SEED_ROWS).cast("long").alias("pieces")).filter("pieces > 1"), "many-seeds")
    one = F.coalesce("pieces", F.lit(1).cast("long"))
    dealt = left.join(many, ["mask", "seed"], "left").withColumn("piece", F.pmod(F.xxhash64("key"), one)).drop("pieces")
    copies = right.join(many, ["mask", "seed"], "left").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), one - 1))).drop("pieces")

    @F.arrow_udf("struct<n_equal: int, at: int, n_compared: int>")
    def compare(doc: pa.Array, doc_lead: pa.Array, item: pa.Array, item_lead: pa.Array) -> pa.Array:
        out = []
        for d, dl, i, il in zip(doc, doc_lead.to_pylist(), item, item_lead.to_pylist(), strict=True):
            equal, at, width = overlap(d.values.to_numpy(), i.values.to_numpy(), dl - il, short)
            out.append({"n_equal": equal, "at": at, "n_compared": width})
        return pa.array(out, pa.struct([("n_equal", pa.int32()), ("at", pa.int32()), ("n_compared", pa.int32())]))

    named = copies.select("mask", "seed", "piece", "item_id", F.col("word").alias("item_seed"), F.col("lead").alias("item_lead"), F.col("words").alias("item_words"))
    met = dealt.join(named, ["mask", "seed", "piece"]).withColumn("m", compare("words", "lead", "item_words", "item_lead")).filter("m.n_equal > 0")
    item_word = F.col("item_seed") - F.col("item_lead") + F.col("m.at")
    found = F.struct((-F.col("m.n_equal")).alias("less"), (item_word + F.col("word") - F.col("item_seed")).alias("doc_word"), item_word.alias("item_word"), F.col("m.n_compared").alias("n_compared"))
    best = met.select("key", "item_id", found.alias("f")).groupBy("key", "item_id").agg(F.min("f").alias("f"))
    return best.select("key", "item_id", (-F.col("f.less")).alias("n_equal"), "f.doc_word", "f.item_word", "f.n_compared")


def leaking(index: _Index) -> Column:
    @F.arrow_udf("boolean")
    def flag(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), bool)
        for row in index.matches(texts.fill_null("")):
            out[row[0]] = True
        trim()
        return pa.array(out)

    return flag(F.lower("text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that leak an item go."""
    prepare(spark)
    items = staged(_item_hashes(table(spark, sf_dir, "benchmark")), "items")
    n_seeds = _seeds_at_most(items)
    if n_seeds <= BROADCAST_SEEDS:
        return docs.filter(~leaking(_small_index(items)))
    # by the text, not by doc_id: that may be null or stand for several texts
    text = F.lower("text")
    gone = _matches_by_join(docs.filter("text is not null").select(text.alias("text")), items).select(F.hex("key").alias("key")).distinct()
    counted = docs.filter("text is not null").select(F.hex(_text_key(text)).alias("key")).join(gone, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    flag = fresh(docs, "_leaks")
    marked = keyed_join(docs, F.hex(_text_key(text)), staged(counted.withColumn(flag, F.lit(True)), "leaking"), [flag])
    return marked.filter(F.col(flag).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that leak benchmark items, with the items and where."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=True)
