"""Near-duplicates by ProbMinHash.

A document is the shingles (five words) of its text, each with a weight, how often it stands there.
ProbMinHash lets every shingle arrive by a Poisson process of its weight, each arrival at a random component;
a component keeps its earliest shingle, and a shingle is done once its next arrival comes after the latest
kept one.  Two documents agree in a component with their probability Jaccard similarity.

Two documents are linked if the probability Jaccard similarity of their weighted shingles is at least the
threshold, or the Jaccard similarity of their sets of shingles is, which is the same where no shingle
repeats: copies that repeat passages unequally are caught by the second, texts that consist of one repeated
passage by the first.  A document with repeated shingles therefore has two signatures, one of its weights and
one with all weights equal, and stands in the buckets of both; others have one, which serves as both.

Documents of equal words are one class from the start, and only one of them goes on.  Bands of equal
components make buckets.  Every member of a bucket is first verified against the bucket's smallest
document, so a group of copies costs its size and not its square; connected components of these links
are the first classes.  Documents of buckets that hold several classes get a second, longer signature.  Pairs
that lie in different classes are compared by all components of both signatures (four bits each, within the
join), and those whose estimates of either similarity are not far below the threshold are verified one by one,
each pair once: first the members of a bucket with some documents of it, so that most of a group that its
smallest document missed is one class, then all that are left.  At a similarity of 0.8 the estimates turn a
pair away with a chance of 5e-5.  Large buckets, and documents of many pairs, are split.

Defined results: a text of one to four words is one shingle; texts without words are classes of equal
texts; null and empty texts are each a class of their own; rows that share a doc_id share a class;
rows without doc_id have class null; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, keyed_join, mix, prepare, staged, table, text_slices, texts_of, trim, windows_of, word_hashes
from .components import components

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: At a similarity of 0.8 a pair shares none of 28 bands of 5 with a chance of 1.5e-5.
BANDS = 28
BAND_ROWS = 5
#: Components of a signature; the bands use the first of them, the estimate all.
COMPONENTS = 384
#: Pairs with a lower estimate are not verified.
LEAST_ESTIMATE = 0.71
#: One bit of each component is compared first; below this estimate the other bits are not looked at.
FIRST_ESTIMATE = 0.66
#: Components of the longer signature, which only documents of buckets of several classes get, and the least
#: estimate by it.
FINE_COMPONENTS = 1024
LEAST_FINE = 0.745
#: Documents of a bucket of several classes with which its other members are compared before all others.
STARS = 3
#: Pairs of one document that are verified together; a document with more has its text in several tasks.
LEAD_PAIRS = 10_000
#: Documents of a bucket that one task compares with all others of it.
BUCKET_DOCS = 1_000
_PER_LONG, _HEADS = 16, COMPONENTS // 64
#: Texts whose prints are made at once, and bytes of texts whose signatures are.
_TOGETHER, _SKETCH_BYTES = 500, 1 << 18

_U64 = np.uint64
_STEP = _U64(0xD1B54A32D192ED03)
_FINE = _U64(0x8CB92BA72F3D8DD7)


def weighted_shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles: hash, text, how often the text has it."""
    shingle, doc = windows_of(hashes, first, k)
    _, at, count = np.unique(mix(shingle + doc.astype(_U64) * _STEP), return_index=True, return_counts=True)
    return shingle[at], doc[at], count.astype(float)


def probminhash(element: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures (n_docs, m): the element that reaches each component first; 0 for empty sets.

    Arrivals of an element are a fixed random stream of its hash; all elements of a slice take their
    next arrivals together, more at a time as fewer remain."""
    earliest = np.full(n_docs * m, np.inf)
    kept = np.zeros(n_docs * m, _U64)
    at = np.zeros(len(element))
    step = 0
    while len(element):
        ahead = int(np.clip(200_000 // len(element), 1, 64))
        index = np.arange(step + 1, step + ahead + 1, dtype=_U64) * _STEP
        noise = mix(element[:, None] + index)
        wait = -np.log1p(-(noise >> _U64(11)).astype(float) * 2.0**-53)
        wait /= weight[:, None]
        wait[:, 0] += at
        when = np.cumsum(wait, axis=1)
        slot = doc[:, None] * m + (mix(noise ^ _STEP) % _U64(m)).astype(np.int64)
        early = when < earliest[slot]
        slot, times, who = slot[early], when[early], np.broadcast_to(element[:, None], early.shape)[early]
        np.minimum.at(earliest, slot, times)
        won = times == earliest[slot]
        kept[slot[won]] = who[won]
        latest = earliest.reshape(n_docs, m).max(axis=1)
        at = when[:, -1]
        more = at < latest[doc]
        element, doc, weight, at = element[more], doc[more], weight[more], at[more]
        step += ahead
    return kept.reshape(n_docs, m)


def bands_of(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket for each band."""
    out = np.tile(np.arange(1, bands + 1, dtype=_U64) * _STEP, (len(signatures), 1))
    for r in range(rows):
        out = mix(out * _STEP + signatures[:, r : bands * rows : rows])
    return out


def prints_of(signatures: np.ndarray) -> np.ndarray:
    """One bit of each component, 64 of them to a long, then four bits of each, 16 of them to a long.  Made for
    some texts at a time, as the arrays on the way are several times the signatures' size."""
    parts = [_prints(signatures[at : at + _TOGETHER]) for at in range(0, len(signatures), _TOGETHER)]
    return np.concatenate(parts) if parts else np.zeros((0, _HEADS + COMPONENTS // _PER_LONG), _U64)


def _prints(signatures: np.ndarray) -> np.ndarray:
    mixed = mix(signatures)
    one = ((mixed >> _U64(32)) & _U64(1)).reshape(len(signatures), _HEADS, 64)
    heads = np.bitwise_or.reduce(one << np.arange(64, dtype=_U64), axis=2)
    return np.concatenate([heads, fours_of(mixed)], axis=1)


def fours_of(mixed: np.ndarray) -> np.ndarray:
    """Four bits of each mixed component, 16 of them to a long."""
    four = (mixed >> _U64(60)).reshape(len(mixed), mixed.shape[1] // _PER_LONG, _PER_LONG)
    return np.bitwise_or.reduce(four << (_U64(4) * np.arange(_PER_LONG, dtype=_U64)), axis=2)


def few_differ(left: Column, right: Column, components: int, least: float) -> Column:
    """Is the estimate by two arrays of four bits a component at least so much?"""

    def differing(a: Column, b: Column) -> Column:
        x = a.bitwiseXOR(b)
        y = x.bitwiseOR(F.shiftright(x, 1))
        return F.bit_count(y.bitwiseOR(F.shiftright(y, 2)).bitwiseAND(F.lit(0x1111111111111111)))

    # a loop over the array: one long expression of all its entries would be too long for Java to compile well
    differ = F.aggregate(F.zip_with(left, right, differing), F.lit(0), lambda done, n: done + n)
    return differ <= int(components * (1 - least) * 15 / 16)


def alike(left: str, right: str, least: float, first_least: float) -> Column:
    """Is the estimate by two arrays of prints at least so much?  The single bits go first, as most pairs need no
    others; a component that differs shows it in every second of these, and in 15 of 16 cases in four bits."""
    heads = F.lit(0)
    for i in range(_HEADS):
        heads += F.bit_count(F.col(left)[i].bitwiseXOR(F.col(right)[i]))

    rest = [F.slice(c, _HEADS + 1, COMPONENTS // _PER_LONG) for c in (left, right)]
    return (heads <= int(COMPONENTS * (1 - first_least) / 2)) & few_differ(*rest, COMPONENTS, least)


def word_keys(raw: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """Of each text of a slice, a key of its words, or of its bytes if it has none; null for empty texts."""
    keys: list[bytes | None] = []
    for i in range(len(offsets) - 1):
        if first[i + 1] > first[i]:
            keys.append(hashlib.blake2b(hashes[first[i] : first[i + 1]].tobytes(), digest_size=16).digest())
        elif offsets[i + 1] > offsets[i]:
            keys.append(hashlib.blake2b(raw[offsets[i] : offsets[i + 1]].tobytes(), digest_size=15).digest())
        else:
            keys.append(None)
    return keys


def both_signatures(element: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the weights of n texts, those of the sets of texts that repeat shingles, and which do."""
    repeats = np.zeros(n, bool)
    repeats[doc[weight > 1]] = True
    number = np.cumsum(repeats) - 1
    some = repeats[doc]
    plain = probminhash(element[some], number[doc[some]], np.ones(int(some.sum())), int(repeats.sum()), m)
    return probminhash(element, doc, weight, n, m), plain, repeats


def lists_of(values: np.ndarray, there: np.ndarray, null: np.ndarray | None = None) -> pa.ListArray:
    """A list of longs for each text: the next row of values if it is there, else an empty one or null."""
    ends = np.concatenate([[0], np.cumsum(np.where(there, values.shape[1], 0))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64).ravel()), mask=None if null is None else pa.array(null))


def sketches(docs: DataFrame, bands: int, rows: int, k: int) -> DataFrame:
    """doc_id, word_key (equal for equal words; null for empty texts), buckets, prints (of the weights) and
    set_prints (null where no shingle repeats, as they are the same); texts without words have empty lists."""

    def make(batches):
        for batch in batches:
            for at, to, raw, offsets in text_slices(batch["text"], _SKETCH_BYTES):
                hashes, first = word_hashes(raw, offsets)
                element, doc, weight = weighted_shingles(hashes, first, k)
                n = to - at
                signatures, plain, repeats = both_signatures(element, doc, weight, n, COMPONENTS)
                number = np.cumsum(repeats) - 1
                keys = word_keys(raw, offsets, hashes, first)
                held = np.diff(first) > 0
                own, other = bands_of(signatures, bands, rows), bands_of(plain, bands, rows)
                both = [np.union1d(own[i], other[number[i]]) if repeats[i] else own[i] for i in range(n) if held[i]]
                ends = np.zeros(n + 1, np.int64)
                ends[1:][held] = [len(x) for x in both]
                buckets = pa.ListArray.from_arrays(pa.array(np.cumsum(ends), pa.int32()), pa.array(np.concatenate([*both, np.zeros(0, _U64)]).view(np.int64)))
                lists = lists_of(prints_of(signatures)[held], held), lists_of(prints_of(plain), repeats, ~repeats)
                yield pa.RecordBatch.from_arrays([batch["doc_id"][at:to], pa.array(keys, pa.binary()), buckets, *lists], names=["doc_id", "word_key", "buckets", "prints", "set_prints"])
            trim()

    return docs.mapInArrow(make, "doc_id long, word_key binary, buckets array<long>, prints array<long>, set_prints array<long>")


def fine_sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, word_key, fine (of the weights) and set_fine (null where no shingle repeats): longer signatures,
    independent of those of sketches()."""

    def make(batches):
        for batch in batches:
            for at, to, raw, offsets in text_slices(batch["text"], _SKETCH_BYTES):
                hashes, first = word_hashes(raw, offsets)
                element, doc, weight = weighted_shingles(hashes, first, k)
                signatures, plain, repeats = both_signatures(mix(element ^ _FINE), doc, weight, to - at, FINE_COMPONENTS)
                keys = word_keys(raw, offsets, hashes, first)
                every = np.ones(to - at, bool)
                lists = lists_of(fours_of(mix(signatures)), every), lists_of(fours_of(mix(plain)), repeats, ~repeats)
                yield pa.RecordBatch.from_arrays([batch["doc_id"][at:to], pa.array(keys, pa.binary()), *lists], names=["doc_id", "word_key", "fine", "set_fine"])
            trim()

    return docs.mapInArrow(make, "doc_id long, word_key binary, fine array<long>, set_fine array<long>")


def probability_jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two rows of weights of the same elements, none of which is 0 in both.  Sorted by x / y, what an element
    is compared with is x of those at least as high and y of the lower ones."""
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(-ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    last = np.searchsorted(-ratio, -ratio, side="right")  # ties count as at least as high
    high, low = np.concatenate([[0.0], np.cumsum(x)])[last], y.sum() - np.concatenate([[0.0], np.cumsum(y)])[last]
    both = (x > 0) & (y > 0)
    return float((1.0 / (high[both] / x[both] + low[both] / y[both])).sum())


def similarities(left: pa.Array, right: pa.Array, k: int) -> np.ndarray:
    """The greater of the exact Jaccard similarity of shingle sets and the probability Jaccard similarity of
    weighted shingles, of two columns of texts, row by row."""
    sets: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for texts in (left, right):
        own: list[tuple[np.ndarray, np.ndarray]] = []
        for at, to, raw, offsets in text_slices(texts):
            shingle, doc, weight = weighted_shingles(*word_hashes(raw, offsets), k)
            order = np.lexsort((shingle, doc))
            cuts = np.searchsorted(doc[order], np.arange(1, to - at))
            own += list(zip(np.split(shingle[order], cuts), np.split(weight[order], cuts), strict=True))
        sets.append(own)
    out = np.zeros(len(left))
    for i, ((a, a_weight), (b, b_weight)) in enumerate(zip(*sets, strict=True)):
        if not len(a) or not len(b):
            continue
        union, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        out[i] = (len(a) + len(b) - len(union)) / len(union)
        if a_weight.max() > 1 or b_weight.max() > 1:
            x, y = np.zeros(len(union)), np.zeros(len(union))
            x[place[: len(a)]], y[place[len(a) :]] = a_weight, b_weight
            out[i] = max(out[i], probability_jaccard(x, y))
    return out


def with_texts(pairs: DataFrame, docs: DataFrame, side: str, text: str, many: DataFrame | None) -> DataFrame:
    """pairs with the text of one of their documents.  many: documents of that side with so many pairs that they are
    dealt over pieces, each with a copy of the text; None if there are none."""
    texts = docs.select(F.col("doc_id").alias(side), F.col("text").alias(text))
    if many is None:
        return pairs.join(texts, side)
    many = many.filter(F.col("side") == side).select(F.col("doc").alias(side), "pieces")
    one = F.coalesce("pieces", F.lit(1).cast("long"))
    other = "b" if side == "a" else "a"
    dealt = pairs.join(many, side, "left").withColumn("piece", F.pmod(F.xxhash64(other), one)).drop("pieces")
    copies = texts.join(many, side, "left").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), one - 1))).drop("pieces")
    return dealt.join(copies, [side, "piece"]).drop("piece")


def verified(pairs: DataFrame, docs: DataFrame, threshold: float, k: int) -> DataFrame:
    """The (a, b) pairs whose texts are similar."""

    @F.arrow_udf("double")
    def similarity(left: pa.Array, right: pa.Array) -> pa.Array:
        out = pa.array(similarities(left, right, k))
        trim()
        return out

    # at most two rows for LEAD_PAIRS pairs; written first, so that Spark knows how small the table is
    ends = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("doc")) for side in "ab"]))
    counts = pairs.select(ends.alias("end")).groupBy("end.side", "end.doc").agg(F.ceil(F.count(F.lit(1)) / LEAD_PAIRS).cast("long").alias("pieces"))
    leads = staged(counts.filter("pieces > 1"), "leads")
    many = None if leads.isEmpty() else leads
    joined = with_texts(with_texts(pairs, docs, "a", "_left", many), docs, "b", "_right", many)
    return joined.filter(similarity("_left", "_right") >= threshold).select("a", "b").distinct()


def split_buckets(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The members, with their classes, of buckets that hold several classes."""
    placed = members.join(classes.withColumnRenamed("doc", "doc_id"), "doc_id", "left").withColumn("class", F.coalesce("class", "doc_id"))
    split = placed.groupBy("bucket").agg(F.min("class").alias("least"), F.max("class").alias("most")).filter("least <> most").select("bucket")
    return placed.join(split, "bucket", "left_semi")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), a row per row of docs."""
    prepare(docs.sparkSession)
    docs = texts_of(docs)
    sketch = staged(sketches(docs, bands, rows, k), "sketches")
    keyed = sketch.filter("doc_id is not null and word_key is not null")
    # one document of each word sequence goes on; counted map-side first, so large groups are cheap
    owners = staged(keyed.groupBy(F.hex("word_key").alias("key")).agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("n")), "owners")
    owned = keyed_join(sketch.select("doc_id", "word_key"), F.when(F.col("doc_id").isNotNull(), F.hex("word_key")), owners, ["owner"])
    copies = staged(owned.select("doc_id", F.coalesce("owner", "doc_id").alias("owner")), "copies")
    alone = copies.filter("doc_id = owner").select("doc_id").distinct()
    rows_of = keyed.filter("size(buckets) > 0").join(alone, "doc_id", "left_semi").select(F.explode("buckets").alias("bucket"), "doc_id")
    shared = rows_of.groupBy("bucket").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).filter("lead <> last").select("bucket", "lead")
    members = staged(rows_of.join(shared, "bucket"), "members")  # bucket, doc_id, lead

    texts = docs.filter("doc_id is not null")
    stars = staged(members.filter("doc_id <> lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct(), "stars")
    links = staged(verified(stars, texts, threshold, k), "star-links")
    classes = components(links, "classes")

    placed = split_buckets(members.drop("lead"), classes).distinct()
    fine = fine_sketches(texts.join(placed.select("doc_id").distinct(), "doc_id", "left_semi"), k)
    # rows that repeat a doc_id and its words have the same signatures
    signed = staged(keyed.join(fine, ["doc_id", "word_key"]).dropDuplicates(["doc_id", "word_key"]), "signed")
    # a document of two signatures has a row for each; one of weights and one of sets are not compared
    kind = lambda n, *names: F.struct(F.lit(n).alias("kind"), *[F.col(c).alias(a) for c, a in zip(names, ("prints", "fine"), strict=True)])
    kinds = F.when(F.col("set_prints").isNull(), F.array(kind(0, "prints", "fine"))).otherwise(F.array(kind(1, "prints", "fine"), kind(2, "set_prints", "set_fine")))
    signed = signed.select("doc_id", "buckets", F.explode(kinds).alias("s")).select("doc_id", "buckets", "s.*")
    placed = staged(placed.join(signed, "doc_id"), "placed")
    # of a large bucket, each of several tasks compares a part of the documents with all; counted here, where partial
    # counts are made before rows of a bucket meet
    large = staged(placed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BUCKET_DOCS).cast("long").alias("pieces")).filter("pieces > 1"), "large")
    least, first_least, least_fine = (e * threshold / THRESHOLD for e in (LEAST_ESTIMATE, FIRST_ESTIMATE, LEAST_FINE))
    apart = (F.col("class_a") != F.col("class_b")) & (F.col("kind_a") + F.col("kind_b") != 3)
    close, closer = alike("prints_a", "prints_b", least, first_least), few_differ(F.col("fine_a"), F.col("fine_b"), FINE_COMPONENTS, least_fine)

    def sides(rows: DataFrame, n: str) -> DataFrame:
        return rows.select("bucket", *[F.col(c).alias(f"{c}_{n}") for c in ("class", "buckets", "kind", "prints", "fine")], F.col("doc_id").alias(n), *([] if "pieces" not in rows.columns else ["pieces"]))

    some = F.array_distinct(F.array(*[F.min_by("doc_id", F.xxhash64("doc_id", F.lit(turn))) for turn in range(STARS)]))
    some = placed.groupBy("bucket").agg(some.alias("some")).select("bucket", F.explode("some").alias("doc_id"))
    centres = placed.join(some, ["bucket", "doc_id"], "left_semi")
    met = sides(placed, "a").join(sides(centres, "b"), "bucket").filter(apart & close & closer).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = staged(met.join(stars, ["a", "b"], "left_anti"), "stars")
    found = staged(verified(pairs, texts, threshold, k), "star-links")
    tried = stars.union(pairs)
    if not found.isEmpty():
        links = links.union(found)
        classes = components(links, "classes", classes)
        placed = split_buckets(placed.drop("class"), classes)

    placed = placed.join(large, "bucket", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1).cast("long")))
    left = sides(placed, "a").withColumn("piece", F.pmod(F.xxhash64("a"), F.col("pieces"))).drop("pieces")
    right = sides(placed, "b").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).drop("pieces")
    # of a pair's buckets the least one decides
    first = left["bucket"] == F.array_min(F.array_intersect("buckets_a", "buckets_b"))
    rest = left.join(right, (left["bucket"] == right["bucket"]) & (left["piece"] == right["piece"]) & (F.col("a") < F.col("b")) & apart & close & first & closer).select("a", "b").distinct()
    rest = staged(rest.join(tried, ["a", "b"], "left_anti"), "rest")
    more = staged(verified(rest, texts, threshold, k), "rest-links")
    if not more.isEmpty():
        classes = components(links.union(more), "classes", classes)
    same_id = copies.filter("doc_id is not null").groupBy("doc_id").agg(F.min("owner").alias("least"), F.max("owner").alias("most")).filter("least <> most")
    if not same_id.isEmpty():  # one doc_id with several texts
        one = links.union(more).union(copies.filter("doc_id <> owner").select("owner", "doc_id"))
        classes = components(one, "classes", classes)
    return copies.join(classes.withColumnRenamed("doc", "owner"), "owner", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "owner")).alias("class_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class stays, that with the smallest doc_id; of rows that repeat
    a doc_id and its text one stays; rows without doc_id stay.  A doc_id with several texts stands for
    several documents, each of which is judged by its own text."""
    number, text = fresh(docs, "_number"), F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.xxhash64(text).alias("h")).filter("doc_id is not null")
    unclear = staged(own.groupBy("doc_id").agg(F.min("h").alias("least"), F.max("h").alias("most")).filter("least <> most").select("doc_id"), "unclear")
    numbered = docs.withColumn(number, F.col("doc_id").cast("long"))
    if not unclear.isEmpty():
        mark = fresh(docs, "_unclear")
        marked = docs.join(unclear.select(F.col("doc_id").alias(number), F.lit(True).alias(mark)), F.col("doc_id") == F.col(number), "left").drop(number)
        by_text = F.shiftrightunsigned(F.xxhash64("doc_id", text), 1).bitwiseOR(F.lit(1 << 62))  # beyond the doc_ids
        numbered = marked.withColumn(number, F.when(F.col(mark), by_text).otherwise(F.col("doc_id"))).drop(mark)
    classes = near_duplicates(numbered.select(F.col(number).alias("doc_id"), "text"))
    gone = staged(classes.filter("doc_id <> class_id").select(F.col("doc_id").alias(number)).distinct(), "gone")
    kept = numbered.filter(F.col(number).isNotNull()).join(gone, number, "left_anti").dropDuplicates([number])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return kept.select(*columns).unionByName(docs.filter("doc_id is null").select(*columns))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class of near-duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"))
