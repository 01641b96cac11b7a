"""Spelling variants by blocked Gram matrices.

A word is a vector of letter counts, and one edit moves that vector by a squared distance of one (a letter
more or less) or two (a letter replaced).  Words of one length are cut into blocks; the Gram matrix of two
blocks, one product of their count matrices, gives all squared distances between them, and only pairs of at
most two are verified letter by letter.  Blocks of equal or adjacent length meet, no others.

Within a length, words are first sorted by letter class: how many letters fall in each of CLASSES groups of
the alphabet.  One edit changes one or two of these numbers by one, so of all blocks of a length only those
of such neighbouring classes need a product; that loses no pair.  A class of more than a block's words is
dealt over several blocks, all of which meet.  Words are counted per task first; each pair of blocks is a
row with both blocks' words, so no task holds more than two blocks.

Forms point to words at least twice as frequent, so chains of forms end; their roots are found by pointers
that jump over twice as many forms in each round.

Defined results: a null text has no words; a null doc_id damages no run; rows that repeat a doc_id are
documents of their own; words of any length are compared; a word without near words has form null and is
its own root; an empty table gives an empty table; other columns, whatever their names, are left behind.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_join, prepare, staged, table, texts_of, trim
from .merkle import CRC_TABLE_SQL

LEAST_LETTERS, LEAST_COUNT, DAMAGE = 5, 3, 97
#: Words of a block, and letters of a block of long words.
BLOCK_WORDS, BLOCK_LETTERS = 1024, 1 << 20
#: Distinct words that a task counts before it hands them on, and bytes of text that are cut at once.
TALLY_WORDS, CUT_BYTES = 200_000, 1 << 20
#: Letters are dealt over so many groups by their rank below, those of one group far from each other.
CLASSES = 4
_BY_FREQUENCY = "etaoinsrhldcumfpgwybvkxjqz"
#: Longer words' counts may give products that single precision rounds.
_SINGLE_LETTERS = 2000
#: Letters that one comparison of candidates looks at.
_VERIFY_LETTERS = 1 << 22


def _cut_table() -> bytes:
    out = bytearray(b" " * 256)
    for c in range(256):
        if ord("a") <= c <= ord("z") or c >= 0xC0:
            out[c] = c
        elif ord("A") <= c <= ord("Z"):
            out[c] = c + 32
    return bytes(out)


#: Latin-1 byte -> the byte a run holds (A-Z in lower case), a blank for all that separates runs.
CUT = _cut_table()
_LETTERS = np.zeros(256, np.int64)
_LETTERS[ord("a") : ord("z") + 1] = np.arange(26)
_LETTERS[0xC0:] = 26 + np.arange(64)
_ALPHABET = 90
_CLASS_LETTERS = [_BY_FREQUENCY[i::CLASSES] for i in range(1, CLASSES)]  # the other letters are the last class


def runs_of(text: str):
    """Lists of the runs of letters of a text, each run in Latin-1: a byte a code point."""
    raw = text.encode("latin-1", "replace").translate(CUT)  # code points from U+0100 on separate
    at = 0
    while at < len(raw):
        to = raw.find(b" ", at + CUT_BYTES)
        to = len(raw) if to < 0 else to
        yield raw[at:to].split()
        at = to


def word_counts(docs: DataFrame, damage: int | None = DAMAGE, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """word, n.  damage: of so many pairs of document and run one, by checksum, loses a letter."""

    def tally(batches):
        found: dict[bytes, int] = {}
        full = False

        def out():
            words = [w.decode("latin-1") for w in found]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                start = None if doc_id is None or not damage else zlib.crc32(b"%d:" % doc_id)
                for runs in runs_of(text.as_py()):
                    here: dict[bytes, int] = {}
                    for run in runs:
                        if len(run) >= letters:
                            here[run] = here.get(run, 0) + 1
                    for run, n in here.items():
                        if start is not None:
                            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                            if not h % damage:
                                k = h % len(run)
                                run = run[:k] + run[k + 1 :]
                                if len(run) < letters:
                                    continue
                        found[run] = found.get(run, 0) + n
                    full = len(found) >= TALLY_WORDS
                    if full:
                        yield out()
                        found = {}
            trim()
        if found:
            yield out()

    return docs.mapInArrow(tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def letter_class(word: Column) -> Column:
    """How many letters of the word fall in each class but the last."""
    return F.array(*[(F.length(word) - F.length(F.translate(word, letters, ""))).cast("int") for letters in _CLASS_LETTERS])


def _key(length: Column, of: Column) -> Column:
    return F.concat_ws(":", length.cast("string"), F.array_join(of.cast("array<string>"), "."))


def neighbours(length: Column, of: Column) -> Column:
    """Keys of the classes that one edit leads to, each unordered pair of classes of one length from one of the
    two alone, with whether it is the class itself."""
    moves = [tuple(int(i == j) for j in range(CLASSES)) for i in range(CLASSES)]  # one letter more in class i

    def moved(step: tuple[int, ...]) -> Column:
        return F.transform(of, lambda x, i: x + F.element_at(F.array(*map(F.lit, step[:-1])), i + 1))

    same = [tuple(a - b for a, b in zip(up, down, strict=True)) for up in moves for down in moves]
    upward = sorted({s for s in same if s > tuple([0] * CLASSES)})  # of s and -s the greater
    out = [F.struct(_key(length, of).alias("key"), F.lit(True).alias("own"))]
    out += [F.struct(_key(length, moved(s)).alias("key"), F.lit(False).alias("own")) for s in upward]
    out += [F.struct(_key(length + 1, moved(s)).alias("key"), F.lit(False).alias("own")) for s in moves]
    return F.array(*out)


def blocks_of(words: DataFrame) -> DataFrame:
    """key, piece, length, class, words and their ns, a row a block."""
    keyed = words.select("word", "n", F.length("word").alias("length"), letter_class(F.col("word")).alias("class")).withColumn("key", _key(F.col("length"), F.col("class")))
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.lit(BLOCK_LETTERS) / F.col("length"))))
    sizes = staged(keyed.groupBy("key", "length").agg(F.count(F.lit(1)).alias("n")).select("key", "n", F.ceil(F.col("n") / most).cast("long").alias("pieces")), "spelling-classes")
    dealt = keyed_join(keyed, F.col("key"), sizes, ["pieces"]).withColumn("piece", F.pmod(F.xxhash64("word"), F.col("pieces")))
    return dealt.groupBy("key", "piece", "length", "class").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("members"))


def count_vectors(codes: np.ndarray) -> np.ndarray:
    """Letter counts of words of one length, a row a word."""
    m, length = codes.shape
    at = np.repeat(np.arange(m) * _ALPHABET, length) + _LETTERS[codes.ravel()]
    kind = np.float32 if length <= _SINGLE_LETTERS else np.float64
    return np.bincount(at, minlength=m * _ALPHABET).reshape(m, _ALPHABET).astype(kind)


def close_pairs(left: np.ndarray, right: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two blocks of letter codes, right's words as long or one letter longer, that one edit tells
    apart; within a block (own) each pair once."""
    a, b = count_vectors(left), count_vectors(right)
    distance = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    near = distance <= 2.5
    if own:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    length = left.shape[1]
    kept = np.zeros(len(i), bool)
    step = max(1, _VERIFY_LETTERS // right.shape[1])
    for at in range(0, len(i), step):
        x, y = left[i[at : at + step]], right[j[at : at + step]]
        if right.shape[1] == length:
            kept[at : at + step] = (x != y).sum(1) == 1
        else:  # equal letters from the front and from the back make up the shorter word
            front = np.logical_and.accumulate(x == y[:, :-1], axis=1).sum(1)
            back = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(1)
            kept[at : at + step] = front + back >= length
    return i[kept], j[kept]


def near_words(words: DataFrame) -> DataFrame:
    """word, other, other_n: each pair of near words in both directions, once."""
    blocks = staged(blocks_of(words), "spelling-blocks")
    ids = blocks.select("key", "piece", "length", "class")
    wanted = ids.select(F.col("key").alias("left_key"), F.col("piece").alias("left_piece"), F.explode(neighbours(F.col("length"), F.col("class"))).alias("to")).select("left_key", "left_piece", F.col("to.key").alias("key"), F.col("to.own").alias("own"))
    pairs = wanted.join(ids.select("key", "piece"), "key").filter(~F.col("own") | (F.col("left_piece") <= F.col("piece")))
    pairs = pairs.withColumn("own", F.col("own") & (F.col("left_piece") == F.col("piece")))
    left = blocks.select(F.col("key").alias("left_key"), F.col("piece").alias("left_piece"), F.col("members").alias("left"))
    met = pairs.join(left, ["left_key", "left_piece"]).join(blocks.select("key", "piece", F.col("members").alias("right")), ["key", "piece"]).select("own", "left", "right")

    def compare(batches):
        for batch in batches:
            for own, left_words, right_words in zip(batch["own"].to_pylist(), batch["left"], batch["right"], strict=True):
                sides = []
                for side in (left_words, right_words):
                    text = side.values.field("word").to_pylist()
                    raw = "".join(text).encode("latin-1")
                    sides.append((np.frombuffer(raw, np.uint8).reshape(len(text), -1), pa.array(text, pa.string()), side.values.field("n")))
                (x, x_words, x_n), (y, y_words, y_n) = sides
                i, j = close_pairs(x, y, own)
                if len(i):
                    i, j = pa.array(i), pa.array(j)
                    for a, b, b_n in ((x_words.take(i), y_words.take(j), y_n.take(j)), (y_words.take(j), x_words.take(i), x_n.take(i))):
                        yield pa.RecordBatch.from_arrays([a, b, b_n], names=["word", "other", "other_n"])
            trim()

    return met.mapInArrow(compare, "word string, other string, other_n long")


def roots_of(forms: DataFrame) -> DataFrame:
    """word, root: where the forms of each word that has one end.  forms: word, form, without cycles."""
    at = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        jump = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = staged(at.join(jump, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        at = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return at


def variant_groups(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of words (word, n) of letters a-z and U+00C0 to U+00FF:
    form is the most frequent near word, if it is at least `ratio` times as frequent as the word."""
    words = staged(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    rows = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    has = F.coalesce(F.col("form_n") >= F.col("n") * ratio, F.lit(False))
    rows = staged(rows.select("word", F.when(has, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("form_n")).alias("form_n")), "spelling-forms")
    roots = roots_of(rows.filter("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their forms and roots."""
    prepare(spark)
    return variant_groups(word_counts(texts_of(table(spark, sf_dir, "documents"))))


SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED ({CRC_TABLE_SQL}),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL),
summed AS (SELECT run, n, xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [195, ord(x) - 64] END)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM runs, crc),
damaged AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM summed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n, length(word) AS len FROM damaged WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
places AS (SELECT word, n, unnest(range(1, len + 1)) AS i FROM words),
shorter AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM places),
wild AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS form FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM wild a JOIN wild b ON a.form = b.form AND a.word <> b.word
  UNION ALL SELECT w.word, s.word, s.n FROM words w JOIN shorter s ON w.word = s.less
  UNION ALL SELECT s.word, w.word, w.n FROM words w JOIN shorter s ON w.word = s.less),
placed AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM near),
forms AS MATERIALIZED (SELECT w.word, CASE WHEN p.other_n >= 2 * w.n THEN p.other END AS form, w.n, coalesce(p.n_near, 0) AS n_near, CASE WHEN p.other_n >= 2 * w.n THEN p.other_n END AS form_n FROM words w LEFT JOIN placed p ON w.word = p.word AND p.place = 1),
chain AS (SELECT word, word AS at FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON f.word = c.word JOIN forms l ON c.at = l.word WHERE l.form IS NULL
"""
