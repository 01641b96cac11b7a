"""What the operators of this subpackage share: where staged tables go, how words are cut and hashed.

Words follow one law everywhere here: A-Z become a-z, and a word is a longest run of 0-9, a-z and
code points from U+0080 on.  The law works on UTF-8 bytes, since every byte of such a code point is
0x80 or more, which lets numpy cut and hash whole Arrow buffers without a Python step per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import shared_dir, ship

#: Bytes of text that one numpy pass works on (its temporaries are some 30 times as large).
SLICE_BYTES = 1 << 19
#: Bytes of one Arrow batch that Spark hands to Python; Spark's own default is 256 MB.
ARROW_BATCH_BYTES = 8 << 20

_U64 = np.uint64
_BASE = _U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _word_bytes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    for low, high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        table[low : high + 1] = 0
    return table


#: Byte -> the byte a word holds, 0 for bytes that separate words.
WORD_BYTE = _word_bytes()
#: The same for bytes.translate(): separators become blanks, so that bytes.split() gives the words.
SPLIT_TABLE = bytes(int(b) or 32 for b in _word_bytes())


def words_of(text: str | None) -> list[bytes]:
    """The words of one text, as UTF-8."""
    return (text or "").encode().translate(SPLIT_TABLE).split()


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI in the shared folder, and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def staged_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/plumbline/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write a table into the shared folder and read it back: the lineage ends there and survives
    lost executors."""
    path = staged_path(df.sparkSession, label)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> None:
    """Hand the package to the executors, and bound what one Arrow batch holds, as single texts may
    be long."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(1 << 28)).rstrip("bB")) > ARROW_BATCH_BYTES:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty) alone; other columns, whatever their names, are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


#: A key is hot if more than one in so many rows has it; there are fewer hot keys than that.
HOT_PARTS = 1_000


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def keyed_join(rows: DataFrame, key: Column, table: DataFrame, values: list[str]) -> DataFrame:
    """rows and, by a left join, values of table (key: string, n: how many rows have it, values).  Hot keys
    are joined by a broadcast of at most HOT_PARTS rows, and their rows, like those without a key, are
    dealt out evenly in the shuffled join of the others: no key gathers in one task."""
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > total / HOT_PARTS
    names = {c: fresh(rows, f"_{c}") for c in ("key", "id", "there", *values)}
    k, one, there = names["key"], names["id"], names["there"]
    common = table.filter(hot).select(F.col("key").alias(k), F.lit(True).alias(there), *[F.col(v).alias(names[v]) for v in values])
    others = table.filter(~hot).select(F.col("key").alias(one), *[F.col(v).alias(f"{names[v]}2") for v in values])
    out = rows.withColumn(k, key).withColumn(one, F.monotonically_increasing_id()).join(F.broadcast(common), k, "left")
    lone = F.concat(F.lit("~"), F.col(one).cast("string"))  # no key begins so
    out = out.withColumn(one, F.when(F.col(k).isNull() | F.col(there).isNotNull(), lone).otherwise(F.col(k))).join(others, one, "left")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.coalesce(names[v], f"{names[v]}2").alias(v) for v in values])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); works on a copy."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


_powers: list[np.ndarray] = []


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            t = np.full(size, base, dtype=_U64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[:] = tables
    return _powers[0], _powers[1]


def text_slices(texts: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole texts in slices of about `most` bytes (one text at least): first row, row after the
    last, their UTF-8 bytes in one array, and the offsets of the texts in it."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield at, to, raw[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut a slice into words: bytes by WORD_BYTE, starts, ends (exclusive), and for each text the
    first of its words (one entry more than texts).  No word crosses a text's end."""
    low = WORD_BYTE[raw]
    inside = low != 0
    n = len(low)
    starts_at = inside.copy()
    starts_at[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < n]
    starts_at[cut] = inside[cut]
    starts = np.flatnonzero(starts_at)
    ends_at = inside.copy()
    ends_at[:-1] &= ~inside[1:]
    cut = offsets[1:][offsets[1:] > 0] - 1
    ends_at[cut] = inside[cut]
    ends = np.flatnonzero(ends_at) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a slice, and for each text the first of its words."""
    low, starts, ends, first = word_spans(raw, offsets)
    if not len(starts):
        return np.zeros(0, _U64), first
    power, inverse = power_tables(len(low))
    total = np.cumsum(low * power[: len(low)], dtype=_U64)
    value = total[ends - 1] - total[starts] + low[starts] * power[starts]
    return mix(value * inverse[starts] + (ends - starts).astype(_U64)), first


def hash_word(word: bytes) -> int:
    """What word_hashes() gives for one word."""
    raw = np.frombuffer(word, np.uint8)
    return int(word_hashes(raw, np.array([0, len(raw)]))[0][0])


def windows_of(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words that lie within one text, and the text of each.  A text with
    1 to k-1 words counts as one window."""
    n_words = np.diff(first)
    doc_of_word = np.repeat(np.arange(len(n_words)), n_words)
    full = np.maximum(n_words - k + 1, 0)
    if len(hashes) >= k:
        rolled = np.zeros(len(hashes) - k + 1, _U64)
        for j in range(k):
            rolled = rolled * _BASE + hashes[j : j + len(rolled)]
        whole = doc_of_word[: len(rolled)] == doc_of_word[k - 1 :]
        rolled, docs = mix(rolled[whole]), doc_of_word[: len(whole)][whole]
    else:
        rolled, docs = np.zeros(0, _U64), np.zeros(0, np.int64)
    short = np.flatnonzero((n_words > 0) & (full == 0))
    if len(short):
        own = np.array([_fold(hashes[first[i] : first[i + 1]]) for i in short], dtype=_U64)
        rolled, docs = np.concatenate([rolled, own]), np.concatenate([docs, short])
        order = np.argsort(docs, kind="stable")
        rolled, docs = rolled[order], docs[order]
    return rolled, docs


def _fold(hashes: np.ndarray) -> int:
    value = np.array([len(hashes)], dtype=_U64)
    for h in hashes:
        value = mix(value * _BASE + h)
    return int(value[0])


def trim() -> None:
    """Give memory that a task or batch no longer needs back to the system: Python workers live on
    beside the executor's heap and serve later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def local_path(uri: str) -> str:
    """file:// URI -> path, for files that a parameter names (tokenizers)."""
    return uri.removeprefix("file://") if uri.startswith("file:") else os.fspath(uri)
