"""BPE encoding and decoding by a contiguous rank array.

For a vocabulary file of the tokenizers library with words (end-of-word suffix): text is split at the
added tokens it contains, normalised (NFC, white space, lower case), cut into words, and each word
becomes byte symbols that merges join.  A short word is held as an array of parts and an array of the
ranks of adjacent pairs; the minimum is looked for over and over, its boundary deleted and the two
neighbouring ranks refreshed.  Words of more than SHORT_WORD symbols use a heap instead, as scans would
grow with the square.  Each distinct word is encoded once per task and found by number after that, so
that numpy gathers the ids of a whole slice.

Defined results: null and empty texts have no ids and decode to an empty text; repeated rows are
treated alike; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import sys
import unicodedata
from array import array
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, prepare, table, texts_of, trim

WORD_TOKENIZER = "word_bpe_49k.json"
SHORT_WORD = 64
#: Distinct words a task remembers before it starts anew.
MOST_WORDS = 150_000
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_NONE = sys.maxsize
# Letters, numbers and lower-case forms that the tokenizers library's Unicode version has
# beyond this Python's.
_MORE_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
_MORE_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
_MORE_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_MORE_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)} | {ord("Σ"): ord("σ")}  # no final form


def _ranges(initial: str, top: int, more: tuple[tuple[int, int], ...]) -> str:
    """The body of a character class: code points up to `top` whose general category begins so."""
    out: list[list[int]] = [list(r) for r in more]
    run: list[int] = []
    for c in range(top + 2):
        if c <= top and unicodedata.category(chr(c))[0] == initial:
            run = [run[0] if run else c, c]
        elif run:
            out.append(run)
            run = []
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in sorted(out))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: the byte's own if
    it is printable Latin-1, else the next free one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordIndex(dict):
    """Word -> its number; a new word is encoded and its ids are appended."""

    def __init__(self, encode):
        super().__init__()
        self._encode, self._ids, self._ends, self._arrays = encode, array("i"), array("q", [0]), None

    def __missing__(self, word: str) -> int:
        self._ids.extend(self._encode(word))
        self._ends.append(len(self._ids))
        self[word] = n = len(self._ends) - 2
        self._arrays = None
        return n

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words one after another, and how many each has."""
        if self._arrays is None:
            self._arrays = np.array(self._ids, np.int32), np.array(self._ends, np.int64)
        ids, ends = self._arrays
        begin = ends[numbers]
        length = ends[numbers + 1] - begin
        total = np.cumsum(length)
        at = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - length - begin, length)
        return ids[at], length


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(map(tuple, model["merges"]))}
        self.inner = [vocab[c] for c in byte_symbols()]
        self.final = [vocab[c + self.suffix] for c in byte_symbols()]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_pattern = re.compile("(" + "|".join(re.escape(t) for t in self.added) + ")") if self.added else None
        self.added_hint = os.path.commonprefix(list(self.added))  # a text without it holds no added token
        # texts without code points from U+0250 on take a pattern of few ranges, which is much faster
        self.beyond = re.compile("[\u0250-\U0010ffff]")
        self.word_pattern, self.latin_pattern = (self._pattern(_ranges("L", top, more), _ranges("N", top, others)) for top, more, others in ((sys.maxunicode, _MORE_LETTERS, _MORE_NUMBERS), (0x24F, (), ())))
        self.odd_capitals = re.compile("[" + "".join(map(chr, _MORE_LOWER)) + "]")
        self.words = WordIndex(self.encode_word)
        self.names = pa.array([self.tokens[i] for i in range(len(self.tokens))])

    @staticmethod
    def _pattern(letters: str, numbers: str) -> re.Pattern[str]:
        return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{_SPACE}{letters}{numbers}]+")

    def encode_word(self, word: str) -> list[int]:
        if word in self.added:
            return [self.added[word]]
        raw = word.encode()
        parts = [*(self.inner[b] for b in raw[:-1]), self.final[raw[-1]]]
        return self._by_array(parts) if len(parts) <= SHORT_WORD else self._by_heap(parts)

    def _by_array(self, parts: list[int]) -> list[int]:
        ranks, none = self.ranks, (_NONE, -1)
        adjacent = [ranks.get(p, none) for p in zip(parts, parts[1:], strict=False)]
        while adjacent:
            low = min(adjacent)
            if low is none:
                break
            at = adjacent.index(low)
            parts[at] = low[1]
            del parts[at + 1], adjacent[at]
            if at < len(adjacent):
                adjacent[at] = ranks.get((parts[at], parts[at + 1]), none)
            if at:
                adjacent[at - 1] = ranks.get((parts[at - 1], parts[at]), none)
        return parts

    def _by_heap(self, parts: list[int]) -> list[int]:
        """The same result for long words: pairs wait in a heap by rank and place."""
        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r[0], i, p, r[1]) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if (r := self.ranks.get(p))]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, pair, new = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or (parts[i], parts[j]) != pair:
                continue
            parts[i], gone[j], after[i] = new, 1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (r := self.ranks.get(own := (parts[a], parts[after[a]]))):
                    heapq.heappush(heap, (r[0], a, own, r[1]))
        return [p for p, away in zip(parts, gone, strict=True) if not away]

    def split(self, text: str) -> list[str]:
        """The words of a text; added tokens stand as words of their own."""
        out: list[str] = []
        for piece in self.added_pattern.split(text) if self.added and self.added_hint in text else [text]:
            if piece in self.added:
                out.append(piece)
            elif piece:
                if not piece.isascii():
                    piece = unicodedata.normalize("NFC", piece)
                    if self.odd_capitals.search(piece):
                        piece = piece.translate(_MORE_LOWER)
                piece = piece.lower()
                out += (self.word_pattern if self.beyond.search(piece) else self.latin_pattern).findall(piece)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's end."""
        if len(self.words) > MOST_WORDS:
            self.words = WordIndex(self.encode_word)
        split = [self.split(t) for t in texts]
        number = self.words.__getitem__
        numbers = np.array([n for words in split for n in map(number, words)], np.int64)
        ids, length = self.words.gather(numbers)
        total = np.concatenate([[0], np.cumsum(length)])
        return ids, total[np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The tokens of each list joined by blanks, added tokens included, as the library does where
        the file names no decoder."""
        flat = ids.flatten()
        ends = pa.compute.subtract(ids.offsets, ids.offsets[0])
        return pc.binary_join(pa.ListArray.from_arrays(ends, self.names.take(flat)), " ")


@cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def tokenizer_path(name: str) -> str:
    return public_tokenizers.path(name)


def _slices(texts: pa.Array, most: int):
    at, size = 0, 0
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def encode_documents(docs: DataFrame, path: str | None = None, decode: bool = True) -> DataFrame:
    """doc_id, ids, and decoded (what the ids decode to; null unless asked for)."""
    prepare(docs.sparkSession)

    def encode(batches):
        bpe = word_bpe(path or tokenizer_path(WORD_TOKENIZER))  # each machine's own file
        for batch in batches:
            for at, to in _slices(batch["text"], SLICE_BYTES):
                ids, ends = bpe.encode(batch["text"][at:to].to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                decoded = bpe.decode(lists) if decode else pa.nulls(to - at, pa.string())
                yield pa.RecordBatch.from_arrays([batch["doc_id"][at:to], lists, decoded], names=["doc_id", "ids", "decoded"])
            trim()

    return texts_of(docs).mapInArrow(encode, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: token counts and digests of the ids and of what they decode to."""
    return digests(encode_documents(docs))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return digests(encode_documents(table(spark, sf_dir, "documents")))
