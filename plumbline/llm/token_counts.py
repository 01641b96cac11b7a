"""Token counts behind a digest cache.

The cache is a table in the shared folder: content digest, tokenizer digest, number of tokens.  A run
digests every text's normalised content (null: empty; otherwise the text as it is, since tokenizers
tell apart what stronger forms would merge), joins the digests with the cache, encodes one text of each
digest that is missing, appends those counts, and joins all counts back to the rows.

The query takes the cache that spark.plumbline.tokenCache names, a folder all machines see, and begins a
new one where the session names none.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows and equal texts share a
cache entry and keep their rows; an empty table gives an empty table and appends nothing.
"""

from __future__ import annotations

import hashlib
from functools import cache
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_join, prepare, staged, staged_path, table, texts_of

PIECE_TOKENIZER = "piece_bpe_32k.model"
LIMIT = 4096
CACHE_SETTING = "spark.plumbline.tokenCache"
ENTRY = "content binary, tokenizer string, n_tokens long"


@cache
def _piece_processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def _json_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def count_tokens(path: str, texts: list[str]) -> list[int]:
    """Tokens of each text as the library for this file gives them, without any added at the ends."""
    if path.endswith(".model"):
        return [len(ids) for ids in _piece_processor(path).encode(texts, num_threads=1)]
    return [len(e.ids) for e in _json_tokenizer(path).encode_batch(texts, add_special_tokens=False)]


def tokenizer_digest(path: str) -> str:
    """Digest of the file and of the library's version: counts of another version are never reused."""
    import importlib.metadata

    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    return hashlib.sha256(Path(path).read_bytes() + f"{library} {importlib.metadata.version(library)}".encode()).hexdigest()


def _stored(spark: SparkSession, cache_path: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(cache_path)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(ENTRY).parquet(cache_path) if there else spark.createDataFrame([], ENTRY)


def token_counts(docs: DataFrame, path: str | None = None, cache_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit.  cache_path: the cache to use and extend; without one a
    new cache is begun."""
    spark = docs.sparkSession
    prepare(spark)
    cache_path = cache_path or staged_path(spark, "token-counts")
    version = tokenizer_digest(path or public_tokenizers.path(PIECE_TOKENIZER))

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        own = path or public_tokenizers.path(PIECE_TOKENIZER)  # each machine's own file
        return pa.array(count_tokens(own, texts.to_pylist()), pa.int64())

    docs = texts_of(docs).withColumn("content", F.unhex(F.sha2("text", 256)))
    rows = staged(docs.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    known = _stored(spark, cache_path).filter(F.col("tokenizer") == version).select("content", "n_tokens").dropDuplicates(["content"])
    # equal texts meet map-side first, so a large group of copies moves one text a task
    distinct = docs.select("content", "text").dropDuplicates(["content"])
    missing = distinct.join(known.select("content"), "content", "left_anti")
    missing.select("content", F.lit(version).alias("tokenizer"), count("text").alias("n_tokens")).write.mode("append").parquet(cache_path)
    counts = spark.read.schema(ENTRY).parquet(cache_path).filter(F.col("tokenizer") == version).select("content", "n_tokens").dropDuplicates(["content"])
    used = rows.groupBy("content").agg(F.count(F.lit(1)).alias("n")).join(counts, "content")
    used = staged(used.select(F.hex("content").alias("key"), "n", "n_tokens"), "used-counts")
    found = keyed_join(rows, F.hex("content"), used, ["n_tokens"])
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, over the cache the session names or a new one."""
    return token_counts(table(spark, sf_dir, "documents"), cache_path=spark.conf.get(CACHE_SETTING, None))
