"""A corpus pipeline over `documents`: reject bad documents, keep one of each group of near-duplicates,
drop documents that leak benchmark items, mask personal data, encode.

Each stage works on all that its predecessor kept; stage results go to Parquet in the shared folder
and are read back, so lineage is short and lost executors cost one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, decontaminate, near_dedup, pii, quality
from plumbline.llm.common import staged, table

STAGES = [
    ("quality classifier", quality.stage),
    ("near-duplicates", near_dedup.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("personal data", pii.stage),
    ("BPE", bpe.stage),
]

#: Trained models and hashing decide; SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "-"))
    return docs
