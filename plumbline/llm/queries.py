"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import merkle, spelling_groups, topk_search, url_filter, warc_zip
from .bpe import op7_bpe
from .decontaminate import op5_decontaminate
from .kd_shards import op9_kd_shards
from .licenses import op2_license_scan
from .near_dedup import op8_near_dedup
from .pii import op3_pii_crf
from .quality import op10_quality_bayes
from .token_counts import op4_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": topk_search.op1_topk_search,
    "op2_license_scan": op2_license_scan,
    "op3_pii_crf": op3_pii_crf,
    "op4_token_counts": op4_token_counts,
    "op5_decontaminate": op5_decontaminate,
    "op6_warc_zip": warc_zip.op6_warc_zip,
    "op7_bpe": op7_bpe,
    "op8_near_dedup": op8_near_dedup,
    "op9_kd_shards": op9_kd_shards,
    "op10_quality_bayes": op10_quality_bayes,
    "op11_url_filter": url_filter.op11_url_filter,
    "op12_spelling_groups": spelling_groups.op12_spelling_groups,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk_search": topk_search.SQL,
    "op6_warc_zip": warc_zip.SQL,
    "op11_url_filter": url_filter.SQL,
    "op12_spelling_groups": spelling_groups.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
