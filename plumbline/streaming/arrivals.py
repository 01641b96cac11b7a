"""Pages as a stream: the stateless page rules on arrivals, and each page once within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import urls
from plumbline.operators.records import page_records
from plumbline.operators.rules import Frames
from plumbline.operators.rules import page_hits as one_pass


def once(pages: DataFrame, time: str = "fetched_at", within: str = "1 hour") -> DataFrame:
    """Arrivals of a page after its first within the watermark go."""
    return pages.withColumn("identity", urls.normalise(F.col("url"))).withWatermark(time, within).dropDuplicatesWithinWatermark(["identity"])


def page_hits(pages: DataFrame, rules: tuple[str, ...] = ("MET-01", "MET-02", "MET-03", "MET-11", "MET-12", "CNT-09", "IDX-04")) -> DataFrame:
    """Hits of rules that look at one page at a time; works on streams and on tables."""
    return one_pass(Frames(page_records(pages)), list(rules)).select("site", "finding", "url", "detail")


def hits_by_window(hits: DataFrame, time: str, size: str = "10 minutes") -> DataFrame:
    return hits.groupBy(F.window(time, size), "finding").agg(F.count(F.lit(1)).alias("hits"))
