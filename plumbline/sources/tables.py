"""Sources: crawled pages and collected measurements in the formats they come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.probes import sitemap_lines, sitemap_urls


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def saved_runs(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents of saved runs, one a file; unreadable files give a row of nulls and are left out."""
    raw = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return raw.filter("_broken is null").drop("_broken") if "_broken" in raw.columns else raw


def run_pages(spark: SparkSession, path: str) -> DataFrame:
    """The pages of all saved runs, as write_documents() left them."""
    return spark.read.parquet(f"{path}/parquet").drop("_slug")


def run_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents of all saved runs."""
    return spark.read.json(f"{path}/json").drop("_slug")


def text_feed(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a feed without comments and blank lines."""
    return spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> '' and line not like '#%'")


def robots_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole robots.txt files: path, body, sitemaps."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"), sitemap_lines(F.col("value")).alias("sitemaps"))


def sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """Sitemaps, a file each: path, urls; an index's are further sitemaps."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").rlike(r"(?is)<(\w+:)?sitemapindex").alias("is_index"), sitemap_urls(F.col("value")).alias("urls"))
