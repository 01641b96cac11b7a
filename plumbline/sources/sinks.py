"""Sinks: a run's tables, one partition a site, replaced by the next run of that site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_HITS = 500

def slug(host: Column) -> Column:
    """Partition key of a site: its host without www., anything but letters and digits as a dash."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(host), r"^www\.", ""), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def write_run(df: DataFrame, path: str, site: str = "site") -> None:
    """Overwrite the partitions of the sites in df and no others."""
    out = df.withColumn("_slug", slug(F.col(site)))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_slug").parquet(path)


def capped_hits(hits: DataFrame, most: int = MAX_HITS) -> DataFrame:
    """Hits as a report shows them: `most` a finding and site, by URL."""
    nth = F.row_number().over(Window.partitionBy("site", "finding").orderBy("url", "detail"))
    return hits.withColumn("_nth", nth).filter(F.col("_nth") <= most).drop("_nth")


def run_documents(sites: DataFrame, hits: DataFrame, pages: DataFrame, most: int = MAX_HITS) -> DataFrame:
    """A nested document a site: the columns of `sites` (site, ...), findings (each with severity, category, urls,
    n and at most `most` hits, worst first) and how many pages it has.  A document is a report and bounded by
    its rules; the pages themselves are a table beside it (write_documents)."""
    severity = F.array_position(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), F.col("severity"))
    totals = hits.groupBy("site", "finding").agg(F.first("category").alias("category"), F.min_by("severity", severity).alias("severity"), F.min(severity).alias("rank"), F.count_distinct("url").alias("urls"), F.count(F.lit(1)).alias("n"))
    shown = capped_hits(hits, most).groupBy("site", "finding").agg(F.array_sort(F.collect_list(F.struct("url", "detail"))).alias("hits"))
    each = totals.join(shown, ["site", "finding"])
    order = F.struct("rank", (-F.col("urls")).alias("less"), "finding", "severity", "category", "urls", "n", "hits")
    found = each.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(order)), lambda f: F.struct(f.finding.alias("id"), f.severity.alias("severity"), f.category.alias("category"), f.urls.alias("urls"), f.n.alias("n"), f.hits.alias("hits"))).alias("findings"))
    counted = pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    return sites.join(found, "site", "left").join(counted, "site", "left").na.fill(0, ["pages"])


def write_documents(documents: DataFrame, pages: DataFrame, path: str) -> None:
    """Documents as JSON and their pages as Parquet, a partition a site: those of these sites are replaced, others
    stay."""
    for df, kind in ((documents, "json"), (pages, "parquet")):
        own = df.withColumn("_slug", slug(F.col("site")))
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_slug").format(kind).save(f"{path}/{kind}")


def delete_run(spark: SparkSession, path: str, site: str) -> bool:
    """Drop a site's document and pages; false if there was none.  A name that is no site's deletes nothing."""
    name = spark.range(1).select(slug(F.lit(site)).alias("s")).first().s
    if not name:
        return False
    gone = False
    for kind in ("json", "parquet"):
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}/_slug={name}")
        system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        gone |= system.exists(folder) and system.delete(folder, True)
    return gone
