"""Across sites and runs: history of runs, distribution of metrics and what it says about a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scoring as S
from plumbline.operators.few import smallest


def history(runs: DataFrame) -> DataFrame:
    """runs: site, finished, overall, ... -> the latest run of each site, newest first."""
    latest = runs.groupBy("site").agg(F.max_by(F.struct(*[F.col(c) for c in runs.columns if c != "site"]), "finished").alias("r"), F.count(F.lit(1)).alias("runs"))
    return latest.select("site", "r.*", "runs").orderBy(F.desc("finished"), "site")


def window_verdict(metric: Column, low: Column, middle: Column, high: Column) -> Column:
    """What the corpus says of a metric's window, first match."""
    floor, target = (F.create_map(*[F.lit(x) for m, w in S.WINDOWS.items() for x in (m, float(w[i]))])[metric] for i in (0, 1))
    return (
        F.when(high - low < 0.08, "compliance check")
        .when(S.ramp(low, floor, target) > 0.90, "too generous")
        .when((middle > 0.95) & (low < 0.5), "bimodal")
        .when(S.ramp(middle, floor, target) > 0.95, "top-heavy")
        .when(S.ramp(middle, floor, target) < 0.15, "too harsh")
        .otherwise("working")
    )


def run_ratios(pages: DataFrame) -> DataFrame:
    """site, metric, value recomputed from the saved pages of runs (those that were read back, none collected),
    as calibration() takes them: the shares that page records alone tell."""
    from plumbline.operators.scores import page_metrics

    return page_metrics(pages).select("site", "metric", "value")


def calibration(values: DataFrame) -> DataFrame:
    """values: site, metric, value -> min, median, max over sites and the verdict."""
    own = values.filter(F.col("value").isNotNull() & F.col("metric").isin(*S.WINDOWS))
    out = own.groupBy("metric").agg(F.count(F.lit(1)).alias("sites"), F.min("value").alias("low"), F.median("value").alias("middle"), F.max("value").alias("high"))
    return out.withColumn("verdict", window_verdict(F.col("metric"), F.col("low"), F.col("middle"), F.col("high")))


def word_report(words: DataFrame) -> DataFrame:
    """words: site, url, word, n -> count, pages and five example pages of each word, most frequent first."""
    counted = words.groupBy("site", "word").agg(F.sum("n").alias("n"), F.count_distinct("url").alias("pages"))
    examples = smallest(words.withColumnRenamed("url", "examples"), ["site", "word"], "examples", 5)
    return counted.join(examples, ["site", "word"], "left").orderBy(F.desc("n"), "word")
