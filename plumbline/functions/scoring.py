"""Curves and bands that turn measurements into scores.  Unmeasured (null) stays unmeasured."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (floor, target) of every pass-ratio's window.
WINDOWS = {
    "indexable": (0.90, 1.00),
    "noindex_expected": (0.60, 1.00),
    "sitemap_coverage": (0.80, 0.99),
    "canonical": (0.90, 1.00),
    "canonical_self": (0.85, 0.98),
    "title_present": (0.90, 1.00),
    "title_unique": (0.80, 0.99),
    "title_length": (0.40, 0.95),
    "desc_present": (0.90, 1.00),
    "desc_unique": (0.85, 0.995),
    "desc_length": (0.55, 0.97),
    "h1": (0.80, 0.99),
    "social": (0.60, 0.96),
    "html_basics": (0.90, 1.00),
    "no_placeholder": (0.95, 1.00),
    "encoding": (0.95, 1.00),
    "word_depth": (0.65, 0.98),
    "spelling": (0.70, 0.98),
    "img_alt": (0.40, 0.95),
    "hygiene": (0.05, 0.75),
    "linked": (0.75, 0.99),
    "links_in_html": (0.85, 1.00),
    "reachable": (0.70, 1.00),
    "click_depth": (0.70, 0.97),
    "inbound_depth": (0.45, 0.90),
    "http_200": (0.95, 1.00),
    "links_resolve": (0.93, 1.00),
    "links_direct": (0.80, 0.98),
    "js_errors": (0.50, 1.00),
    "no_overflow": (0.60, 1.00),
    "images_load": (0.70, 1.00),
    "mixed_content": (0.95, 1.00),
    "schema_coverage": (0.30, 0.95),
    "schema_valid": (0.80, 1.00),
    "schema_complete": (0.90, 1.00),
}
# Fixed values: (group, weight) of every metric, the groups' declared weights, the categories' weights.
METRICS = {
    "noindex_expected": ("indexability", 8.0),
    "indexable": ("indexability", 8.0),
    "sitemap": ("indexability", 4.0),
    "sitemap_coverage": ("indexability", 3.0),
    "robots": ("indexability", 2.0),
    "canonical": ("indexability", 3.0),
    "canonical_self": ("indexability", 2.0),
    "soft_404": ("indexability", 2.0),
    "title_present": ("metadata", 5.0),
    "title_unique": ("metadata", 4.0),
    "title_length": ("metadata", 3.0),
    "desc_present": ("metadata", 4.0),
    "desc_unique": ("metadata", 3.0),
    "desc_length": ("metadata", 2.0),
    "h1": ("metadata", 4.0),
    "social": ("metadata", 2.0),
    "html_basics": ("metadata", 1.5),
    "no_placeholder": ("content", 4.0),
    "encoding": ("content", 3.0),
    "word_depth": ("content", 4.0),
    "spelling": ("content", 2.0),
    "img_alt": ("content", 3.0),
    "hygiene": ("content", 1.5),
    "linked": ("architecture", 5.0),
    "links_in_html": ("architecture", 1.5),
    "reachable": ("architecture", 4.0),
    "click_depth": ("architecture", 3.0),
    "inbound_depth": ("architecture", 2.0),
    "http_200": ("health", 3.0),
    "links_resolve": ("health", 3.0),
    "links_direct": ("health", 2.0),
    "js_errors": ("health", 2.0),
    "no_overflow": ("health", 1.5),
    "images_load": ("health", 1.0),
    "mixed_content": ("health", 1.5),
    "schema_coverage": ("structured", 2.0),
    "schema_valid": ("structured", 3.5),
    "schema_complete": ("structured", 2.5),
    "https": ("trust", 2.0),
    "exposed": ("trust", 2.0),
    "enumeration": ("trust", 1.0),
}
GROUP_WEIGHTS = {"indexability": 24.0, "metadata": 20.0, "content": 16.0, "architecture": 14.0, "health": 13.0, "structured": 8.0, "trust": 5.0}
DECLARED_WEIGHTS = {"indexability": 24.0, "metadata": 28.5, "content": 17.5, "architecture": 15.5, "health": 14.0, "structured": 8.0, "trust": 5.0, "vitals": 100.0}
CATEGORY_WEIGHTS = {"seo": 60.0, "performance": 40.0}
BANDS = ((90, "excellent", "good"), (80, "strong", "good"), (65, "needs work", "medium"), (45, "weak", "high"))
VITAL_POINTS = {
    "desktop": {"fcp": (934, 1600), "lcp": (1200, 2400), "tbt": (150, 350), "cls": (0.1, 0.25), "si": (1311, 2300)},
    "mobile": {"fcp": (1800, 3000), "lcp": (2500, 4000), "tbt": (200, 600), "cls": (0.1, 0.25), "si": (3387, 5800)},
}
VITAL_WEIGHTS = {"fcp": 10.0, "lcp": 25.0, "tbt": 30.0, "cls": 25.0}
ERF_INVERSE_08 = 0.9061938024368232


def ramp(value: Column, floor: Column | float, target: Column | float) -> Column:
    """0 at the floor, 1 at the target, linear between; a step where they meet."""
    floor, target = (x if isinstance(x, Column) else F.lit(float(x)) for x in (floor, target))
    step = F.when(value.isNotNull(), (value >= target).cast("double"))
    return F.when(target <= floor, step).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - floor) / F.nullif(target - floor, F.lit(0.0))))) * F.when(value.isNotNull(), 1.0)


def windowed(metric: str, value: Column) -> Column:
    return ramp(value, *WINDOWS[metric])


def falling(value: Column, good: float, bad: float) -> Column:
    """1 up to `good`, 0 from `bad`, linear between."""
    return F.when(value <= good, 1.0).when(value >= bad, 0.0).when(value.isNotNull(), (F.lit(float(bad)) - value) / (bad - good))


def band(total: Column) -> Column:
    """struct<word, severity> of a score."""
    chain = F.when(total.isNull(), F.struct(F.lit("not scored").alias("word"), F.lit("low").alias("severity")))
    for floor, word, severity in BANDS:
        chain = chain.when(total >= floor, F.struct(F.lit(word).alias("word"), F.lit(severity).alias("severity")))
    return chain.otherwise(F.struct(F.lit("critical").alias("word"), F.lit("critical").alias("severity")))


def weighted_mean(score: Column, weight: Column) -> Column:
    """Aggregate: weights of unmeasured scores do not count; null where nothing was measured."""
    measured = F.sum(F.when(score.isNotNull(), weight))
    return F.sum(score * weight) / F.nullif(measured, F.lit(0.0))


def erfc(x: np.ndarray) -> np.ndarray:
    """The complementary error function of each entry, to 2e-15: near 0 by a series whose
    terms are all positive, further out by its continued fraction."""
    x = np.asarray(x, float)
    far = np.abs(x) >= 2.5
    near = np.where(far, 0.0, x)
    term = total = near * 2 / math.sqrt(math.pi) * np.exp(-near * near)
    for n in range(1, 70):
        term = term * 2 * near * near / (2 * n + 1)
        total = total + term
    out = 1 - total
    z = np.where(far, np.abs(x), 3.0)
    fraction = z
    for n in range(120, 0, -1):
        fraction = z + n / 2 / fraction
    tail = np.exp(-z * z) / (fraction * math.sqrt(math.pi))
    return np.where(np.isnan(x), np.nan, np.where(far, np.where(x > 0, tail, 2 - tail), out))


def lognormal_score(p10: float, median: float):
    """Arrow UDF of the log-normal cost curve: 0.9 at p10, 0.5 at the median."""

    @F.pandas_udf("double")
    def curve(values: pd.Series) -> pd.Series:
        if median <= 0 or p10 <= 0 or p10 >= median:
            return values.where(values.isna(), 0.0)
        scale = ERF_INVERSE_08 / math.log(median / p10)
        x = values.to_numpy(dtype=float, na_value=np.nan)
        return pd.Series(np.clip(0.5 * erfc(np.log(np.maximum(x, 1e-9) / median) * scale), 0.0, 1.0))

    return curve
