"""Some examples of many values: no array grows with the rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def smallest(rows: DataFrame, keys: list[str], column: str, most: int) -> DataFrame:
    """keys and `column`, an array of the `most` smallest distinct values that the key's rows have there.  Values
    are made distinct first, and each task hands on `most` of a key at most."""
    once = rows.filter(F.col(column).isNotNull()).select(*keys, column).distinct()
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(column))
    kept = once.withColumn("_nth", nth).filter(F.col("_nth") <= most)
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_list(column)).alias(column))
