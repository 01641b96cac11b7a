"""Connected components of a graph of links, with hubs kept apart.

Labels spread to neighbours and then jump to their own label's label, so rounds grow with the logarithm of
the longest path.  A node that more than a HUB_SHARE-th of all links reach is a hub; there are fewer than
twice that many hubs, so their labels are broadcast, and so are the labels that more than such a share of
all nodes carry.  All other joins are on keys with few rows.  Of a graph of at most FEW_NODES nodes all labels are
broadcast.  Every round is written to the shared folder; the last is one in which no neighbour has a lower label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

HUB_SHARE = 2_000
#: A graph of so many nodes has its labels broadcast.
FEW_NODES = 10_000


def split_join(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """rows left-joined with table on key.  hot: the keys (at most some thousand) that many rows have, which
    are joined by a broadcast; None if there are none."""
    if hot is None:
        return rows.join(table, key, "left")
    hot = F.broadcast(hot.select(key))
    common = rows.join(hot, key, "left_semi").join(F.broadcast(table.join(hot, key, "left_semi")), key, "left")
    return common.unionByName(rows.join(hot, key, "left_anti").join(table, key, "left"))


def hot_keys(rows: DataFrame, key: str, total: int, label: str) -> DataFrame | None:
    """The keys that more than a HUB_SHARE-th of `total` rows have, or None."""
    found = staged(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(total / HUB_SHARE, 1)).select(key), f"{label}-hot")
    return None if found.isEmpty() else found


def components(links: DataFrame, label: str, known: DataFrame | None = None) -> DataFrame:
    """doc, class (the smallest doc of its component) for every doc that (a, b) links name.  known: the result
    for some of these links, to begin with."""
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{label}-links")
    labels = both.groupBy(F.col("a").alias("doc")).agg(F.least(F.min("b"), F.first("a")).alias("class"))
    if known is not None:
        labels = labels.join(known.select("doc", F.col("class").alias("known")), "doc", "left").select("doc", F.least("class", "known").alias("class"))
    labels = staged(labels, label)
    nodes = labels.count()
    few = nodes <= FEW_NODES
    hubs = None if few else hot_keys(both, "b", both.count(), label)
    held = F.broadcast if few else (lambda table: table)
    while True:
        seen = split_join(both, held(labels.select(F.col("doc").alias("b"), "class")), "b", hubs)
        near = seen.groupBy(F.col("a").alias("doc")).agg(F.min("class").alias("near"))
        spread = staged(near.join(held(labels), "doc").select("doc", "class", F.least("class", "near").alias("new")), label)
        if spread.filter("new <> class").isEmpty():
            return labels
        jump = held(spread.select(F.col("doc").alias("new"), F.col("new").alias("further")))
        moved = split_join(spread, jump, "new", None if few else hot_keys(spread, "new", nodes, label))
        labels = staged(moved.select("doc", F.coalesce("further", "new").alias("class")), label)
