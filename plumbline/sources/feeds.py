"""Snapshots of feeds: which one a run reads, as of its start.

snapshots: feed, taken (timestamp), failed (the download failed), and what was kept of it (its path, say);
runs: site, feed, started.  A snapshot no older than the limit is fresh.  Where none is, the latest one that
was kept is read all the same and marked as stale, as an old list says more than none; only a feed that was
never kept is absent, and what it would have said is unmeasured, not clean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds: feeds change hourly at most.
FRESH_S = 12 * 3600
#: Runs and snapshots of a feed are dealt by days, so that a feed that all runs ask is no single partition.
DAY_S = 86_400


def chosen(runs: DataFrame, snapshots: DataFrame, fresh_s: int = FRESH_S) -> DataFrame:
    """runs with snapshot (struct of taken and what was kept; null if there is none), age_s and state (fresh, stale
    or absent).

    An as-of join: within a day of a feed the last snapshot is carried forward to the runs behind it; a run with
    none before it on its day takes the day's carry, the last snapshot of any day before, which is found among
    one row a day.  Of snapshots of one time the greatest counts."""
    columns = [c for c in snapshots.columns if c not in ("feed", "taken", "failed")]
    day = F.floor(F.unix_timestamp("at") / DAY_S)
    kept = snapshots.filter("not coalesce(failed, false)").select("feed", F.col("taken").alias("at"), F.struct("taken", *columns).alias("snapshot"))
    kept = kept.groupBy("feed", "at").agg(F.max("snapshot").alias("snapshot")).withColumn("day", day)
    asked = runs.withColumn("at", F.col("started")).withColumn("day", day)

    last = kept.groupBy("feed", "day").agg(F.max_by("snapshot", "at").alias("last"))
    days = asked.select("feed", "day").unionByName(kept.select("feed", "day")).distinct().join(last, ["feed", "day"], "left")
    earlier = Window.partitionBy("feed").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carry = days.select("feed", "day", F.last("last", ignorenulls=True).over(earlier).alias("carry"))

    own = asked.select(F.struct(*runs.columns).alias("run"), "feed", "day", "at", F.lit(1).alias("turn"), F.lit(None).cast(kept.schema["snapshot"].dataType).alias("snapshot"))
    both = own.unionByName(kept.select(F.lit(None).cast(own.schema["run"].dataType).alias("run"), "feed", "day", "at", F.lit(0).alias("turn"), "snapshot"))
    until = Window.partitionBy("feed", "day").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_s", F.last("snapshot", ignorenulls=True).over(until)).filter("turn = 1").join(carry, ["feed", "day"], "left")
    found = F.coalesce("_s", "carry")
    out = met.select("run.*", found.alias("snapshot"))
    age = F.unix_timestamp("started") - F.unix_timestamp("snapshot.taken")
    state = F.when(F.col("snapshot").isNull(), "absent").when(age < fresh_s, "fresh").otherwise("stale")
    return out.withColumns({"age_s": age, "state": state})
