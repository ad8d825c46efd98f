"""As-of joins from equi-joins on time buckets, exact lookups, positional lookups and carried values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bars import epoch_micros
from .frames import blocks
from .scans import last_known, span_of


def asof(events: DataFrame, bars: DataFrame, value: str, direction: str, tolerance_s: int = 300, out: str = "price") -> DataFrame:
    """events (with ts) plus the value of the nearest bar at or after (forward) or at or before (backward) ts.

    Events go to two buckets of the tolerance's width, bars to one; the join is on equal buckets and the nearest bar is an
    aggregate with map-side partial results. No sort over the whole series, no cartesian product.
    """
    if direction not in ("forward", "backward"):
        raise ValueError("direction is forward or backward")
    tau, sign = tolerance_s * 1_000_000, 1 if direction == "forward" else -1
    keyed = events.select("ts").distinct().withColumn("__t", epoch_micros(F.col("ts")))
    spread = keyed.withColumn("__b", F.explode(F.array(F.floor(F.col("__t") / tau), F.floor(F.col("__t") / tau) + sign)))
    own = bars.select(epoch_micros(F.col("ts")).alias("__bt"), F.col(value).alias("__v")).withColumn("__bb", F.floor(F.col("__bt") / tau))
    gap = (F.col("__bt") - F.col("__t")) * sign
    hits = spread.join(own, F.col("__b") == F.col("__bb")).withColumn("__gap", gap).filter(F.col("__gap").between(0, tau))
    best = hits.groupBy(F.col("ts").alias("__ts")).agg(F.min_by("__v", F.struct("__gap", "__v")).alias(out), F.min("__gap").alias("gap_us"))
    return events.join(best, F.col("ts") == F.col("__ts"), "left").drop("__ts")


def exact(events: DataFrame, bars: DataFrame, value: str, offsets: list[int]) -> DataFrame:
    """events in long form: the value exactly `minutes` after ts, for each offset; null where the minute has no bar."""
    spread = events.withColumn("minutes", F.explode(F.array(*map(F.lit, offsets)))).withColumn("__at", F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("minutes")))
    return spread.join(bars.select(F.col("ts").alias("__bt"), F.col(value)), F.col("__at") == F.col("__bt"), "left").drop("__at", "__bt")


def positional(bars: DataFrame, value: str, steps: list[int], day: str) -> DataFrame:
    """The change to the value some rows later (not minutes; rows are counted across days), as value_<k>."""
    w = W.partitionBy("block").orderBy("n")
    held = blocks(bars, "ts", day, 0, max(steps)).withColumns({f"{value}_{k}": F.try_divide(F.lead(value, k).over(w), F.col(value)) - 1 for k in steps})
    return held.filter("own").drop("block", "own", "n")


def carried(bars: DataFrame, other: DataFrame, value: str, day) -> DataFrame:
    """bars left-joined to other on ts; gaps filled from earlier rows (across days), then from later ones of the day.

    Filling across days needs only each day's last value: a window over days carries it, and windows over rows stay within
    a day. The day table comes from other's own rows that fall on a bar, so the joined bars are made once.
    """
    joined = bars.join(other.select("ts", value), "ts", "left").withColumn("__day", day)
    w = W.partitionBy("__day").orderBy("ts")
    joined = joined.withColumn("__up", F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    joined = joined.withColumn("__down", F.first(value, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)))
    days = bars.select("ts").join(other.select("ts", value), "ts", "left").groupBy(day.alias("__of")).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("ts"))).alias("__last"))
    before = F.last("__last", ignorenulls=True).over(W.orderBy("__of").rowsBetween(W.unboundedPreceding, -1))
    days = days.select("__of", before.alias("__before"))
    fill = F.coalesce("__up", "__before", "__down")
    return joined.join(days, F.col("__day") == F.col("__of")).withColumn(value, fill).drop("__before", "__day", "__of", "__up", "__down")


def daily_asof(base: DataFrame, other: DataFrame, value: str, out: str) -> DataFrame:
    """base (with d) plus the last known value of other at or before d, without a limit: both by day, scanned by spans of days."""
    days = base.select("d", F.lit(None).cast("double").alias("v")).union(other.select("d", F.col(value).cast("double")))
    filled = last_known(days.groupBy("d").agg(F.max("v").alias("v")), F.col("v"), "d", span_of(base, "d"), "__v")
    return base.join(filled.select("d", F.col("__v").alias(out)), "d", "left")
