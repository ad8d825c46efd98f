"""Ordered frames: rolling, expanding, filling, runs, drawdowns.

`order` names the ordering columns and `part` the partition. Without a partition a window orders its series in one task, which
suits daily series; `scans` and `orderstats` have the forms for series of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scans


def over(order: str | list[str] = "d", part: list[str] | None = None):
    return W.partitionBy(*(part or [])).orderBy(*([order] if isinstance(order, str) else order))


def full(value: Column, x: Column, w, n: int) -> Column:
    """value where the frame w holds at least n non-null x."""
    return F.when(F.count(x).over(w) >= n, value)


def rolling(fn, x: Column, n: int, w, least: int | None = None) -> Column:
    """fn of x over the last n rows; null until `least` (default n) values are there."""
    frame = w.rowsBetween(-(n - 1), 0)
    return full(fn(x).over(frame), x, frame, n if least is None else least)


def prior(fn, x: Column, n: int, w, least: int) -> Column:
    """fn of x over the n rows before this one."""
    frame = w.rowsBetween(-n, -1)
    return full(fn(x).over(frame), x, frame, least)


def change(x: Column, n: int, w) -> Column:
    return F.try_divide(x, F.lag(x, n).over(w)) - 1


def returns(df: DataFrame, values: dict[str, str], order: str, day: str, partition_by_day: bool = False) -> DataFrame:
    """df with, for each (out, price column), the change from the row before: that of the day before for a day's first row, so
    a night's jump counts. The very first row, and any change from or to nothing, is 0. With partition_by_day each day's
    first row is 0.

    Rows are ordered within their day; across days only each day's last row is carried, by a window over days.
    """
    w = over(order, [day])
    prices = list(dict.fromkeys(values.values()))
    held, before = df, {c: F.lag(c).over(w) for c in prices}
    if not partition_by_day:
        last = df.groupBy(F.col(day).alias("__day")).agg(F.max_by(F.struct(*prices), F.col(order)).alias("__last"))
        held = df.join(last.select("__day", F.lag("__last").over(W.orderBy("__day")).alias("__from")), F.col(day).eqNullSafe(F.col("__day")))
        first = F.row_number().over(w) == 1
        before = {c: F.when(first, F.col(f"__from.{c}")).otherwise(F.lag(c).over(w)) for c in prices}
    held = held.withColumns({out: F.coalesce(F.try_divide(c, before[c]) - 1, F.lit(0.0)) for out, c in values.items()})
    return held if partition_by_day else held.drop("__day", "__from")


def forward_sum(x: Column, h: int, w) -> Column:
    """Sum of the next h values; null where fewer follow."""
    frame = w.rowsBetween(1, h)
    return full(F.sum(x).over(frame), x, frame, h)


def rolling_corr(x: Column, y: Column, n: int, w, least: int | None = None) -> Column:
    """Correlation over the last n rows, of rows with both values, from moments; null if either is constant."""
    frame = w.rowsBetween(-(n - 1), 0)
    return full(corr(x, y, lambda c: c.over(frame)), F.when(y.isNotNull(), x), frame, n if least is None else least)


def corr(x: Column, y: Column, at=lambda c: c) -> Column:
    """Correlation of pairwise complete rows; safe where a side is constant."""
    x, y = F.when(y.isNotNull(), x).cast("double"), F.when(x.isNotNull(), y).cast("double")
    spread = at(F.stddev_pop(x)) * at(F.stddev_pop(y))
    return F.try_divide(at(F.covar_pop(x, y)), F.when(spread > 1e-300, spread))


def forward_fill(x: Column, w) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))


def back_fill(x: Column, w) -> Column:
    return F.first(x, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))


def drawdown(df: DataFrame, ret: str, order: str, compound: bool, part: list[str] | None = None, out: str = "drawdown") -> DataFrame:
    """Distance from the running peak: of the running sum, or relative to the running product of 1 + ret. Without a partition the
    series is scanned by spans of its order.
    """
    if not part:
        return scans.drawdowns(df, F.col(ret), order, scans.span_of(df, order), compound, out)
    w = over(order, part).rowsBetween(W.unboundedPreceding, 0)
    path = F.exp(F.sum(F.log1p(ret)).over(w)) if compound else F.sum(ret).over(w)
    held = df.withColumn("__path", path).withColumn("__peak", F.max("__path").over(w))
    gap = F.col("__path") - F.col("__peak")
    return held.withColumn(out, gap / F.col("__peak") if compound else gap).drop("__path", "__peak")


def runs(df: DataFrame, flag: str, order: str, part: list[str] | None = None, out: str = "streak") -> DataFrame:
    """How many rows in a row the flag has held, 0 where it does not. Without a partition the series is scanned by spans."""
    if not part:
        return scans.streaks(df, F.col(flag), order, scans.span_of(df, order), out)
    held = df.withColumn("__f", F.coalesce(F.col(flag), F.lit(False)).cast("int"))
    held = held.withColumn("__g", F.sum(1 - F.col("__f")).over(over(order, part).rowsBetween(W.unboundedPreceding, 0)))
    inside = over(order, [*(part or []), "__g"]).rowsBetween(W.unboundedPreceding, 0)
    return held.withColumn(out, F.sum("__f").over(inside)).drop("__f", "__g")


def longest_runs(df: DataFrame, x: str, order: str, part: list[str]) -> DataFrame:
    """part, wins, losses: the longest runs of rows with x above 0, and of rows without."""
    won = runs(df.withColumn("__up", F.col(x) > 0), "__up", order, part, "__w")
    both = runs(won.withColumn("__down", ~F.col("__up")), "__down", order, part, "__l")
    return both.groupBy(*part).agg(F.max("__w").alias("wins"), F.max("__l").alias("losses"))


def edge(flag: Column, w) -> Column:
    """True where a flag turns on."""
    return F.coalesce(flag, F.lit(False)) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))


def windows(df: DataFrame, columns: list[str], n: int, order: str, part: list[str], first: int | None = None, last: int | None = None, least_rows: int | None = None) -> DataFrame:
    """Sliding windows of n rows within each partition: ends (order), row (from 1) and window (array of structs).

    first and last bound the row at which a window may end; least_rows drops shorter partitions.
    """
    w = over(order, part)
    rows = df.withColumn("row", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*part)))
    rows = rows.withColumn("window", F.collect_list(F.struct(*columns)).over(w.rowsBetween(-(n - 1), 0)))
    kept = (F.size("window") == n) & (F.col("__n") >= (least_rows or n))
    if first is not None:
        kept &= F.col("row").between(first, last)
    return rows.filter(kept).select(*part, order, "row", "window")


def numbered(df: DataFrame, order: str, day: str, out: str = "n") -> DataFrame:
    """df with each row's place (from 0) in the order of `order` over all days: counts of days give where each day starts, so
    rows are ordered within their day alone.
    """
    days = df.groupBy(day).agg(F.count(F.lit(1)).alias("__rows"))
    starts = days.select(F.col(day).alias("__day"), (F.sum("__rows").over(W.orderBy(day)) - F.col("__rows")).alias("__start"))
    held = df.join(starts, F.col(day) == F.col("__day"))
    return held.withColumn(out, F.col("__start") + F.row_number().over(over(order, [day])) - 1).drop("__day", "__start")


def blocks(df: DataFrame, order: str, day: str, before: int, after: int, size: int = 4096) -> DataFrame:
    """df in blocks of consecutive rows, each with copies of the `before` rows ahead of it and the `after` rows behind it: frames
    of that reach, over block and n, are right for rows with own = true, wherever days end.
    """
    held = numbered(df, order, day)
    block, at = F.floor(F.col("n") / size), F.col("n") % size
    copies = F.array(F.struct(block.alias("block"), F.lit(True).alias("own")))
    if after:
        copies = F.concat(copies, F.when((at < after) & (block > 0), F.array(F.struct((block - 1).alias("block"), F.lit(False).alias("own")))).otherwise(F.slice(copies, 1, 0)))
    if before:
        copies = F.concat(copies, F.when(at >= size - before, F.array(F.struct((block + 1).alias("block"), F.lit(False).alias("own")))).otherwise(F.slice(copies, 1, 0)))
    return held.withColumn("__c", F.explode(copies)).select("*", "__c.*").drop("__c")
