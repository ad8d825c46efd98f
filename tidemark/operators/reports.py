"""Tables that studies report: horizons after costs, exact-minute responses, calendars of strategies, dead zones, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import minute_of_day, normalised
from ..functions.special import p_of_r
from .asof import exact
from .bars import epoch_minute
from .frames import corr
from .scans import last_known, span_of
from .stats import pairs
from .strategy import sharpe


def _pct(c: Column) -> Column:
    return 100.0 * F.avg(F.when(c, 1.0).otherwise(0.0))


def horizon_report(grid: DataFrame, by: list[str], cost: float = 0.0004, side: int = 1) -> DataFrame:
    """by, n, r, p, hit_pct, gross, net (means a trade), win_pct, cum_net of trading each event's signal, or against it (side -1).

    Every event with a signal and a return is a trade. A signal of 0 holds nothing, pays the cost, and hits where the return is 0.
    """
    held = grid.filter(F.col("signal").isNotNull() & F.col("ret").isNotNull()).withColumn("__s", side * F.signum("signal"))
    gain = F.col("__s") * F.col("ret")
    out = held.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), corr(F.col("signal"), F.col("ret")).alias("r"), _pct(F.signum("ret") == F.col("__s")).alias("hit_pct"),
        F.avg(gain).alias("gross"), (F.avg(gain) - cost).alias("net"), _pct(gain > 0).alias("win_pct"), F.sum(gain - cost).alias("cum_net"),
    )
    return out.withColumn("p", p_of_r(F.col("r"), F.col("n")))


def response_table(events: DataFrame, bars: DataFrame, value: str, offsets: dict[str, int], need: str | None = None) -> DataFrame:
    """events (with ts) plus a column for each offset: the return from the bar at ts to the bar exactly that many minutes later.

    Events without a bar at ts go. So do those without a return at the offset named by need or, if none is named, at any offset.
    All offsets are one equi-join on the minute and one aggregation.
    """
    at = lambda m: F.max(F.when(F.col("minutes") == m, F.col(value)))
    wide = exact(events, bars, value, sorted({0, *offsets.values()})).groupBy(*events.columns).agg(at(0).alias("__base"), *[at(m).alias(f"__{name}") for name, m in offsets.items()])
    wide = wide.select(*events.columns, *[(F.try_divide(f"__{name}", "__base") - 1).alias(name) for name in offsets])
    return wide.filter(F.coalesce(*([need] if need else offsets)).isNotNull())


def yearly(df: DataFrame, strat: str, hold: str, pos: str, order: str = "d", days: int = 365) -> DataFrame:
    """year, n, total and hold (compounded), excess, sharpe, flat_pct, exposure_pct, ahead: a strategy beside buying and holding."""
    grown = lambda c: F.exp(F.sum(F.log1p(c))) - 1
    out = df.groupBy(F.year(order).alias("year")).agg(
        F.count(F.lit(1)).alias("n"), grown(strat).alias("total"), grown(hold).alias("hold"), sharpe(F.col(strat), days).alias("sharpe"),
        _pct(F.col(pos) == 0).alias("flat_pct"), (100.0 * F.avg(F.abs(pos))).alias("exposure_pct"),
    )
    return out.withColumn("excess", F.col("total") - F.col("hold")).withColumn("ahead", F.col("excess") > 0)


def corr_table(df: DataFrame, by: str, x: str, ys: list[str], least: int = 3) -> DataFrame:
    """by, then the correlation of x with each of ys: a row for each group and one, with a null group, for all rows; null below
    least pairs. One aggregation by rollup.
    """
    cell = lambda y: F.when(pairs(F.col(x), F.col(y)) >= least, corr(F.col(x), F.col(y)))
    return df.rollup(by).agg(*[cell(y).alias(y) for y in ys])


def monthly_table(df: DataFrame, strategies: list[str], order: str = "d") -> DataFrame:
    """month, then each strategy's compounded return in per cent; 0 in months where it has no rows."""
    cell = lambda c: F.coalesce(100.0 * (F.exp(F.sum(F.log1p(c))) - 1), F.lit(0.0))
    return df.groupBy(F.trunc(order, "month").alias("month")).agg(*[cell(c).alias(c) for c in strategies])


def dead_zone(df: DataFrame, x: str, mode: str, threshold: float = 0.3, order: str = "d", by: list[str] | tuple[str, ...] = (), out: str = "lev") -> DataFrame:
    """df with a leverage from the target x. Below the threshold in size: "none" takes it as it is, "neutral" goes flat, "hold" keeps
    the leverage held before (0 before the first). A null target counts as one inside the zone.
    """
    clear = F.when(F.abs(x) >= threshold, F.col(x))
    if mode == "hold":
        return last_known(df, clear, order, span_of(df, order), out, by).withColumn(out, F.coalesce(out, F.lit(0.0)))
    if mode not in ("none", "neutral"):
        raise ValueError(f"no such mode: {mode}")
    return df.withColumn(out, F.coalesce(F.col(x) if mode == "none" else clear, F.lit(0.0)))


def coverage(bars: DataFrame, minutes: int, first: int = 0, last: int = 1440) -> DataFrame:
    """day, n, missing_pct: the bars of each day's slots between two minutes of the day, and the share of slots without one."""
    slots = -(-(last - first) // minutes)
    inside = bars.filter(minute_of_day(F.col("ts")).between(first, last - 1))
    slot = F.floor((minute_of_day(F.col("ts")) - first) / minutes)
    return inside.groupBy(F.to_date("ts").alias("day")).agg(F.count_distinct(slot).alias("n")).withColumn("missing_pct", 100.0 - 100.0 * F.col("n") / slots)


def complete_days(bars: DataFrame, minutes: int, most: float = 5.0, first: int = 0, last: int = 1440) -> DataFrame:
    """Bars of the days that lack less than `most` per cent of their slots."""
    whole = coverage(bars, minutes, first, last).filter(F.col("missing_pct") < most).select(F.col("day").alias("__day"))
    return bars.join(whole, F.to_date("ts") == F.col("__day"), "left_semi")


def whole_windows(bars: DataFrame, minutes: int, rows: int) -> DataFrame:
    """Bars that end a window of `rows` slots of their day of which none lacks its bar."""
    back = W.partitionBy(F.to_date("ts")).orderBy(epoch_minute(F.col("ts"))).rangeBetween(-(rows - 1) * minutes, 0)
    return bars.withColumn("__n", F.count(F.lit(1)).over(back)).filter(F.col("__n") == rows).drop("__n")


def side_volumes(df: DataFrame, by: list[str], side: str, volume: str, sell: str = "SELL", buy: str = "BUY") -> DataFrame:
    """by, long_volume (sold, as when longs are closed by force) and short_volume, whatever case and space the side is written in."""
    of = lambda name: F.sum(F.when(normalised(F.col(side)) == name, F.col(volume)).otherwise(0.0))
    return df.groupBy(*by).agg(of(sell).alias("long_volume"), of(buy).alias("short_volume"))
