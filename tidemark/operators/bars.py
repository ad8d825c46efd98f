"""Ticks to bars, gaps, daily series, and the clocks of trade days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scans import reach

from ..functions.scalars import safe_ratio


def from_ticks(ticks: DataFrame, minutes: int = 1) -> DataFrame:
    """OHLCV bars; first and last price by (ts, id), imbalance by count of trades. One shuffle with partial sums."""
    order = F.struct("ts", "id")
    sells, buys = F.count_if("is_buyer_maker"), F.count_if(~F.col("is_buyer_maker"))
    at = floor_minutes(F.col("ts"), minutes)
    return ticks.groupBy(at.alias("ts")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("qty").alias("volume"), F.sum("quote_qty").alias("quote_volume"), F.count(F.lit(1)).alias("trade_count"), F.avg("qty").alias("avg_trade_size"),
        safe_ratio((buys - sells).cast("double"), F.count(F.lit(1))).alias("trade_imbalance"),
    )


def floor_minutes(ts: Column, minutes: int) -> Column:
    day = F.date_trunc("day", ts).cast("timestamp_ntz")
    k = F.floor((F.hour(ts) * 60 + F.minute(ts)) / minutes) * minutes
    return day + F.make_dt_interval(F.lit(0), F.lit(0), k.cast("int"))


def epoch_minute(ts: Column) -> Column:
    """Minutes since 1970 of a zoneless timestamp; no session time zone is involved."""
    return F.datediff(ts, F.lit("1970-01-01")).cast("long") * 1440 + F.hour(ts) * 60 + F.minute(ts)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zoneless timestamp."""
    return F.datediff(ts, F.lit("1970-01-01")).cast("long") * 86_400_000_000 + F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def kline_imbalance(klines: DataFrame) -> DataFrame:
    """Imbalance of bars that report taker volumes: by volume, not by count."""
    return klines.withColumn("trade_imbalance", safe_ratio(2 * F.col("taker_buy_volume") - F.col("volume"), F.col("volume"))).withColumn("avg_trade_size", safe_ratio(F.col("volume"), F.col("trade_count")))


def filled(bars: DataFrame, minutes: int) -> DataFrame:
    """Every slot of each day that has bars, from its first to its last: prices carried from their own last value, sums 0.

    Spines are made day by day, so windows stay within a day's partition.
    """
    day = F.to_date("ts")
    spine = bars.groupBy(day.alias("day")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    spine = spine.select("day", F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {minutes} MINUTES"))).alias("ts"))
    order = W.partitionBy("day").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    joined = spine.join(bars, "ts", "left")
    prices = {c: F.last(c, ignorenulls=True).over(order) for c in ("open", "high", "low", "close")}
    sums = {c: F.coalesce(c, F.lit(0).cast(bars.schema[c].dataType)) for c in ("volume", "quote_volume", "trade_count", "avg_trade_size", "trade_imbalance")}
    return joined.withColumns(prices | sums)


def realized_vol(bars: DataFrame, day: Column) -> DataFrame:
    """(d, rv): root of the summed squared log returns within each day, days without movement left out."""
    order = W.partitionBy("d").orderBy("ts")
    step = F.log(F.col("close") / F.lag("close").over(order))
    return bars.filter("close > 0").select(day.alias("d"), "ts", "close").withColumn("r", step).groupBy("d").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("rv")).filter("rv > 0")


def daily_close_return(bars: DataFrame, day: Column) -> DataFrame:
    """(d, close, ret) from each day's last bar; the window runs over days, not bars."""
    last = bars.groupBy(day.alias("d")).agg(F.max_by("close", "ts").alias("close"))
    return last.withColumn("ret", F.try_divide("close", F.lag("close").over(W.orderBy("d"))) - 1)


def session_return(bars: DataFrame, day: Column, least: int = 10) -> DataFrame:
    """(d, n, ret) from each day's first to last bar, for days with enough bars."""
    ends = bars.groupBy(day.alias("d")).agg(F.count(F.lit(1)).alias("n"), F.min_by("close", "ts").alias("a"), F.max_by("close", "ts").alias("b"))
    return ends.filter(F.col("n") >= least).select("d", "n", (F.try_divide("b", "a") - 1).alias("ret"))


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an explicit order; which row stays never depends on partitioning."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def gaps(df: DataFrame, seconds: float, part: list[str]) -> DataFrame:
    """Rows that come more than `seconds` after the one before in their partition, with gap_s."""
    before = F.lag("ts").over(W.partitionBy(*part).orderBy("ts"))
    gap = (epoch_micros(F.col("ts")) - epoch_micros(before)) / 1e6
    return df.withColumn("gap_s", gap).filter(F.col("gap_s") > seconds)


def mean_by(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """One row a key: the means of the columns whose name, without case, "_" and spaces, holds one of the names."""
    plain = lambda c: c.lower().replace("_", "").replace(" ", "")
    kept = [c for c in df.columns if c != key and any(n in plain(c) for n in names)]
    return df.groupBy(key).agg(*[F.avg(c).alias(c) for c in kept])


def consecutive(df: DataFrame, gap_s: int, first_hour: int, last_hour: int, part: list[str] | None = None) -> DataFrame:
    """Rows that come exactly gap_s after the row before, at hours between first_hour and last_hour."""
    gap = lambda w: {"__g": epoch_micros(F.col("ts")) - F.lag(epoch_micros(F.col("ts"))).over(w)}
    held = df.withColumns(gap(W.partitionBy(*part).orderBy("ts"))) if part else reach(df, "ts", F.to_date("ts"), 1, 0, gap)
    return held.filter((F.col("__g") == gap_s * 1_000_000) & F.hour("ts").between(first_hour, last_hour)).drop("__g")
