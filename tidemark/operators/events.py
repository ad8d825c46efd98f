"""Event studies: response grids, per-minute metrics, event paths, thinning, threshold strategies."""

from __future__ import annotations

from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.special import binomial_p
from .asof import asof
from .bars import epoch_micros
from .frames import corr, drawdown, longest_runs, over
from .scans import numbered, span_of
from .stats import pairs


def response_grid(events: DataFrame, bars: DataFrame, horizons: list[int], direction: str = "forward", tolerance_s: int = 300, base_offset: int = -1) -> DataFrame:
    """events (key, ts, signal) -> key, signal, minute, ret for each horizon, in long form.

    The base price is looked up base_offset minutes from ts, the others at ts + minute. All lookups of all events are one
    as-of join; its shuffle is by time bucket.
    """
    at = lambda m: F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), m)
    spread = events.withColumn("minute", F.explode(F.array(*map(F.lit, [base_offset, *horizons])))).withColumn("__at", at(F.col("minute")))
    looked = asof(spread.select("key", "signal", "minute", F.col("__at").alias("ts")), bars, "close", direction, tolerance_s)
    base = F.max(F.when(F.col("minute") == base_offset, F.col("price"))).over(W.partitionBy("key"))
    return looked.withColumn("__p", base).filter(F.col("minute") != base_offset).select("key", "signal", "minute", (F.try_divide("price", "__p") - 1).alias("ret"))


def grid_metrics(grid: DataFrame, by: list[str], least: int = 20) -> DataFrame:
    """by, n, r, hit_pct: one aggregation over the long grid; r and hit_pct are null below `least` rows."""
    both = F.col("signal").isNotNull() & F.col("ret").isNotNull()
    live = both & (F.col("signal") != 0)
    out = grid.groupBy(*by).agg(
        pairs(F.col("signal"), F.col("ret")).alias("n"),
        corr(F.col("signal"), F.col("ret")).alias("r"),
        F.count_if(live & (F.signum("signal") == F.signum("ret"))).alias("hits"),
        F.count_if(live).alias("n_live"),
    )
    return out.select(*by, "n", F.when(F.col("n") >= least, F.col("r")).alias("r"), F.when((F.col("n") >= least) & (F.col("n_live") > 0), 100.0 * F.col("hits") / F.col("n_live")).alias("hit_pct"))


def horizon_table(grid: DataFrame, cost: float = 0.0004) -> DataFrame:
    """minute, n, hit_pct, gross, net, win_pct of trading each event in its signal's direction."""
    traded = grid.filter(F.col("ret").isNotNull() & (F.col("signal") != 0)).withColumn("g", F.signum("signal") * F.col("ret"))
    return traded.groupBy("minute").agg(
        F.count(F.lit(1)).alias("n"), (100.0 * F.avg(F.when(F.col("g") > 0, 1.0).otherwise(0.0))).alias("hit_pct"), F.sum("g").alias("gross"),
        F.sum(F.col("g") - cost).alias("net"), (100.0 * F.avg(F.when(F.col("g") > cost, 1.0).otherwise(0.0))).alias("win_pct"),
    )


def sigma_side(df: DataFrame, x: str, k: float, around_mean: bool = True, ddof: int = 1) -> DataFrame:
    """df with side: 1 above k standard deviations, -1 below; others are dropped. The moments are one broadcast row."""
    sd = (F.stddev_samp if ddof else F.stddev_pop)(x)
    one = df.agg((F.avg(x) if around_mean else F.lit(0.0)).alias("__m"), sd.alias("__s"))
    held = df.crossJoin(F.broadcast(one))
    side = F.when(F.col(x) > F.col("__m") + k * F.col("__s"), 1).when(F.col(x) < F.col("__m") - k * F.col("__s"), -1)
    return held.withColumn("side", side).filter("side is not null").drop("__m", "__s")


def event_paths(grid: DataFrame, k: float = 2.0) -> DataFrame:
    """side, minute, n, mean, se, t of responses to events beyond k sigma (moments over events, not over grid rows)."""
    sides = sigma_side(grid.select("key", "signal").distinct(), "signal", k).select(F.col("key").alias("__k"), "side")
    paths = grid.join(sides, F.col("key") == F.col("__k")).groupBy("side", "minute").agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), (F.stddev_samp("ret") / F.sqrt(F.count("ret"))).alias("se"))
    return paths.withColumn("t", F.try_divide("mean", "se"))


def turning_point(paths: DataFrame, after: int = 3) -> DataFrame:
    """(side, minute, mean) -> side, turn: the first minute, at least `after` steps on, where the path's slope changes sign against
    the side: from falling to rising on side 1, from rising to falling on side -1; null without one.
    """
    w = over("minute", ["side"])
    held = paths.withColumn("__s", F.signum(F.col("mean") - F.lag("mean").over(w))).withColumn("__k", F.row_number().over(w) - 2)
    held = held.withColumn("__m", F.lag("minute").over(w)).withColumn("__was", F.lag("__s").over(w))
    turned = F.when(F.col("side") > 0, F.col("__s") > F.col("__was")).otherwise(F.col("__s") < F.col("__was"))
    return held.groupBy("side").agg(F.min(F.when(turned & (F.col("__k") - 1 >= after), F.col("__m"))).alias("turn"))


def curve_summary(metrics: DataFrame, significant: float) -> DataFrame:
    """peak_minute (largest |r|, earliest on ties), first and last minute with |r| above a bound, and how many."""
    strong = F.abs("r") > significant
    return metrics.agg(F.max_by("minute", F.struct(F.round(F.abs("r"), 9), -F.col("minute"))).alias("peak_minute"), F.min(F.when(strong, F.col("minute"))).alias("first_minute"), F.max(F.when(strong, F.col("minute"))).alias("last_minute"), F.count_if(strong).alias("n_strong"), F.avg("hit_pct").alias("mean_hit"))


def thin(events: DataFrame, gap_s: int, part: list[str]) -> DataFrame:
    """Keep an event if it comes more than gap_s after the last kept one: a fold over the sorted times of each chain.

    A chain is a run of events without a longer gap; the first of each is kept whatever came before. As no two events in a
    bucket of the gap's width are further apart, chains come from the first and last time of each bucket. Rows of a chain
    are sorted (and may spill) and pass through one by one; none are gathered in a row.
    """
    us = gap_s * 1_000_000
    held = events.select(*part, "ts", epoch_micros(F.col("ts")).alias("__t")).withColumn("__b", F.col("__t") - F.pmod("__t", F.lit(max(us, 1)).cast("long")))
    w = over("__b", part)
    ends = held.groupBy(*part, "__b").agg(F.min("__t").alias("__lo"), F.max("__t").alias("__hi"))
    ends = ends.withColumn("__far", F.coalesce(F.col("__lo") - F.lag("__hi").over(w) > us, F.lit(True)))
    ends = ends.withColumn("__s", F.last(F.when(F.col("__far"), F.col("__lo")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    keys = [*part, "__b"]
    ends = ends.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__s")
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    first = F.row_number().over(over("__t", [*part, "__s"])) == 1
    chains = held.join(ends, reduce(and_, same)).select(*part, "ts", "__t", first.alias("__first"))

    def fold(batches):
        last = None
        for batch in batches:
            kept = []
            for t, new in zip(batch.column("__t").to_pylist(), batch.column("__first").to_pylist(), strict=True):
                keep = new or t is None or t - last > us
                last = t if keep else last
                kept.append(keep)
            yield batch.select([*part, "ts"]).filter(pa.array(kept, pa.bool_()))

    return chains.mapInArrow(fold, events.select(*part, "ts").schema)


def threshold_grid(trades: DataFrame, sigmas: list[float], cost: float = 0.0004) -> DataFrame:
    """(signal, minute, ret) -> sigma, minute, trades, total, avg, win_pct, profit_factor of trading beyond k sigma.

    The parameter rows are exploded from an array, so there is no join; one aggregation serves the whole grid.
    """
    one = trades.agg(F.stddev_samp("signal").alias("__s"))
    spread = trades.crossJoin(F.broadcast(one)).withColumn("sigma", F.explode(F.array(*map(F.lit, sigmas)))).filter(F.abs("signal") > F.col("sigma") * F.col("__s"))
    pnl = spread.withColumn("pnl", F.signum("signal") * F.col("ret") - cost).filter("pnl is not null")
    return pnl.groupBy("sigma", "minute").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("pnl").alias("total"), F.avg("pnl").alias("avg"), (100.0 * F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0))).alias("win_pct"),
        F.try_divide(F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), -F.sum(F.when(F.col("pnl") < 0, F.col("pnl")))).alias("profit_factor"),
    )


def threshold_report(trades: DataFrame, sigmas: list[float], cost: float = 0.0) -> DataFrame:
    """(ts, key, signal, ret, regime) -> sigma, side (all, long, short), regime (its names, and all), trades, total, avg, win_pct, sd,
    max_drawdown, wins, losses, hold: trading in the signal's direction beyond k sigma, in the order of ts and key; hold is what the
    same trades make without a direction. Wins and losses are the longest runs.
    """
    one = trades.agg(F.stddev_samp("signal").alias("__s"))
    spread = trades.filter("ret IS NOT NULL").crossJoin(F.broadcast(one)).withColumn("sigma", F.explode(F.array(*map(F.lit, sigmas)))).filter(F.abs("signal") > F.col("sigma") * F.col("__s"))
    spread = spread.withColumn("side", F.explode(F.array(F.lit("all"), F.when(F.col("signal") > 0, "long").otherwise("short")))).withColumn("regime", F.explode(F.array(F.lit("all"), F.col("regime"))))
    by = ["sigma", "side", "regime"]
    held = spread.select(*by, F.struct("ts", "key").alias("at"), "ret", (F.signum("signal") * F.col("ret") - cost).alias("pnl"))
    made = drawdown(held, "pnl", "at", False, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"), F.sum("pnl").alias("total"), F.avg("pnl").alias("avg"), (100.0 * F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0))).alias("win_pct"),
        F.stddev_pop("pnl").alias("sd"), F.min("drawdown").alias("max_drawdown"), F.sum("ret").alias("hold"),
    )
    return made.join(longest_runs(held, "pnl", "at", by), by)


def learned_sign(df: DataFrame, x: str, ret: str, train: str, thresholds: list[float], cost: float = 0.0004) -> DataFrame:
    """Beyond each threshold, trade the sign that did better on the training rows; thr, n, sign, hits, net, p on the rest."""
    spread = df.filter(F.col(ret).isNotNull() & F.col(x).isNotNull()).withColumn("thr", F.explode(F.array(*map(F.lit, thresholds)))).filter(F.abs(x) > F.col("thr"))
    spread = spread.withColumn("g", F.signum(x) * F.col(ret))
    sign = F.when(F.sum(F.when(F.col(train), F.col("g"))) >= 0, 1).otherwise(-1)
    signs = spread.groupBy("thr").agg(sign.alias("sign")).withColumnRenamed("thr", "__t")
    tested = spread.filter(~F.col(train)).join(signs, F.col("thr") == F.col("__t")).withColumn("g", F.col("g") * F.col("sign"))
    out = tested.groupBy("thr", "sign").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("g") > 0).alias("hits"), F.sum(F.col("g") - cost).alias("net"))
    return out.withColumn("p", binomial_p(F.col("hits"), F.col("n")))


def without_calendar(df: DataFrame, calendar: DataFrame, days: int = 1) -> DataFrame:
    """Rows not within some days of a calendar's dates."""
    near = calendar.select(F.explode(F.sequence(F.date_sub("d", days), F.date_add("d", days))).alias("__d")).distinct()
    return df.join(near, F.col("d") == F.col("__d"), "left_anti")


def every_kth(df: DataFrame, k: int, order: str) -> DataFrame:
    """Every k-th row, from the first."""
    return numbered(df, order, span_of(df, order), "__n").filter(F.col("__n") % k == 0).drop("__n")
