"""Positions, costs, leverage, exits, and performance metrics.

Daily series are (d, ret, ...) rows; intraday ones (day, i, ret, ...) with i the row within the day. Sequential rules that
depend on their own last state are folds over one day's sorted rows inside the JVM.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scans
from .frames import drawdown, full, over, rolling
from .orderstats import expanding_quantiles, quantile_columns
from .quantiles import exact_quantiles

# ---- metrics


def sharpe(ret: Column, year: int = 252, ddof: int = 1, plain: bool = False) -> Column:
    """Mean over deviation, annualised; 0 without deviation. With plain, what the division gives then: infinite with the mean's
    sign, NaN if that is 0 too; null for too few values.
    """
    sd, mean = (F.stddev_samp if ddof else F.stddev_pop)(ret), F.avg(ret)
    ratio = F.when(sd > 0, mean / sd * F.sqrt(F.lit(float(year))))
    if not plain:
        return ratio.otherwise(F.lit(0.0))
    return F.when(sd.isNotNull(), ratio.when(mean > 0, float("inf")).when(mean < 0, float("-inf")).otherwise(float("nan")))


def profit_factor(pnl: Column) -> Column:
    """Gains over losses; infinite without losses, null without trades."""
    gain, loss = F.sum(F.when(pnl > 0, pnl)), -F.sum(F.when(pnl < 0, pnl))
    return F.when(loss > 0, F.coalesce(gain, F.lit(0.0)) / loss).when(gain > 0, F.lit(float("inf")))


def metrics(df: DataFrame, by: list[str], ret: str, order: str, year: int = 252, compound: bool = False, ddof: int = 1, plain: bool = False) -> DataFrame:
    """by, n, total, mean, sharpe (with plain as there), max_drawdown, win_pct, profit_factor of return rows."""
    held = drawdown(df, ret, order, compound, by)
    total = F.exp(F.sum(F.log1p(ret))) - 1 if compound else F.sum(ret)
    return held.groupBy(*by).agg(
        F.count(ret).alias("n"), total.alias("total"), F.avg(ret).alias("mean"), sharpe(F.col(ret), year, ddof, plain).alias("sharpe"), F.min("drawdown").alias("max_drawdown"),
        (100.0 * F.avg(F.when(F.col(ret) > 0, 1.0).otherwise(0.0))).alias("win_pct"), profit_factor(F.col(ret)).alias("profit_factor"),
    )


def compound_metrics(df: DataFrame, by: list[str], ret: str, order: str, year: int = 252) -> DataFrame:
    """by, n, total, annual (geometric), vol, sharpe and sortino (annual return over deviation, over downside deviation),
    max_drawdown, calmar, pl_ratio (mean gain over mean loss), simple (mean return times the year).
    """
    r = F.col(ret)
    held = drawdown(df, ret, order, True, by).groupBy(*by).agg(
        F.count(r).alias("n"), (F.exp(F.sum(F.log1p(r))) - 1).alias("total"), (F.stddev_samp(r) * F.sqrt(F.lit(float(year)))).alias("vol"),
        (F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), 2))) * F.sqrt(F.lit(float(year)))).alias("__down"), F.min("drawdown").alias("max_drawdown"),
        F.try_divide(F.avg(F.when(r > 0, r)), -F.avg(F.when(r < 0, r))).alias("pl_ratio"), (F.avg(r) * year).alias("simple"),
    )
    held = held.withColumn("annual", annual(F.col("total"), F.col("n"), year))
    ratios = {"sharpe": F.col("vol"), "sortino": F.col("__down"), "calmar": F.abs("max_drawdown")}
    return held.withColumns({k: F.try_divide("annual", c) for k, c in ratios.items()}).drop("__down")


def against(totals: DataFrame, name: str, total: str, base: str) -> DataFrame:
    """totals with alpha (what a row has above the base's row) and best: the row, other than the base, with the most."""
    one = totals.filter(F.col(name) == base).agg(F.max(total).alias("__b"))
    held = totals.crossJoin(F.broadcast(one)).withColumn("alpha", F.col(total) - F.col("__b"))
    first = F.row_number().over(W.partitionBy(F.col(name) != base).orderBy(F.desc(F.round("alpha", 9)), name)) == 1
    return held.withColumn("best", (F.col(name) != base) & first).drop("__b")


def exposure(df: DataFrame, by: list[str], pos: str, order: str) -> DataFrame:
    """by, short_pct, flat_pct, changes, avg_leverage."""
    held = df.withColumn("__d", F.abs(F.col(pos) - F.lag(pos).over(over(order, by))))
    share = lambda c: 100.0 * F.avg(F.when(c, 1.0).otherwise(0.0))
    return held.groupBy(*by).agg(share(F.col(pos) < 0).alias("short_pct"), share(F.col(pos) == 0).alias("flat_pct"), F.count_if(F.col("__d") > 0).alias("changes"), F.avg(F.abs(pos)).alias("avg_leverage"))


def net_returns(df: DataFrame, pos: str, ret: str, order: str, fee: float = 0.0004, funding: str | None = None, first_cost: bool = False, part: list[str] | None = None) -> DataFrame:
    """df with strat (position times return, less turnover fees and funding) and hold (buy and hold, less funding)."""
    before = F.lag(pos).over(over(order, part))
    turn = F.abs(F.col(pos) - (F.coalesce(before, F.lit(0.0)) if first_cost else F.coalesce(before, F.col(pos))))
    rate = F.coalesce(funding, F.lit(0.0)) if funding else F.lit(0.0)
    return df.withColumn("strat", F.col(pos) * F.col(ret) - turn * fee - F.col(pos) * rate).withColumn("hold", F.col(ret) - rate)


# ---- daily rules; each adds pos


def rv_regime(df: DataFrame, rv: str, short: int, long: int, q: float, order: str = "d", confirm: Column | None = None, first: float = 0.0) -> DataFrame:
    """The days that have a ratio of rv's short mean over its long mean: -1 a day after the ratio exceeded the quantile of the
    ratios before it (and confirm held, over all days), else +1.

    The quantile is strictly prior, infinite while it is undefined; the first day's position is `first`.
    """
    w = over(order)
    held = df.withColumn("ratio", F.try_divide(rolling(F.avg, F.col(rv), short, w), rolling(F.avg, F.col(rv), long, w)))
    held = held.withColumn("__ok", F.coalesce(F.lit(True) if confirm is None else confirm, F.lit(False))).filter("ratio IS NOT NULL")
    held = quantile_columns(held, {"limit": ("ratio", q, True, 1)}, order).withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    held = held.withColumn("__raw", F.when((F.col("ratio") > F.col("limit")) & F.col("__ok"), -1.0).otherwise(1.0))
    return held.withColumn("pos", F.coalesce(F.lag("__raw").over(w), F.lit(first))).drop("__raw", "__ok")


def regime_positions(df: DataFrame, order: str, levels: list[float], part: list[str]) -> DataFrame:
    """df (ratio) -> a row for each level q, with pos as in rv_regime: one pass finds all quantiles of a partition's series."""
    w, names = over(order, part), F.array(*map(F.lit, levels))
    held = expanding_quantiles(df.filter("ratio IS NOT NULL"), "ratio", levels, order, part, prior_only=True, out="__l")
    limit = lambda k: F.coalesce(F.get("__l", F.lit(k)), F.lit(float("inf")))
    held = held.withColumn("__r", F.array(*[F.when(F.col("ratio") > limit(k), -1.0).otherwise(1.0) for k in range(len(levels))]))
    held = held.withColumn("__p", F.lag("__r").over(w)).drop("__l", "__r")
    each = F.transform(F.sequence(F.lit(0), F.lit(len(levels) - 1)), lambda k: F.struct(F.get(names, k).alias("q"), F.coalesce(F.get("__p", k), F.lit(0.0)).alias("pos")))
    return held.withColumn("__x", F.explode(each)).select("*", "__x.*").drop("__p", "__x")


def falling(ret: str, n: int, order: str = "d") -> Column:
    """Whether the sum of the last n returns, this one included, is negative."""
    return rolling(F.sum, F.col(ret), n, over(order)) < 0


def below_average(close: str, n: int, order: str = "d") -> Column:
    """Whether the close is below its n-day mean."""
    return F.col(close) < rolling(F.avg, F.col(close), n, over(order))


def rv_and_funding(df: DataFrame, rv: str, short: int, long: int, q: float, rate: str, n: int, rate_q: float, order: str = "d") -> DataFrame:
    """rv_regime whose shorts also need the n-day mean of the rate above the quantile of its values before, over the days
    that have both.
    """
    w = over(order)
    held = rv_regime(df.withColumn("__f", F.round(rolling(F.avg, F.col(rate), n, w), 12)), rv, short, long, q, order).filter("__f IS NOT NULL")
    held = quantile_columns(held, {"__l": ("__f", rate_q, True, 1)}, order)
    high = F.col("__f") > F.coalesce("__l", F.lit(float("inf")))
    held = held.withColumn("__raw", F.when((F.col("ratio") > F.col("limit")) & high, -1.0).otherwise(1.0))
    return held.withColumn("pos", F.coalesce(F.lag("__raw").over(w), F.lit(0.0))).drop("__f", "__l", "__raw")


def funding_rule(df: DataFrame, rate: str, n: int, q: float, order: str = "d") -> DataFrame:
    """The days that have an n-day funding sum: -1 a day after it exceeded the quantile of the sums so far (this one
    included), else +1; the first day is +1.
    """
    w = over(order)
    held = df.withColumn("__f", F.round(rolling(F.sum, F.col(rate), n, w), 9)).filter("__f IS NOT NULL")
    held = quantile_columns(held, {"__q": ("__f", q, False, 1)}, order)
    held = held.withColumn("__r", F.when(F.col("__f") > F.col("__q"), -1.0).otherwise(1.0))
    return held.withColumn("pos", F.coalesce(F.lag("__r").over(w), F.lit(1.0))).drop("__f", "__q", "__r")


def funding_modes(df: DataFrame, rate: str, interest: str, taker: str, n: int, high: float, low: float, order: str = "d") -> DataFrame:
    """df, from the first n-day funding sum on, for each mode: funding_only (the sum above its upper quantile), funding_oi (and
    open interest rising), composite (scores of funding, interest and taker imbalance that add up to -1 or less); short a day
    after. Quantiles are of the values so far, this day included; interest without a value counts as 0 in the score.
    """
    w = over(order)
    held = df.withColumn("__f", F.round(rolling(F.sum, F.col(rate), n, w), 9)).filter("__f IS NOT NULL")
    limits = {"__hi": ("__f", high), "__lo": ("__f", low), "__qi": ("__i", 0.8), "__th": (taker, 0.85), "__tl": (taker, 0.15)}
    held = quantile_columns(held.withColumn("__i", F.coalesce(interest, F.lit(0.0))), {k: (x, p, False, 1) for k, (x, p) in limits.items()}, order)
    many, over_top = F.col("__i") > F.col("__qi"), F.col("__f") > F.col("__hi")
    score = F.when(over_top, -1.0).when(F.col("__f") < F.col("__lo"), 1.0).otherwise(0.0)
    score += F.when(many & (F.col("__f") > 0), -0.5).when(many & (F.col("__f") < 0), 0.5).otherwise(0.0)
    score += F.when(F.col(taker) > F.col("__th"), -0.5).when(F.col(taker) < F.col("__tl"), 0.5).otherwise(0.0)
    rules = {"funding_only": over_top, "funding_oi": over_top & F.coalesce(F.col(interest) > 0, F.lit(False)), "composite": score <= -1.0}
    held = held.select(*df.columns, *[F.when(c, -1.0).otherwise(1.0).alias(mode) for mode, c in rules.items()])
    held = held.select(*df.columns, *[F.coalesce(F.lag(mode).over(w), F.lit(1.0)).alias(mode) for mode in rules])
    return held.unpivot(df.columns, list(rules), "mode", "pos")


def imbalance_rules(df: DataFrame, x: str, n: int, high: float, low: float, order: str = "d") -> DataFrame:
    """df from the n-th row on, for each mode: short a day after the n-day mean of x was above its upper expanding quantile
    (mean_reversion) or below its lower one (momentum), else long; the quantiles hold this day, the first position is 0.
    """
    w = over(order)
    held = df.withColumn("__s", F.round(rolling(F.avg, F.col(x), n, w), 12)).filter("__s is not null")
    held = quantile_columns(held, {"__hi": ("__s", high, False, 1), "__lo": ("__s", low, False, 1)}, order)
    short = (("mean_reversion", F.col("__s") > F.col("__hi")), ("momentum", F.col("__s") < F.col("__lo")))
    held = held.select(*df.columns, *[F.coalesce(F.lag(F.when(c, -1.0).otherwise(1.0)).over(w), F.lit(0.0)).alias(mode) for mode, c in short])
    return held.unpivot(df.columns, [mode for mode, _ in short], "mode", "pos")


def low_funding(df: DataFrame, rate: str, interest: str, lengths: list[int], spans: list[int], order: str = "d") -> DataFrame:
    """df for each length fw, from its fw-th row on, with f (the sum of that many rates) and falling_<n> for each span: whether the
    mean of the last n changes of open interest, of these rows, is negative (false until there are n).
    """
    w = over(order)
    sums = df.withColumns({str(n): F.round(rolling(F.sum, F.col(rate), n, w), 9) for n in lengths})
    held = sums.unpivot(df.columns, [f"`{n}`" for n in lengths], "fw", "f").withColumn("fw", F.col("fw").cast("int")).filter("f is not null")
    each = over(order, ["fw"])
    return held.withColumns({f"falling_{n}": F.coalesce(F.round(rolling(F.avg, F.col(interest), n, each), 12) < 0, F.lit(False)) for n in spans})


def score_rule(df: DataFrame, flags: list[Column], threshold: int, order: str = "d") -> DataFrame:
    """Each flag that holds subtracts one; short a day after the score reached -threshold."""
    score = F.lit(0)
    for flag in flags:
        score = score - F.coalesce(flag, F.lit(False)).cast("int")
    held = df.withColumn("score", score).withColumn("__r", F.when(F.col("score") <= -threshold, -1.0).otherwise(1.0))
    return held.withColumn("pos", F.coalesce(F.lag("__r").over(over(order)), F.lit(1.0))).drop("__r")


def filter_rule(df: DataFrame, x: str, q: float, rising: bool, lag: int = 2, least: int = 30, order: str = "d") -> DataFrame:
    """Long `lag` days after x was above the quantile of at least `least` values so far (and, if asked, above its value two rows
    before), else flat.
    """
    w = over(order)
    held, on = quantile_columns(df, {"__q": (x, q, False, least)}, order), F.col(x) > F.col("__q")
    if rising:
        on = on & (F.col(x) > F.lag(x, 2).over(w))
    held = held.withColumn("__on", F.coalesce(on, F.lit(False)))
    return held.withColumn("pos", F.when(F.coalesce(F.lag("__on", lag).over(w), F.lit(False)), 1.0).otherwise(0.0)).drop("__on", "__q")


def volatility_filters(df: DataFrame, vol: str, search: str, mood: str, order: str = "d", least: int = 30) -> DataFrame:
    """df for each of twelve rules A to L, with pos: long or flat a day after what an implied volatility, a search index and a
    0-100 sentiment said; the first day is long. Quantiles take at least `least` values so far; what is unknown does not hold.
    """
    w = over(order)
    limits = {"__v4": (vol, 0.4), "__v5": (vol, 0.5), "__v6": (vol, 0.6), "__s8": (search, 0.8)}
    known = quantile_columns(df, {k: (x, p, False, least) for k, (x, p) in limits.items()}, order)
    v, holds = F.col(vol), lambda c: F.coalesce(c, F.lit(False))
    high, move = holds(v > F.col("__v5")), F.try_divide(v, F.lag(v, 2).over(w)) - 1
    up, down, crowd = holds(move > 0), holds(move < 0), holds(F.col(search) > F.col("__s8"))
    m = F.col(mood)
    bad = holds(v < F.col("__v5")).cast("int") + down.cast("int") + holds(m < 45).cast("int")
    rules = {
        "A": high, "B": up, "C": high | up, "D": high & up, "E": holds(v > F.col("__v6")), "F": high & ~crowd, "G": (high | up) & ~crowd, "H": high & holds(m > 50),
        "I": high | holds(m > 60), "J": ~(holds(v < F.col("__v4")) & down & holds(m < 40)), "K": bad < 2, "L": high & holds(F.col(search) <= F.col("__s8")) & holds(m > 40),
    }
    held = known.withColumns({f"rule_{k}": F.when(c, 1.0).otherwise(0.0) for k, c in rules.items()})
    held = held.select(*df.columns, *[F.coalesce(F.lag(f"rule_{k}").over(w), F.lit(1.0)).alias(f"rule_{k}") for k in rules])
    return held.unpivot(df.columns, [f"rule_{k}" for k in rules], "variant", "pos").withColumn("variant", F.substring("variant", 6, 1))


def lagged_filters(df: DataFrame, vol: str, mood: str, order: str = "d", least: int = 30) -> DataFrame:
    """df for each of seven rules (A to E, H, K), with pos: long or flat by an implied volatility of two days before and a sentiment
    of the day before. Where a volatility signal is not known yet, A, B and E have no position, and in the others it does not hold.
    """
    w, held = over(order), quantile_columns(df, {"__v5": (vol, 0.5, False, least), "__v6": (vol, 0.6, False, least)}, order)
    v, move = F.col(vol), F.try_divide(F.col(vol), F.lag(vol, 2).over(w)) - 1
    said = {"__high": v > F.col("__v5"), "__top": v > F.col("__v6"), "__up": move > 0, "__down": move < 0}
    held = held.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in said.items()})
    held = held.withColumns({k: F.lag(k, 2).over(w) for k in said} | {"__glad": F.lag(F.coalesce(F.col(mood) > 50, F.lit(False))).over(w), "__fear": F.lag(F.coalesce(F.col(mood) < 40, F.lit(False))).over(w)})
    holds = lambda c: F.coalesce(F.col(c), F.lit(False))
    number = lambda c: c.cast("int").cast("double")
    bad = (~holds("__high")).cast("int") + holds("__down").cast("int") + holds("__fear").cast("int")
    known = F.col("__high").isNotNull()  # an unknown left side makes C false, whatever the right one says
    rules = {
        "A": number(F.col("__high")), "B": number(F.col("__up")), "C": number(known & (holds("__high") | holds("__up"))), "D": number(holds("__high") & holds("__up")),
        "E": number(F.col("__top")), "H": number(holds("__high") & holds("__glad")), "K": number(bad < 2),
    }
    held = held.select(*df.columns, *[c.alias(f"rule_{k}") for k, c in rules.items()])
    return held.unpivot(df.columns, [f"rule_{k}" for k in rules], "variant", "pos").withColumn("variant", F.substring("variant", 6, 1))


def contrarian(x: Column, low: float = 25, high: float = 75) -> Column:
    """Long in fear, short in greed, else flat."""
    return F.when(x < low, 1.0).when(x > high, -1.0).otherwise(0.0)


def quantile_leverage(df: DataFrame, x: str) -> DataFrame:
    """lev: 0.5, 1, 1.5 or 2 by the quartile of x's size, negative where x is positive."""
    one = exact_quantiles(df, F.abs(x), [0.25, 0.5, 0.75]).select(F.col("quantiles").alias("__q"))
    size = F.lit(0.5) + 0.5 * F.size(F.filter("__q", lambda e: e <= F.abs(x)))
    return df.crossJoin(F.broadcast(one)).withColumn("lev", F.when(F.col(x) > 0, -size).otherwise(size)).drop("__q")


def soft_leverage(posterior: list[Column], levels: list[float], most: float) -> Column:
    """The mean of the states' leverages under their probabilities, within [-most, most]."""
    mean = sum((p * lev for p, lev in zip(posterior[1:], levels[1:], strict=True)), posterior[0] * levels[0])
    return F.greatest(F.least(mean, F.lit(most)), F.lit(-most))


def hard_leverage(alert: Column, fear: Column, alert_min: float, fear_min: float, levels: list[float]) -> Column:
    """levels are those of normal, alert and fear: fear where it is likely enough, else alert where that is, else normal."""
    return F.when(fear > fear_min, levels[2]).when(alert > alert_min, levels[1]).otherwise(levels[0])


def objective(sharpe_: Column, drawdown_: Column, trades: Column, funding: Column, over_leverage: Column, fee: float = 0.0004) -> Column:
    """Sharpe less half of the drawdown, costs of trades and funding, and twice the share of days beyond the leverage limit."""
    return sharpe_ - 0.5 * F.abs(drawdown_) - 0.3 * trades * fee - 0.4 * funding - 2.0 * over_leverage


def annual(total: Column, n: Column, year: int = 252) -> Column:
    """Geometric annual return of a total return over n days."""
    return F.pow(1 + total, F.lit(float(year)) / n) - 1


def smooth(df: DataFrame, target: str, step: float, order: str, part: list[str], out: str = "pos") -> DataFrame:
    """Positions that move towards the target by at most `step` a row: a fold, as each depends on its own last value."""
    rows = df.groupBy(*part).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(target, F.lit(0.0)).alias("t")))).alias("all"))
    moved = lambda p, t: p + F.least(F.greatest(t - p, F.lit(-step)), F.lit(step))
    start = F.struct(F.lit(0.0).alias("p"), F.transform(F.slice("all", 1, 0), lambda x: F.struct(x["o"].alias("o"), x["t"].alias("t"), F.lit(0.0).alias("p"))).alias("done"))
    fold = F.aggregate("all", start, lambda s, x: F.struct(moved(s["p"], x["t"]).alias("p"), F.concat(s["done"], F.array(F.struct(x["o"].alias("o"), x["t"].alias("t"), moved(s["p"], x["t"]).alias("p")))).alias("done")), lambda s: s["done"])
    return rows.select(*part, F.explode(fold).alias("x")).select(*part, F.col("x.o").alias(order), F.col("x.t").alias(target), F.col("x.p").alias(out))


def hold_last(df: DataFrame, x: str, threshold: float, order: str, part: list[str] | None = None) -> DataFrame:
    """Inside the dead zone the last direction outside it stays: a carried value, no state needed."""
    sign = F.when(F.abs(x) >= threshold, F.signum(x))
    if not part:
        held = scans.last_known(df, sign, order, scans.span_of(df, order), "pos")
        return held.withColumn("pos", F.coalesce("pos", F.lit(0.0)))
    return df.withColumn("pos", F.coalesce(F.last(sign, ignorenulls=True).over(over(order, part).rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0)))


# ---- intraday rules


def daily_pnl(bars: DataFrame, direction: DataFrame, leverage: Column, fee: float = 0.0005, slip: float = 0.0005, least: int = 10) -> DataFrame:
    """(day, ret) bars and (day, dir) -> day, pnl, n: one direction a day, entry and exit costs by leverage."""
    by_day = bars.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("ret").alias("sum_ret"))
    held = by_day.filter(F.col("n") >= least).join(direction.filter("dir <> 0"), "day").withColumn("lev", leverage)
    return held.select("day", "n", "lev", (F.col("dir") * F.col("sum_ret") * F.col("lev") - 2 * (fee + slip) * F.col("lev")).alias("pnl"))


def stops(bars: DataFrame, target: float, trail: float, stop: float) -> DataFrame:
    """(day, i, ret) -> day, final, take_profit, trailing, stop_loss, both: the running sum's value at each rule's first hit.

    A stop loss acts once the path is below -stop, and takes the path's value there. A trailing stop acts once the peak exceeds the trail and the path falls more than the trail below it; where both stops
    apply, the earlier row decides and the trailing stop is tested first.
    """
    w = W.partitionBy("day").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    path = bars.withColumn("cum", F.sum("ret").over(w)).withColumn("peak", F.max("cum").over(w))
    hit_trail = (F.col("peak") > trail) & (F.col("cum") < F.col("peak") - trail)
    hit_stop = F.col("cum") < -stop
    first = lambda hit: F.min_by("cum", F.when(hit, F.col("i")))
    final = F.max_by("cum", "i")
    return path.groupBy("day").agg(
        final.alias("final"), F.when(F.max("cum") >= target, F.lit(target)).otherwise(final).alias("take_profit"), F.coalesce(first(hit_trail), final).alias("trailing"),
        F.coalesce(first(hit_stop), final).alias("stop_loss"), F.coalesce(first(hit_trail | hit_stop), final).alias("both"),
        F.max("cum").alias("max_excursion"), F.max_by("i", F.struct("cum", -F.col("i"))).alias("max_row"),
    )


def min_hold(bars: DataFrame, flag: str, rows: int = 5) -> DataFrame:
    """(day, i, flag) -> day, i, pos, trades: out of the market (0) from a flagged row to the first unflagged one at least `rows`
    rows later, else 1; trades counts the changes so far. A fold over each day's rows.
    """
    all_rows = bars.groupBy("day").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce(F.col(flag), F.lit(False)).alias("f")))).alias("all"))
    none = F.lit(None).cast("int")
    row = lambda i, pos, trades: F.struct(i.alias("i"), pos.alias("pos"), trades.alias("trades"))
    start = F.struct(none.alias("since"), F.lit(0).alias("trades"), F.transform(F.slice("all", 1, 0), lambda x: row(x["i"], F.lit(1), F.lit(0))).alias("done"))

    def step(s: Column, x: Column) -> Column:
        leave, back = s["since"].isNull() & x["f"], s["since"].isNotNull() & ~x["f"] & (x["i"] - s["since"] >= rows)
        since = F.when(leave, x["i"]).when(back, none).otherwise(s["since"])
        trades = s["trades"] + (leave | back).cast("int")
        return F.struct(since.alias("since"), trades.alias("trades"), F.concat(s["done"], F.array(row(x["i"], since.isNull().cast("int"), trades))).alias("done"))

    return all_rows.select("day", F.explode(F.aggregate("all", start, step, lambda s: s["done"])).alias("x")).select("day", "x.i", "x.pos", "x.trades")


def anomaly_rules(bars: DataFrame, flag: str, norm: str, rows: int = 5) -> DataFrame:
    """(day, i, ret, dir, flag, norm) -> mode, day, n, n_trades, gross of holding the day's direction: always (baseline), out or
    at half size in flagged stretches (exit, leverage, with a least stay), from the first unflagged row on (filter), or with
    1 - norm of the size (sizing, whose trades are changes of more than a tenth).
    """
    w, held = over("i", ["day"]), bars.join(min_hold(bars.select("day", "i", flag), flag, rows), ["day", "i"])
    before = W.partitionBy("day").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    entered = F.max((~F.coalesce(F.col(flag), F.lit(False))).cast("int")).over(before)
    size = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col(norm)))
    share = {"baseline": F.lit(1.0), "exit": F.col("pos").cast("double"), "leverage": F.when(F.col("pos") == 0, 0.5).otherwise(1.0), "filter": entered.cast("double"), "sizing": size}
    wide = held.withColumns({f"__{k}": c for k, c in share.items()})
    wide = wide.withColumn("__moved", F.coalesce(F.abs(F.col("dir") * F.col("__sizing") - F.lag(F.col("dir") * F.col("__sizing")).over(w)) > 0.1, F.lit(False)))
    trades = {"baseline": F.lit(2), "exit": 2 + F.max("trades"), "leverage": 2 + F.max("trades"), "filter": 2 * F.max("__filter"), "sizing": 2 + F.count_if("__moved")}
    day = wide.groupBy("day").agg(F.count(F.lit(1)).alias("n"), *[F.struct(trades[k].cast("long").alias("n_trades"), F.sum(F.col("dir") * F.col(f"__{k}") * F.col("ret")).alias("gross")).alias(k) for k in share])
    return day.unpivot(["day", "n"], list(share), "mode", "x").select("mode", "day", "n", "x.n_trades", "x.gross")


def breakout(bars: DataFrame, trigger: float, look: int, hold: int, lev: float = 1.0, cost: float = 0.002) -> DataFrame:
    """(day, i, close, ret, flag) -> day, entry, exit, side, pnl: from a flagged row, the first of the next `look` rows at or
    beyond the trigger is entered and held for `hold` rows; pnl is the sum of the returns from the entry's row on, times lev,
    less cost times lev. Rows up to the exit are skipped. Depends on its own exits: one pandas pass for each day.
    """

    def one(pdf):
        pdf = pdf.sort_values("i")
        close, ret, flag, index = pdf["close"].to_numpy(float), pdf["ret"].to_numpy(float), pdf["flag"].to_numpy(bool), pdf["i"].to_numpy()
        rows, k, n = [], 0, len(pdf)
        while k < n:
            ahead = close[k + 1 : k + 1 + look]
            up, down = ahead >= close[k] * (1 + trigger), ahead <= close[k] * (1 - trigger)
            if not flag[k] or not (up | down).any():
                k += 1
                continue
            j = int((up | down).argmax())
            entry = k + 1 + j
            side, leave = (1 if up[j] else -1), min(entry + hold, n - 1)
            rows.append((pdf["day"].iloc[0], int(index[entry]), int(index[leave]), side, float(side * ret[entry : leave + 1].sum() * lev - cost * lev)))
            k = leave + 1
        return pd.DataFrame(rows, columns=["day", "entry", "exit", "side", "pnl"])

    return bars.select("day", "i", "close", "ret", "flag").groupBy("day").applyInPandas(one, "day date, entry int, exit int, side int, pnl double")


def vol_target(df: DataFrame, vol: Column, target: Column | float, most: Column | float = 3.0, base: Column | float = 1.0, without: Column | float = 2.0) -> DataFrame:
    """lev: base times target over forecast volatility, within [0.5, most]; `without` where there is no forecast above 0."""
    goal, top, none = (x if isinstance(x, Column) else F.lit(x) for x in (target, most, without))
    lev = F.least(F.greatest(goal / vol * base, F.lit(0.5)), top)
    return df.withColumn("lev", F.when(vol > 0, lev).otherwise(none))


def base_leverage(strength: Column, strong: float = 1.2) -> Column:
    """3 on days whose signal is at least `strong`, else 2."""
    return F.when(F.abs(strength) >= strong, 3.0).otherwise(2.0)


def vol_sizing(days: DataFrame, most: list[float], trip: float = 0.002, signed_twice: bool = True) -> DataFrame:
    """(day, dir, strength, ret, sd) of each day traded -> rule, most, day, lev, pnl: leverage by the deviation of the day before
    (prev), by the mean of the five before (mean), and by that mean and the strength of the day's signal within [0.8, 1.5]
    (boost), with costs for a round trip by leverage; rule fixed, at most 2.0, is twofold leverage.

    The goal is twice the median deviation of the days that have both forecasts, which are the days traded. The published
    rule takes the day's direction twice, so a short day earns as a long one; signed_twice=False takes it once.
    """
    w = W.orderBy("day")
    held = days.withColumn("prev", F.lag("sd").over(w)).withColumn("mean", full(F.avg("sd").over(w.rowsBetween(-5, -1)), F.col("sd"), w.rowsBetween(-5, -1), 5))
    held = held.filter("prev IS NOT NULL AND mean IS NOT NULL AND sd IS NOT NULL")
    held = held.crossJoin(F.broadcast(held.agg((2 * F.percentile("sd", F.lit(0.5))).alias("goal"))))
    boost = F.least(F.greatest(F.abs("strength"), F.lit(0.8)), F.lit(1.5))
    rules = [F.struct(F.lit(r).alias("rule"), F.lit(float(m)).alias("most"), v.alias("vol"), b.alias("base")) for r, v, b in (("prev", F.col("prev"), F.lit(1.0)), ("mean", F.col("mean"), F.lit(1.0)), ("boost", F.col("mean"), boost)) for m in most]
    held = vol_target(held.withColumn("x", F.explode(F.array(*rules))).select("*", "x.*"), F.col("vol"), F.col("goal"), F.col("most"), F.col("base"), 2.0 * F.col("base"))
    fixed = held.filter((F.col("rule") == "prev") & (F.col("most") == most[0])).withColumns({"rule": F.lit("fixed"), "most": F.lit(2.0), "lev": F.lit(2.0)})
    signed = F.col("ret") if signed_twice else F.col("dir") * F.col("ret")
    signed = F.when(F.col("rule") == "fixed", F.col("dir") * F.col("ret")).otherwise(signed)
    return held.union(fixed.select(held.columns)).select("rule", "most", "day", "lev", (signed * F.col("lev") - trip * F.col("lev")).alias("pnl"))


def relevered(df: DataFrame, lev: str, base: Column | float, every: int = 30, least: float = 0.3) -> DataFrame:
    """(day, i from 1) -> day, changes: how often, looking every so many rows, leverage is further than `least` from what it was
    at the last change (base, one for a day, at first): a fold over a day's few looks.
    """
    first = F.any_value(base if isinstance(base, Column) else F.lit(base)).alias("first")
    looks = df.filter((F.col("i") - 1) % every == 0).groupBy("day").agg(F.sort_array(F.collect_list(F.struct("i", F.col(lev).alias("l")))).alias("all"), first)
    start = F.struct(F.col("first").alias("at"), F.lit(0).alias("n"))
    moved = lambda s, x: F.abs(x["l"] - s["at"]) > least
    fold = F.aggregate("all", start, lambda s, x: F.struct(F.when(moved(s, x), x["l"]).otherwise(s["at"]).alias("at"), (s["n"] + moved(s, x).cast("int")).alias("n")), lambda s: s["n"])
    return looks.select("day", fold.alias("changes"))


def slippage(orders: DataFrame, book: DataFrame) -> DataFrame:
    """orders (key, ts, qty) and book (ts, level, price, size, mid) -> key, filled, vwap, slip of walking the levels.

    A book is summed up once for its ts, in the order of level, price and size, and no deeper than the largest order of that
    ts reaches: where many orders and books share a ts, each order meets a few rows and not all of them.
    """
    w = W.partitionBy("ts").orderBy("level", "price", "size").rowsBetween(W.unboundedPreceding, -1)
    most = orders.groupBy("ts").agg(F.max("qty").alias("most"))
    ladder = book.join(most, "ts").withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0.0))).filter((F.col("before") < F.col("most")) | (F.col("before") == 0))
    walked = orders.join(ladder, "ts").withColumn("take", F.greatest(F.lit(0.0), F.least(F.col("size"), F.col("qty") - F.col("before"))))
    mid = F.min_by("mid", F.struct("level", "price", "size", "mid"))
    out = walked.groupBy("key").agg(F.sum("take").alias("filled"), F.try_divide(F.sum(F.col("take") * F.col("price")), F.sum("take")).alias("vwap"), mid.alias("mid"))
    return out.select("key", "filled", "vwap", (F.col("vwap") - F.col("mid")).alias("slip"))
