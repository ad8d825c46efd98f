"""Bars, sessions, daily aggregates, bins, rollups, deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import bars, frames, quantiles, stats
from ..operators.strategy import sharpe
from ..sources import views
from ..sources.views import with_views as sql
from .registry import r6, registry

QUERIES, ORACLE_SQL, query = registry()

_SLOPE = "SELECT d, slope - lag(slope) OVER (ORDER BY d) AS change FROM sig"


def slope_and_next(spark, sf):
    """(d, change, nxt): the signal's daily change and the next day's return."""
    w = frames.over("d")
    signal = views.sig(spark, sf).withColumn("change", F.col("slope") - F.lag("slope").over(w)).select("d", "change")
    price = views.px(spark, sf).withColumn("nxt", F.lead("close").over(w) / F.col("close") - 1).select("d", "nxt")
    return signal.join(price, "d")


@query(sql("""SELECT CASE WHEN abs(change) <= 20000 THEN 'small' WHEN abs(change) <= 60000 THEN 'middle' ELSE 'large' END AS bin, count(*) AS n,
  count(*) FILTER (WHERE sign(change) = sign(nxt)) AS hits, round(100.0 * count(*) FILTER (WHERE sign(change) = sign(nxt)) / count(*), 6) AS hit_pct
  FROM j WHERE change IS NOT NULL AND change <> 0 AND nxt IS NOT NULL GROUP BY 1""", "sig", "px", s=_SLOPE, p="SELECT d, lead(close) OVER (ORDER BY d) / close - 1 AS nxt FROM px", j="SELECT s.d, change, nxt FROM s JOIN p ON s.d = p.d"))
def slope_change_bins(spark, sf):
    held = slope_and_next(spark, sf).withColumn("bin", scalars.cut(F.abs("change"), [-1.0, 20000.0, 60000.0, 1e12], ["small", "middle", "large"]))
    return stats.hit_rate(held, ["bin"], F.col("change"), F.col("nxt")).select("bin", "n", "hits", r6("hit_pct"))


_BAR = "ts, open, high, low, close, volume, round(quote_volume, 6) AS quote_volume, trade_count, round(avg_trade_size, 6) AS avg_trade_size, round(trade_imbalance, 6) AS trade_imbalance"


def _bar_columns(df):
    return df.select("ts", "open", "high", "low", "close", "volume", r6("quote_volume"), "trade_count", r6("avg_trade_size"), r6("trade_imbalance"))


@query(sql(f"SELECT {_BAR} FROM b1", "b1"))
def ohlcv_1m(spark, sf):
    return _bar_columns(views.bars(spark, sf))


@query(sql(f"""SELECT {_BAR} FROM (SELECT g.ts, {', '.join(f'last_value({c} IGNORE NULLS) OVER (PARTITION BY g.ts::DATE ORDER BY g.ts ROWS UNBOUNDED PRECEDING) AS {c}' for c in ('open', 'high', 'low', 'close'))},
  coalesce(volume, 0) AS volume, coalesce(quote_volume, 0) AS quote_volume, coalesce(trade_count, 0) AS trade_count, coalesce(avg_trade_size, 0) AS avg_trade_size, coalesce(trade_imbalance, 0) AS trade_imbalance
  FROM g LEFT JOIN b15 USING (ts))""", "b15", g="SELECT unnest(generate_series(a, b, INTERVAL 15 MINUTE)) AS ts FROM (SELECT min(ts) AS a, max(ts) AS b FROM b15 GROUP BY ts::DATE)"))
def ohlcv_15m_filled(spark, sf):
    return _bar_columns(bars.filled(views.bars(spark, sf, 15), 15))


@query(sql("SELECT d, round(sqrt(sum(r * r)), 6) AS rv FROM (SELECT ts::DATE AS d, ln(close / lag(close) OVER (PARTITION BY ts::DATE ORDER BY ts)) AS r FROM b15) GROUP BY d HAVING sqrt(sum(r * r)) > 0", "b15"))
def realized_vol_daily(spark, sf):
    return bars.realized_vol(views.bars(spark, sf, 15), F.to_date("ts")).select("d", r6("rv"))


@query(sql("SELECT d, close, round(close / lag(close) OVER (ORDER BY d) - 1, 6) AS ret FROM (SELECT ts::DATE AS d, arg_max(close, ts) AS close FROM b15 GROUP BY 1)", "b15"))
def daily_close_return(spark, sf):
    return bars.daily_close_return(views.bars(spark, sf, 15), F.to_date("ts")).select("d", "close", r6("ret"))


_ET = "ts - INTERVAL 5 HOUR"


@query(sql(f"SELECT d, n, round(b / a - 1, 6) AS ret FROM (SELECT ({_ET})::DATE AS d, count(*) AS n, arg_min(close, ts) AS a, arg_max(close, ts) AS b FROM b1 WHERE hour({_ET}) * 60 + minute({_ET}) BETWEEN 570 AND 959 AND isodow({_ET}) < 6 GROUP BY 1) WHERE n >= 10", "b1"))
def session_return(spark, sf):
    et = scalars.eastern(F.col("ts"))
    inside = views.bars(spark, sf).filter(scalars.in_session(et))
    return bars.session_return(inside, F.to_date(et)).select("d", "n", r6("ret"))


@query(sql(f"SELECT ({_ET} + INTERVAL 7 HOUR)::DATE AS d, count(*) AS n, round(sum(price), 4) AS total, round(avg(price), 6) AS mean, (ts + INTERVAL 2 HOUR)::DATE AS utc22 FROM ticks GROUP BY 1, 5", "ticks"))
def trade_day_17h_funding(spark, sf):
    held = views.ticks(spark, sf).select(scalars.trade_day_17(scalars.eastern(F.col("ts"))).alias("d"), scalars.trade_day_utc22(F.col("ts")).alias("utc22"), "price")
    return held.groupBy("d", "utc22").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("price"), "total", 4), r6(F.avg("price"), "mean"))


@query(sql("SELECT ts, id, price FROM (SELECT date_trunc('hour', ts) AS ts, id, price, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ticks.ts, id) AS n FROM ticks) WHERE n = 1", "ticks"))
def dedupe_keep_first(spark, sf):
    held = views.ticks(spark, sf).select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "ts", "id", "price")
    return bars.keep_one(held, ["hour"], [F.asc("ts"), F.asc("id")]).select(F.col("hour").alias("ts"), "id", "price")


@query(sql("SELECT ts, id, price FROM (SELECT date_trunc('hour', ts) AS ts, id, price, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ticks.ts DESC, id DESC) AS n FROM ticks) WHERE n = 1", "ticks"))
def dedupe_keep_last(spark, sf):
    held = views.ticks(spark, sf).select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "ts", "id", "price")
    return bars.keep_one(held, ["hour"], [F.desc("ts"), F.desc("id")]).select(F.col("hour").alias("ts"), "id", "price")


@query(sql("SELECT ts::DATE AS d, round(avg(trade_imbalance), 6) AS imbalance, round(stddev_samp(close), 6) AS sd, sum(volume)::BIGINT AS volume, arg_min(open, ts) AS first_open, arg_max(extract(hour FROM ts), (high, -epoch(ts)))::INT AS hour_of_high FROM b1 GROUP BY 1", "b1"))
def daily_multi_agg(spark, sf):
    high = F.max_by(F.hour("ts"), F.struct("high", -bars.epoch_minute(F.col("ts"))))
    return views.bars(spark, sf).groupBy(F.to_date("ts").alias("d")).agg(r6(F.avg("trade_imbalance"), "imbalance"), r6(F.stddev_samp("close"), "sd"), F.sum("volume").alias("volume"), F.min_by("open", "ts").alias("first_open"), high.alias("hour_of_high"))


@query(sql("SELECT ts::DATE AS d, round(coalesce(sum(quote_qty) FILTER (WHERE is_buyer_maker), 0), 4) AS long_side, round(coalesce(sum(quote_qty) FILTER (WHERE NOT is_buyer_maker), 0), 4) AS short_side, count(*) AS n, round(sum(CASE WHEN is_buyer_maker THEN quote_qty ELSE -quote_qty END), 4) AS net FROM ticks GROUP BY 1", "ticks"))
def side_notional(spark, sf):
    side = lambda c: F.coalesce(F.sum(F.when(c, F.col("quote_qty"))), F.lit(0.0))
    m = F.col("is_buyer_maker")
    return views.ticks(spark, sf).groupBy(F.to_date("ts").alias("d")).agg(r6(side(m), "long_side", 4), r6(side(~m), "short_side", 4), F.count(F.lit(1)).alias("n"), r6(F.sum(F.when(m, F.col("quote_qty")).otherwise(-F.col("quote_qty"))), "net", 4))


@query(sql("SELECT round(x, 6) AS value, k AS level FROM (SELECT quantile_cont(close, 0.25) AS a, quantile_cont(close, 0.5) AS b, quantile_cont(close, 0.925) AS c FROM px) UNPIVOT (x FOR k IN (a, b, c))", "px"))
def exact_quantiles(spark, sf):
    one = quantiles.exact_quantiles(views.px(spark, sf), "close", [0.25, 0.5, 0.925]).withColumnRenamed("quantiles", "q")
    return one.select(F.get("q", 0).alias("a"), F.get("q", 1).alias("b"), F.get("q", 2).alias("c")).unpivot([], ["a", "b", "c"], "level", "value").select("level", r6("value"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(quantile_cont(l_extendedprice, 0.05), 4) AS low, round(quantile_cont(l_extendedprice, 0.5), 4) AS mid, round(quantile_cont(l_extendedprice, 0.99), 4) AS high
  FROM lineitem GROUP BY 1, 2""")
def quantiles_by_group(spark, sf):
    """Exact quantiles of prices, in groups that grow with the table."""
    one = quantiles.exact_quantiles(views.table(spark, sf, "lineitem"), "l_extendedprice", [0.05, 0.5, 0.99], ["l_returnflag", "l_linestatus"])
    return one.select("l_returnflag", "l_linestatus", "n", *[r6(F.get("quantiles", F.lit(k)), name, 4) for k, name in enumerate(("low", "mid", "high"))])


@query(sql("SELECT CASE WHEN fg > -1 AND fg <= 25 THEN 'fear' WHEN fg <= 50 THEN 'low' WHEN fg <= 75 THEN 'high' WHEN fg <= 100 THEN 'greed' END AS bin, count(*) AS n, round(avg(rate), 8) AS rate FROM fund GROUP BY 1", "fund"))
def cut_bins(spark, sf):
    held = views.fund(spark, sf).withColumn("bin", scalars.cut(F.col("fg"), [-1.0, 25.0, 50.0, 75.0, 100.0], ["fear", "low", "high", "greed"]))
    return held.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("rate"), "rate", 8))


@query(sql("SELECT ((close > e[1])::INT + (close > e[2])::INT + (close > e[3])::INT + (close > e[4])::INT) AS bin, count(*) AS n, round(avg(nxt), 6) AS mean, round(stddev_samp(nxt), 6) AS sd FROM n, (SELECT [quantile_cont(close, 0.2), quantile_cont(close, 0.4), quantile_cont(close, 0.6), quantile_cont(close, 0.8)] AS e FROM px) GROUP BY 1", "px", n="SELECT close, lead(close) OVER (ORDER BY d) / close - 1 AS nxt FROM px"))
def qcut_dose_response(spark, sf):
    held = views.px(spark, sf).withColumn("nxt", F.lead("close").over(frames.over("d")) / F.col("close") - 1)
    return stats.quantile_bins(held, "close", 5).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("nxt"), "mean"), r6(F.stddev_samp("nxt"), "sd"))


@query(sql("SELECT hour(ts)::INT AS hour, " + ", ".join(f"round(corr(r, f{h}), 6) AS h{h}" for h in (1, 2, 4)) + " FROM x GROUP BY 1", "b15", x="SELECT ts, close / lag(close) OVER w - 1 AS r, " + ", ".join(f"lead(close, {h}) OVER w / close - 1 AS f{h}" for h in (1, 2, 4)) + " FROM b15 WINDOW w AS (PARTITION BY ts::DATE ORDER BY ts)"))
def hour_horizon_corr_pivot(spark, sf):
    w = frames.over("ts", ["day"])
    held = views.bars(spark, sf, 15).withColumn("day", F.to_date("ts")).withColumn("r", frames.change(F.col("close"), 1, w))
    held = held.select(F.hour("ts").alias("hour"), "r", *[(F.lead("close", h).over(w) / F.col("close") - 1).alias(f"h{h}") for h in (1, 2, 4)])
    wide = held.unpivot(["hour", "r"], ["h1", "h2", "h4"], "h", "f").groupBy("hour").pivot("h", ["h1", "h2", "h4"]).agg(frames.corr(F.col("r"), F.col("f")))
    return wide.select("hour", r6("h1"), r6("h2"), r6("h4"))


@query(sql("SELECT date_trunc('month', d)::DATE AS month, count(*) AS n, round(sum(ret), 6) AS total, round(avg(ret), 6) AS mean, round(100.0 * avg((ret > 0)::INT), 6) AS win_pct, round(exp(sum(ln(1 + ret))) - 1, 6) AS compounded FROM ret WHERE ret IS NOT NULL GROUP BY 1", "ret"))
def monthly_rollup(spark, sf):
    held = views.px(spark, sf).withColumn("ret", frames.change(F.col("close"), 1, frames.over("d"))).filter("ret IS NOT NULL")
    return held.groupBy(F.trunc("d", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("ret"), "total"), r6(F.avg("ret"), "mean"), r6(100.0 * F.avg((F.col("ret") > 0).cast("double")), "win_pct"), r6(F.exp(F.sum(F.log1p("ret"))) - 1, "compounded"))


@query(sql("SELECT year(d)::INT AS year, count(*) AS n, round(sum(ret), 6) AS total, round(avg(ret) / stddev_samp(ret) * sqrt(365), 6) AS sharpe, round(100.0 * avg((ret > 0)::INT), 6) AS up_pct FROM ret WHERE ret IS NOT NULL GROUP BY 1", "ret"))
def yearly_breakdown(spark, sf):
    held = views.px(spark, sf).withColumn("ret", frames.change(F.col("close"), 1, frames.over("d"))).filter("ret IS NOT NULL")
    return held.groupBy(F.year("d").alias("year")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("ret"), "total"), r6(sharpe(F.col("ret"), 365, plain=True), "sharpe"), r6(100.0 * F.avg((F.col("ret") > 0).cast("double")), "up_pct"))


@query("SELECT event_type, CAST(props->>'k' AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_field_counts(spark, sf):
    parsed = views.table(spark, sf, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return parsed.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT d, max(CASE WHEN k = 'a' THEN x END) AS vix, max(CASE WHEN k = 'b' THEN x END) AS vix3m FROM (SELECT d, 'a' AS k, vix AS x FROM sig UNION ALL SELECT d, 'b', vix3m FROM sig) GROUP BY d", "sig"))
def long_and_wide(spark, sf):
    long = views.sig(spark, sf).unpivot(["d"], ["vix", "vix3m"], "k", "x")
    return long.groupBy("d").pivot("k", ["vix", "vix3m"]).agg(F.max("x"))


@query(sql("SELECT coalesce(sig.d, px.d) AS d, slope, close, CASE WHEN slope IS NULL AND close IS NULL THEN NULL ELSE coalesce(slope, 0) + coalesce(close, 0) END AS total FROM sig FULL JOIN px ON sig.d = px.d", "sig", "px"))
def outer_assembly(spark, sf):
    both = views.sig(spark, sf).select("d", "slope").join(views.px(spark, sf), "d", "full_outer")
    return both.select("d", "slope", "close", scalars.sum_of(F.col("slope"), F.col("close")).alias("total"))


@query(sql("SELECT d, printf('%02d:%02d', (fg / 60)::INT, (fg % 60)::INT) AS clock, CASE WHEN abs(rate) < 0.0005 THEN 0 WHEN rate > 0 THEN 1 ELSE -1 END AS band, CASE WHEN fg >= 75 THEN 2.0 WHEN fg >= 50 THEN 1.5 WHEN fg >= 25 THEN 1.0 ELSE 0.5 END::DOUBLE AS lev, CASE WHEN fg > 50 THEN 'LONG' ELSE 'FLAT' END AS label, greatest(-1, least(1, rate * 1000))::DOUBLE AS capped FROM fund", "fund").replace("(fg / 60)::INT", "floor(fg / 60)::INT"))
def scalar_expressions(spark, sf):
    fg, rate = F.col("fg"), F.col("rate")
    return views.fund(spark, sf).select("d", scalars.clock(fg).alias("clock"), scalars.dead_band(rate, 0.0005).alias("band"), scalars.ladder(fg, [25, 50, 75], [0.5, 1.0, 1.5, 2.0]).alias("lev"), F.when(fg > 50, "LONG").otherwise("FLAT").alias("label"), scalars.clamp(rate * 1000, -1.0, 1.0).alias("capped"))


@query("SELECT o_orderpriority AS mode, o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1, 2")
def frequency_counts(spark, sf):
    return views.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("mode"), F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))
