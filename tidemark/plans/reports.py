"""Reports: horizons by half of the month, exact-minute tables, calendars of strategies, dead zones, coverage, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import bars, frames, reports, stats
from ..sources import readers, views
from ..sources.views import with_views as sql
from .eventstudies import _GRID, _NEXT, day_events, grid, signal_and_returns
from .registry import r6, registry

QUERIES, ORACLE_SQL, query = registry()


@query(sql("""SELECT period, minute, count(*) AS n, round(corr(signal, ret), 6) AS r, round(100.0 * avg((sign(ret) = -sign(signal))::INT), 6) AS hit_pct,
  round(avg(-sign(signal) * ret), 6) AS gross, round(avg(-sign(signal) * ret) - 0.0004, 6) AS net, round(100.0 * avg((-sign(signal) * ret > 0)::INT), 6) AS win_pct,
  round(sum(-sign(signal) * ret - 0.0004), 6) AS cum_net
  FROM (SELECT g.*, CASE WHEN day(ev.ts) <= 15 THEN 'first' ELSE 'second' END AS period FROM grid g JOIN ev USING (key)) WHERE ret IS NOT NULL GROUP BY 1, 2""", "b1", "b15", **_GRID))  # fmt: skip
def horizon_report(spark, sf):
    """Trading against the signal at each horizon, in two periods. The operator's p is left out, as SQL has none."""
    period = F.when(F.dayofmonth("ts") <= 15, "first").otherwise("second")
    held = grid(spark, sf).join(day_events(spark, sf).select("key", period.alias("period")), "key")
    made = reports.horizon_report(held, ["period", "minute"], side=-1)
    return made.select("period", "minute", "n", *[r6(c) for c in ("r", "hit_pct", "gross", "net", "win_pct", "cum_net")])


#: Horizons in minutes of the tables that published studies print: fixed values.
DAILY = {"m1": 1, "m5": 5, "m10": 10, "m15": 15, "m20": 20, "m30": 30, "m45": 45, "h1": 60, "m90": 90, "h2": 120, "h3": 180, "h4": 240, "h6": 360, "h8": 480, "h12": 720, "h24": 1440}


def _table_sql(need: str) -> str:
    cells = ", ".join(f"round(max(b.close) FILTER (WHERE m.minute = {m}) / e.base - 1, 6) AS {name}" for name, m in DAILY.items())
    return sql(f"""SELECT * FROM (SELECT e.key, {cells} FROM e CROSS JOIN m LEFT JOIN b1 b ON b.ts = e.ts + to_minutes(m.minute) GROUP BY e.key, e.base) WHERE {need} IS NOT NULL""", "b1", "b15",
      ev=_GRID["ev"], e="SELECT ev.key, ev.ts, b1.close AS base FROM ev JOIN b1 ON b1.ts = ev.ts", m="SELECT unnest([" + ", ".join(map(str, DAILY.values())) + "])::INT AS minute")


@query(_table_sql("m1"))
def response_table_first(spark, sf):
    """Returns at 16 exact minutes, of events that have one after the first minute."""
    return _rounded(reports.response_table(day_events(spark, sf), views.bars(spark, sf), "close", DAILY, "m1"))


@query(_table_sql(f"coalesce({', '.join(DAILY)})"))
def response_table_any(spark, sf):
    """Returns at 16 exact minutes, of events that have any of them."""
    return _rounded(reports.response_table(day_events(spark, sf), views.bars(spark, sf), "close", DAILY))


def _rounded(table):
    return table.select("key", *map(r6, DAILY))


_POS = "CASE WHEN abs(change) < 20000 THEN 0 WHEN change > 0 THEN -1 ELSE 1 END"
_TRADED = _NEXT | {"t": f"SELECT d, {_POS} AS pos, {_POS} * nxt AS strat, nxt AS hold FROM j WHERE change IS NOT NULL AND nxt IS NOT NULL"}


def traded(spark, sf):
    """(d, pos, strat, hold): against the signal's change where it is large, flat otherwise."""
    pos = F.when(F.abs("change") < 20000, 0).when(F.col("change") > 0, -1).otherwise(1)
    held = signal_and_returns(spark, sf).filter("change IS NOT NULL AND nxt IS NOT NULL").withColumn("pos", pos)
    return held.select("d", "pos", (F.col("pos") * F.col("nxt")).alias("strat"), F.col("nxt").alias("hold"))


@query(sql("""SELECT year, n, round(total, 6) AS total, round(hold, 6) AS hold, round(total - hold, 6) AS excess, round(sharpe, 6) AS sharpe, round(flat_pct, 6) AS flat_pct, round(exposure_pct, 6) AS exposure_pct, total > hold AS ahead
  FROM (SELECT year(d)::INT AS year, count(*) AS n, exp(sum(ln(1 + strat))) - 1 AS total, exp(sum(ln(1 + hold))) - 1 AS hold, CASE WHEN stddev_samp(strat) > 0 THEN avg(strat) / stddev_samp(strat) * sqrt(365) ELSE 0 END AS sharpe,
  100.0 * avg((pos = 0)::INT) AS flat_pct, 100.0 * avg(abs(pos)) AS exposure_pct FROM t GROUP BY 1)""", "sig", "px", **_TRADED))  # fmt: skip
def yearly_strategy(spark, sf):
    made = reports.yearly(traded(spark, sf), "strat", "hold", "pos")
    return made.select("year", "n", *[r6(c) for c in ("total", "hold", "excess", "sharpe", "flat_pct", "exposure_pct")], "ahead")


_DAYS = (1, 2, 5, 10, 20)


@query(sql("SELECT year(d)::INT AS year, " + ", ".join(f"CASE WHEN count(*) FILTER (WHERE change IS NOT NULL AND d{k} IS NOT NULL) >= 3 THEN round(corr(change, d{k}), 6) END AS d{k}" for k in _DAYS) + " FROM (SELECT x.d, change, " + ", ".join(f"d{k}" for k in _DAYS) + " FROM x JOIN p ON x.d = p.d) GROUP BY ROLLUP (1)",
  "sig", "px", x=_NEXT["x"], p="SELECT d, " + ", ".join(f"lead(close, {k}) OVER (ORDER BY d) / close - 1 AS d{k}" for k in _DAYS) + " FROM px"))
def year_horizon_corr(spark, sf):
    """Correlation of the signal's change with the return over the next days, by year and for all years."""
    w = frames.over("d")
    ahead = views.px(spark, sf).select("d", *[(F.lead("close", k).over(w) / F.col("close") - 1).alias(f"d{k}") for k in _DAYS])
    x = views.sig(spark, sf).select("d", (F.col("slope") - F.lag("slope").over(w)).alias("change"))
    names = [f"d{k}" for k in _DAYS]
    made = reports.corr_table(x.join(ahead, "d").withColumn("year", F.year("d")), "year", "change", names)
    return made.select("year", *map(r6, names))


@query(sql("SELECT coalesce(t.month, f.month) AS month, round(coalesce(t.hold, 0), 4) AS hold, round(coalesce(t.strat, 0), 4) AS slope, round(coalesce(f.mood, 0), 4) AS mood FROM (SELECT date_trunc('month', d)::DATE AS month, 100 * (exp(sum(ln(1 + hold))) - 1) AS hold, 100 * (exp(sum(ln(1 + strat))) - 1) AS strat FROM t GROUP BY 1) t "
  "FULL JOIN (SELECT date_trunc('month', d)::DATE AS month, 100 * (exp(sum(ln(1 + mood))) - 1) AS mood FROM f GROUP BY 1) f ON t.month = f.month", "sig", "px", "fund", **_TRADED,
  f="SELECT p.d, CASE WHEN fg < 50 THEN nxt WHEN fg > 50 THEN -nxt ELSE 0 END AS mood FROM p JOIN fund ON p.d = fund.d WHERE nxt IS NOT NULL"))
def strategy_by_month(spark, sf):
    """Monthly returns of holding, of the signal, and against the mood, side by side."""
    nxt = views.px(spark, sf).select("d", (F.lead("close").over(frames.over("d")) / F.col("close") - 1).alias("nxt")).join(views.fund(spark, sf), "d").filter("nxt IS NOT NULL")
    mood = nxt.select("d", F.when(F.col("fg") < 50, F.col("nxt")).when(F.col("fg") > 50, -F.col("nxt")).otherwise(0.0).alias("mood"))
    both = traded(spark, sf).select("d", "hold", F.col("strat").alias("slope")).join(mood, "d", "full_outer")
    return reports.monthly_table(both, ["hold", "slope", "mood"]).select("month", *[r6(c, digits=4) for c in ("hold", "slope", "mood")])


@query(sql("SELECT d, coalesce(rate, 0) AS as_is, CASE WHEN abs(rate) >= 0.002 THEN rate ELSE 0 END AS neutral, coalesce(last_value(CASE WHEN abs(rate) >= 0.002 THEN rate END IGNORE NULLS) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING), 0) AS held FROM fund", "fund"))
def dead_zone_modes(spark, sf):
    """A target's leverage by the three modes of the dead zone."""
    held = views.fund(spark, sf)
    for mode, out in (("none", "as_is"), ("neutral", "neutral"), ("hold", "held")):
        held = reports.dead_zone(held, "rate", mode, 0.002, out=out)
    return held.select("d", "as_is", "neutral", "held")


@query(sql("SELECT CASE WHEN fg <= 20 THEN '0-20' WHEN fg <= 40 THEN '20-40' WHEN fg <= 60 THEN '40-60' WHEN fg <= 80 THEN '60-80' ELSE '80-100' END AS bin, count(nxt) AS n, round(avg(nxt), 6) AS mean, round(stddev_samp(nxt), 6) AS sd, round(avg(nxt) / (stddev_samp(nxt) / sqrt(count(nxt))), 4) AS t FROM fund JOIN p ON fund.d = p.d GROUP BY 1", "fund", "px", p=_NEXT["p"]))
def mood_bins(spark, sf):
    """Next returns by bins of the mood, the lowest with its edge; the test's p is left out."""
    nxt = views.px(spark, sf).select("d", (F.lead("close").over(frames.over("d")) / F.col("close") - 1).alias("nxt"))
    held = views.fund(spark, sf).join(nxt, "d").withColumn("bin", scalars.cut(F.col("fg"), [0.0, 20.0, 40.0, 60.0, 80.0, 100.0], ["0-20", "20-40", "40-60", "60-80", "80-100"], include_lowest=True))
    return stats.t_one_sample(held, ["bin"], "nxt").select("bin", "n", r6("mean"), r6("sd"), r6("t", digits=4))


@query(sql("SELECT CASE WHEN abs(change) < 10000 THEN 'q1' WHEN abs(change) < 20000 THEN 'q2' WHEN abs(change) < 60000 THEN 'q3' ELSE 'q4' END AS bin, count(*) AS n, round(100.0 * avg((sign(change) = sign(nxt))::INT), 6) AS hit_pct FROM j WHERE change IS NOT NULL AND nxt IS NOT NULL AND change <> 0 GROUP BY 1", "sig", "px", **_NEXT))
def strength_bins(spark, sf):
    """Hit rate by the size of the signal's change, in bins closed on the left."""
    held = signal_and_returns(spark, sf).filter("change <> 0 AND nxt IS NOT NULL").withColumn("bin", scalars.cut(F.abs("change"), [0.0, 10000.0, 20000.0, 60000.0, 1e12], ["q1", "q2", "q3", "q4"], right=False))
    return stats.hit_rate(held, ["bin"], F.col("change"), F.col("nxt")).select("bin", "n", r6("hit_pct"))


@query(sql("SELECT ts::DATE AS day, count(*) AS n, round(100.0 - 100.0 * count(*) / 96, 6) AS missing_pct FROM b15 GROUP BY 1", "b15"))
def coverage_by_day(spark, sf):
    return reports.coverage(views.bars(spark, sf, 15), 15).select("day", "n", r6("missing_pct"))


@query(sql("SELECT ts, close FROM (SELECT ts, close, count(*) OVER (PARTITION BY ts::DATE ORDER BY ts RANGE BETWEEN INTERVAL 105 MINUTE PRECEDING AND CURRENT ROW) AS k, count(*) OVER (PARTITION BY ts::DATE) AS n FROM b15) WHERE k = 8 AND 100.0 - 100.0 * n / 96 < 5", "b15"))
def windows_of_complete_days(spark, sf):
    """Rows that end eight 15-minute bars in a row, on days that lack less than 5 % of their bars."""
    return reports.whole_windows(reports.complete_days(views.bars(spark, sf, 15), 15), 15, 8).select("ts", "close")


@query(sql("SELECT ts, volume, round((2 * taker - volume) / volume, 6) AS trade_imbalance, round(volume / trade_count, 6) AS avg_trade_size FROM (SELECT time_bucket(INTERVAL '15 minutes', ts) AS ts, sum(qty)::DOUBLE AS volume, coalesce(sum(qty) FILTER (WHERE NOT is_buyer_maker), 0) AS taker, count(*) AS trade_count FROM ticks GROUP BY 1)", "ticks"))
def kline_imbalance(spark, sf):
    """Imbalance by volume, of bars that report what takers bought."""
    at = bars.floor_minutes(F.col("ts"), 15).alias("ts")
    bought = F.sum(F.when(F.col("is_buyer_maker"), 0).otherwise(F.col("qty")))
    klines = views.ticks(spark, sf).groupBy(at).agg(F.sum("qty").cast("double").alias("volume"), bought.alias("taker_buy_volume"), F.count(F.lit(1)).alias("trade_count"))
    return bars.kline_imbalance(klines).select("ts", "volume", r6("trade_imbalance"), r6("avg_trade_size"))


@query("SELECT date_trunc('month', o_orderdate)::DATE AS month, round(sum(CASE WHEN upper(trim(o_orderstatus)) = 'F' THEN o_totalprice ELSE 0 END), 2) AS long_volume, round(sum(CASE WHEN upper(trim(o_orderstatus)) = 'O' THEN o_totalprice ELSE 0 END), 2) AS short_volume FROM orders GROUP BY 1")
def side_volumes(spark, sf):
    """Volumes by side, the side written in lower case between spaces."""
    held = views.table(spark, sf, "orders").select(F.trunc("o_orderdate", "month").alias("month"), F.concat(F.lit("  "), F.lower("o_orderstatus"), F.lit(" ")).alias("side"), "o_totalprice")
    return reports.side_volumes(held, ["month"], "side", "o_totalprice", "F", "O").select("month", r6("long_volume", digits=2), r6("short_volume", digits=2))


@query(sql("""SELECT to_json({'time_axis': {'minutes': minutes}, 'n': n, 'two_sigma_events': {'n_spike': spike, 'n_drop': fell}})::VARCHAR AS value
  FROM (SELECT count(DISTINCT minute) AS minutes, count(DISTINCT key) AS n, count(DISTINCT CASE WHEN signal > m + 2 * s THEN key END) AS spike, count(DISTINCT CASE WHEN signal < m - 2 * s THEN key END) AS fell
  FROM grid, (SELECT avg(signal) AS m, stddev_samp(signal) AS s FROM ev))""", "b1", "b15", **_GRID))  # fmt: skip
def study_summary(spark, sf):
    """A study's counts as one nested document."""
    looked = day_events(spark, sf)
    spread = looked.agg(F.avg("signal").alias("m"), F.stddev_samp("signal").alias("s"))
    far = lambda sign: F.count_distinct(F.when((F.col("signal") - F.col("m")) * sign > 2 * F.col("s"), F.col("key")))
    one = grid(spark, sf).crossJoin(F.broadcast(spread)).agg(F.count_distinct("minute").alias("minutes"), F.count_distinct("key").alias("n"), far(1).alias("spike"), far(-1).alias("fell"))
    parts = {"time_axis": {"minutes": F.col("minutes")}, "n": F.col("n"), "two_sigma_events": {"n_spike": F.col("spike"), "n_drop": F.col("fell")}}
    return one.select(F.to_json(readers.nested(parts)).alias("value"))
