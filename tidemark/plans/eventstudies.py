"""Event studies: response grids, horizons, paths, thinning, thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, events, features, frames, stats
from ..sources import views
from ..sources.views import with_views as sql
from .registry import r6, registry

QUERIES, ORACLE_SQL, query = registry()

HORIZONS = [0, 1, 5, 15, 30, 60, 120]
_EV = "SELECT ts::DATE AS key, ts, round(close / lag(close, 4) OVER w - 1, 9) AS signal, row_number() OVER w AS n FROM b15 WINDOW w AS (PARTITION BY ts::DATE ORDER BY ts)"
_GRID = {
    "ev": f"SELECT key || '-' || n AS key, ts, signal FROM ({_EV}) WHERE signal IS NOT NULL",
    "looks": "SELECT key, signal, m.minute, ts + to_minutes(m.minute) AS ts FROM ev CROSS JOIN (VALUES (-1), " + ", ".join(f"({h})" for h in HORIZONS) + ") m(minute)",
    "found": "SELECT l.key, l.signal, l.minute, CASE WHEN b.ts <= l.ts + INTERVAL 5 MINUTE THEN b.close END AS price FROM looks l ASOF LEFT JOIN b1 b ON l.ts <= b.ts",
    "grid": "SELECT f.key, f.signal, f.minute, f.price / p.price - 1 AS ret FROM found f JOIN found p ON f.key = p.key AND p.minute = -1 WHERE f.minute <> -1",
}


def day_events(spark, sf):
    """(key, ts, signal): each 15-minute bar of a day that has a return over the four bars before."""
    w = frames.over("ts", ["day"])
    held = views.bars(spark, sf, 15).withColumn("day", F.to_date("ts"))
    held = held.withColumn("signal", F.round(frames.change(F.col("close"), 4, w), 9)).withColumn("n", F.row_number().over(w)).filter("signal IS NOT NULL")
    return held.select(F.concat_ws("-", F.col("day").cast("string"), F.col("n").cast("string")).alias("key"), "ts", "signal")


def grid(spark, sf):
    return events.response_grid(day_events(spark, sf), views.bars(spark, sf), HORIZONS)


@query(sql("SELECT key, minute, round(ret, 6) AS ret FROM grid", "b1", "b15", **_GRID))
def response_grid(spark, sf):
    return grid(spark, sf).select("key", "minute", r6("ret"))


_BOTH = "signal IS NOT NULL AND ret IS NOT NULL"
_METRICS = f"""SELECT minute, count(*) FILTER (WHERE {_BOTH}) AS n, CASE WHEN count(*) FILTER (WHERE {_BOTH}) >= 20 THEN corr(signal, ret) END AS r,
  CASE WHEN count(*) FILTER (WHERE {_BOTH}) >= 20 THEN 100.0 * count(*) FILTER (WHERE {_BOTH} AND signal <> 0 AND sign(signal) = sign(ret)) / count(*) FILTER (WHERE {_BOTH} AND signal <> 0) END AS hit_pct FROM grid GROUP BY 1"""


@query(sql(f"SELECT minute, n, round(r, 6) AS r, round(hit_pct, 6) AS hit_pct FROM ({_METRICS})", "b1", "b15", **_GRID))
def response_grid_metrics(spark, sf):
    return events.grid_metrics(grid(spark, sf), ["minute"]).select("minute", "n", r6("r"), r6("hit_pct"))


@query(sql("SELECT minute, count(*) AS n, round(100.0 * avg((g > 0)::INT), 6) AS hit_pct, round(sum(g), 6) AS gross, round(sum(g - 0.0004), 6) AS net, round(100.0 * avg((g > 0.0004)::INT), 6) AS win_pct FROM (SELECT minute, sign(signal) * ret AS g FROM grid WHERE ret IS NOT NULL AND signal <> 0) GROUP BY 1", "b1", "b15", **_GRID))
def horizon_table(spark, sf):
    return events.horizon_table(grid(spark, sf)).select("minute", "n", r6("hit_pct"), r6("gross"), r6("net"), r6("win_pct"))


_MINUTES = _GRID | {"looks": "SELECT key, signal, m.minute, ts + to_minutes(m.minute) AS ts FROM ev CROSS JOIN (SELECT unnest(range(-1, 1035))::INT AS minute) m"}


@query(sql(f"SELECT minute, n, round(r, 6) AS r, round(hit_pct, 6) AS hit_pct FROM ({_METRICS})", "b1", "b15", **_MINUTES))
def response_minutes(spark, sf):
    """The study at every minute from the event to 1,034 minutes after it."""
    whole = events.response_grid(day_events(spark, sf), views.bars(spark, sf), list(range(1035)))
    return events.grid_metrics(whole, ["minute"]).select("minute", "n", r6("r"), r6("hit_pct"))


_LEG = _GRID | {
    "looks": "SELECT key, signal, m.minute, ts + to_minutes(m.minute) AS ts FROM ev CROSS JOIN (VALUES (1034), (1423)) m(minute)",
    "grid": "SELECT f.key, f.signal, 1423 AS minute, f.price / p.price - 1 AS ret FROM found f JOIN found p ON f.key = p.key AND p.minute = 1034 WHERE f.minute = 1423",
}


@query(sql(f"SELECT minute, n, round(r, 6) AS r, round(hit_pct, 6) AS hit_pct FROM ({_METRICS})", "b1", "b15", **_LEG))
def next_session_leg(spark, sf):
    """The return within the next session, from 1,034 to 1,423 minutes after the event."""
    leg = events.response_grid(day_events(spark, sf), views.bars(spark, sf), [1423], base_offset=1034)
    return events.grid_metrics(leg, ["minute"]).select("minute", "n", r6("r"), r6("hit_pct"))


@query(sql("""SELECT sigma, side, regime, count(*) AS trades, round(sum(pnl), 6) AS total, round(avg(pnl), 6) AS avg, round(100.0 * avg((pnl > 0)::INT), 6) AS win_pct, round(stddev_pop(pnl), 6) AS sd, round(min(path - peak), 6) AS max_drawdown,
  max(won)::BIGINT AS wins, max(lost)::BIGINT AS losses, round(sum(ret), 6) AS hold FROM (SELECT *, sum(f) OVER (PARTITION BY sigma, side, regime, g ORDER BY ts, key) AS won, sum(1 - f) OVER (PARTITION BY sigma, side, regime, h ORDER BY ts, key) AS lost,
    max(path) OVER (PARTITION BY sigma, side, regime ORDER BY ts, key) AS peak FROM tw) GROUP BY 1, 2, 3""", "b1", "b15", **_GRID,
  ta="SELECT g.key, ev.ts, g.signal, ret, CASE WHEN hour(ev.ts) < 12 THEN 'morning' ELSE 'afternoon' END AS regime FROM grid g JOIN ev USING (key) WHERE g.minute = 60 AND ret IS NOT NULL",
  tb="SELECT t.*, k.sigma, sign(signal) * ret AS pnl FROM ta t, (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) k(sigma), (SELECT stddev_samp(signal) AS s FROM grid WHERE minute = 60) WHERE abs(signal) > k.sigma * s",
  tc="SELECT sigma, s.side, r.regime, key, ts, ret, pnl FROM tb, LATERAL (SELECT unnest(['all', CASE WHEN signal > 0 THEN 'long' ELSE 'short' END]) AS side) s, LATERAL (SELECT unnest(['all', tb.regime]) AS regime) r",
  tw="SELECT *, (pnl > 0)::INT AS f, sum(pnl) OVER w AS path, sum(1 - (pnl > 0)::INT) OVER w AS g, sum((pnl > 0)::INT) OVER w AS h FROM tc WINDOW w AS (PARTITION BY sigma, side, regime ORDER BY ts, key)"))
def sigma_threshold_splits(spark, sf):
    """The threshold strategy an hour after the event, by side and by half of the day, with drawdowns, runs and holding."""
    looked = day_events(spark, sf)
    regime = F.when(F.hour("ts") < 12, "morning").otherwise("afternoon")
    trades = events.response_grid(looked, views.bars(spark, sf), [60]).join(looked.select("key", "ts", regime.alias("regime")), "key")
    made = events.threshold_report(trades, [0.5, 1.0, 2.0])
    return made.select("sigma", "side", "regime", "trades", *[r6(c) for c in ("total", "avg", "win_pct", "sd", "max_drawdown")], "wins", "losses", r6("hold"))


@query(sql("SELECT side, minute, count(ret) AS n, round(avg(ret), 6) AS mean, round(stddev_samp(ret) / sqrt(count(ret)), 6) AS se FROM grid JOIN sides USING (key) GROUP BY 1, 2", "b1", "b15", **_GRID, sides="SELECT key, CASE WHEN signal > m + s THEN 1 ELSE -1 END AS side FROM (SELECT DISTINCT key, signal FROM grid), (SELECT avg(signal) AS m, stddev_samp(signal) AS s FROM (SELECT DISTINCT key, signal FROM grid)) WHERE signal > m + s OR signal < m - s"))
def sigma_event_paths(spark, sf):
    return events.event_paths(grid(spark, sf), 1.0).select("side", "minute", "n", r6("mean"), r6("se"))


@query(sql(f"SELECT arg_max(minute, (round(abs(r), 9), -minute)) AS peak_minute, min(minute) FILTER (WHERE abs(r) > 0.05) AS first_minute, max(minute) FILTER (WHERE abs(r) > 0.05) AS last_minute, count(*) FILTER (WHERE abs(r) > 0.05) AS n_strong, round(avg(hit_pct), 6) AS mean_hit FROM ({_METRICS})", "b1", "b15", **_GRID))
def curve_summary(spark, sf):
    return events.curve_summary(events.grid_metrics(grid(spark, sf), ["minute"]), 0.05).select("peak_minute", "first_minute", "last_minute", "n_strong", r6("mean_hit"))


@query(sql("""SELECT user_id, ts FROM walk WHERE kept""", e="SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events").replace("WITH e AS", "WITH RECURSIVE e AS").replace("\nSELECT user_id, ts FROM walk", """, walk AS (
  SELECT user_id, ts, n, ts AS last, true AS kept FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.ts, e.n, CASE WHEN e.ts > walk.last + INTERVAL 12 HOUR THEN e.ts ELSE walk.last END, e.ts > walk.last + INTERVAL 12 HOUR FROM walk JOIN e ON e.user_id = walk.user_id AND e.n = walk.n + 1)
SELECT user_id, ts FROM walk"""))
def greedy_thinning(spark, sf):
    return events.thin(views.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts")), 12 * 3600, ["user_id"])


@query(sql("SELECT n.ts, round(n.close / b.close - 1, 6) AS during, round(a.close / n.close - 1, 6) AS after FROM b15 n JOIN b15 b ON b.ts = n.ts - INTERVAL 1 HOUR LEFT JOIN b15 a ON a.ts = n.ts + INTERVAL 1 HOUR", "b15"))
def during_after_split(spark, sf):
    x = asof.exact(views.bars(spark, sf, 15).select("ts", F.col("close").alias("c")), views.bars(spark, sf, 15), "close", [-60, 60])
    wide = x.groupBy("ts", "c").agg(F.max(F.when(F.col("minutes") == -60, F.col("close"))).alias("b"), F.max(F.when(F.col("minutes") == 60, F.col("close"))).alias("a"))
    return wide.filter("b IS NOT NULL").select("ts", r6(F.col("c") / F.col("b") - 1, "during"), r6(F.col("a") / F.col("c") - 1, "after"))


@query(sql("""SELECT k.sigma, minute, count(*) AS trades, round(sum(sign(signal) * ret - 0.0004), 6) AS total, round(avg(sign(signal) * ret - 0.0004), 6) AS avg, round(100.0 * avg((sign(signal) * ret - 0.0004 > 0)::INT), 6) AS win_pct,
  round(sum(CASE WHEN sign(signal) * ret - 0.0004 > 0 THEN sign(signal) * ret - 0.0004 END) / -sum(CASE WHEN sign(signal) * ret - 0.0004 < 0 THEN sign(signal) * ret - 0.0004 END), 6) AS profit_factor
  FROM grid, (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) k(sigma), (SELECT stddev_samp(signal) AS s FROM grid) WHERE abs(signal) > k.sigma * s AND ret IS NOT NULL GROUP BY 1, 2""", "b1", "b15", **_GRID))
def sigma_threshold_grid(spark, sf):
    return events.threshold_grid(grid(spark, sf), [0.5, 1.0, 2.0]).select("sigma", "minute", "trades", r6("total"), r6("avg"), r6("win_pct"), r6("profit_factor"))


_NEXT = {"x": "SELECT sig.d, slope - lag(slope) OVER (ORDER BY sig.d) AS change FROM sig", "p": "SELECT d, lead(close) OVER (ORDER BY d) / close - 1 AS nxt, close / lag(close) OVER (ORDER BY d) - 1 AS same FROM px", "j": "SELECT x.d, change, nxt, same, x.d < DATE '1999-01-01' AS train FROM x JOIN p ON x.d = p.d"}


def signal_and_returns(spark, sf):
    """(d, change, nxt, same, train)."""
    w = frames.over("d")
    x = views.sig(spark, sf).select("d", (F.col("slope") - F.lag("slope").over(w)).alias("change"))
    p = views.px(spark, sf).select("d", (F.lead("close").over(w) / F.col("close") - 1).alias("nxt"), frames.change(F.col("close"), 1, w).alias("same"))
    return x.join(p, "d").withColumn("train", F.col("d") < "1999-01-01")


@query(sql("""SELECT t.thr, s.sign, count(*) AS n, count(*) FILTER (WHERE s.sign * sign(change) * nxt > 0) AS hits, round(sum(s.sign * sign(change) * nxt - 0.0004), 6) AS net
  FROM j, (VALUES (0.0::DOUBLE), (20000.0::DOUBLE), (60000.0::DOUBLE)) t(thr) JOIN signs s ON s.thr = t.thr WHERE NOT train AND nxt IS NOT NULL AND abs(change) > t.thr GROUP BY 1, 2""", "sig", "px", **_NEXT,
  signs="SELECT thr, CASE WHEN sum(CASE WHEN train THEN sign(change) * nxt END) >= 0 THEN 1 ELSE -1 END AS sign FROM j, (VALUES (0.0::DOUBLE), (20000.0::DOUBLE), (60000.0::DOUBLE)) t(thr) WHERE nxt IS NOT NULL AND abs(change) > thr GROUP BY 1"))
def sign_learned_threshold(spark, sf):
    return events.learned_sign(signal_and_returns(spark, sf), "change", "nxt", "train", [0.0, 20000.0, 60000.0]).select("thr", "sign", "n", "hits", r6("net"))


@query(sql("SELECT 'next' AS kind, count(*) AS n, count(*) FILTER (WHERE sign(change) = sign(nxt)) AS hits FROM j WHERE change <> 0 AND nxt IS NOT NULL UNION ALL SELECT 'same', count(*), count(*) FILTER (WHERE sign(change) = sign(same)) FROM j WHERE change <> 0 AND same IS NOT NULL", "sig", "px", **_NEXT))
def biased_vs_unbiased(spark, sf):
    held = signal_and_returns(spark, sf).unpivot(["d", "change"], ["nxt", "same"], "kind", "r").withColumn("kind", F.when(F.col("kind") == "nxt", "next").otherwise("same"))
    return stats.hit_rate(held, ["kind"], F.col("change"), F.col("r")).select("kind", "n", "hits")


@query(sql("SELECT k.lag, count(*) AS n, round(corr(x, y), 6) AS r FROM (" + " UNION ALL ".join(f"SELECT {k} AS lag, lag(change, {k}) OVER (ORDER BY d) AS x, same AS y FROM j" for k in (1, 2, 3)) + ") k WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1", "sig", "px", **_NEXT))
def lag_sensitivity(spark, sf):
    w = frames.over("d")
    wide = signal_and_returns(spark, sf).select("same", *[F.lag("change", k).over(w).alias(str(k)) for k in (1, 2, 3)])
    held = wide.unpivot(["same"], ["`1`", "`2`", "`3`"], "lag", "x").withColumn("lag", F.col("lag").cast("int"))
    return stats.pearson(held, ["lag"], "x", "same").select("lag", "n", r6("r"))


@query(sql("SELECT day, ts, round(f, 6) AS fwd_8 FROM (SELECT ts::DATE AS day, ts, CASE WHEN count(*) OVER w = 8 THEN sum(r) OVER w END AS f FROM (SELECT ts, coalesce(close / lag(close) OVER (ORDER BY ts) - 1, 0) AS r FROM b15) WINDOW w AS (PARTITION BY ts::DATE ORDER BY ts ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))", "b15"))
def residual_forward_study(spark, sf):
    held = frames.returns(views.bars(spark, sf, 15).withColumn("day", F.to_date("ts")), {"r": "close"}, "ts", "day")
    return features.forward_window_sum(held, "r", 8, "ts", "day").select("day", "ts", r6("fwd_8"))


@query(sql("SELECT count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM b1 WHERE ts::DATE = DATE '2024-01-02'", "b1"))
def day_scan(spark, sf):
    return views.bars(spark, sf).filter(F.to_date("ts") == "2024-01-02").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


