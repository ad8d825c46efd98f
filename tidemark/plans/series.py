"""Windows, fills, runs and as-of joins over ordered series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, bars, events, frames, orderstats, scans
from ..operators.strategy import contrarian
from ..sources import views
from ..sources.views import with_views as sql
from .registry import r6, registry

QUERIES, ORACLE_SQL, query = registry()
_W = "OVER (ORDER BY d ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def ret(spark, sf):
    """(d, close, ret): daily price with its return."""
    return near(views.px(spark, sf), 1, 0, lambda w: {"ret": frames.change(F.col("close"), 1, w)})


def near(df, before, after, columns):
    """Columns over the daily series whose frames reach some rows back and ahead, without one ordered task."""
    return scans.reach(df, "d", F.year("d"), before, after, columns)


@query(sql("SELECT d, " + ", ".join(f"round(close / lag(close, {k}) OVER (ORDER BY d) - 1, 6) AS ret_{k}" for k in (1, 2, 5, 10, 15)) + " FROM px", "px"))
def pct_change_multi(spark, sf):
    made = near(views.px(spark, sf), 15, 0, lambda w: {f"ret_{k}": frames.change(F.col("close"), k, w) for k in (1, 2, 5, 10, 15)})
    return made.select("d", *[r6(f"ret_{k}") for k in (1, 2, 5, 10, 15)])


@query(sql("SELECT d, round(slope - lag(slope) OVER (ORDER BY d), 4) AS slope_change, round(slope - lag(slope, 5) OVER (ORDER BY d), 4) AS change_5, lead(slope) OVER (ORDER BY d) AS next_slope FROM sig", "sig"))
def diff_lag_lead(spark, sf):
    made = near(views.sig(spark, sf), 5, 1, lambda w: {"one": F.col("slope") - F.lag("slope").over(w), "five": F.col("slope") - F.lag("slope", 5).over(w), "next_slope": F.lead("slope").over(w)})
    return made.select("d", r6("one", "slope_change", 4), r6("five", "change_5", 4), "next_slope")


@query(sql("SELECT d, " + ", ".join(f"CASE WHEN count(close) {_W.format(n - 1)} = {n} THEN round(avg(close) {_W.format(n - 1)}, 6) END AS ma_{n}, CASE WHEN count(close) {_W.format(n - 1)} = {n} THEN round(sum(close) {_W.format(n - 1)}, 4) END AS sum_{n}" for n in (5, 20)) + " FROM px", "px"))
def rolling_mean_full(spark, sf):
    x = F.col("close")
    made = near(views.px(spark, sf), 19, 0, lambda w: {f"{k}_{n}": frames.rolling(f, x, n, w) for n in (5, 20) for k, f in (("ma", F.avg), ("sum", F.sum))})
    return made.select("d", *[c for n in (5, 20) for c in (r6(f"ma_{n}"), r6(f"sum_{n}", None, 4))])


@query(sql(f"SELECT d, round(coalesce(stddev_samp(ret) {_W.format(19)}, 0), 8) AS sd_20, CASE WHEN count(ret) {_W.format(14)} = 15 THEN round(stddev_samp(ret) {_W.format(14)}, 8) END AS sd_15 FROM ret", "ret"))
def rolling_std_min1(spark, sf):
    x = F.col("ret")
    made = near(ret(spark, sf), 19, 0, lambda w: {"sd_20": F.coalesce(frames.rolling(F.stddev_samp, x, 20, w, 2), F.lit(0.0)), "sd_15": frames.rolling(F.stddev_samp, x, 15, w)})
    return made.select("d", r6("sd_20", None, 8), r6("sd_15", None, 8))


@query(sql("SELECT d, CASE WHEN count(CASE WHEN s IS NOT NULL THEN ret END) OVER w >= 5 THEN nullif(round(corr(ret, s) OVER w, 6), 'nan'::DOUBLE) END AS corr_20 FROM (SELECT ret.d, ret, slope - lag(slope) OVER (ORDER BY ret.d) AS s FROM ret JOIN sig ON ret.d = sig.d) WINDOW w AS (ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", "ret", "sig"))
def rolling_corr_min5(spark, sf):
    both = near(ret(spark, sf).join(views.sig(spark, sf), "d"), 1, 0, lambda w: {"s": F.col("slope") - F.lag("slope").over(w)})
    return near(both, 19, 0, lambda w: {"r": frames.rolling_corr(F.col("ret"), F.col("s"), 20, w, 5)}).select("d", r6("r", "corr_20"))


@query(sql("SELECT d, CASE WHEN count(ret) OVER w >= 5 THEN round(stddev_pop(ret) OVER w * 1e4, 4) END AS vol_bp FROM ret WINDOW w AS (ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)", "ret"))
def prior_vol_bp(spark, sf):
    made = near(ret(spark, sf), 30, 0, lambda w: {"vol": frames.prior(F.stddev_pop, F.col("ret"), 30, w, 5) * 1e4})
    return made.select("d", r6("vol", "vol_bp", 4))


@query(sql("SELECT d, CASE WHEN count(rate) OVER w >= 30 THEN round(quantile_cont(rate, 0.8) OVER w, 8) END AS q80 FROM fund WINDOW w AS (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "fund"))
def expanding_quantile_incl(spark, sf):
    made = orderstats.expanding_quantiles(views.fund(spark, sf), "rate", [0.8], "d", span=F.year("d"), least=30)
    return made.select("d", r6(F.get("quantiles", F.lit(0)), "q80", 8))


@query(sql("SELECT d, coalesce(round(quantile_cont(rate, 0.6) OVER w, 8), 'inf'::DOUBLE) AS q60 FROM fund WINDOW w AS (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "fund"))
def expanding_quantile_prior(spark, sf):
    made = orderstats.expanding_quantiles(views.fund(spark, sf), "rate", [0.6], "d", span=F.year("d"), prior_only=True)
    return made.select("d", F.coalesce(F.round(F.get("quantiles", F.lit(0)), 8), F.lit(float("inf"))).alias("q60"))


@query(sql("SELECT d, round((close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0), 6) AS z FROM px WINDOW w AS (ORDER BY d ROWS UNBOUNDED PRECEDING)", "px"))
def expanding_zscore(spark, sf):
    return scans.zscores(views.px(spark, sf), "close", "d", F.year("d")).select("d", r6("z"))


@query(sql("SELECT a.d, round((count(*) FILTER (WHERE b.close < a.close) + (count(*) FILTER (WHERE b.close = a.close) + 1) / 2.0) / count(*), 6) AS rank_pct FROM px a JOIN px b ON b.d <= a.d GROUP BY a.d", "px"))
def expanding_rank_pct(spark, sf):
    return orderstats.expanding_ranks(views.px(spark, sf), "close", "d", F.year("d")).select("d", r6("rank_pct"))


@query(sql("SELECT d, round(p - max(p) OVER (ORDER BY d), 6) AS drawdown FROM (SELECT d, sum(ret) OVER (ORDER BY d) AS p FROM ret WHERE ret IS NOT NULL)", "ret"))
def drawdown_arith(spark, sf):
    return frames.drawdown(ret(spark, sf).filter("ret IS NOT NULL"), "ret", "d", False).select("d", r6("drawdown"))


@query(sql("SELECT d, round(p / max(p) OVER (ORDER BY d) - 1, 6) AS drawdown FROM (SELECT d, exp(sum(ln(1 + ret)) OVER (ORDER BY d)) AS p FROM ret WHERE ret IS NOT NULL)", "ret"))
def drawdown_rel(spark, sf):
    return frames.drawdown(ret(spark, sf).filter("ret IS NOT NULL"), "ret", "d", True).select("d", r6("drawdown"))


@query(sql("SELECT d, " + ", ".join(f"CASE WHEN count(ret) OVER (ORDER BY d ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) = {h} THEN round(sum(ret) OVER (ORDER BY d ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING), 6) END AS fwd_{h}" for h in (1, 5, 20)) + " FROM ret", "ret"))
def forward_return_h(spark, sf):
    made = near(ret(spark, sf), 0, 20, lambda w: {f"fwd_{h}": frames.forward_sum(F.col("ret"), h, w) for h in (1, 5, 20)})
    return made.select("d", *[r6(f"fwd_{h}") for h in (1, 5, 20)])


@query(sql("SELECT d, sum(f) OVER (PARTITION BY g ORDER BY d)::BIGINT AS streak FROM (SELECT d, f, sum(1 - f) OVER (ORDER BY d) AS g FROM (SELECT d, coalesce(ret > 0, false)::INT AS f FROM ret))", "ret"))
def streaks(spark, sf):
    return frames.runs(ret(spark, sf).withColumn("up", F.col("ret") > 0), "up", "d").select("d", "streak")


@query(sql("SELECT d FROM (SELECT d, coalesce(fg < 25, false) AS x, coalesce(lag(fg < 25) OVER (ORDER BY d), false) AS b FROM fund) WHERE x AND NOT b", "fund"))
def edge_entries(spark, sf):
    held = near(views.fund(spark, sf), 1, 0, lambda w: {"on": frames.edge(F.col("fg") < 25, w)})
    return held.filter("on").select("d")


_MA = ", ".join(f"CASE WHEN count(*) {_W.format(n - 1)} = {n} THEN avg(close) {_W.format(n - 1)} END AS m{n}" for n in (5, 10, 20, 40, 60))


@query(sql(f"SELECT d, coalesce(m5 > m10 AND m10 > m20 AND m20 > m40 AND m40 > m60, false) AS aligned FROM (SELECT d, {_MA} FROM px)", "px"))
def ma_alignment(spark, sf):
    held = near(views.px(spark, sf), 59, 0, lambda w: {f"m{n}": frames.rolling(F.avg, F.col("close"), n, w) for n in (5, 10, 20, 40, 60)})
    return held.select("d", F.coalesce(F.expr("m5 > m10 AND m10 > m20 AND m20 > m40 AND m40 > m60"), F.lit(False)).alias("aligned"))


@query(sql("SELECT p.ts, CASE WHEN b.ts <= p.ts + INTERVAL 5 MINUTE THEN b.close END AS price FROM probes p ASOF LEFT JOIN b1 b ON p.ts <= b.ts", "b1", "probes"))
def asof_forward_5m(spark, sf):
    return asof.asof(views.probes(spark, sf), views.bars(spark, sf), "close", "forward").select("ts", "price")


@query(sql("SELECT p.ts, CASE WHEN b.ts >= p.ts - INTERVAL 5 MINUTE THEN b.close END AS price FROM probes p ASOF LEFT JOIN b1 b ON p.ts >= b.ts", "b1", "probes"))
def asof_backward_5m(spark, sf):
    return asof.asof(views.probes(spark, sf), views.bars(spark, sf), "close", "backward").select("ts", "price")


@query(sql("SELECT p.ts, m.minutes, b.close FROM probes p CROSS JOIN (VALUES (0), (1), (5), (15), (60)) m(minutes) LEFT JOIN b1 b ON b.ts = p.ts + to_minutes(m.minutes)", "b1", "probes"))
def exact_minute_lookup(spark, sf):
    return asof.exact(views.probes(spark, sf), views.bars(spark, sf), "close", [0, 1, 5, 15, 60]).select("ts", "minutes", "close")


@query(sql("SELECT p.ts, round(CASE WHEN b.ts <= p.ts + INTERVAL 5 MINUTE THEN b.ret_5 END, 6) AS ret_5, round(CASE WHEN b.ts <= p.ts + INTERVAL 5 MINUTE THEN b.ret_30 END, 6) AS ret_30 FROM probes p ASOF LEFT JOIN lb b ON p.ts <= b.ts",
  "b1", "probes", lb="SELECT ts, lead(close, 5) OVER w / close - 1 AS ret_5, lead(close, 30) OVER w / close - 1 AS ret_30 FROM b1 WINDOW w AS (ORDER BY ts)"))
def asof_then_positional(spark, sf):
    """The change over the next 5 and 30 rows, of this day or later ones, from the first row within 5 minutes."""
    ahead = asof.positional(views.bars(spark, sf).withColumn("day", F.to_date("ts")), "close", [5, 30], "day").withColumn("both", F.struct("close_5", "close_30"))
    return asof.asof(views.probes(spark, sf), ahead, "both", "forward").select("ts", r6(F.col("price.close_5"), "ret_5"), r6(F.col("price.close_30"), "ret_30"))


@query(sql("SELECT ts, close, coalesce(last_value(aux_close IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING), first_value(aux_close IGNORE NULLS) OVER (PARTITION BY ts::DATE ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS aux_close FROM b1 LEFT JOIN aux USING (ts)", "b1", "aux"))
def ffill_left_join(spark, sf):
    return asof.carried(views.bars(spark, sf), views.aux(spark, sf), "aux_close", F.to_date("ts")).select("ts", "close", "aux_close")


@query(sql("SELECT f.d, s.slope AS last_slope FROM fund f ASOF LEFT JOIN sig s ON f.d >= s.d", "fund", "sig"))
def daily_asof_ffill(spark, sf):
    return asof.daily_asof(views.fund(spark, sf), views.sig(spark, sf), "slope", "last_slope").select("d", "last_slope")


@query(sql("SELECT ts, ts::DATE AS day, round(date_diff('microsecond', b, ts) / 1e6, 3) AS gap_s FROM (SELECT ts, lag(ts) OVER (PARTITION BY ts::DATE ORDER BY ts) AS b FROM ticks) WHERE date_diff('microsecond', b, ts) / 1e6 > 600", "ticks"))
def gap_detection(spark, sf):
    held = views.ticks(spark, sf).select("ts", F.to_date("ts").alias("day"))
    return bars.gaps(held, 600, ["day"]).select("ts", "day", r6("gap_s", None, 3))


@query(sql("SELECT d, close FROM (SELECT *, row_number() OVER (ORDER BY d) AS n FROM px) WHERE (n - 1) % 5 = 0", "px"))
def systematic_sample(spark, sf):
    return events.every_kth(views.px(spark, sf), 5, "d").select("d", "close")


@query(sql("SELECT d, vix FROM sig WHERE NOT EXISTS (SELECT 1 FROM hot WHERE abs(date_diff('day', hot.d, sig.d)) <= 1)", "sig", "fund", hot="SELECT d FROM fund WHERE fg > 75"))
def calendar_anti_join(spark, sf):
    return events.without_calendar(views.sig(spark, sf), views.fund(spark, sf).filter("fg > 75")).select("d", "vix")


@query(sql("SELECT d, pos, abs(pos - coalesce(lag(pos) OVER (ORDER BY d), 0)) AS turnover FROM (SELECT d, CASE WHEN fg < 25 THEN 1.0 WHEN fg > 75 THEN -1.0 ELSE 0.0 END::DOUBLE AS pos FROM fund)", "fund"))
def position_turnover(spark, sf):
    held = views.fund(spark, sf).withColumn("pos", contrarian(F.col("fg")))
    made = near(held, 1, 0, lambda w: {"turnover": F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(0.0)))})
    return made.select("d", "pos", "turnover")


@query(sql("SELECT d, close, round(exp(sum(ln(1 + coalesce(ret, 0))) OVER (ORDER BY d)), 6) AS wealth, round(sum(coalesce(ret, 0)) OVER (ORDER BY d), 6) AS running FROM ret", "ret"))
def cumulative_paths(spark, sf):
    r = F.coalesce("ret", F.lit(0.0))
    held = scans.running_sum(ret(spark, sf), r, "d", F.year("d"), "running")
    held = scans.running_sum(held, F.log1p(r), "d", F.year("d"), "logs")
    return held.select("d", "close", r6(F.exp("logs"), "wealth"), r6("running"))


@query(sql("SELECT d, ret, row_number() OVER (ORDER BY round(ret, 9) DESC, d) AS rank FROM ret WHERE ret IS NOT NULL ORDER BY rank LIMIT 10", "ret").replace("SELECT d, ret, row", "SELECT d, round(ret, 6) AS ret, row"))
def top_moves(spark, sf):
    top = ret(spark, sf).filter("ret IS NOT NULL").orderBy(F.desc(F.round("ret", 9)), "d").limit(10)
    return top.select("d", r6("ret"), F.row_number().over(frames.over([F.desc(F.round("ret", 9)), "d"])).alias("rank"))


@query(sql("SELECT d FROM sig UNION SELECT d FROM fund", "sig", "fund"))
def union_of_dates(spark, sf):
    return views.sig(spark, sf).select("d").union(views.fund(spark, sf).select("d")).distinct()


@query(sql("SELECT d FROM fund EXCEPT SELECT d FROM sig", "sig", "fund"))
def missing_dates(spark, sf):
    return views.fund(spark, sf).select("d").subtract(views.sig(spark, sf).select("d"))


@query(sql("SELECT d FROM fund INTERSECT SELECT d FROM sig", "sig", "fund"))
def shared_dates(spark, sf):
    return views.fund(spark, sf).select("d").intersect(views.sig(spark, sf).select("d"))
