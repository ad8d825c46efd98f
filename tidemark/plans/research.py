"""Further studies: strategy families, grids and their metrics, overnight grids, residual studies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import asof, bars, events, features, frames, resample, scans, stats, strategy
from ..sources import views
from ..sources.views import with_views as sql
from . import backtests
from .eventstudies import day_events, signal_and_returns
from .registry import r6, registry

QUERIES, ORACLE_SQL, query = registry()

_P, _V = backtests._P, backtests._V
_PANEL = {
    "oi": "SELECT d, oi / lag(oi) OVER (ORDER BY d) - 1 AS oic FROM (SELECT CAST(l_shipdate AS DATE) AS d, sum(l_quantity)::DOUBLE AS oi FROM lineitem GROUP BY 1)",
    "wide": "SELECT panel.*, vix, oic FROM panel JOIN (SELECT d, vix FROM sig) USING (d) JOIN oi USING (d)",
}


def wide(spark, sf):
    """The daily panel with vix and the change of open interest, for which the day's quantity stands."""
    oi = views.table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("d")).agg(F.sum("l_quantity").cast("double").alias("oi"))
    oi = oi.select("d", frames.change(F.col("oi"), 1, frames.over("d")).alias("oic"))
    return backtests.daily(spark, sf).join(views.sig(spark, sf).select("d", "vix"), "d").join(oi, "d")


def _by(name: str, rows: str) -> str:
    return f"SELECT {name}, d, pos, round(pos * ret - coalesce(abs(pos - lag(pos) OVER (PARTITION BY {name} ORDER BY d)), 0) * 0.0004, 8) + 0.0 AS strat FROM {rows}"


def _netted(held: DataFrame, name: str) -> DataFrame:
    return strategy.net_returns(held, "pos", "ret", "d", part=[name]).select(name, "d", "pos", r6("strat", None, 8))


# ---- strategy families

_ALL = "OVER (ORDER BY d ROWS UNBOUNDED PRECEDING)"


@query(sql(_by("mode", "mp"), *_V, **_P, **_PANEL,
  ma=f"SELECT * FROM (SELECT *, round({backtests._roll('sum', 'rate', 7)}, 9) AS f, coalesce(oic, 0.0) AS i FROM wide) WHERE f IS NOT NULL",
  mb=f"SELECT *, quantile_cont(f, 0.8) {_ALL} AS hi, quantile_cont(f, 0.2) {_ALL} AS lo, quantile_cont(i, 0.8) {_ALL} AS qi, quantile_cont(slope, 0.85) {_ALL} AS th, quantile_cont(slope, 0.15) {_ALL} AS tl FROM ma",
  mc="""SELECT *, CASE WHEN f > hi THEN -1.0 WHEN f < lo THEN 1.0 ELSE 0.0 END + CASE WHEN i > qi AND f > 0 THEN -0.5 WHEN i > qi AND f < 0 THEN 0.5 ELSE 0.0 END
    + CASE WHEN slope > th THEN -0.5 WHEN slope < tl THEN 0.5 ELSE 0.0 END AS score FROM mb""",
  mp="""SELECT mode, d, ret, coalesce(lag(CASE WHEN (mode = 'funding_only' AND f > hi) OR (mode = 'funding_oi' AND f > hi AND coalesce(oic > 0, false)) OR (mode = 'composite' AND score <= -1.0) THEN -1.0 ELSE 1.0 END)
    OVER (PARTITION BY mode ORDER BY d), 1.0)::DOUBLE AS pos FROM mc, (VALUES ('funding_only'), ('funding_oi'), ('composite')) k(mode)"""))  # fmt: skip
def funding_mode_grid(spark, sf):
    """Slope stands for the taker imbalance."""
    held = wide(spark, sf).select("d", "ret", "rate", "oic", "slope")
    return _netted(strategy.funding_modes(held, "rate", "oic", "slope", 7, 0.8, 0.2), "mode")


def _q30(x: str, p: float) -> str:
    return f"CASE WHEN count({x}) {_ALL} >= 30 THEN quantile_cont({x}, {p}) {_ALL} END"


_RULES = {
    "A": "high", "B": "up", "C": "high OR up", "D": "high AND up", "E": "coalesce(vix > q60, false)", "F": "high AND NOT crowd", "G": "(high OR up) AND NOT crowd", "H": "high AND fg > 50", "I": "high OR fg > 60",
    "J": "NOT (coalesce(vix < q40, false) AND down AND fg < 40)", "K": "coalesce(vix < q50, false)::INT + down::INT + (fg < 45)::INT < 2", "L": "high AND coalesce(rate <= g80, false) AND fg > 40",
}


@query(sql(_by("variant", "vp"), *_V, **_P, **_PANEL,
  va=f"SELECT *, {_q30('vix', 0.5)} AS q50, {_q30('vix', 0.6)} AS q60, {_q30('vix', 0.4)} AS q40, {_q30('rate', 0.8)} AS g80, vix / lag(vix, 2) OVER (ORDER BY d) - 1 AS move FROM wide",
  vb="SELECT *, coalesce(vix > q50, false) AS high, coalesce(move > 0, false) AS up, coalesce(move < 0, false) AS down, coalesce(rate > g80, false) AS crowd FROM va",
  vc=" UNION ALL ".join(f"SELECT '{k}' AS variant, d, ret, CASE WHEN {c} THEN 1.0 ELSE 0.0 END AS raw FROM vb" for k, c in _RULES.items()),
  vp="SELECT variant, d, ret, coalesce(lag(raw) OVER (PARTITION BY variant ORDER BY d), 1.0)::DOUBLE AS pos FROM vc"))
def volatility_filter_variants(spark, sf):
    """The twelve rules; vix stands for implied volatility, the funding rate for the search index."""
    held = wide(spark, sf).select("d", "ret", "vix", "rate", "fg")
    return _netted(strategy.volatility_filters(held, "vix", "rate", "fg").select("d", "ret", "variant", "pos"), "variant")


@query(sql("SELECT variant, d, pos, round(pos * ret - coalesce(abs(pos - coalesce(lag(pos) OVER (PARTITION BY variant ORDER BY d), pos)), 0) * 0.0004, 8) + 0.0 AS strat FROM vp", *_V, **_P, **_PANEL,
  va=f"SELECT *, coalesce(vix > {_q30('vix', 0.5)}, false) AS high, coalesce(vix > {_q30('vix', 0.6)}, false) AS top, coalesce(vix / lag(vix, 2) OVER (ORDER BY d) - 1 > 0, false) AS up, coalesce(vix / lag(vix, 2) OVER (ORDER BY d) - 1 < 0, false) AS down FROM wide",
  vb="SELECT d, ret, lag(high, 2) OVER w AS high, lag(top, 2) OVER w AS top, lag(up, 2) OVER w AS up, lag(down, 2) OVER w AS down, lag(fg > 50) OVER w AS glad, lag(fg < 40) OVER w AS fear FROM va WINDOW w AS (ORDER BY d)",
  vp=" UNION ALL ".join(f"SELECT '{k}' AS variant, d, ret, ({c})::INT::DOUBLE AS pos FROM vb" for k, c in {"A": "high", "B": "up", "C": "coalesce(high, false) OR (high IS NOT NULL AND coalesce(up, false))", "D": "coalesce(high, false) AND coalesce(up, false)", "E": "top",
    "H": "coalesce(high, false) AND coalesce(glad, false)", "K": "(NOT coalesce(high, false))::INT + coalesce(down, false)::INT + coalesce(fear, false)::INT < 2"}.items())))
def lagged_filter_variants(spark, sf):
    """The second family of the rules, two days behind; vix stands for implied volatility."""
    held = wide(spark, sf).select("d", "ret", "vix", "fg")
    return _netted(strategy.lagged_filters(held, "vix", "fg").select("d", "ret", "variant", "pos"), "variant")


@query(sql("SELECT d, round(greatest(-1.5, least(1.5, (1 - a - f) * 2.0 + a * 0.0 + f * -1.0)), 6) + 0.0 AS soft, CASE WHEN f > 0.55 THEN -1.0 WHEN a > 0.5 THEN 0.5 ELSE 2.0 END::DOUBLE AS hard FROM (SELECT d, (1 - abs(fg - 50) / 50) * 0.7 AS a, (1 - fg / 100) * 0.3 + CASE WHEN fg < 25 THEN 0.4 ELSE 0 END AS f FROM fund)", "fund"))
def soft_hard_leverage(spark, sf):
    """Leverage from the probabilities of three states, which sentiment stands for."""
    held = views.fund(spark, sf)
    alert = (1 - F.abs(F.col("fg") - 50) / 50) * 0.7
    fear = (1 - F.col("fg") / 100) * 0.3 + F.when(F.col("fg") < 25, 0.4).otherwise(0.0)
    return held.select("d", r6(strategy.soft_leverage([1 - alert - fear, alert, fear], [2.0, 0.0, -1.0], 1.5), "soft"), strategy.hard_leverage(alert, fear, 0.5, 0.55, [2.0, 0.5, -1.0]).alias("hard"))


# ---- metrics


@query(sql("""SELECT name, n, round(total, 6) AS total, round(pow(1 + total, 252.0 / n) - 1, 6) AS annual, round(vol, 6) AS vol, round((pow(1 + total, 252.0 / n) - 1) / vol, 6) AS sharpe, round((pow(1 + total, 252.0 / n) - 1) / down, 6) AS sortino, round(mdd, 6) AS max_drawdown,
  round((pow(1 + total, 252.0 / n) - 1) / abs(mdd), 6) AS calmar, round(up / -dn, 6) AS pl_ratio, round(mean * 252, 6) AS simple FROM (SELECT name, count(*) AS n, exp(sum(ln(1 + r))) - 1 AS total, stddev_samp(r) * sqrt(252) AS vol, sqrt(avg(least(r, 0) ** 2)) * sqrt(252) AS down,
    min(path / peak - 1) AS mdd, avg(r) FILTER (WHERE r > 0) AS up, avg(r) FILTER (WHERE r < 0) AS dn, avg(r) AS mean FROM (SELECT *, max(path) OVER (PARTITION BY name ORDER BY d) AS peak FROM (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY name ORDER BY d)) AS path FROM two)) GROUP BY 1)""",
  *_V, **_P, **backtests._regime(3, 20, 0.8), net=backtests._NET.format("", "", "rp"), two="SELECT 'regime' AS name, d, strat * 0.001 AS r FROM net UNION ALL SELECT 'hold', d, hold * 0.001 FROM net"))
def annual_metrics(spark, sf):
    """Compound metrics of a thousandth of the capital in the regime strategy, and in holding."""
    net = backtests._net(strategy.rv_regime(backtests.daily(spark, sf), "rv", 3, 20, 0.8))
    held = net.select("d", (F.col("strat") * 0.001).alias("regime"), (F.col("hold") * 0.001).alias("hold")).unpivot(["d"], ["regime", "hold"], "name", "r")
    return strategy.compound_metrics(held, ["name"], "r", "d", 252).select("name", "n", *[r6(c) for c in ("total", "annual", "vol", "sharpe", "sortino", "max_drawdown", "calmar", "pl_ratio", "simple")])


_AB = backtests.ORACLE_SQL["anomaly_backtest"]
_AT = _AB.index("\nSELECT mode")


@query(_AB[:_AT] + f""",
ab AS ({_AB[_AT:]})
SELECT mode, round(total, 6) AS total, round(total - base, 6) AS alpha, mode <> 'baseline' AND row_number() OVER (PARTITION BY mode <> 'baseline' ORDER BY round(total - base, 9) DESC, mode) = 1 AS best
FROM (SELECT mode, sum(net) AS total FROM ab GROUP BY 1), (SELECT sum(net) AS base FROM ab WHERE mode = 'baseline')""")
def alpha_vs_baseline(spark, sf):
    """Each way to hold a day's direction against the baseline."""
    total = backtests.QUERIES["anomaly_backtest"](spark, sf).groupBy("mode").agg(F.sum("net").alias("total"))
    return strategy.against(total, "mode", "total", "baseline").select("mode", r6("total"), r6("alpha"), "best")


@query(sql("SELECT max(up) AS wins, max(down) AS losses FROM (SELECT sum(f) OVER (PARTITION BY g ORDER BY d)::BIGINT AS up, sum(1 - f) OVER (PARTITION BY h ORDER BY d)::BIGINT AS down FROM (SELECT *, sum(1 - f) OVER (ORDER BY d) AS g, sum(f) OVER (ORDER BY d) AS h FROM (SELECT d, (strat > 0)::INT AS f FROM net)))",
  *_V, **_P, **backtests._regime(3, 20, 0.8), net=backtests._NET.format("", "", "rp")))
def longest_streaks(spark, sf):
    held = backtests._net(strategy.rv_regime(backtests.daily(spark, sf), "rv", 3, 20, 0.8)).withColumn("g", F.lit(1))
    return frames.longest_runs(held, "strat", "d", ["g"]).select("wins", "losses")


# ---- filters, merges, lookups


@query(sql("SELECT lo, hi, count(*) AS n, round(corr(change, nxt), 6) AS r FROM (SELECT x.d, vix, slope - lag(slope) OVER (ORDER BY x.d) AS change FROM sig x) JOIN (SELECT d, lead(close) OVER (ORDER BY d) / close - 1 AS nxt FROM px) USING (d), (VALUES (0.0::DOUBLE, 140000.0::DOUBLE), (140000.0, 160000.0), (160000.0, 1e12)) b(lo, hi) WHERE vix >= lo AND vix < hi AND change IS NOT NULL AND nxt IS NOT NULL GROUP BY 1, 2", "sig", "px"))
def band_correlations(spark, sf):
    """Correlation of the signal's change with the next return, within bands of its level."""
    held = signal_and_returns(spark, sf).join(views.sig(spark, sf).select("d", "vix"), "d")
    bands = F.explode(F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in ((0.0, 140000.0), (140000.0, 160000.0), (160000.0, 1e12))]))
    held = held.withColumn("b", bands).select("*", "b.*").filter((F.col("vix") >= F.col("lo")) & (F.col("vix") < F.col("hi")))
    return stats.pearson(held.filter("change IS NOT NULL AND nxt IS NOT NULL"), ["lo", "hi"], "change", "nxt").select("lo", "hi", "n", r6("r"))


@query(sql("SELECT ts, round(x - lag_x, 6) AS change, round(close / lag_close - 1, 6) AS ret FROM (SELECT ts, trade_imbalance AS x, lag(trade_imbalance) OVER w AS lag_x, close, lag(close) OVER w AS lag_close, lag(ts) OVER w AS was FROM bh WINDOW w AS (ORDER BY ts)) WHERE ts = was + INTERVAL 1 HOUR AND hour(ts) BETWEEN 10 AND 16", "ticks", bh=views.bars_sql(60)))
def hourly_changes(spark, sf):
    """Changes over exactly an hour, at hours from 10 to 16."""
    b = views.bars(spark, sf, 60)
    held = scans.reach(b, "ts", F.to_date("ts"), 1, 0, lambda w: {"change": F.col("trade_imbalance") - F.lag("trade_imbalance").over(w), "ret": frames.change(F.col("close"), 1, w)})
    return bars.consecutive(held, 3600, 10, 16).select("ts", r6("change"), r6("ret"))


@query("SELECT l_shipdate::DATE AS d, round(avg(l_quantity), 6) AS l_quantity, round(round(avg(l_extendedprice), 6), 2) AS l_extendedprice FROM lineitem GROUP BY 1")
def means_by_date(spark, sf):
    held = views.table(spark, sf, "lineitem").withColumn("d", F.col("l_shipdate").cast("date"))
    return bars.mean_by(held, "d", ["quantity", "extendedprice"]).select("d", r6("l_quantity"), F.round(F.round("l_extendedprice", 6), 2).alias("l_extendedprice"))


_OVER = [60, 240, 480, 900]


@query(sql("SELECT d, minute, round(price / p0 - 1, 6) AS ret, round(p0 / po - 1, 6) AS intraday FROM (SELECT *, max(CASE WHEN minute = 0 THEN price END) OVER (PARTITION BY d) AS p0, max(CASE WHEN minute = -390 THEN price END) OVER (PARTITION BY d) AS po FROM found) WHERE minute > 0 AND p0 IS NOT NULL", "b1",
  looks="SELECT d, minute, d + INTERVAL 16 HOUR + to_minutes(minute) AS ts FROM (SELECT DISTINCT ts::DATE AS d FROM b1), (VALUES (-390), (0), " + ", ".join(f"({m})" for m in _OVER) + ") m(minute)",
  found="SELECT l.d, l.minute, CASE WHEN b.ts >= l.ts - INTERVAL 5 MINUTE THEN b.close END AS price FROM looks l ASOF LEFT JOIN b1 b ON l.ts >= b.ts"))
def overnight_grid(spark, sf):
    """Returns from 16:00 on, looked up backwards within 5 minutes, and the day's leg from 09:30 to 16:00."""
    b = views.bars(spark, sf)
    days = b.select(F.to_date("ts").alias("d")).distinct()
    spread = days.withColumn("minute", F.explode(F.array(*map(F.lit, [-390, 0, *_OVER]))))
    at = F.col("d").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(16), F.col("minute"))
    looked = asof.asof(spread.withColumn("ts", at), b, "close", "backward")
    one = lambda m: F.max(F.when(F.col("minute") == m, F.col("price"))).over(W.partitionBy("d"))
    held = looked.withColumn("p0", one(0)).withColumn("po", one(-390)).filter("minute > 0 AND p0 IS NOT NULL")
    return held.select("d", "minute", r6(F.col("price") / F.col("p0") - 1, "ret"), r6(F.col("p0") / F.col("po") - 1, "intraday"))


_STEPS = list(range(0, 61, 5))
_TURN = {
    "ev": "SELECT key || '-' || n AS key, ts, signal FROM (SELECT ts::DATE AS key, ts, round(close / lag(close, 4) OVER w - 1, 9) AS signal, row_number() OVER w AS n FROM b15 WINDOW w AS (PARTITION BY ts::DATE ORDER BY ts)) WHERE signal IS NOT NULL",
    "looks": "SELECT key, signal, m.minute, ts + to_minutes(m.minute) AS ts FROM ev CROSS JOIN (VALUES (-1), " + ", ".join(f"({m})" for m in _STEPS) + ") m(minute)",
    "found": "SELECT l.key, l.signal, l.minute, CASE WHEN b.ts <= l.ts + INTERVAL 5 MINUTE THEN b.close END AS price FROM looks l ASOF LEFT JOIN b1 b ON l.ts <= b.ts",
    "grid": "SELECT f.key, f.signal, f.minute, f.price / p.price - 1 AS ret FROM found f JOIN found p ON f.key = p.key AND p.minute = -1 WHERE f.minute <> -1",
    "sides": "SELECT key, CASE WHEN signal > m + s THEN 1 WHEN signal < m - s THEN -1 END AS side FROM ev, (SELECT avg(signal) AS m, stddev_samp(signal) AS s FROM ev)",
    "paths": "SELECT side, minute, round(avg(ret), 9) AS mean FROM grid JOIN sides USING (key) WHERE side IS NOT NULL GROUP BY 1, 2",
    "steps": "SELECT *, sign(mean - lag(mean) OVER w) AS s, row_number() OVER w - 2 AS k, lag(minute) OVER w AS m FROM paths WINDOW w AS (PARTITION BY side ORDER BY minute)",
}


@query(sql("SELECT side, min(m) FILTER (WHERE k - 1 >= 3 AND CASE WHEN side > 0 THEN s > was ELSE s < was END) AS turn FROM (SELECT *, lag(s) OVER (PARTITION BY side ORDER BY minute) AS was FROM steps) GROUP BY 1", "b1", "b15", **_TURN))
def path_turns(spark, sf):
    """Where the mean path after events beyond one sigma turns."""
    grid = events.response_grid(day_events(spark, sf), views.bars(spark, sf), _STEPS)
    paths = events.event_paths(grid, 1.0).select("side", "minute", F.round("mean", 9).alias("mean"))
    return events.turning_point(paths)


@query(sql("SELECT ts, round(signal, 6) AS signal, nxt AS entry_ts, round(entry, 6) AS entry FROM (SELECT ts, trade_imbalance AS signal, lead(ts) OVER w AS nxt, lead(open) OVER w AS entry FROM b15 WINDOW w AS (PARTITION BY ts::DATE ORDER BY ts)) WHERE abs(signal) > 0.3 AND nxt IS NOT NULL", "b15"))
def next_bar_entries(spark, sf):
    """A signal's bar with the bar after it, at whose open the trade is entered."""
    w = frames.over("ts", ["day"])
    held = views.bars(spark, sf, 15).withColumn("day", F.to_date("ts"))
    held = held.withColumn("entry_ts", F.lead("ts").over(w)).withColumn("entry", F.lead("open").over(w))
    return held.filter((F.abs("trade_imbalance") > 0.3) & F.col("entry_ts").isNotNull()).select("ts", r6("trade_imbalance", "signal"), "entry_ts", r6("entry"))


@query(sql("""SELECT a.thr, a.n AS n_train, round(a.total, 6) AS total_train, b.n AS n_test, round(b.total, 6) AS total_test FROM st a LEFT JOIN st b ON a.thr = b.thr AND NOT b.train WHERE a.train""", "sig", "px",
  x="SELECT d, slope - lag(slope) OVER (ORDER BY d) AS change FROM sig", p="SELECT d, lead(close) OVER (ORDER BY d) / close - 1 AS nxt FROM px",
  st="SELECT thr, d < DATE '1999-01-01' AS train, count(*) AS n, sum(sign(change) * nxt) AS total FROM x JOIN p USING (d), (VALUES (0.0::DOUBLE), (20000.0), (60000.0), (400000.0)) t(thr) WHERE nxt IS NOT NULL AND abs(change) > thr GROUP BY 1, 2"))
def threshold_grid_merged(spark, sf):
    """Results on the training days, with those on the rest joined on the threshold."""
    spread = signal_and_returns(spark, sf).filter("nxt IS NOT NULL").withColumn("thr", F.explode(F.array(*map(F.lit, [0.0, 20000.0, 60000.0, 400000.0])))).filter(F.abs("change") > F.col("thr"))
    grid = spread.groupBy("thr", "train").agg(F.count(F.lit(1)).alias("n"), F.sum(F.signum("change") * F.col("nxt")).alias("total"))
    test = grid.filter("NOT train").select("thr", F.col("n").alias("n_test"), F.col("total").alias("total_test"))
    return grid.filter("train").join(test, "thr", "left").select("thr", F.col("n").alias("n_train"), r6("total", "total_train"), "n_test", r6("total_test"))


# ---- residual studies: what a row's features differ by from the 20 rows before stands for a model's signed residual

_FEATURES = ("ret", "trade_imbalance", "avg_trade_size")
_RES = {
    "ra": "SELECT ts::DATE AS day, ts, coalesce(close / lag(close) OVER (ORDER BY ts) - 1, 0) AS ret, trade_imbalance, avg_trade_size, row_number() OVER w AS i FROM b15 WINDOW w AS (PARTITION BY ts::DATE ORDER BY ts)",
    "rb": "SELECT *, " + ", ".join(f"round({c} - CASE WHEN count({c}) OVER w >= 5 THEN avg({c}) OVER w END, 9) AS res_{c}" for c in _FEATURES) + ", " + ", ".join(f"CASE WHEN count(*) OVER (PARTITION BY day ORDER BY ts ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING) = {h} THEN sum(ret) OVER (PARTITION BY day ORDER BY ts ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING) END AS fwd_{h}" for h in (1, 2, 4)) + " FROM ra WINDOW w AS (PARTITION BY day ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)",
    "rc": " UNION ALL ".join(f"SELECT day, ts, '{c}' AS feature, {h} AS fwd, res_{c} AS res, round(fwd_{h}, 9) AS r FROM rb WHERE abs(trade_imbalance) > 0.3" for c in _FEATURES for h in (1, 2, 4)),
    "rd": "SELECT * FROM rc WHERE res IS NOT NULL AND r IS NOT NULL",
}


def residuals(spark, sf):
    """(day, ts, feature, fwd, res, r): each flagged row's residual by feature, with the sum of the coming returns by horizon."""
    w = frames.over("ts", ["day"])
    held = frames.returns(views.bars(spark, sf, 15).withColumn("day", F.to_date("ts")), {"ret": "close"}, "ts", "day")
    for h in (1, 2, 4):
        held = features.forward_window_sum(held, "ret", h, "ts", "day")
    held = held.withColumns({f"res_{c}": F.round(F.col(c) - frames.prior(F.avg, F.col(c), 20, w, 5), 9) for c in _FEATURES}).filter(F.abs("trade_imbalance") > 0.3)
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(h).alias("fwd"), F.col(f"res_{c}").alias("res"), F.round(f"fwd_{h}", 9).alias("r")) for c in _FEATURES for h in (1, 2, 4)])
    return held.select("day", "ts", F.explode(each).alias("x")).select("day", "ts", "x.*").filter("res IS NOT NULL AND r IS NOT NULL")


@query(sql("SELECT feature, fwd, count(*) AS n, round(corr(res, r), 6) AS r FROM rd GROUP BY 1, 2", "b15", **_RES))
def residual_correlations(spark, sf):
    return stats.pearson(residuals(spark, sf), ["feature", "fwd"], "res", "r").select("feature", "fwd", "n", r6("r"))


@query(sql("SELECT feature, fwd, count(*) FILTER (WHERE res > 0) AS n_up, round(avg(r) FILTER (WHERE res > 0), 6) AS mean_up, count(*) FILTER (WHERE res < 0) AS n_down, round(avg(r) FILTER (WHERE res < 0), 6) AS mean_down FROM rd GROUP BY 1, 2", "b15", **_RES))
def residual_sides(spark, sf):
    up, down = F.when(F.col("res") > 0, F.col("r")), F.when(F.col("res") < 0, F.col("r"))
    return residuals(spark, sf).groupBy("feature", "fwd").agg(F.count(up).alias("n_up"), r6(F.avg(up), "mean_up"), F.count(down).alias("n_down"), r6(F.avg(down), "mean_down"))


@query(sql("SELECT k.rule, fwd, count(*) AS n, round(100.0 * avg((sign(r) = k.way * sign(res))::INT), 6) AS hit_pct FROM rd, (VALUES ('against_imbalance', 'trade_imbalance', -1), ('momentum', 'ret', 1), ('reversal', 'ret', -1)) k(rule, f, way) WHERE feature = k.f AND r <> 0 GROUP BY 1, 2", "b15", **_RES))
def residual_rules(spark, sf):
    """How often three rules name the direction of the coming return: against one residual, with and against the other."""
    rules = F.array(*[F.struct(F.lit(a).alias("rule"), F.lit(f).alias("f"), F.lit(s).alias("way")) for a, f, s in (("against_imbalance", "trade_imbalance", -1), ("momentum", "ret", 1), ("reversal", "ret", -1))])
    held = residuals(spark, sf).filter("r <> 0").withColumn("k", F.explode(rules)).select("*", "k.*").filter("feature = f")
    hit = F.when(F.signum("r") == F.col("way") * F.signum("res"), 1.0).otherwise(0.0)
    return held.groupBy("rule", "fwd").agg(F.count(F.lit(1)).alias("n"), r6(100.0 * F.avg(hit), "hit_pct"))


@query(sql("SELECT fwd, count(*) FILTER (WHERE fear) AS n_fear, round(avg(r) FILTER (WHERE fear), 6) AS mean_fear, count(*) FILTER (WHERE hope) AS n_hope, round(avg(r) FILTER (WHERE hope), 6) AS mean_hope FROM (SELECT a.fwd, a.r, a.res > 0 AND b.res < 0 AS fear, a.res < 0 AND b.res > 0 AS hope FROM rd a JOIN rd b ON a.ts = b.ts AND a.fwd = b.fwd AND a.feature = 'trade_imbalance' AND b.feature = 'ret') GROUP BY 1", "b15", **_RES))
def residual_pairs(spark, sf):
    """The coming return where two residuals point apart: one up and the other down, and the reverse."""
    both = residuals(spark, sf).groupBy("ts", "fwd").agg(F.max("r").alias("r"), *[F.max(F.when(F.col("feature") == c, F.col("res"))).alias(n) for n, c in (("a", "trade_imbalance"), ("b", "ret"))]).filter("a IS NOT NULL AND b IS NOT NULL")
    fear, hope = F.when((F.col("a") > 0) & (F.col("b") < 0), F.col("r")), F.when((F.col("a") < 0) & (F.col("b") > 0), F.col("r"))
    return both.groupBy("fwd").agg(F.count(fear).alias("n_fear"), r6(F.avg(fear), "mean_fear"), F.count(hope).alias("n_hope"), r6(F.avg(hope), "mean_hope"))


@query()
def residual_t_tests(spark, sf):
    """Whether the coming return differs with the sign of a residual; p of the pooled test, by feature and horizon."""
    up, down = F.when(F.col("res") > 0, F.col("r")), F.when(F.col("res") < 0, F.col("r"))
    held = residuals(spark, sf).groupBy("feature", "fwd").agg(*[f(c).alias(f"{k}{s}") for s, c in (("1", up), ("0", down)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2)
    held = held.filter("n1 > 5 AND n0 > 5").withColumn("t", (F.col("m1") - F.col("m0")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n0")))).withColumn("dof", F.col("n1") + F.col("n0") - 2)
    return held.select("feature", "fwd", "n1", "n0", r6("t"), r6(stats.p_of_t(F.col("t"), F.col("dof").cast("double")), "p"))


# ---- permutations of a strategy, one-sided as the strategy is meant to gain


def _permuted(spark, sf, statistic, observed):
    held = backtests.daily(spark, sf).withColumn("pos", strategy.contrarian(F.col("fg"))).withColumn("cost", F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(frames.over("d")), F.lit(0.0))) * 0.0004)
    reps = resample.replicate(held, ["pos", "ret", "cost"], "d", 5_000, statistic)
    return resample.permutation_p(reps, held.agg(observed).first()[0], False)


@query()
def permutation_mean(spark, sf):
    return _permuted(spark, sf, resample.permuted_mean, F.avg(F.col("pos") * F.col("ret") - F.col("cost")))


@query()
def permutation_signal(spark, sf):
    x = F.col("pos") * F.col("ret")
    return _permuted(spark, sf, resample.permuted_signal, F.coalesce(F.try_divide(F.avg(x), F.stddev_pop(x)), F.lit(0.0)) * F.sqrt(F.lit(365.0)))
