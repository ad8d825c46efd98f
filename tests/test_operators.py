"""Hand-made frames for the edge cases of the ordered operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars, special
from tidemark.operators import asof, bars, events, features, frames, hmm, lagged, models, orderstats, resample, stats, strategy, walkforward

T0 = dt.datetime(2024, 1, 2, 10)


def at(**k):
    return T0 + dt.timedelta(**k)


def series(spark, xs, name="x"):
    return spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(xs)], f"d int, {name} double")


def values(df, c, order="d"):
    return [r[c] for r in df.orderBy(order).collect()]


@pytest.mark.parametrize("direction,sign", [("forward", 1), ("backward", -1)])
def test_asof_tolerance_is_inclusive(spark, direction, sign):
    b = spark.createDataFrame([(at(), 1.0), (at(hours=1), 2.0)], "ts timestamp_ntz, close double")
    ev = spark.createDataFrame([(at(),), (at(seconds=-300 * sign),), (at(seconds=-301 * sign),), (at(hours=9),)], "ts timestamp_ntz")
    got = {r.ts: r.price for r in asof.asof(ev, b, "close", direction).collect()}
    assert got == {at(): 1.0, at(seconds=-300 * sign): 1.0, at(seconds=-301 * sign): None, at(hours=9): None}


def test_asof_needs_a_direction(spark):
    with pytest.raises(ValueError):
        asof.asof(None, None, "close", "nearest")


def test_rolling_needs_full_frames(spark):
    df = series(spark, [1, 2, None, 4, 5, 6])
    w = frames.over("d")
    assert values(df.select("d", frames.rolling(F.avg, F.col("x"), 2, w).alias("m")), "m") == [None, 1.5, None, None, 4.5, 5.5]


def test_correlation_of_constant_is_null(spark):
    df = spark.createDataFrame([(i, 1.0, float(i)) for i in range(8)], "d int, x double, y double")
    assert set(values(df.select("d", frames.rolling_corr(F.col("x"), F.col("y"), 5, frames.over("d"), 3).alias("r")), "r")) == {None}


def test_correlation_uses_complete_pairs(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=30), rng.normal(size=30)
    rows = [(float(a) if i % 7 else None, float(b) if i % 5 else None) for i, (a, b) in enumerate(zip(x, y))]
    keep = [i for i in range(30) if i % 7 and i % 5]
    got = spark.createDataFrame(rows, "x double, y double").agg(frames.corr(F.col("x"), F.col("y")).alias("r")).first().r
    assert got == pytest.approx(np.corrcoef(x[keep], y[keep])[0, 1])


def test_prior_quantile_does_not_see_the_future(spark):
    q = lambda xs: values(orderstats.quantile_columns(series(spark, xs), {"q": ("x", 0.5, True, 1)}, "d"), "q")
    a, b = q([3, 1, 2, 9]), q([3, 1, 2, -50])
    assert a == b == [None, 3.0, 2.0, 2.0]


def test_expanding_rank_averages_ties(spark):
    got = values(orderstats.expanding_ranks(series(spark, [3, 1, 2, 2]), "x", "d", F.floor(F.col("d") / 2)), "rank_pct")
    assert got == pytest.approx([1, 0.5, 2 / 3, 0.625])


def test_drawdown_never_positive(spark):
    df = series(spark, [0.1, -0.2, 0.05, 0.3], "r")
    for compound in (False, True):
        assert max(values(frames.drawdown(df, "r", "d", compound), "drawdown")) <= 0


@pytest.mark.parametrize("flags,want", [([1, 1, 1], [1, 2, 3]), ([0, 0], [0, 0]), ([1, 0, 1, 0], [1, 0, 1, 0])])
def test_runs(spark, flags, want):
    df = series(spark, flags).withColumn("f", F.col("x") > 0)
    assert values(frames.runs(df, "f", "d"), "streak") == want


@pytest.mark.parametrize("rows,main,early", [(59, 0, 0), (60, 1, 45), (390, 331, 45)])
def test_windows_of_a_day(spark, rows, main, early):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(rows)], "day int, i int, x double")
    assert frames.windows(df, ["x"], 60, "i", ["day"]).count() == main
    assert frames.windows(df, ["x"], 15, "i", ["day"], 15, 59, 60).count() == early


def test_trade_days_over_daylight_saving(spark):
    utc = [dt.datetime(2024, 3, 10, 20, 59), dt.datetime(2024, 3, 10, 21, 0), dt.datetime(2024, 11, 3, 21, 59), dt.datetime(2024, 11, 3, 22, 0)]
    df = spark.createDataFrame([(t,) for t in utc], "ts timestamp_ntz")
    got = [r.d.day for r in df.select("ts", scalars.trade_day_17(scalars.eastern(F.col("ts"))).alias("d")).orderBy("ts").collect()]
    assert got == [10, 11, 3, 4]


def test_bins_are_right_closed(spark):
    df = series(spark, [0, 0.3, 0.30001, 5])
    assert values(df.withColumn("b", scalars.cut(F.col("x"), [0, 0.3, 1], ["a", "b"])), "b") == [None, "a", "b", None]


def test_thinning_gap_is_exclusive(spark):
    ev = spark.createDataFrame([(1, at(minutes=m)) for m in (0, 20, 30, 40, 61)] + [(2, at(minutes=m)) for m in (0, 20, 40)], "k int, ts timestamp_ntz")
    got = sorted((r.k, (r.ts - T0).seconds // 60) for r in events.thin(ev, 1800, ["k"]).collect())
    assert got == [(1, 0), (1, 40), (2, 0), (2, 40)]


def test_stops(spark):
    days = {1: [1.5, -0.2, -0.9], 2: [0.2, -0.9, 2.0], 3: [2.5, 0.0], 4: [0.1]}
    df = spark.createDataFrame([(d, i, r) for d, rs in days.items() for i, r in enumerate(rs)], "day int, i int, ret double")
    got = {r.day: r for r in strategy.stops(df, 2.0, 1.0, 0.5).collect()}
    assert got[1].trailing == pytest.approx(0.4) and got[2].trailing == pytest.approx(1.3)
    assert got[2].stop_loss == pytest.approx(-0.7) and got[3].take_profit == 2.0 and got[4].both == pytest.approx(0.1)
    # the path's own value beyond the stop, and not at it: -0.5 stays, -1.2 leaves
    df = spark.createDataFrame([(1, 0, -0.5), (1, 1, -0.7), (1, 2, 3.0), (2, 0, -0.5), (2, 1, 0.75)], "day int, i int, ret double")
    got = {r.day: r for r in strategy.stops(df, 9.0, 1.0, 0.5).collect()}
    assert got[1].stop_loss == got[1].both == pytest.approx(-1.2) and got[2].stop_loss == pytest.approx(0.25)


@pytest.mark.parametrize("flags,want", [([0, 1, 0, 0, 0, 0, 0, 1, 1], [1, 0, 0, 0, 0, 0, 1, 0, 0]), ([1, 1, 1, 1, 1, 1, 0, 0, 1, 0], [0, 0, 0, 0, 0, 0, 1, 1, 0, 0])])
def test_min_hold(spark, flags, want):
    df = spark.createDataFrame([(1, i, bool(f)) for i, f in enumerate(flags)], "day int, i int, flag boolean")
    assert values(strategy.min_hold(df, "flag", 5), "pos", "i") == want


def test_anomaly_rules_by_hand(spark):
    rows = [(1, 0, 0.1, -1, True, 0.5), (1, 1, 0.2, -1, False, 0.0), (1, 2, 0.3, -1, False, 0.95), (1, 3, 0.4, -1, True, 2.0)]
    got = {r["mode"]: (r.n_trades, round(r.gross, 9)) for r in strategy.anomaly_rules(spark.createDataFrame(rows, "day int, i int, ret double, dir int, flag boolean, norm double"), "flag", "norm", 2).collect()}
    # exit: out at row 0, back at row 2, out at row 3; sizing: 0.5, 1, 0.05, 0 moves by more than a tenth twice
    assert got == {"baseline": (2, -1.0), "exit": (5, -0.3), "leverage": (5, -0.65), "filter": (2, -0.9), "sizing": (4, -0.265)}


def test_regime_starts_with_the_first_ratio(spark):
    rows = [(d, float(x), float(r)) for d, (x, r) in enumerate(zip([1.0, 1, 1, 4, 1, 1, 9, 1], [1, -1, 1, -1, -1, -1, -1, -1]))]
    df = spark.createDataFrame(rows, "d int, rv double, ret double")
    held = {r.d: r.pos for r in strategy.rv_regime(df, "rv", 1, 3, 0.5).collect()}
    # ratios 1, 2, 0.5, 0.5, 2.45, 0.27 of days 2 to 7; above the median of those before on days 3 and 6
    assert held == {2: 0.0, 3: 1.0, 4: -1.0, 5: 1.0, 6: 1.0, 7: -1.0}
    both = {r.d: r.pos for r in strategy.rv_regime(df, "rv", 1, 3, 0.5, confirm=strategy.falling("ret", 4), first=1.0).collect()}
    assert both == {2: 1.0, 3: 1.0, 4: 1.0, 5: 1.0, 6: 1.0, 7: -1.0}  # the four returns to day 3 sum to 0


def test_filter_rule_needs_thirty_values_and_two_rows(spark):
    df = spark.createDataFrame([(d, float(x)) for d, x in enumerate([*range(30), 50, 40, 45, 60])], "d int, x double")
    held = {r.d: r.pos for r in strategy.filter_rule(df, "x", 0.6, True).collect()}
    # day 29 has the 30th value; day 31 is above day 29's 29, day 32 is below day 30's 50
    assert {d for d, p in held.items() if p} == {31, 32, 33}


def test_leverage_at_zero_is_long(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (-2.0,), (3.0,)], "x double")
    assert {r.x: r.lev for r in strategy.quantile_leverage(df, "x").collect()} == {0.0: 0.5, 1.0: -1.0, -2.0: 1.5, 3.0: -2.0}


def test_vol_target_without_forecast(spark):
    df = spark.createDataFrame([(None,), (0.0,), (1.0,), (100.0,), (5.0,)], "v double")
    assert [r.lev for r in strategy.vol_target(df, F.col("v"), 10.0).collect()] == [2.0, 2.0, 3.0, 0.5, 2.0]


def test_relevered_counts_changes(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in ((1, 2.2), (2, 9.0), (31, 2.5), (61, 2.7), (91, 1.0))], "day int, i int, lev double")
    assert [r.changes for r in strategy.relevered(df, "lev", 2.0).collect()] == [2]


def test_permutation_sides(spark):
    reps = spark.createDataFrame([(x,) for x in (-3.0, 0.0, 1.0, 2.0)], "value double")
    assert [resample.permutation_p(reps, 1.0, two).first().beyond for two in (True, False)] == [3, 2]


def test_blocks_reach_across_days(spark):
    n = 57
    df = spark.createDataFrame([(i, i // 5, float(i * i % 13)) for i in range(n)], "ts int, day int, x double").repartition(5)
    w = frames.W.partitionBy("block").orderBy("n")
    held = frames.blocks(df, "ts", "day", 3, 2, 8).withColumn("sum", F.sum("x").over(w.rowsBetween(-3, 2))).filter("own")
    x = [i * i % 13 for i in range(n)]
    assert values(held, "sum", "ts") == [sum(x[max(0, i - 3) : i + 3]) for i in range(n)] and values(held, "n", "ts") == list(range(n))


def test_positional_counts_rows_across_days(spark):
    b = spark.createDataFrame([(at(days=k // 2, minutes=k), dt.date(2024, 1, 2) + dt.timedelta(k // 2), 100.0 + k) for k in range(5)], "ts timestamp_ntz, day date, close double")
    assert values(asof.positional(b, "close", [3], "day"), "close_3", "ts") == [pytest.approx(103 / 100 - 1), pytest.approx(104 / 101 - 1), None, None, None]


def test_walk_forward_needs_days_and_shorts(spark):
    rows = [(p, dt.date(2024, 1, 1) + dt.timedelta(i), -1.0 if p and i == 2 else 1.0, 0.01 * (i % 3) + 0.001 * (2 - p), 0.0) for p in (0, 1) for i in range(15)]
    paths = spark.createDataFrame(rows, "param int, d date, pos double, strat double, hold double")
    windows = walkforward.rounds(spark, "2024-01-11", 5, 5, 1)
    assert [r.param for r in walkforward.select(paths, windows, least=10, short=0.05).collect()] == [1]
    assert walkforward.select(paths, windows, least=11).count() == 0


def test_turning_point(spark):
    rows = [(1, m, x) for m, x in enumerate([0.0, -1.0, 0.0, -1.0, -2.0, -3.0, -2.0, -4.0])] + [(-1, m, float(m)) for m in range(6)]
    assert {r.side: r.turn for r in events.turning_point(spark.createDataFrame(rows, "side int, minute int, mean double")).collect()} == {1: 5, -1: None}


def test_longest_runs_and_means(spark):
    df = spark.createDataFrame([(1, d, float(x)) for d, x in enumerate([1, 2, -1, 0, -3, 4])], "g int, d int, x double")
    r = frames.longest_runs(df, "x", "d", ["g"]).first()
    assert (r.wins, r.losses) == (2, 3)
    m = bars.mean_by(spark.createDataFrame([(1, 2.0, 3.0), (1, 4.0, 9.0)], "d int, Open_Interest double, other double"), "d", ["openinterest"])
    assert m.columns == ["d", "Open_Interest"] and m.first()[1] == 3.0


def test_signals_default_where_missing(spark):
    b = spark.createDataFrame([(1,), (2,)], "ts int")
    s = spark.createDataFrame([(2, 0.7, True)], "ts int, score double, is_anomaly boolean")
    assert sorted(tuple(r) for r in features.with_signals(b, s, {"score": 0.0, "is_anomaly": False}).collect()) == [(1, 0.0, False), (2, 0.7, True)]


def test_compound_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 0, 0.1), (1, 1, -0.05), (1, 2, 0.02)], "g int, d int, r double")
    m = strategy.compound_metrics(df, ["g"], "r", "d", 3).first()
    total = 1.1 * 0.95 * 1.02 - 1
    assert m.total == pytest.approx(total) and m.annual == pytest.approx(total) and m.max_drawdown == pytest.approx(-0.05) and m.calmar == pytest.approx(total / 0.05)
    assert m.pl_ratio == pytest.approx(0.06 / 0.05) and m.sortino == pytest.approx(total / (0.05 / math.sqrt(3) * math.sqrt(3)))


def test_smooth_moves_by_steps(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate([1.0, 1.0, -1.0])], "g int, i int, t double")
    assert values(strategy.smooth(df, "t", 0.5, "i", ["g"]), "pos", "i") == [0.5, 1.0, 0.5]


def test_slippage_beyond_depth(spark):
    o = spark.createDataFrame([("a", at(), 10.0)], "key string, ts timestamp_ntz, qty double")
    b = spark.createDataFrame([(at(), 1, 100.0, 2.0, 99.0), (at(), 2, 101.0, 3.0, 99.0)], "ts timestamp_ntz, level int, price double, size double, mid double")
    r = strategy.slippage(o, b).first()
    assert r.filled == 5 and r.vwap == pytest.approx(100.6)


def test_breakout_skips_to_after_exit(spark):
    close = [100, 101, 102, 104, 104, 104, 90]
    rows = [(dt.date(2024, 1, 2), i, float(c), 0.0 if i == 0 else c / close[i - 1] - 1, i in (0, 1, 2)) for i, c in enumerate(close)]
    df = spark.createDataFrame(rows, "day date, i int, close double, ret double, flag boolean")
    (r,) = strategy.breakout(df, 0.02, 3, 2, 2.0, 0.002).collect()  # 102 is at the trigger; returns from its own row on count
    assert (r.entry, r.exit, r.side) == (2, 4, 1) and r.pnl == pytest.approx(2 * (102 / 101 - 1 + 104 / 102 - 1) - 0.004)


def test_golden_p_values(spark):
    r, n = np.array([-0.23307852321731748, -0.18010865419755287, 0.01795747692076536]), np.array([601, 1017, 580])
    p = special.t_two_sided(r * np.sqrt((n - 2) / (1 - r * r)), n - 2)
    assert p == pytest.approx([7.38555175434745e-09, 7.292628375777024e-09, 0.666050234171563], rel=1e-9)
    df = spark.createDataFrame([(231, 457), (293, 580), (0, 0)], "k int, n int").select(special.binomial_p(F.col("k"), F.col("n")).alias("p"))
    got = [x.p for x in df.collect()]
    assert got[:2] == pytest.approx([0.8515986334963409, 0.8355529533810061], rel=1e-9) and got[2] is None


def test_tail_functions_known_values():
    assert special.gamma_upper(np.array([1.0]), np.array([2.0]))[0] == pytest.approx(math.exp(-2))
    assert special.f_upper([1.0], [2], [2])[0] == pytest.approx(0.5)


def test_anova_matches_numpy(spark):
    groups = [[1.0, 2.0, 3.0], [2.0, 4.0, 6.0], [9.0, 8.0, 7.0]]
    df = spark.createDataFrame([(g, x) for g, xs in enumerate(groups) for x in xs], "g int, x double")
    allx = np.concatenate(groups)
    between = sum(len(g) * (np.mean(g) - allx.mean()) ** 2 for g in groups)
    within = sum(((np.array(g) - np.mean(g)) ** 2).sum() for g in groups)
    assert stats.anova(df, "g", "x").first().f == pytest.approx(between / 2 / (within / 6))


def test_resampling_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i * i % 11)) for i in range(60)], "d int, x double, y double")
    a, b = (sorted(r.value for r in resample.replicate(df.repartition(p), ["x", "y"], "d", 40, resample.permuted_r, parts=p).collect()) for p in (2, 5))
    assert a == b


def test_walk_forward_ties_go_to_the_first(spark):
    rows = [(p, dt.date(2024, 1, 1) + dt.timedelta(i), 0.01 * (i % 3), 0.0) for p in (1, 0) for i in range(20)]
    paths = spark.createDataFrame(rows, "param int, d date, strat double, hold double")
    chosen = walkforward.select(paths, walkforward.rounds(spark, "2024-01-11", 5, 5, 2))
    assert sorted((r["round"], r.param, r.n_test) for r in chosen.collect()) == [(0, 0, 5), (1, 0, 5)]


def test_lstm_layer_by_hand():
    w = {"input": np.zeros((4, 1)), "hidden": np.zeros((4, 1)), "bias": np.zeros(4)}
    w["input"][2, 0] = 1.0
    out = models.lstm_layer(np.ones((1, 2, 1)), w)
    c1 = 0.5 * math.tanh(1)
    c2 = 0.5 * c1 + 0.5 * math.tanh(1)
    assert out[0, :, 0] == pytest.approx([0.5 * math.tanh(c1), 0.5 * math.tanh(c2)])


def test_hmm_likelihood_rises():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 1, 100) for m in (-4, 0, 4, -4)])[:, None]
    post, mean, seen = hmm.fit(x, 3, 20)
    assert all(b >= a - 1e-6 for a, b in zip(seen, seen[1:])) and (np.diff(mean[:, 0]) > 0).all()
    assert (post[10:90].argmax(1) == 0).mean() > 0.95


def test_granger_finds_the_cause(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    y = np.concatenate([[0], 0.8 * x[:-1]]) + 0.3 * rng.normal(size=300)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "d int, x double, y double")
    assert lagged.granger(df, "x", "y", "d", 2).filter("lag = 1").first().p_f < 1e-10
    # x is independent of y's past, but one sample may look otherwise (this one has p = 0.0009): hold the statistic against plain least squares
    own = np.column_stack([np.ones(299), x[:-1]])
    left = [float(((x[1:] - m @ np.linalg.lstsq(m, x[1:], rcond=None)[0]) ** 2).sum()) for m in (own, np.column_stack([own, y[:-1]]))]
    assert lagged.granger(df, "y", "x", "d", 1).first().f == pytest.approx((left[0] - left[1]) / (left[1] / 296))


def test_adf_tells_walks_from_noise(spark):
    rng = np.random.default_rng(2)
    e = rng.normal(size=400)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(e, np.cumsum(e)))], "d int, noise double, walk double")
    assert lagged.adf(df, "noise", "d").first().below_1 and not lagged.adf(df, "walk", "d").first().below_5


def test_scaler_uses_population_deviation(spark):
    df = series(spark, [1, 3], "x")
    assert values(features.scale(df, ["x"], features.fit_scaler(df, ["x"])), "x") == [-1.0, 1.0]


def test_keep_one_is_deterministic(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (2, 1, "c")], "k int, o int, v string")
    assert sorted(r.v for r in bars.keep_one(df, ["k"], [F.asc("o"), F.asc("v")]).collect()) == ["a", "c"]
