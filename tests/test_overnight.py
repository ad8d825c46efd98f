"""Returns over nights, on two days by hand, and the rules that use them."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, frames, strategy

D = [dt.date(2024, 1, 2), dt.date(2024, 1, 3), dt.date(2024, 1, 5)]


def bars(spark, closes):
    """closes by day -> (day, ts, close, aux_close, ...) rows a minute apart."""
    rows = [(d, dt.datetime(d.year, d.month, d.day, 10, k), float(c), None if k % 3 == 2 else 10.0 + k, 0.5, 3, 2.0) for d, day in zip(D, closes, strict=False) for k, c in enumerate(day)]
    return spark.createDataFrame(rows, "day date, ts timestamp_ntz, close double, aux_close double, trade_imbalance double, trade_count long, avg_trade_size double")


def test_the_first_return_of_a_day_is_from_the_last_close_before(spark):
    df = bars(spark, [[100, 110], [121, 121, 0], [50, 60]])
    got = [r.r for r in frames.returns(df, {"r": "close"}, "ts", "day").orderBy("ts").collect()]
    assert got == pytest.approx([0, 0.1, 0.1, 0, -1, 0, 0.2])  # 50 after 0 is unknown, hence 0
    held = [r.r for r in frames.returns(df, {"r": "close"}, "ts", "day", partition_by_day=True).orderBy("ts").collect()]
    assert held == pytest.approx([0, 0.1, 0, 0, -1, 0, 0.2])
    assert frames.returns(df.limit(0), {"r": "close"}, "ts", "day").count() == 0


def test_features_carry_the_night_and_the_flag_leaves_it_out(spark):
    df = bars(spark, [[100, 110], [121, 121], [242]])
    rows = features.minute_features(df).orderBy("ts").collect()
    assert [r.ret for r in rows] == pytest.approx([0, 0.1, 0.1, 0, 1.0]) and [r.aux_ret for r in rows] == pytest.approx([0, 0.1, 10 / 11 - 1, 0.1, 10 / 11 - 1])
    assert rows[2].vol20 == 0 and rows[3].vol20 == pytest.approx(np.std([0.1, 0], ddof=1))
    apart = features.minute_features(df, partition_by_day=True).orderBy("ts").collect()
    assert [r.ret for r in apart] == pytest.approx([0, 0.1, 0, 0, 0])


def test_stops_see_the_jump(spark):
    df = frames.returns(bars(spark, [[100, 100], [40, 40]]), {"ret": "close"}, "ts", "day").withColumn("i", F.minute("ts"))
    got = {r.day: r for r in strategy.stops(df, 2.0, 1.0, 0.5).collect()}
    assert got[D[0]].stop_loss == 0 and got[D[1]].stop_loss == pytest.approx(-0.6)


def test_leverage_by_forecast_volatility(spark):
    rng = np.random.default_rng(2)
    days = [(dt.date(2024, 1, 1) + dt.timedelta(k), int(rng.choice([-1, 1])), float(rng.uniform(0, 2)), float(rng.normal(0, 0.1)), float(rng.uniform(0.01, 0.05)) if k != 9 else 0.0) for k in range(20)]
    df = spark.createDataFrame(days, "day date, dir int, strength double, ret double, sd double")
    for twice in (True, False):
        got = {(r.rule, r.most, r.day): (r.lev, r.pnl) for r in strategy.vol_sizing(df, [2.5, 4.0], signed_twice=twice).collect()}
        kept = [(d, prev, np.mean([x[4] for x in days[k - 5 : k]])) for k, (d, prev) in enumerate(zip(days, [None, *[x[4] for x in days]][:20], strict=True)) if k >= 5]
        goal = 2 * np.median([d[4] for d, *_ in kept])
        want = {}
        for (day, side, strength, ret, _), prev, mean in kept:
            for most in (2.5, 4.0):
                for rule, vol, b in (("prev", prev, 1), ("mean", mean, 1), ("boost", mean, min(1.5, max(0.8, strength)))):
                    lev = min(most, max(0.5, goal / vol * b)) if vol > 0 else 2.0 * b
                    want[rule, most, day] = (lev, (ret if twice else side * ret) * lev - 0.002 * lev)
            want["fixed", 2.0, day] = (2.0, side * ret * 2 - 0.004)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_base_leverage_and_changes(spark):
    rows = [(1, i, 1.3 if i <= 30 else 3.0, -1.2) for i in range(1, 100)] + [(2, i, 2.1, 0.3) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "day int, i int, lev double, strength double").withColumn("base", strategy.base_leverage(F.col("strength")))
    assert {r.day: r.base for r in df.select("day", "base").distinct().collect()} == {1: 3.0, 2: 2.0}
    assert {r.day: r.changes for r in strategy.relevered(df, "lev", F.col("base")).collect()} == {1: 2, 2: 0}
