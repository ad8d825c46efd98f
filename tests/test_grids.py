"""Whole grids by components, against one strategy at a time."""

import datetime as dt

import numpy as np
import pytest

from tidemark.operators import grids
from tidemark.plans import grids as plans

START = dt.date(2020, 1, 1)
DAYS = 90
STARTS = ["2020-02-01", "2020-03-01", "2020-03-20"]


def made(spark, rate):
    rng = np.random.default_rng(6)
    ret, fund = rng.normal(0, 0.02, DAYS), rng.normal(0, 0.001, DAYS)
    panel = spark.createDataFrame([(START + dt.timedelta(k), float(ret[k]), float(fund[k])) for k in range(DAYS)], "d date, ret double, rate double").repartition(4)
    line = grids.Line(grids.numbered(panel), "d", "ret", "rate" if rate else None, STARTS)
    parts = {"a": {k: int(rng.integers(-1, 2)) for k in range(DAYS)}, "b": {k: int(rng.integers(-1, 1)) for k in range(20, DAYS)}, "c": {k: -1 for k in range(DAYS)}}
    rows = spark.createDataFrame([(c, k, v) for c, x in parts.items() for k, v in x.items()], "component string, n int, v int").repartition(3)
    combos = [(["a"], 1), (["a", "b"], 2), (["c"], 1), (["a", "b", "c"], 3), (["b"], 1), (["c"], 2)]
    return ret, fund if rate else np.zeros(DAYS), line, parts, rows, combos


def alone(ret, fund, parts, chosen, least, first):
    """Day numbers, positions, net returns and holding of one combination."""
    at = [k for k in range(DAYS) if all(k in parts[c] for c in chosen)]
    raw = [-1.0 if sum(parts[c][k] for c in chosen) <= -least else 1.0 for k in at]
    pos = [first, *raw[:-1]]
    turn = [0.0] + [abs(b - a) for a, b in zip(pos, pos[1:], strict=False)]
    return at, pos, turn, [p * ret[k] - t * 0.0004 - p * fund[k] for k, p, t in zip(at, pos, turn, strict=True)], [ret[k] - fund[k] for k in at]


@pytest.mark.parametrize("rate,first", [(True, 0.0), (False, 1.0)])
def test_moments_equal_each_strategy(spark, rate, first):
    ret, fund, line, parts, rows, combos = made(spark, rate)
    got = {(r.param, r.segment): r for r in grids.evaluate(grids.combinations(spark, combos), grids.packed(rows, DAYS), line, first, partitions=3).collect()}
    assert len(got) == len(combos) * 4
    ends = [np.datetime64(x) for x in STARTS]
    for p, (chosen, least) in enumerate(combos):
        at, pos, turn, strat, hold = alone(ret, fund, parts, chosen, least, first)
        for s in range(4):
            own = [i for i, k in enumerate(at) if sum(np.datetime64(START + dt.timedelta(k)) >= e for e in ends) == s]
            r, x, h = got[p, s], np.array([strat[i] for i in own]), np.array([hold[i] for i in own])
            assert (r.n, r.short, r.changes) == (len(own), sum(pos[i] < 0 for i in own), sum(turn[i] > 0 for i in own))
            assert (r.total, r.square, r.hold, r.growth) == pytest.approx((x.sum(), (x**2).sum(), h.sum(), np.prod(1 + x)))
            assert (r.excess, r.excess_square, r.turnover) == pytest.approx(((x - h).sum(), ((x - h) ** 2).sum(), sum(turn[i] for i in own)))
            path = np.cumsum(x)
            assert r.drawdown == pytest.approx((path - np.maximum.accumulate(path)).min())


@pytest.mark.parametrize("relative,short", [(False, 0.0), (True, 0.3)])
def test_walk_forward_takes_the_best_of_the_days_before(spark, relative, short):
    ret, fund, line, parts, rows, combos = made(spark, True)
    moments = grids.evaluate(grids.combinations(spark, combos), grids.packed(rows, DAYS), line, partitions=3)
    got = {r["round"]: r for r in grids.walk_forward(moments, relative, 15, short).collect()}
    for rnd in range(3):
        train_end, test_end = STARTS[rnd], STARTS[rnd + 1] if rnd < 2 else "2021-01-01"
        best = None
        for p, (chosen, least) in enumerate(combos):
            at, pos, _, strat, hold = alone(ret, fund, parts, chosen, least, 0.0)
            day = [str(START + dt.timedelta(k)) for k in at]
            x = np.array([s - (h if relative else 0) for s, h, d in zip(strat, hold, day, strict=True) if d < train_end])
            q = [v for v, d in zip(pos, day, strict=True) if d < train_end]
            if len(x) < 15 or sum(v < 0 for v in q) < short * len(q):
                continue
            sd = x.std(ddof=0 if relative else 1)
            score = round(x.mean() / sd * np.sqrt(365), 9) if sd > 1e-9 else 0.0
            test = np.array([s for s, d in zip(strat, day, strict=True) if train_end <= d < test_end])
            if best is None or score > best[0]:
                best = (score, p, len(x), len(test), test.sum(), np.prod(1 + test))
        r = got.get(rnd)
        assert (best is None) == (r is None)
        if best:
            assert (r.param, r.n_train, r.n_test) == best[1:4] and (r.score, r.total, r.growth) == pytest.approx((best[0], best[4], best[5]))


def test_sizes_of_the_published_grids():
    assert len(plans.signal_grid()) == 10_692 and plans.signal_grid()[0] == (["fr:5", "oi:5", "fg:20:70", "ma:10", "rv:3:21:0.75"], 2)
    size = lambda space: sum(x[0] < x[1] for x in __import__("itertools").product(*space))
    assert (size(plans.RATIO), size(plans.FIXED), size(plans.BOTH)) == (160, 528, 4200) and len(plans.ROUNDS) == 23


def test_plan_does_not_grow_with_the_grid(spark):
    _, _, line, _, rows, combos = made(spark, True)
    plan = lambda n: grids.evaluate(grids.combinations(spark, combos[:n]), grids.packed(rows, DAYS), line)._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert plan(2) == plan(6)


def test_a_daily_series_has_a_size(spark, monkeypatch):
    monkeypatch.setattr(grids, "MOST_DAYS", 10)
    with pytest.raises(ValueError):
        made(spark, True)
