"""Running values, order statistics and quantiles over spans, against plain passes over the same series."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import frames, orderstats, scans

DAY = dt.date(2020, 1, 1)


def series(spark, xs, keys=None):
    rows = [(None if keys is None else keys[i], DAY + dt.timedelta(i), None if x is None else float(x)) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "k string, d date, x double").repartition(5)


def got(df, c):
    return [r[c] for r in df.orderBy("d").collect()]


def month():
    return F.year("d") * 12 + F.month("d")


@pytest.fixture(scope="module")
def noisy():
    rng = np.random.default_rng(4)
    xs = [None if rng.random() < 0.15 else float(rng.integers(-4, 6)) / 10 for _ in range(400)]
    xs[:3], xs[95:200] = [None] * 3, [0.3] * 105  # a run over several months
    return xs


def test_running_values_equal_windows(spark, noisy):
    df, w = series(spark, noisy), W.orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    assert got(scans.running_sum(df, F.col("x"), "d", month(), "y"), "y") == pytest.approx(got(df.withColumn("y", F.sum("x").over(w)), "y"))
    assert got(scans.last_known(df, F.col("x"), "d", month(), "y"), "y") == got(df.withColumn("y", F.last("x", ignorenulls=True).over(w)), "y")
    assert got(scans.numbered(df, "d", month()), "n") == list(range(400))
    want, run = [], 0
    for x in noisy:
        run = run + 1 if x is not None and x > 0 else 0
        want.append(run)
    assert got(scans.streaks(df, F.col("x") > 0, "d", month()), "streak") == want and max(want) >= 105
    assert scans.streaks(df.limit(0), F.col("x") > 0, "d", month()).count() == 0


@pytest.mark.parametrize("compound", [False, True])
def test_drawdowns_and_scores(spark, noisy, compound):
    xs = [0.0 if x is None else x for x in noisy]
    df = series(spark, xs)
    path = np.cumprod(1 + np.array(xs)) if compound else np.cumsum(xs)
    peak = np.maximum.accumulate(path)
    assert got(scans.drawdowns(df, F.col("x"), "d", month(), compound), "drawdown") == pytest.approx(list(path / peak - 1 if compound else path - peak))
    far = [x + 1e6 if x is not None else None for x in noisy]
    z, seen = [], []
    for x in far:
        seen += [x] if x is not None else []
        sd = np.std(seen, ddof=1) if len(seen) > 1 else 0
        z.append(None if x is None or not sd else (x - np.mean(seen)) / sd)
    made = got(scans.zscores(series(spark, far), "x", "d", month()), "z")
    assert [v is None for v in made] == [v is None for v in z] and [v for v in made if v is not None] == pytest.approx([v for v in z if v is not None], rel=1e-6)


def test_keyed_series_do_not_meet(spark, noisy):
    keys = ["a" if i % 3 else "b" for i in range(400)]
    df = series(spark, noisy, keys)
    w = W.partitionBy("k").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    assert got(scans.running_sum(df, F.col("x"), "d", month(), "y", ["k"]), "y") == pytest.approx(got(df.withColumn("y", F.sum("x").over(w)), "y"))
    assert got(scans.numbered(df, "d", month(), "y", ["k"]), "y") == got(df.withColumn("y", F.row_number().over(W.partitionBy("k").orderBy("d")) - 1), "y")


@pytest.mark.parametrize("size", [4, 7, 4096])
def test_frames_reach_over_blocks(spark, noisy, size):
    df = series(spark, noisy)
    columns = lambda w: {"m": F.avg("x").over(w.rowsBetween(-9, 0)), "a": F.sum("x").over(w.rowsBetween(1, 5)), "l": F.lag("x", 9).over(w)}
    one, two = scans.reach(df, "d", month(), 9, 5, columns, size), df.withColumns(columns(W.orderBy("d")))
    assert one.columns == two.columns
    for c in ("m", "a", "l"):
        assert got(one, c) == pytest.approx(got(two, c), nan_ok=True)


def test_plans_have_no_unpartitioned_window_over_rows(spark, noisy):
    df = series(spark, noisy)
    for made in (scans.streaks(df, F.col("x") > 0, "d", month()), scans.drawdowns(df, F.col("x"), "d", month(), False), scans.reach(df, "d", month(), 3, 3, lambda w: {"y": F.lag("x").over(w)})):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        alone = [line for line in plan.splitlines() if "Window" in line and "], [d#" in line and "windowspecdefinition(d#" in line]
        assert not alone, alone


def plain_quantiles(xs, ps, prior, least):
    seen, out = [], []
    for x in xs:
        before = list(seen)
        seen += [x] if x is not None else []
        use = before if prior else seen
        out.append(None if len(use) < max(1, least) else list(np.quantile(use, ps)))
    return out


def same(a, b):
    return len(a) == len(b) and all((x is None) == (y is None) and (x is None or x == pytest.approx(y)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("prior,least", [(False, 1), (True, 1), (False, 30)])
def test_expanding_quantiles_in_one_task_and_over_spans(spark, noisy, prior, least, monkeypatch):
    ps = [0.2, 0.8, 1.0]
    inner = orderstats._spanned
    monkeypatch.setattr(orderstats, "_spanned", lambda *a: inner(*a, rows=25))  # about 16 buckets
    for xs in (noisy, [0.5] * 200, list(np.random.default_rng(1).normal(size=300)), [None] * 5 + [1.0, 2.0]):
        df, want = series(spark, xs), plain_quantiles(xs, ps, prior, least)
        assert same(got(orderstats.expanding_quantiles(df, "x", ps, "d", prior_only=prior, least=least), "quantiles"), want)
        assert same(got(orderstats.expanding_quantiles(df, "x", ps, "d", span=month(), prior_only=prior, least=least), "quantiles"), want)


def test_expanding_quantiles_of_keyed_series(spark, noisy):
    keys = ["a" if i % 3 else None for i in range(400)]
    df = series(spark, noisy, keys)
    for span in (None, month()):
        rows = orderstats.expanding_quantiles(df, "x", [0.6], "d", ["k"], span).orderBy("d").collect()
        for key in ("a", None):
            own = [r for r in rows if r.k == key]
            assert same([r.quantiles for r in own], plain_quantiles([r.x for r in own], [0.6], False, 1))


def test_expanding_ranks(spark, noisy):
    rng = np.random.default_rng(8)
    for xs in (noisy, list(rng.normal(size=300)), [1.0] * 100):
        seen, want = [], []
        for x in xs:
            seen += [x] if x is not None else []
            want.append(None if x is None else (sum(v < x for v in seen) + (sum(v == x for v in seen) + 1) / 2) / len(seen))
        made = got(orderstats.expanding_ranks(series(spark, xs), "x", "d", month(), rows=25), "rank_pct")
        assert same([None if v is None else [v] for v in made], [None if v is None else [v] for v in want])
    two = orderstats.expanding_ranks(series(spark, [3.0, 1.0, 2.0, 2.0], ["a", "b", "a", "b"]), "x", "d", month(), ["k"])
    assert got(two, "rank_pct") == [1.0, 1.0, 0.5, 1.0]


def test_a_minute_series_of_a_million_rows(spark):
    n = 1_000_000
    df = spark.range(n).select(F.col("id").alias("d"), (F.pmod(F.hash("id"), F.lit(100_003)) / 7.0).alias("x"))
    made = orderstats.expanding_quantiles(df, "x", [0.9], "d", span=F.floor(F.col("d") / 20_000))
    at = [19_999, 20_000, 500_123, 999_999]
    rows = {r.d: r for r in made.filter(F.col("d").isin(at)).collect()}
    xs = np.array([r.x for r in df.orderBy("d").select("x").collect()])
    assert all(rows[i].quantiles[0] == pytest.approx(np.quantile(xs[: i + 1], 0.9)) for i in at)
    ranks = orderstats.expanding_ranks(df, "x", "d", F.floor(F.col("d") / 20_000))
    for r in ranks.filter(F.col("d").isin(at)).collect():
        assert r.rank_pct == pytest.approx(((xs[: r.d + 1] < xs[r.d]).sum() + ((xs[: r.d + 1] == xs[r.d]).sum() + 1) / 2) / (r.d + 1))


def test_frames_use_the_spans(spark, noisy):
    df = series(spark, noisy)
    assert frames.drawdown is not None and got(frames.runs(df.withColumn("f", F.col("x") > 0), "f", "d", ["k"]), "streak") == got(scans.streaks(df, F.col("x") > 0, "d", month()), "streak")
