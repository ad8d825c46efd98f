"""Exact quantiles of groups, lagged regressions of many series, hidden Markov models by spans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import hmm, lagged, quantiles


def groups(spark, n=3000):
    rng = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in rng.standard_cauchy(n)] + [("tied", float(x)) for x in rng.integers(0, 3, 500)] + [(None, 5.0), ("none", None), ("none", float("nan")), ("two", 1.0), ("two", 4.0), ("same", 2.0)] + [("same", 2.0)] * 400
    return rows, spark.createDataFrame(rows, "g string, x double").repartition(6)


@pytest.mark.parametrize("accuracy", [20, 200, 10_000])
def test_exact_quantiles_whatever_the_sketch(spark, accuracy):
    rows, df = groups(spark)
    ps = [0.0, 0.05, 0.5, 0.925, 0.99, 1.0]
    got = {r.g: (r.n, r.quantiles) for r in quantiles.exact_quantiles(df, "x", ps, ["g"], accuracy).collect()}
    for g in ("hot", "tied", None, "none", "two", "same"):
        xs = [x for k, x in rows if k == g and x is not None and x == x]
        assert got[g][0] == len(xs) and (got[g][1] == pytest.approx(list(np.quantile(xs, ps))) if xs else got[g][1] is None)
    xs = [x for _, x in rows if x is not None and x == x]
    assert quantiles.exact_quantiles(df, F.abs("x"), [0.3], accuracy=accuracy).first().quantiles == pytest.approx([np.quantile(np.abs(xs), 0.3)])
    empty = quantiles.exact_quantiles(df.limit(0), "x", ps)
    assert [(r.n, r.quantiles) for r in empty.collect()] == [(0, None)] and quantiles.exact_quantiles(df.limit(0), "x", ps, ["g"]).count() == 0


def shuffled_rows(df):
    """Rows that the exchanges of the plan that ran wrote, at most by one of them."""

    def walk(p):
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(p.plan())
        own = [p.metrics().apply("shuffleRecordsWritten").value()] if kind == "ShuffleExchangeExec" else []
        return own + [n for k in range(p.children().size()) for n in walk(p.children().apply(k))]

    df.collect()
    return max(walk(df._jdf.queryExecution().executedPlan()))


def test_rows_of_large_groups_are_not_shuffled_to_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quantiles, "HOT", 400, raising=False)  # "hot", "tied" and "same" have more rows
    rows, df = groups(spark, 20_000)
    ps = [0.0, 0.5, 0.99]
    df.write.parquet(f"{tmp_path}/t")
    made = quantiles.exact_quantiles(spark.read.parquet(f"{tmp_path}/t"), "x", ps, ["g"], 200)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of a size that Spark does not broadcast
    try:
        assert shuffled_rows(made) < 3000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for r in made.collect():
        xs = [x for k, x in rows if k == r.g and x is not None and x == x]
        assert r.n == len(xs) and (r.quantiles == pytest.approx(list(np.quantile(xs, ps))) if xs else r.quantiles is None)


def test_no_task_holds_a_group(spark):
    df = spark.range(400_000).select(F.lit("one").alias("g"), (F.pmod(F.hash("id"), F.lit(10**9)) / 3.0).alias("x"))
    plan = quantiles.exact_quantiles(df, "x", [0.9], ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan.replace("percentile_approx(", "") and "collect_list(x" not in plan
    xs = np.array([r.x for r in df.select("x").collect()])
    assert quantiles.exact_quantiles(df, "x", [0.9], ["g"]).first().quantiles == pytest.approx([np.quantile(xs, 0.9)])


def panel(spark, far=0.0):
    rng = np.random.default_rng(1)
    rows = []
    for g, n in (("a", 300), (None, 180), ("short", 4)):
        x = rng.normal(size=n)
        y = np.concatenate([[0], 0.5 * x[:-1]]) + rng.normal(size=n)
        rows += [(g, i, float(a) + far, float(b) + far) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    rows += [("a", 1000, None, 1.0)]
    return rows, spark.createDataFrame(rows, "g string, d int, x double, y double").repartition(5)


def rss(m, t):
    gap = t - m @ np.linalg.lstsq(m, t, rcond=None)[0]
    return float(gap @ gap)


@pytest.mark.parametrize("far", [0.0, 1e5])
def test_granger_of_keyed_series_equals_least_squares(spark, far):
    rows, df = panel(spark, far)
    got = lagged.granger(df, "x", "y", "d", 3, ["g"]).collect()
    for g in ("a", None):
        x, y = (np.array([r[k] for r in rows if r[0] == g and r[2] is not None]) for k in (2, 3))
        own_rows = sorted((r for r in got if r.g == g), key=lambda r: r.lag)
        assert len(own_rows) == 3
        for r in own_rows:
            k, n = r.lag, len(y) - r.lag
            own = np.column_stack([np.ones(n), *[y[k - j : len(y) - j] for j in range(1, k + 1)]])
            both = np.column_stack([own, *[x[k - j : len(x) - j] for j in range(1, k + 1)]])
            small, large, t = rss(own, y[k:]), rss(both, y[k:]), y[k:]
            assert r.n == n and r.f == pytest.approx((small - large) / k / (large / (n - 2 * k - 1)), rel=1e-5)
            assert (r.chi2, r.lr, r.gain) == pytest.approx((n * (small - large) / large, n * np.log(small / large), (small - large) / ((t - t.mean()) ** 2).sum()), rel=1e-5)
        assert [r.lag for r in own_rows if r.best] == [min(own_rows, key=lambda r: r.p_f).lag]
    assert not [r for r in got if r.g == "short" and r.lag > 1]
    one = lagged.granger(df.filter("g = 'a'"), "x", "y", "d", 3)
    assert {r.lag: r.f for r in one.collect()} == pytest.approx({r.lag: r.f for r in got if r.g == "a"})
    assert lagged.granger(df.limit(0), "x", "y", "d", 2).count() == 0


def test_unit_roots_of_keyed_series(spark):
    rng = np.random.default_rng(2)
    e = rng.normal(size=400)
    rows = [("noise", i, float(x)) for i, x in enumerate(e)] + [("walk", i, float(x)) for i, x in enumerate(np.cumsum(e))] + [("short", 0, 1.0)]
    got = {r.g: r for r in lagged.adf(spark.createDataFrame(rows, "g string, d int, x double"), "x", "d", ["g"]).collect()}
    assert got["noise"].below_1 and got["noise"].p < 0.001 and not got["walk"].below_5 and got["walk"].p > 0.1
    v = np.cumsum(e)
    d, k = np.diff(v), got["walk"].lags
    m = np.column_stack([np.ones(len(d) - k), v[k:-1], *[d[k - j : len(d) - j] for j in range(1, k + 1)]])
    b, n = np.linalg.lstsq(m, d[k:], rcond=None)[0], len(d) - k
    se = np.sqrt(np.linalg.inv(m.T @ m)[1, 1] * rss(m, d[k:]) / (n - k - 2))
    assert got["walk"].n == n and got["walk"].stat == pytest.approx(b[1] / se)
    # published points of the distribution: 1, 5 and 10 per cent at these statistics
    assert [round(lagged._p_of_tau(t), 2) for t in (-3.43, -2.86, -2.57)] == [0.01, 0.05, 0.1] and lagged._p_of_tau(3) == 1 and lagged._p_of_tau(-20) == 0


def test_order_of_vector_autoregressions(spark):
    rng = np.random.default_rng(5)
    v = np.zeros((600, 2))
    for t in range(2, 600):
        v[t] = 0.5 * v[t - 1] + np.array([[0, 0.3], [0.2, -0.4]]) @ v[t - 2] + rng.normal(size=2)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(v)]
    got = sorted(lagged.var_order(spark.createDataFrame(rows, "d int, a double, b double"), ["a", "b"], "d", 5).collect(), key=lambda r: r.lag)
    assert [r.lag for r in got if r.best_bic] == [2]
    for r in got:
        x = np.column_stack([np.ones(595), *[v[5 - j : 600 - j] for j in range(1, r.lag + 1)]])
        gap = v[5:] - x @ np.linalg.lstsq(x, v[5:], rcond=None)[0]
        assert r.aic == pytest.approx(np.linalg.slogdet(gap.T @ gap / 595)[1] + 2 * (r.lag * 4 + 2) / 595)


def plain_likelihood(x, q):
    logs = -0.5 * (((x[:, None] - q.mean) ** 2 / q.var) + np.log(2 * np.pi * q.var)).sum(2)
    a = np.log(q.start) + logs[0]
    for row in logs[1:]:
        a = np.logaddexp.reduce(a[:, None] + np.log(q.move), 0) + row
    return np.logaddexp.reduce(a)


def chain(n=400):
    rng = np.random.default_rng(7)
    s = np.cumsum(rng.random(n) < 0.05) % 3
    return np.column_stack([rng.normal(np.array([-2.0, 0, 2.0])[s], 0.7), rng.normal(0, 1 + s)])


def test_messages_over_spans_equal_one_pass(spark):
    x = chain()
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "d int, a double, b double").repartition(5)
    q = hmm.initial(x, 3)
    post, _ = hmm._span_posteriors(x, q, q.start, np.ones(3), True)
    rows = hmm.scan_posteriors(df, ["a", "b"], "d", F.floor(F.col("d") / 37), q).orderBy("d").collect()
    assert np.allclose([r.posterior for r in rows], post[:, np.argsort(q.mean[:, 0])])
    end, seen = hmm.scan_fit(df, ["a", "b"], "d", F.floor(F.col("d") / 37), q, 4)
    _, mean, plain = hmm.fit(x, 3, 4)
    assert seen == pytest.approx(plain) and np.allclose(np.sort(end.mean[:, 0]), mean[:, 0])
    assert seen[0] == pytest.approx(plain_likelihood(x, q)) and all(b >= a for a, b in zip(seen, seen[1:], strict=False))


def test_keyed_models_do_not_meet(spark):
    x = chain()
    rows = [("one", i, float(a)) for i, a in enumerate(x[:200, 0])] + [(None, i, float(a)) for i, a in enumerate(x[200:, 0])] + [("short", 0, 1.0), ("one", 500, None)]
    got = hmm.states(spark.createDataFrame(rows, "g string, d int, x double").repartition(4), ["x"], "d", ["g"], 3, 10).collect()
    for g, part in (("one", x[:200, :1]), (None, x[200:, :1])):
        post, _, seen = hmm.fit((part - part.mean(0)) / part.std(0), 3, 10)
        own = sorted((r for r in got if r.g == g), key=lambda r: r.d)
        assert np.allclose([r.posterior for r in own], post) and own[0].log_likelihood == pytest.approx(seen[-1])
    assert len(got) == 400
