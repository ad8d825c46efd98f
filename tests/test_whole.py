"""Queries over every row: against brute force on small tables, and against their SQL."""

import datetime as dt

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import events, strategy
from tidemark.plans import backtests

T0 = dt.datetime(2024, 1, 2, 10)
STUDIES = ["response_grid", "response_grid_metrics", "horizon_table", "sigma_event_paths", "curve_summary", "sigma_threshold_grid"]


def events_table(folder, rows):
    """rows: (seconds after T0, value)."""
    n = len(rows)
    cols = {"event_id": list(range(n)), "ts": [T0 + dt.timedelta(seconds=s) for s, _ in rows], "user_id": [1] * n, "event_type": ["view"] * n, "value": [float(v) for _, v in rows]}
    pq.write_table(pa.table(cols, schema=pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64())])), f"{folder}/events.parquet")
    return str(folder)


def norm(v):
    return f"{v + 0.0:.6g}" if isinstance(v, float) else str(v)


def equals_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    r = c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    df = entry.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    own = sorted(tuple(norm(row[k]) for k in names) for row in df.collect())
    assert own and own == sorted(tuple(map(norm, row)) for row in r.fetchall())


def test_every_bar_with_a_signal_is_an_event(spark, tmp_path):
    rows = [(300 * k, 100 + k * k % 17) for k in range(60)] + [(86400 + 420 * k, 90 + k * k % 13) for k in range(13)]  # the second day has 6 bars
    sf = events_table(tmp_path, rows)
    minute, quarter = {}, {}
    for s, v in rows:
        minute[s // 60 * 60], quarter[s // 900 * 900] = v, v
    find = lambda at: next((minute[at + k] for k in range(0, 301, 60) if at + k in minute), None)
    want = set()
    for day in (0, 86400):
        held = [b for b in sorted(quarter) if b // 86400 * 86400 == day]
        for n, b in enumerate(held):
            base = find(b - 60)
            for m in (0, 1, 5, 15, 30, 60, 120) if n >= 4 else ():
                price = find(b + 60 * m)
                ret = None if price is None or base is None else round(price / base - 1, 6)
                want.add((f"{(T0 + dt.timedelta(seconds=b)).date()}-{n + 1}", m, ret))
    assert len({k for k, *_ in want}) == 20 - 4 + 6 - 4
    assert {(r["key"], r["minute"], r["ret"]) for r in entry.queries()["response_grid"](spark, sf).collect()} == want


@pytest.mark.parametrize("name", STUDIES)
def test_whole_study_equals_sql(spark, name):
    equals_sql(spark, "/root/testdata/sf0.001", name)


def test_every_tick_is_walked_through_the_book_of_its_ts(spark, tmp_path):
    rows = [(k // 40, 100 + k * k % 11) for k in range(110)]  # 40 ticks share a ts
    sf = events_table(tmp_path, rows)
    want = {}
    for key, (s, _) in enumerate(rows):
        left = qty = 3 * (1 + key % 7)
        paid = 0.0
        for _, price, size in sorted((level, v * (1 + 0.001 * level), 1 + (i + level) % 5) for i, (t, v) in enumerate(rows) if t == s for level in range(1, 11)):
            take = min(left, size)
            left, paid = left - take, paid + take * price
        want[key] = (qty - left, paid / (qty - left))
    got = {r["key"]: (r["filled"], r["vwap"]) for r in entry.queries()["lob_slippage"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_slippage_equals_sql(spark):
    equals_sql(spark, "/root/testdata/sf0.001", "lob_slippage")


@pytest.mark.parametrize("name", ["imbalance_modes", "funding_momentum", "fixed_funding_variants"])
def test_named_strategy_equals_sql(spark, name):
    equals_sql(spark, "/root/testdata/sf0.001", name)


def test_imbalance_rules_by_hand(spark):
    x = [5, 1, 9, 2, 8, 3, 7, 0, 6, 4]
    got = {(r["mode"], r["d"]): r["pos"] for r in strategy.imbalance_rules(spark.createDataFrame(list(enumerate(map(float, x))), "d int, x double"), "x", 2, 0.8, 0.2).collect()}
    s = [(a + b) / 2 for a, b in zip(x, x[1:])]
    want = {}
    for k in range(len(s)):
        seen = s[:k]
        up, down = (seen[-1] > np.percentile(seen, 80), seen[-1] < np.percentile(seen, 20)) if k else (False, False)
        want |= {("mean_reversion", k + 1): 0.0 if k == 0 else -1.0 if up else 1.0, ("momentum", k + 1): 0.0 if k == 0 else -1.0 if down else 1.0}
    assert got == want and -1.0 in want.values()


def test_fixed_variants_are_the_references():
    assert len(set(backtests.FIXED)) == len(backtests.FIXED) == 25


@pytest.mark.parametrize("gap", [0, 30])
def test_thinning_gathers_no_user_in_a_row(spark, gap):
    rng = np.random.default_rng(5)
    rows = [(None if u == 9 else u, int(s)) for u, n, span in ((1, 3000, 9000), (2, 300, 20000), (3, 40, 3000), (9, 50, 2000)) for s in rng.integers(-span, span, n)]
    df = events.thin(spark.createDataFrame([(u, T0 + dt.timedelta(seconds=s)) for u, s in rows], "u int, ts timestamp_ntz").repartition(7), gap, ["u"])
    want = []
    for u in {u for u, _ in rows}:
        last = None
        for s in sorted(s for v, s in rows if v == u):
            if last is None or s - last > gap:
                want.append((str(u), s))
                last = s
    assert sorted((str(r.u), int((r.ts - T0).total_seconds())) for r in df.collect()) == sorted(want)
    assert "collect_list" not in df._jdf.queryExecution().toString()


def test_thinning_keeps_events_without_a_time(spark):
    df = spark.createDataFrame([(1, None), (1, T0), (1, T0), (1, None)], "u int, ts timestamp_ntz")
    assert sorted(str(r.ts) for r in events.thin(df, 30, ["u"]).collect()) == [str(T0), "None", "None"]


def test_ratios_without_deviation_equal_sql(spark, tmp_path):
    # every trade is a buy: all bars are flagged at the lower thresholds, and each day nets the same
    sf = events_table(tmp_path, [(86400 * d + 900 * k, 100 + (d * k) % 7) for d in range(4) for k in range(12)])
    for t in ("orders", "lineitem"):
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    equals_sql(spark, sf, "anomaly_harness")
    found = {(r["multiplier"], r["mode"]): r["sharpe"] for r in entry.queries()["anomaly_harness"](spark, sf).collect()}
    assert found[0.5, "exit"] == float("-inf") and np.isnan(found[0.5, "filter"]) and np.isfinite(found[1.0, "baseline"])


def test_plain_ratio_of_one_or_equal_values(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 0.0), (2, 0.0), (3, -1.0), (3, -1.0), (4, 3.0), (4, 1.0)], "g int, r double")
    got = {r.g: (r.a, r.b) for r in df.groupBy("g").agg(strategy.sharpe(F.col("r"), 1, plain=True).alias("a"), strategy.sharpe(F.col("r"), 1, 0, True).alias("b")).collect()}
    assert got[1] == (None, float("inf")) and np.isnan(got[2]).all() and got[3] == (float("-inf"),) * 2 and got[4] == (pytest.approx(2 / 2**0.5), 2.0)
