"""Reports: hand-made cases, and every query against its SQL."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F
from test_whole import equals_sql

from tidemark.functions import scalars
from tidemark.operators import reports
from tidemark.plans import reports as plans
from tidemark.sources import readers

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    equals_sql(spark, SF, name)


def test_horizons_after_costs(spark):
    rows = [(1, 1.0, 0.02), (1, -2.0, 0.01), (1, 3.0, 0.03), (1, 0.0, 0.05), (1, None, 0.5), (1, 2.0, None)]
    r = reports.horizon_report(spark.createDataFrame(rows, "minute int, signal double, ret double"), ["minute"], cost=0.01).first()
    assert (r.n, r.hit_pct, r.win_pct) == (4, 50.0, 50.0)
    assert math.isclose(r.gross, (0.02 - 0.01 + 0.03) / 4) and math.isclose(r.net, r.gross - 0.01) and math.isclose(r.cum_net, 0.0, abs_tol=1e-12)
    x, y = [1.0, -2.0, 3.0, 0.0], [0.02, 0.01, 0.03, 0.05]
    mx, my = sum(x) / 4, sum(y) / 4
    rr = sum((a - mx) * (b - my) for a, b in zip(x, y)) / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))
    # with two degrees of freedom the two-sided p of a correlation is 1 - |r|
    assert math.isclose(r.r, rr) and math.isclose(r.p, 1 - abs(rr), rel_tol=1e-9)


def test_response_table_keeps_by_first_or_any(spark):
    t = dt.datetime(2024, 1, 1, 10)
    bars = spark.createDataFrame([(t, 100.0), (t + dt.timedelta(minutes=5), 110.0), (t + dt.timedelta(hours=1), 50.0), (t + dt.timedelta(minutes=61), 55.0), (t + dt.timedelta(hours=3), 7.0)], "ts timestamp_ntz, close double")
    events = spark.createDataFrame([("a", t), ("b", t + dt.timedelta(hours=1)), ("c", t + dt.timedelta(hours=3)), ("d", t + dt.timedelta(hours=9))], "key string, ts timestamp_ntz")
    some = reports.response_table(events, bars, "close", {"one": 1, "five": 5})
    assert {r.key: (r.one and round(r.one, 9), r.five and round(r.five, 9)) for r in some.collect()} == {"a": (None, 0.1), "b": (0.1, None)}
    assert [r.key for r in reports.response_table(events, bars, "close", {"one": 1, "five": 5}, "one").collect()] == ["b"]


def test_dead_zone(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.9), (3, -0.2), (4, None), (5, -0.3), (6, 0.0)], "d int, x double")
    got = {m: [r.lev for r in reports.dead_zone(df, "x", m).orderBy("d").collect()] for m in ("none", "neutral", "hold")}
    assert got == {"none": [0.1, 0.9, -0.2, 0.0, -0.3, 0.0], "neutral": [0.0, 0.9, 0.0, 0.0, -0.3, 0.0], "hold": [0.0, 0.9, 0.9, 0.9, -0.3, -0.3]}
    with pytest.raises(ValueError):
        reports.dead_zone(df, "x", "other")


def test_cut_edges(spark):
    df = spark.createDataFrame([(0.0,), (20.0,), (20.1,), (40.0,), (41.0,), (None,)], "x double")
    of = lambda **k: [r[0] for r in df.select(scalars.cut(F.col("x"), [0.0, 20.0, 40.0], ["a", "b"], **k)).collect()]
    assert of() == [None, "a", "b", "b", None, None]
    assert of(include_lowest=True) == ["a", "a", "b", "b", None, None]
    assert of(right=False) == ["a", "b", "b", None, None, None]


def test_coverage_and_windows(spark):
    t = dt.datetime(2024, 1, 1)
    at = [t + dt.timedelta(minutes=k) for k in range(100) if k != 40] + [t + dt.timedelta(days=1, minutes=k) for k in range(0, 100, 2)]
    bars = spark.createDataFrame([(x, 1.0) for x in at], "ts timestamp_ntz, close double")
    found = {r.day.day: (r.n, round(r.missing_pct, 6)) for r in reports.coverage(bars, 1, 0, 100).collect()}
    assert found == {1: (99, 1.0), 2: (50, 50.0)}
    assert reports.complete_days(bars, 1, 5.0, 0, 100).count() == 99 and reports.complete_days(bars, 1, 1.0, 0, 100).count() == 0
    ends = sorted(r.ts for r in reports.whole_windows(bars, 1, 10).collect())
    assert ends == [t + dt.timedelta(minutes=k) for k in range(9, 100) if not 40 <= k < 50]


def test_sides_in_any_writing(spark):
    df = spark.createDataFrame([(1, " sell", 2.0), (1, "BUY ", 3.0), (1, "Sell", 4.0), (1, "other", 5.0), (1, None, 6.0)], "d int, side string, v double")
    assert reports.side_volumes(df, ["d"], "side", "v").first()[1:] == (6.0, 3.0)


def test_monthly_and_yearly(spark):
    d = dt.date
    df = spark.createDataFrame([(d(2024, 1, 5), 0.1, 0.1, 1), (d(2024, 1, 9), -0.5, 0.5, -1), (d(2024, 2, 1), None, 0.2, 0)], "d date, s double, h double, pos int")
    assert [(r.month, round(r.s, 6), round(r.h, 6)) for r in reports.monthly_table(df, ["s", "h"]).orderBy("month").collect()] == [(d(2024, 1, 1), -45.0, 65.0), (d(2024, 2, 1), 0.0, 20.0)]
    y = reports.yearly(df.na.fill(0.0, ["s"]), "s", "h", "pos").first()
    assert (y.year, y.n, round(y.total, 6), round(y.hold, 6), y.ahead, round(y.flat_pct, 4), round(y.exposure_pct, 4)) == (2024, 3, -0.45, 0.98, False, 33.3333, 66.6667)


def test_nested_document(spark, tmp_path):
    one = spark.createDataFrame([(7, None, 0.25)], "n int, clock string, r double")
    parts = {"axis": {"n": F.col("n"), "peak": {"clock": F.col("clock"), "r": F.col("r")}}, "total": F.col("n") + 1}
    readers.write_json(one.select(readers.nested(parts).alias("doc")).select("doc.*"), f"{tmp_path}/out")
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*.json"))
    assert json.loads(text) == {"axis": {"n": 7, "peak": {"clock": None, "r": 0.25}}, "total": 8}
