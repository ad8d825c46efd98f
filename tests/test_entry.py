import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A few of each module; all queries are compared by the driver.
NAMES = ["slope_change_bins", "ohlcv_15m_filled", "rolling_corr_min5", "expanding_quantile_prior", "asof_forward_5m", "ffill_left_join", "response_grid_metrics", "greedy_thinning", "anova_quintile", "rv_regime", "ts_sl_combo", "min_hold_positions", "feature_builder", "direction_features", "anomaly_backtest", "volatility_filter_variants", "annual_metrics", "overnight_grid", "residual_correlations", "walk_forward_ratio", "regime_and_funding_grid", "walk_forward_signals", "expanding_rank_pct", "breakout_days", "vol_sizing_pnl"]


def norm(v):
    if isinstance(v, float):
        return f"{v + 0.0:.6g}"
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    r = c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(df.columns) == sorted(names)
    own = sorted(tuple(norm(row[k]) for k in sorted(names)) for row in df.collect())
    other = sorted(tuple(norm(row[names.index(k)]) for k in sorted(names)) for row in r.fetchall())
    assert own == other


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_names_of_sql_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
