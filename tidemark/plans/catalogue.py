"""The query catalogue: every name with its Spark query, and its DuckDB text where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import backtests, eventstudies, grids, modelling, reports, research, scans, series, tests

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (scans, series, eventstudies, tests, backtests, grids, modelling, research, reports):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
