"""Walk-forward selection: every parameter's full path is evaluated once; rounds only aggregate over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .strategy import sharpe


def rounds(spark: SparkSession, first_test: str, test_days: int, step_days: int, n: int) -> DataFrame:
    """round, test_from, test_to: expanding training windows end where the test slices begin."""
    start, k = F.to_date(F.lit(first_test)), (F.col("id") * step_days).cast("int")
    return spark.range(n).select(F.col("id").cast("int").alias("round"), F.date_add(start, k).alias("test_from"), F.date_add(start, k + test_days).alias("test_to"))


def select(paths: DataFrame, windows: DataFrame, year: int = 365, embargo: int = 0, relative: bool = False, least: int = 1, short: float = 0.0) -> DataFrame:
    """paths (param, d, strat, hold), windows (round, test_from, test_to) -> the chosen parameter of each round.

    Columns: round, param, score (on training days), n_train, n_test, total, hold (on test days). The windows are a
    parameter's worth of rows and are broadcast; training scores and test results of all (round, param) come from one
    aggregation, so paths are read once. Ties go to the lowest param, the first in the grid. A parameter needs `least`
    training days, and, with a column pos, to be short on a share `short` of them; relative scores the difference to holding.
    """
    value = F.col("strat") - F.col("hold") if relative else F.col("strat")
    near = paths.join(F.broadcast(windows), F.col("d") < F.col("test_to"))
    train, test = F.col("d") < F.date_sub("test_from", embargo), F.col("d") >= F.col("test_from")
    both = near.groupBy("round", "param").agg(
        sharpe(F.when(train, value), year, 0 if relative else 1).alias("score"), F.count_if(train).alias("n_train"),
        (F.count_if(train & (F.col("pos") < 0)) if short else F.lit(0)).alias("n_short"),
        F.count_if(test).alias("n_test"), F.sum(F.when(test, F.col("strat"))).alias("total"), F.sum(F.when(test, F.col("hold"))).alias("hold"),
    )
    order = W.partitionBy("round").orderBy(F.desc(F.round("score", 9)), "param")
    both = both.filter((F.col("n_train") >= least) & (F.col("n_short") >= short * F.col("n_train"))).drop("n_short")
    return both.withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k")


def tested(paths: DataFrame, chosen: DataFrame, windows: DataFrame) -> DataFrame:
    """The daily rows of each round's test slice under its chosen parameter, side by side."""
    picked = chosen.select("round", "param").join(windows, "round").select("round", F.col("param").alias("__p"), "test_from", "test_to")
    rows = paths.join(F.broadcast(picked), (F.col("param") == F.col("__p")) & (F.col("d") >= F.col("test_from")) & (F.col("d") < F.col("test_to")))
    return rows.drop("__p", "test_from", "test_to")
