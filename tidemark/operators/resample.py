"""Permutation tests and bootstrap intervals: replicates are rows, each with its own seeded generator.

The sample is one array; replicates are dealt over partitions and each draws from its id, so results do not depend on
how they are dealt. The sample must be a series of events or days (it is collected and broadcast, within MOST rows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 1_000_000


def _sample(df: DataFrame, columns: list[str], order: str) -> np.ndarray:
    rows = df.na.drop(subset=columns).orderBy(order).select(*columns).limit(MOST + 1).toPandas()
    if len(rows) > MOST:
        raise ValueError(f"resampling takes at most {MOST} rows")
    return rows.to_numpy(float)


def replicate(df: DataFrame, columns: list[str], order: str, draws: int, statistic, seed: int = 42, parts: int = 8) -> DataFrame:
    """rep, value: statistic(sample, generator) for each replicate."""
    spark, sample = df.sparkSession, _sample(df, columns, order)
    shared = spark.sparkContext.broadcast(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"rep": b["id"], "value": [statistic(shared.value, np.random.default_rng([seed, int(i)])) for i in b["id"]]})

    return spark.range(0, draws, 1, parts).mapInPandas(run, "rep long, value double")


def _r(x: np.ndarray, y: np.ndarray) -> float:
    sx, sy = x.std(), y.std()
    return float(((x - x.mean()) * (y - y.mean())).mean() / (sx * sy)) if sx > 0 and sy > 0 else float("nan")


def permuted_r(s: np.ndarray, rng: np.random.Generator) -> float:
    return _r(s[:, 0], rng.permutation(s[:, 1]))


def paired_r(s: np.ndarray, rng: np.random.Generator) -> float:
    at = rng.integers(0, len(s), len(s))
    return _r(s[at, 0], s[at, 1])


def independent_r(s: np.ndarray, rng: np.random.Generator) -> float:
    """Both columns drawn on their own, which breaks the pairing: kept as a named control."""
    return _r(s[rng.integers(0, len(s), len(s)), 0], s[rng.integers(0, len(s), len(s)), 1])


def permuted_sharpe(s: np.ndarray, rng: np.random.Generator) -> float:
    """Columns position, return, cost: returns are permuted, positions and costs stay."""
    x = s[:, 0] * rng.permutation(s[:, 1]) - s[:, 2]
    return float(x.mean() / x.std() * np.sqrt(365)) if x.std() > 0 else 0.0


def permuted_mean(s: np.ndarray, rng: np.random.Generator) -> float:
    """Columns position, return, cost: the mean under permuted returns."""
    return float((s[:, 0] * rng.permutation(s[:, 1]) - s[:, 2]).mean())


def permuted_signal(s: np.ndarray, rng: np.random.Generator) -> float:
    """Columns position, return: the annual Sharpe ratio under permuted positions."""
    x = rng.permutation(s[:, 0]) * s[:, 1]
    return float(x.mean() / x.std() * np.sqrt(365)) if x.std() > 0 else 0.0


def permutation_p(reps: DataFrame, observed: float, two_sided: bool = True) -> DataFrame:
    """draws, beyond (replicates at least as large as what was observed, in size if two-sided), p."""
    beyond = F.abs("value") >= abs(observed) if two_sided else F.col("value") >= observed
    return reps.agg(F.count("value").alias("draws"), F.count_if(beyond).alias("beyond")).withColumn("p", F.col("beyond") / F.col("draws"))


def interval(reps: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    return reps.agg(F.count("value").alias("draws"), F.percentile("value", F.lit(low)).alias("low"), F.percentile("value", F.lit(high)).alias("high"))
