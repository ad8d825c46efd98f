"""Feature building, scaling, splits, thresholds and the merging of model signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import blocks, change, over, returns, rolling, rolling_corr
from .quantiles import exact_quantiles
from .scans import numbered, span_of

FEATURES = ("ret", "trade_imbalance", "trade_count", "avg_trade_size", "aux_ret", "vol20", "corr20")


def minute_features(bars: DataFrame, partition_by_day: bool = False) -> DataFrame:
    """(day, ts, close, aux_close, ...) bars -> the seven features; nulls become 0. Returns run on over the nights, unless
    partition_by_day; deviation and correlation stay within a day.
    """
    w = over("ts", ["day"])
    held = returns(bars, {"ret": "close", "aux_ret": "aux_close"}, "ts", "day", partition_by_day)
    held = held.withColumn("vol20", F.coalesce(rolling(F.stddev_samp, F.col("ret"), 20, w, 2), F.lit(0.0)))
    return held.withColumn("corr20", F.coalesce(rolling_corr(F.col("ret"), F.col("aux_ret"), 20, w, 5), F.lit(0.0))).select("day", "ts", *FEATURES)


DIRECTION = (
    "anomaly_score", "trade_imbalance", "trade_count", "avg_trade_size", "ret_1", "ret_5", "ret_15", "vol_15", "momentum_15", "aux_ret", "aux_vol20", "aux_corr20", "from_open",
)


def direction_features(bars: DataFrame, signals: DataFrame, horizon: int = 15) -> DataFrame:
    """(day, ts, close, aux_close, ...) bars and (ts, anomaly_score, is_anomaly) -> the thirteen features of the anomalous rows that
    have a price `horizon` rows later, and label: whether it is higher. Unknown features are 0.

    Returns, deviation and momentum look back over rows of earlier days too, the label over those of later ones; deviation
    and correlation of the second instrument stay within the day.
    """
    w, d = W.partitionBy("block").orderBy("n"), over("ts", ["day"])
    one = F.col("ret_1")
    held = blocks(bars, "ts", "day", 16, horizon).withColumns({f"ret_{k}": change(F.col("close"), k, w) for k in (1, 5, 15)} | {"aux_ret": F.coalesce(change(F.col("aux_close"), 1, w), F.lit(0.0))})
    held = held.withColumns({"vol_15": rolling(F.stddev_samp, one, 15, w), "momentum_15": rolling(F.avg, one, 15, w), "later": F.lead("close", horizon).over(w)}).filter("own")
    held = held.withColumn("aux_vol20", rolling(F.stddev_samp, F.col("aux_ret"), 20, d, 1)).withColumn("aux_corr20", rolling_corr(F.col("aux_ret"), one, 20, d, 5))
    held = held.withColumn("from_open", F.hour("ts") * 60 + F.minute("ts") - 570)
    flagged = held.join(signals.filter("is_anomaly").select("ts", "anomaly_score"), "ts").filter("later IS NOT NULL")
    return flagged.select("day", "ts", *[F.coalesce(c, F.lit(0)).alias(c) for c in DIRECTION], (F.col("later") / F.col("close") - 1 > 0).cast("int").alias("label"))


def with_signals(bars: DataFrame, signals: DataFrame, defaults: dict, key: str = "ts") -> DataFrame:
    """bars with the signals' columns joined on the key; where there is none, the defaults."""
    held = bars.join(signals.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in defaults]), F.col(key) == F.col("__k"), "left")
    return held.withColumns({c: F.coalesce(f"__{c}", F.lit(x)) for c, x in defaults.items()}).drop("__k", *[f"__{c}" for c in defaults])


def fit_scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and population deviation of each column (1 where it is constant)."""
    return df.agg(*[f(c).alias(f"{c}__{n}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])


def scale(df: DataFrame, columns: list[str], scaler: DataFrame) -> DataFrame:
    """df with the columns scaled by a frozen scaler; its one row is broadcast."""
    held = df.crossJoin(F.broadcast(scaler))
    scaled = {c: (F.col(c) - F.col(f"{c}__mean")) / F.when(F.col(f"{c}__sd") > 0, F.col(f"{c}__sd")).otherwise(1.0) for c in columns}
    return held.withColumns(scaled).select(*df.columns)


def chronological_split(df: DataFrame, order: str, share: float = 0.8) -> DataFrame:
    """df with is_train for the first share of rows in time order, numbered by spans of it; the count is one broadcast row."""
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    held = numbered(df, order, span_of(df, order), "__k").crossJoin(F.broadcast(n))
    return held.withColumn("is_train", F.col("__k") < F.floor(F.col("__n") * share)).drop("__k", "__n")


def flag_above(df: DataFrame, score: str, q: float, by: list[str], multiplier: float = 1.0) -> DataFrame:
    """df with threshold (an exact quantile of the group's scores times a multiplier), is_anomaly and norm = score / q99 in [0, 1].
    A group may be of any size.
    """
    return flag_all(df, score, q, by, [multiplier]).drop("multiplier")


def flag_all(df: DataFrame, score: str, q: float, by: list[str], multipliers: list[float]) -> DataFrame:
    """flag_above for several multipliers: a row for each, quantiles and rows read once."""
    one = exact_quantiles(df, score, [q, 0.99], by)
    each = F.explode(F.array(*map(F.lit, multipliers))).alias("multiplier")
    named = one.select(*[F.col(c).alias(f"__{c}") for c in by], F.get("quantiles", F.lit(0)).alias("__q"), F.get("quantiles", F.lit(1)).alias("__q99"), each)
    named = named.withColumn("threshold", F.col("__q") * F.col("multiplier")).drop("__q")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    held = df.join(named, same) if by else df.crossJoin(F.broadcast(named))
    norm = F.least(F.greatest(F.try_divide(score, "__q99"), F.lit(0.0)), F.lit(1.0))
    return held.withColumn("is_anomaly", F.col(score) > F.col("threshold")).withColumn("norm", norm).drop("__q99", *[f"__{c}" for c in by])


def merge_models(signals: list[tuple[str, DataFrame]], key: str = "ts") -> DataFrame:
    """Signals of several models, one a key: the model named first wins."""
    both = None
    for rank, (name, df) in enumerate(signals):
        one = df.withColumn("model", F.lit(name)).withColumn("__rank", F.lit(rank))
        both = one if both is None else both.unionByName(one)
    w = W.partitionBy(key).orderBy("__rank")
    return both.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__rank")


def episodes(df: DataFrame, flag: str, order: str, part: list[str]) -> DataFrame:
    """part, start, rows of each run of flagged rows."""
    w = over(order, part)
    held = df.withColumn("__f", F.coalesce(F.col(flag), F.lit(False)).cast("int"))
    held = held.withColumn("__g", F.sum(1 - F.col("__f")).over(w.rowsBetween(W.unboundedPreceding, 0))).filter("__f = 1")
    return held.groupBy(*part, "__g").agg(F.min(order).alias("start"), F.count(F.lit(1)).alias("rows")).drop("__g")


def forward_window_sum(df: DataFrame, x: str, h: int, order: str, day: str) -> DataFrame:
    """Sum of this row's and the next h - 1 values of the same day; null where the day ends first."""
    frame = over(order, [day]).rowsBetween(0, h - 1)
    return df.withColumn(f"fwd_{h}", F.when(F.count(F.lit(1)).over(frame) == h, F.sum(x).over(frame)))
