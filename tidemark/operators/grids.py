"""Whole parameter grids of daily strategies, by factors.

A combination of parameters is a set of components (a volatility ratio above its quantile, a funding sum, a sentiment band).
Each component's daily values (-1, 0, 1, or none) are made once, however many combinations use it, and packed as a row of bytes
by the number of the day. A combination joins the rows of its components, adds them up, is short a day after the sum reached
its threshold, and leaves sums of returns, squares, short days and turnover for each segment of days. Segments end where test
windows begin, so the training scores of every (round, combination) are running sums over a combination's few segments, and no
day is read twice. The plan does not grow with the grid: combinations are rows.

Values that hold with a threshold of their number make an AND of flags (-1 each).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scans

#: A series of days is a few thousand numbers, which every task gets; more than this is no daily series.
MOST_DAYS = 1 << 17
NONE = -128
_SUMS = ("total", "square", "excess", "excess_square", "hold", "turnover", "funding", "over")


class Line:
    """The days of a panel in order: their returns, funding rates and segments."""

    def __init__(self, panel: DataFrame, order: str, ret: str, rate: str | None, starts: list) -> None:
        """panel has a row for each day, numbered (n); starts: where segments begin, the first of them after segment 0."""
        rows = panel.select(order, ret, F.coalesce(rate, F.lit(0.0)) if rate else F.lit(0.0)).orderBy(order).limit(MOST_DAYS + 1).collect()
        if len(rows) > MOST_DAYS:
            raise ValueError(f"a daily series of more than {MOST_DAYS} rows")
        self.ret, self.rate = (np.array([r[k] for r in rows], float) for k in (1, 2))
        self.segment = np.searchsorted(np.array(starts, dtype="datetime64[D]"), np.array([r[0] for r in rows], dtype="datetime64[D]"), side="right")
        self.segments = len(starts) + 1


def numbered(panel: DataFrame, order: str = "d") -> DataFrame:
    """panel with n, each day's number from 0."""
    return scans.numbered(panel, order, scans.span_of(panel, order), "n")


def rolling_means(panel: DataFrame, x: str, lengths: list[int], total: bool = False, digits: int | None = None) -> DataFrame:
    """n, length, m: means (or sums) of x over the last so many days, where they are all there; one pass for all lengths."""
    fn = F.sum if total else F.avg

    def columns(w) -> dict[str, Column]:
        made = {}
        for k in lengths:
            frame = w.rowsBetween(-(k - 1), 0)
            made[f"m_{k}"] = F.when(F.count(x).over(frame) == k, fn(x).over(frame))
        return made

    wide = scans.reach(panel.select("n", x), "n", scans.span_of(panel, "n"), max(lengths) - 1, 0, columns)
    value = (lambda c: F.round(c, digits)) if digits else F.col
    each = F.array(*[F.struct(F.lit(k).alias("length"), value(f"m_{k}").alias("m")) for k in lengths])
    return wide.select("n", F.explode(each).alias("x")).select("n", "x.*").filter("m IS NOT NULL")


def ratios(panel: DataFrame, x: str, short: list[int], long: list[int]) -> DataFrame:
    """s, l, n, ratio: short over long means, where both are there."""
    means = rolling_means(panel, x, sorted({*short, *long}))
    top = means.filter(F.col("length").isin(short)).select("n", F.col("length").alias("s"), F.col("m").alias("a"))
    bottom = means.filter(F.col("length").isin(long)).select(F.col("n").alias("__n"), F.col("length").alias("l"), F.col("m").alias("b"))
    both = top.join(bottom, (F.col("n") == F.col("__n")) & (F.col("s") < F.col("l")))
    return both.select("s", "l", "n", F.try_divide("a", "b").alias("ratio")).filter("ratio IS NOT NULL")


def at_levels(df: DataFrame, quantiles: str, levels: list[float]) -> DataFrame:
    """A row for each level, with q and its limit: infinite while there is no quantile."""
    each = F.array(*[F.struct(F.lit(q).alias("q"), F.coalesce(F.get(quantiles, F.lit(k)), F.lit(float("inf"))).alias("limit")) for k, q in enumerate(levels)])
    return df.withColumn("__x", F.explode(each)).select("*", "__x.*").drop("__x", quantiles)


def named(kind: str, *keys: str) -> Column:
    """The name of a component: its kind and parameters."""
    return F.concat_ws(":", F.lit(kind), *[F.col(k).cast("string") for k in keys])


def packed(rows: DataFrame, n_days: int) -> DataFrame:
    """rows (component, n, v) -> component, days: a byte for each day, NONE where the component has no value."""

    def one(table: pa.Table) -> pa.Table:
        days = np.full(n_days, NONE, np.int8)
        days[table.column("n").to_numpy()] = table.column("v").to_numpy()
        return pa.table({"component": table.column("component").slice(0, 1), "days": pa.array([days.tobytes()])})

    return rows.select("component", "n", F.col("v").cast("int").alias("v")).groupBy("component").applyInArrow(one, "component string, days binary")


def combinations(spark: SparkSession, rows: list[tuple[list[str], int]]) -> DataFrame:
    """param (their number, from 0), components, threshold: a row for each combination."""
    return spark.createDataFrame([(k, c, t) for k, (c, t) in enumerate(rows)], "param int, components array<string>, threshold int")


def evaluate(combos: DataFrame, components: DataFrame, line: Line, first: float = 0.0, fee: float = 0.0004, partitions: int = 32) -> DataFrame:
    """-> param, segment, n, short, changes, growth, drawdown and sums over the days of a segment that all components have.

    The position is `first` on the first such day, then -1 a day after the components' sum was at most -threshold, else 1.
    total and square are of net returns, excess and excess_square of their difference to holding; growth is the product of
    1 + net return, drawdown the deepest fall of their running sum within the segment; over counts positions beyond 1.
    """
    each = combos.withColumn("component", F.explode("components")).select("param", "threshold", F.size("components").alias("parts"), "component")
    joined = each.join(components, "component").groupBy("param", "threshold", "parts").agg(F.collect_list("days").alias("days"))
    ret, rate, segment, segments = line.ret, line.rate, line.segment, line.segments
    names = ("n", "short", "changes")
    schema = pa.schema([("param", pa.int32()), ("segment", pa.int32()), *((c, pa.int64()) for c in names), *((c, pa.float64()) for c in (*_SUMS, "growth", "drawdown"))])

    def one(days: list[bytes], threshold: int) -> dict[str, np.ndarray]:
        values = np.stack([np.frombuffer(x, np.int8) for x in days])
        at = np.flatnonzero((values != NONE).all(0))
        pos = np.empty(len(at))
        pos[:1] = first
        pos[1:] = np.where(values[:, at].sum(0, dtype=np.int64) <= -threshold, -1.0, 1.0)[:-1]
        turn = np.abs(np.diff(pos, prepend=pos[:1]))
        strat, hold = pos * ret[at] - turn * fee - pos * rate[at], ret[at] - rate[at]
        ends = np.searchsorted(segment[at], np.arange(segments + 1))
        n = np.diff(ends)
        sums = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[ends])
        by = [(int(a), int(b)) for a, b in zip(ends, ends[1:], strict=False)]
        out = {"n": n, "short": sums(pos < 0).astype(np.int64), "changes": sums(turn > 0).astype(np.int64)}
        out |= {k: sums(x) for k, x in zip(_SUMS, (strat, strat**2, strat - hold, (strat - hold) ** 2, hold, turn, pos * rate[at], np.abs(pos) > 1), strict=True)}
        out["growth"] = np.array([np.prod(1 + strat[a:b]) for a, b in by])
        paths = [np.cumsum(strat[a:b]) for a, b in by]
        out["drawdown"] = np.array([(p - np.maximum.accumulate(p)).min() if len(p) else 0.0 for p in paths])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200).to_pylist()
                made = [(r["param"], one(r["days"], r["threshold"])) for r in part if len(r["days"]) == r["parts"]]
                if made:
                    cols = [np.repeat(np.array([p for p, _ in made], np.int32), segments), np.tile(np.arange(segments, dtype=np.int32), len(made))]
                    cols += [np.concatenate([m[f.name] for _, m in made]).astype(f.type.to_pandas_dtype()) for f in list(schema)[2:]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=schema)

    sql = "param int, segment int, " + ", ".join(f"{c} long" for c in names) + ", " + ", ".join(f"{c} double" for c in (*_SUMS, "growth", "drawdown"))
    return joined.repartition(partitions, "param").mapInArrow(run, sql)


def ratio_score(n: Column, total: Column, square: Column, year: int = 365, ddof: int = 1) -> Column:
    """Mean over deviation, annualised, from sums; 0 without deviation."""
    mean = total / n
    squares = square - n * mean * mean
    sd = F.sqrt(F.greatest(squares, F.lit(0.0)) / (n - ddof))
    return F.when((n > ddof) & (squares > 1e-18), mean / F.when(sd > 0, sd) * F.sqrt(F.lit(float(year)))).otherwise(F.lit(0.0))


def walk_forward(moments: DataFrame, relative: bool = False, least: int = 30, short: float = 0.0, year: int = 365, rounds: int | None = None) -> DataFrame:
    """Moments by segment -> round, param, score, n_train, n_test, total, hold, test_score, growth: in each round the combination
    with the best score over all segments up to it, and its results on the next.

    Scores are of net returns (deviation of a sample) or, if relative, of their excess over holding (of a population);
    combinations need `least` training days and a share `short` of short ones. Of equal scores the lowest param wins. Days after the
    last of the rounds, if their number is given, are tested by none.
    """
    upto = W.partitionBy("param").orderBy("segment").rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy("param").orderBy("segment")
    x, xx = ("excess", "excess_square") if relative else ("total", "square")
    held = moments.select(
        "param", F.col("segment").alias("round"), *[F.sum(c).over(upto).alias(f"train_{c}") for c in ("n", "short", x, xx)],
        *[F.lead(c).over(after).alias(f"test_{c}") for c in ("n", "total", "square", "hold", "growth")],
    )
    score = F.round(ratio_score(F.col("train_n"), F.col(f"train_{x}"), F.col(f"train_{xx}"), year, 0 if relative else 1), 9)
    held = held.filter(F.col("test_n").isNotNull() & (F.col("train_n") >= least) & (F.col("train_short") >= short * F.col("train_n")))
    held = held if rounds is None else held.filter(F.col("round") < rounds)
    best = held.groupBy("round").agg(F.min(F.struct((-score).alias("less"), "param", "train_n", *[f"test_{c}" for c in ("n", "total", "square", "hold", "growth")])).alias("b"))
    return best.select(
        "round", "b.param", (-F.col("b.less")).alias("score"), F.col("b.train_n").alias("n_train"), F.col("b.test_n").alias("n_test"), F.col("b.test_total").alias("total"),
        F.col("b.test_hold").alias("hold"), ratio_score(F.col("b.test_n"), F.col("b.test_total"), F.col("b.test_square"), year).alias("test_score"), F.col("b.test_growth").alias("growth"),
    )


def quarters(first: str, n: int) -> list[str]:
    """n + 1 dates, three months apart: where n test windows begin, and the last of them ends."""
    start = np.datetime64(first, "M")
    return [str((start + 3 * k).astype("datetime64[D]")) for k in range(n + 1)]
