"""Regressions on lagged values of many series at once: Granger causality, order of vector autoregressions, unit roots.

Lags are windows over each series. Every task sums the cross-moments of its rows, (1, values, lags) times itself, for each
series and each number of rows left out at the start; the sums are added by series, and what is solved is a few numbers wide.
Values are taken from their series' mean, which changes no slope, so that levels far from 0 lose no digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.special import p_of_chi2, p_of_f
from .scans import numbered, reach, span_of


def moments(df: DataFrame, columns: list[str], order: str, by: list[str], lags: int, skips: list[int]) -> DataFrame:
    """by, skip, n, gram: for each series the sums of (1, columns now, columns a row before, ...) times itself over its rows from
    number `skip` (at least as many as the lags used of it) on. Rows with a null are left out before they are numbered.
    """
    rows = df.na.drop(subset=columns)
    names = {k: f"__k{i}" for i, k in enumerate(by)}
    means = rows.groupBy(*by).agg(*[F.avg(c).alias(f"__m_{c}") for c in columns]).withColumnsRenamed(names)
    rows = rows.join(means, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]) if by else rows.crossJoin(F.broadcast(means))
    values = [(F.col(c) - F.col(f"__m_{c}")).cast("double") for c in columns]
    vector = lambda w: F.array(F.lit(1.0), *values, *[F.coalesce(F.lag(v, k).over(w), F.lit(0.0)) for k in range(1, lags + 1) for v in values])
    if by:
        w = W.partitionBy(*by).orderBy(order)
        held = rows.select(*by, (F.row_number().over(w) - 1).alias("_place"), vector(w).alias("_vector"))
    else:
        span = span_of(rows, order)
        held = reach(numbered(rows, order, span, "_place"), order, span, lags, 0, lambda w: {"_vector": vector(w)}).select("_place", "_vector")
    size, base = 1 + len(values) * (lags + 1), held.select(*by).limit(0).toArrow().schema
    schema = pa.schema([*base, pa.field("skip", pa.int32()), pa.field("n", pa.int64()), pa.field("part", pa.list_(pa.float64()))])
    sql = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in held.select(*by).schema.fields) + "skip int, n long, part array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t = batch.column("_place").to_numpy()
            v = batch.column("_vector").flatten().to_numpy().reshape(-1, size)
            keys = list(zip(*(batch.column(k).to_pylist() for k in by), strict=True)) if by else [()] * batch.num_rows
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            out = []
            for a, b in zip(edges, edges[1:], strict=False):
                for skip in skips:
                    own = v[a:b][t[a:b] >= skip]
                    if len(own):
                        out.append({**dict(zip(by, keys[a], strict=True)), "skip": skip, "n": len(own), "part": (own.T @ own).ravel()})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    parts = held.mapInArrow(run, sql)
    each = parts.select(*by, "skip", "n", F.posexplode("part").alias("i", "x"))
    sums = each.groupBy(*by, "skip", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return sums.groupBy(*by, "skip").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("gram"))


def _solved(df: DataFrame, by: list[str], fields: list[tuple[str, str]], solve: Callable[[dict[int, tuple[int, np.ndarray]]], list[dict]]) -> DataFrame:
    """solve({skip: (n, gram)}) -> rows, for each series."""
    base = df.select(*by).limit(0).toArrow().schema
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([*base, *(pa.field(n, kinds[t]) for n, t in fields)])
    sql = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*by).schema.fields) + ", ".join(f"{n} {t}" for n, t in fields)

    def one(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        size = int(round(len(rows[0]["gram"]) ** 0.5))
        key = {k: rows[0][k] for k in by}
        return pa.Table.from_pylist([key | r for r in solve({r["skip"]: (r["n"], np.array(r["gram"]).reshape(size, size)) for r in rows})], schema)

    return df.groupBy(*(by or [F.lit(0).alias("__one")])).applyInArrow(one, sql)


def _inverse(gram: np.ndarray) -> np.ndarray:
    """Of the moments of regressors, whatever units they come in."""
    unit = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    return np.linalg.pinv(gram / unit / unit[:, None], rcond=1e-12, hermitian=True) / unit / unit[:, None]


def _fit(gram: np.ndarray, x: list[int], y: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Slopes, residual sum of squares, and the inverse moments of the regressors."""
    inverse = _inverse(gram[np.ix_(x, x)])
    b = inverse @ gram[x, y]
    return b, max(float(gram[y, y] - 2 * b @ gram[x, y] + b @ gram[np.ix_(x, x)] @ b), 0.0), inverse


def granger(df: DataFrame, cause: str, effect: str, order: str, most: int = 10, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """by, lag, n, f, p_f, chi2, p_chi2, lr, p_lr, gain in R squared, best: does the past of cause help to explain effect. best marks
    the lag with the least p_f (of equal ones the first).
    """
    keys = list(by)

    def solve(found: dict) -> list[dict]:
        rows = []
        for k in range(1, most + 1):
            n, gram = found.get(k, (0, None))
            if n <= 2 * k + 1:
                break
            own = [0, *[2 * j + 1 for j in range(1, k + 1)]]  # places: 0 constant, 1 effect, 2 cause, then pairs by lag
            small, large = _fit(gram, own, 1)[1], _fit(gram, [*own, *[2 * j + 2 for j in range(1, k + 1)]], 1)[1]
            total = float(gram[1, 1] - gram[0, 1] ** 2 / n)
            rows.append({"lag": k, "n": n, "f": (small - large) / k / (large / (n - 2 * k - 1)), "chi2": n * (small - large) / large, "lr": float(n * np.log(small / large)), "gain": (small - large) / total})
        return rows

    sums = moments(df, [effect, cause], order, keys, most, list(range(1, most + 1)))
    rows = _solved(sums, keys, [("lag", "int"), ("n", "long"), ("f", "double"), ("chi2", "double"), ("lr", "double"), ("gain", "double")], solve)
    rows = rows.withColumn("p_f", p_of_f(F.col("f"), F.col("lag"), F.col("n") - 2 * F.col("lag") - 1)).withColumn("p_chi2", p_of_chi2(F.col("chi2"), F.col("lag"))).withColumn("p_lr", p_of_chi2(F.col("lr"), F.col("lag")))
    return rows.withColumn("best", F.row_number().over(W.partitionBy(*(keys or [F.lit(0)])).orderBy("p_f", "lag")) == 1)


def _p_of_tau(t: float) -> float:
    """MacKinnon's (1994) approximate p of the unit root statistic with a constant, one variable."""
    from math import erf

    # fixed values: limits, and polynomials of the normal score below and above -1.61
    if t > 2.74:
        return 1.0
    if t < -18.83:
        return 0.0
    z = 2.1659 + 1.4412 * t + 0.038269 * t * t if t <= -1.61 else 1.7339 + 0.93202 * t - 0.12745 * t * t - 0.010368 * t**3
    return 0.5 * (1 + erf(z / 2**0.5))


def adf(df: DataFrame, x: str, order: str, by: list[str] | tuple[str, ...] = (), most: int = 12) -> DataFrame:
    """by, stat, lags, n, p, below_1, below_5, below_10: unit root test with a constant, lags by AIC over a common sample.

    Critical values follow MacKinnon's (2010) response surface for one variable with a constant; p his approximation of 1994.
    """
    keys = list(by)
    # levels and changes; the first row of a series has no change, and goes
    held = df.filter(F.col(x).isNotNull())
    steps = lambda w: {"_step": F.col(x) - F.lag(x).over(w), "_level": F.lag(x).over(w)}
    held = held.withColumns(steps(W.partitionBy(*keys).orderBy(order))) if keys else reach(held, order, span_of(held, order), 1, 0, steps)
    held = held.filter("_step IS NOT NULL")

    def solve(found: dict) -> list[dict]:
        size = found.get(0, (0, None))[0]
        top = min(most, max(0, size // 3 - 2))

        def places(k: int) -> list[int]:  # 0 constant, 1 change, 2 level before, then pairs by lag
            return [0, 2, *[2 * j + 1 for j in range(1, k + 1)]]

        if top not in found:
            return []
        n, gram = found[top]
        scores = [n * np.log(max(_fit(gram, places(k), 1)[1], 1e-300) / n) + 2 * (k + 2) for k in range(top + 1)]
        k = int(np.argmin(scores))
        n, gram = found[k]
        b, rss, inverse = _fit(gram, places(k), 1)
        stat = float(b[1] / np.sqrt(inverse[1, 1] * rss / max(n - k - 2, 1))) if rss > 0 else float("-inf")
        # fixed values: asymptote and terms in 1/n, 1/n^2, 1/n^3 for 1, 5 and 10 per cent
        surface = ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.04), (-2.56677, -1.5384, -2.809, 0.0))
        limits = [sum(c / n**j for j, c in enumerate(row)) for row in surface]
        return [{"stat": stat, "lags": k, "n": n, "p": _p_of_tau(stat), **{f"below_{level}": stat < c for level, c in zip((1, 5, 10), limits, strict=True)}}]

    sums = moments(held, ["_step", "_level"], order, keys, most, list(range(most + 1)))
    return _solved(sums, keys, [("stat", "double"), ("lags", "int"), ("n", "long"), ("p", "double"), *((f"below_{k}", "boolean") for k in (1, 5, 10))], solve)


def var_order(df: DataFrame, columns: list[str], order: str, most: int = 10, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """by, lag, aic, bic, best_aic, best_bic of vector autoregressions over a common sample."""
    keys, m = list(by), len(columns)

    def solve(found: dict) -> list[dict]:
        if most not in found:
            return []
        n, gram = found[most]
        now, rows = list(range(1, m + 1)), []
        for k in range(1, most + 1):
            x = [0, *range(m + 1, m + 1 + k * m)]
            cov = (gram[np.ix_(now, now)] - gram[np.ix_(now, x)] @ _inverse(gram[np.ix_(x, x)]) @ gram[np.ix_(x, now)]) / n
            size, free = float(np.linalg.slogdet(cov)[1]), k * m * m + m
            rows.append({"lag": k, "aic": size + 2 * free / n, "bic": size + float(np.log(n)) * free / n})
        least = {c: min(rows, key=lambda r: r[c])["lag"] for c in ("aic", "bic")}
        return [r | {f"best_{c}": r["lag"] == least[c] for c in least} for r in rows]

    fields = [("lag", "int"), ("aic", "double"), ("bic", "double"), ("best_aic", "boolean"), ("best_bic", "boolean")]
    return _solved(moments(df, columns, order, keys, most, [most]), keys, fields, solve)
