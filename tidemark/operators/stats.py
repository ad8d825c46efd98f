"""Tests and tables from moments: one aggregation for all groups, p-values on the aggregated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.special import binomial_p, p_of_f, p_of_r, p_of_t
from .frames import corr
from .quantiles import exact_quantiles
from .scans import reach, span_of


def pairs(x: Column, y: Column) -> Column:
    """Number of pairwise complete rows."""
    return F.count_if(x.isNotNull() & y.isNotNull())


def pearson(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, n, r, p."""
    out = df.groupBy(*by).agg(pairs(F.col(x), F.col(y)).alias("n"), corr(F.col(x), F.col(y)).alias("r"))
    return out.withColumn("p", p_of_r(F.col("r"), F.col("n")))


def ranked(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """Average ranks of the columns within each group."""
    for c in cols:
        ties = F.count(F.lit(1)).over(W.partitionBy(*by, c))
        df = df.withColumn(f"rank_{c}", F.rank().over(W.partitionBy(*by).orderBy(c)) + (ties - 1) / 2.0)
    return df


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return pearson(ranked(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), [x, y], by), by, f"rank_{x}", f"rank_{y}")


def partial_corr(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """r, the correlation of x and y without what z explains, from the three pairwise ones; n and p by n - 2."""
    rows = df.na.drop(subset=[x, y, z])
    m = rows.agg(F.count(F.lit(1)).alias("n"), corr(F.col(x), F.col(y)).alias("xy"), corr(F.col(x), F.col(z)).alias("xz"), corr(F.col(y), F.col(z)).alias("yz"))
    r = (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))
    return m.select("n", r.alias("r")).withColumn("p", p_of_r(F.col("r"), F.col("n")))


def t_one_sample(df: DataFrame, by: list[str], x: str, mu: float = 0.0) -> DataFrame:
    out = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    out = out.withColumn("t", F.try_divide(F.col("mean") - mu, F.col("sd") / F.sqrt("n")))
    return out.withColumn("p", p_of_t(F.col("t"), F.col("n") - 1))


def t_two_sample(df: DataFrame, flag: str, x: str, welch: bool) -> DataFrame:
    """n1, n0, mean1, mean0, t, dof, p of the rows with and without the flag."""
    a = {k: F.when(F.col(flag) == bool(k), F.col(x)) for k in (1, 0)}
    m = df.agg(*[f(a[k]).alias(f"{name}{k}") for k in (1, 0) for name, f in (("n", F.count), ("mean", F.avg), ("v", F.var_samp))])
    n1, n0, v1, v0 = (F.col(c) for c in ("n1", "n0", "v1", "v0"))
    if welch:
        square = v1 / n1 + v0 / n0
        dof = square * square / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v0 / n0) * (v0 / n0) / (n0 - 1))
    else:
        square = ((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0)
        dof = (n1 + n0 - 2).cast("double")
    out = m.select("n1", "n0", "mean1", "mean0", ((F.col("mean1") - F.col("mean0")) / F.sqrt(square)).alias("t"), dof.alias("dof"))
    return out.withColumn("p", p_of_t(F.col("t"), F.col("dof")))


def anova(df: DataFrame, group: str, x: str) -> DataFrame:
    """groups, n, f, p: between and within sums of squares from one aggregation by group."""
    g = df.filter(F.col(x).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    s = g.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("nmm") - F.col("nm") * F.col("nm") / F.col("n")
    f = (between / (F.col("groups") - 1)) / (F.col("within") / (F.col("n") - F.col("groups")))
    return s.select("groups", "n", f.alias("f")).withColumn("p", p_of_f(F.col("f"), F.col("groups") - 1, F.col("n") - F.col("groups")))


def hit_rate(df: DataFrame, by: list[str], predicted: Column, actual: Column) -> DataFrame:
    """by, n, hits, hit_pct, p: signs that agree, against a fair coin; rows without a predicted sign are left out."""
    rows = df.filter(predicted.isNotNull() & (predicted != 0) & actual.isNotNull())
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.signum(predicted) == F.signum(actual)).alias("hits"))
    return out.withColumn("hit_pct", 100.0 * F.col("hits") / F.col("n")).withColumn("p", binomial_p(F.col("hits"), F.col("n")))


def quantile_bins(df: DataFrame, x: str, n: int, out: str = "bin") -> DataFrame:
    """Right-closed bins between quantiles, the lowest edge included; null stays null. The edges are one broadcast row."""
    inner = [k / n for k in range(1, n)]
    edges = exact_quantiles(df, x, inner).select(F.col("quantiles").alias("__edges"))
    # one row of n - 1 numbers
    placed = df.crossJoin(F.broadcast(edges)).withColumn(out, F.when(F.col(x).isNotNull(), F.size(F.filter("__edges", lambda e: e < F.col(x)))))
    return placed.drop("__edges")


def cross_lag(df: DataFrame, x: str, y: str, order: str, lags: range) -> DataFrame:
    """lag, n, r, p of x now against y some rows later (earlier for negative lags): one pass, all lags side by side."""
    held = df.select(F.col(order).alias("o"), F.col(x).alias("x"), F.col(y).alias("y"))
    moved = lambda w: {f"y{j}": (F.lead("y", k) if k >= 0 else F.lag("y", -k)).over(w) for j, k in enumerate(lags)}
    wide = reach(held, "o", span_of(held, "o"), max(0, -min(lags)), max(0, max(lags)), moved)
    long = wide.select("x", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"y{j}").alias("y")) for j, k in enumerate(lags)])).alias("c")).select("x", "c.*")
    return pearson(long, ["lag"], "x", "y")
