"""Hypothesis tests: moments are compared with SQL, p-values by unit tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import stars
from ..functions.special import binomial_p
from ..operators import frames, lagged, models, resample, stats
from ..sources import views
from ..sources.views import with_views as sql
from .eventstudies import signal_and_returns
from .registry import r6, registry

QUERIES, ORACLE_SQL, query = registry()

_J = {"x": "SELECT sig.d, slope - lag(slope) OVER (ORDER BY sig.d) AS change, vix FROM sig", "p": "SELECT d, lead(close) OVER (ORDER BY d) / close - 1 AS nxt, close / lag(close) OVER (ORDER BY d) - 1 AS same FROM px", "j": "SELECT x.d, change, vix, nxt, same, year(x.d)::INT AS y FROM x JOIN p ON x.d = p.d"}


def joined(spark, sf):
    return signal_and_returns(spark, sf).join(views.sig(spark, sf).select("d", "vix"), "d").withColumn("y", F.year("d"))


@query(sql("SELECT y, count(*) FILTER (WHERE change IS NOT NULL AND nxt IS NOT NULL) AS n, round(corr(change, nxt), 6) AS r FROM j GROUP BY y", "sig", "px", **_J))
def pearson_table(spark, sf):
    return stats.pearson(joined(spark, sf), ["y"], "change", "nxt").select("y", "n", r6("r"))


@query()
def pearson_p_values(spark, sf):
    held = stats.pearson(joined(spark, sf), ["y"], "change", "nxt")
    return held.select("y", "n", r6("r"), r6("p"), stars(F.col("p")).alias("mark"), (F.col("p") < 0.05 / 7).alias("bonferroni"))


_RANK = "SELECT y, rank() OVER (PARTITION BY y ORDER BY change) + (count(*) OVER (PARTITION BY y, change) - 1) / 2.0 AS a, rank() OVER (PARTITION BY y ORDER BY nxt) + (count(*) OVER (PARTITION BY y, nxt) - 1) / 2.0 AS b FROM j WHERE change IS NOT NULL AND nxt IS NOT NULL"


@query(sql(f"SELECT y, count(*) AS n, round(corr(a, b), 6) AS r FROM ({_RANK}) GROUP BY y", "sig", "px", **_J))
def spearman_table(spark, sf):
    return stats.spearman(joined(spark, sf), ["y"], "change", "nxt").select("y", "n", r6("r"))


@query(sql("SELECT n, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS r FROM (SELECT count(*) AS n, corr(change, nxt) AS xy, corr(change, vix) AS xz, corr(nxt, vix) AS yz FROM j WHERE change IS NOT NULL AND nxt IS NOT NULL)", "sig", "px", **_J))
def partial_corr(spark, sf):
    return stats.partial_corr(joined(spark, sf), "change", "nxt", "vix").select("n", r6("r"))


@query(sql("SELECT y, count(nxt) AS n, round(avg(nxt), 6) AS mean, round(avg(nxt) / (stddev_samp(nxt) / sqrt(count(nxt))), 6) AS t FROM j GROUP BY y", "sig", "px", **_J))
def t_one_sample(spark, sf):
    return stats.t_one_sample(joined(spark, sf), ["y"], "nxt").select("y", "n", r6("mean"), r6("t"))


_TWO = "SELECT count(nxt) FILTER (WHERE change > 0) AS n1, count(nxt) FILTER (WHERE change <= 0) AS n0, avg(nxt) FILTER (WHERE change > 0) AS m1, avg(nxt) FILTER (WHERE change <= 0) AS m0, var_samp(nxt) FILTER (WHERE change > 0) AS v1, var_samp(nxt) FILTER (WHERE change <= 0) AS v0 FROM j"


@query(sql(f"SELECT n1, n0, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS t, round((v1 / n1 + v0 / n0) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v0 / n0) ** 2 / (n0 - 1)), 4) AS dof FROM ({_TWO})", "sig", "px", **_J))
def t_welch(spark, sf):
    held = joined(spark, sf).withColumn("up", F.col("change") > 0)
    return stats.t_two_sample(held, "up", "nxt", True).select("n1", "n0", r6("t"), r6("dof", None, 4))


@query(sql(f"SELECT n1, n0, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0)), 6) AS t, (n1 + n0 - 2)::DOUBLE AS dof FROM ({_TWO})", "sig", "px", **_J))
def t_pooled(spark, sf):
    held = joined(spark, sf).withColumn("up", F.col("change") > 0)
    return stats.t_two_sample(held, "up", "nxt", False).select("n1", "n0", r6("t"), r6("dof", None, 4))


@query(sql("""SELECT count(*) AS groups, sum(n)::BIGINT AS n, round(((sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 5) AS f
  FROM (SELECT b, count(nxt) AS n, avg(nxt) AS m, var_pop(nxt) AS v FROM (SELECT nxt, ((change > e[1])::INT + (change > e[2])::INT + (change > e[3])::INT + (change > e[4])::INT) AS b FROM j,
  (SELECT [quantile_cont(change, 0.2), quantile_cont(change, 0.4), quantile_cont(change, 0.6), quantile_cont(change, 0.8)] AS e FROM j) WHERE change IS NOT NULL AND nxt IS NOT NULL) GROUP BY b)""", "sig", "px", **_J))
def anova_quintile(spark, sf):
    return stats.anova(stats.quantile_bins(joined(spark, sf), "change", 5), "bin", "nxt").select("groups", "n", r6("f", None, 5))


@query(sql("SELECT y, count(*) AS n, count(*) FILTER (WHERE sign(change) = sign(nxt)) AS hits FROM j WHERE change <> 0 AND nxt IS NOT NULL GROUP BY y", "sig", "px", **_J))
def binomial_hit(spark, sf):
    return stats.hit_rate(joined(spark, sf), ["y"], F.col("change"), F.col("nxt")).select("y", "n", "hits")


@query()
def binomial_p_values(spark, sf):
    return stats.hit_rate(joined(spark, sf), ["y"], F.col("change"), F.col("nxt")).select("y", "n", "hits", r6(binomial_p(F.col("hits"), F.col("n")), "p"))


@query(sql("SELECT k.lag, count(*) AS n, round(corr(x, y2), 6) AS r FROM (" + " UNION ALL ".join(f"SELECT {k} AS lag, change AS x, lead(same, {k}) OVER (ORDER BY d) AS y2 FROM j" for k in range(-3, 4)) + ") k WHERE x IS NOT NULL AND y2 IS NOT NULL GROUP BY 1", "sig", "px", **_J))
def cross_lag_corr(spark, sf):
    return stats.cross_lag(joined(spark, sf), "change", "same", "d", range(-3, 4)).select("lag", "n", r6("r"))


@query(sql("SELECT CASE WHEN change > 0 THEN 'up' ELSE 'down' END AS side, count(*) AS n, round(corr(change, nxt), 6) AS r FROM j WHERE change <> 0 AND nxt IS NOT NULL GROUP BY 1", "sig", "px", **_J))
def asymmetry(spark, sf):
    held = joined(spark, sf).filter("change <> 0 AND nxt IS NOT NULL").withColumn("side", F.when(F.col("change") > 0, "up").otherwise("down"))
    return stats.pearson(held, ["side"], "change", "nxt").select("side", "n", r6("r"))


@query(sql("""SELECT 1 AS lag, n, round((s0 - s1) / (s1 / (n - 3)), 5) AS f FROM (SELECT count(*) AS n, regr_syy(y, a) * (1 - corr(y, a) ** 2) AS s0,
  regr_syy(y, a) * (1 - (corr(y, a) ** 2 + corr(y, b) ** 2 - 2 * corr(y, a) * corr(y, b) * corr(a, b)) / (1 - corr(a, b) ** 2)) AS s1
  FROM (SELECT same AS y, lag(same) OVER w AS a, lag(change) OVER w AS b FROM j WHERE same IS NOT NULL AND change IS NOT NULL WINDOW w AS (ORDER BY d)) WHERE a IS NOT NULL)""", "sig", "px", **_J))
def granger_lag1(spark, sf):
    return lagged.granger(joined(spark, sf), "change", "same", "d", 1).select("lag", F.col("n").cast("long").alias("n"), r6("f", None, 5))


@query()
def granger_all_lags(spark, sf):
    return lagged.granger(joined(spark, sf), "change", "same", "d", 6)


@query()
def adf_unit_root(spark, sf):
    return lagged.adf(views.px(spark, sf), "close", "d")


@query()
def var_order(spark, sf):
    return lagged.var_order(joined(spark, sf), ["change", "same"], "d", 6)


@query(sql("SELECT 'change' AS name, round(1 / (1 - corr(change, same) ** 2), 6) AS vif FROM j WHERE change IS NOT NULL AND same IS NOT NULL UNION ALL SELECT 'same', round(1 / (1 - corr(change, same) ** 2), 6) FROM j WHERE change IS NOT NULL AND same IS NOT NULL", "sig", "px", **_J))
def vif(spark, sf):
    return models.vif(joined(spark, sf), ["change", "same"]).select("name", r6("vif"))


@query()
def permutation_corr(spark, sf):
    held = joined(spark, sf)
    observed = held.agg(frames.corr(F.col("change"), F.col("nxt"))).first()[0] or 0.0
    return resample.permutation_p(resample.replicate(held, ["change", "nxt"], "d", 10_000, resample.permuted_r), observed)


@query()
def permutation_sharpe(spark, sf):
    w = frames.over("d")
    held = joined(spark, sf).select("d", F.signum("change").alias("pos"), F.col("nxt").alias("r")).na.drop()
    held = held.withColumn("cost", F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(0.0))) * 0.0004)
    net = F.col("pos") * F.col("r") - F.col("cost")
    observed = held.agg(F.avg(net) / F.stddev_pop(net) * 365**0.5).first()[0] or 0.0
    return resample.permutation_p(resample.replicate(held, ["pos", "r", "cost"], "d", 5_000, resample.permuted_sharpe), observed, False)


@query()
def bootstrap_ci(spark, sf):
    return resample.interval(resample.replicate(joined(spark, sf), ["change", "nxt"], "d", 10_000, resample.paired_r))


@query()
def bootstrap_ci_independent(spark, sf):
    return resample.interval(resample.replicate(joined(spark, sf), ["change", "nxt"], "d", 10_000, resample.independent_r))
