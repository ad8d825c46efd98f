"""Exact quantiles of groups of any size, without holding a group in one place.

A mergeable sketch (bounded, partial before the shuffle) gives two values that enclose each wanted rank. Rows below the
bracket are only counted; those inside it are counted by value, and a running count over these values finds the two order
statistics. So of a group of n rows a task sorts about 6 n / ACCURACY distinct values.

Rows meet the bracket of their group where they are read if the group has HOT rows or more: of such groups there is one at most
for each HOT rows of the table, and those are broadcast. Rows of other groups are shuffled to theirs, so a group brings less than
HOT rows to a task. The data is read three times with keys, twice without.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACCURACY = 10_000
HOT = 1_000_000


def exact_quantiles(df: DataFrame, x: str | Column, ps: list[float], by: list[str] | tuple[str, ...] = (), accuracy: int = ACCURACY) -> DataFrame:
    """by, n, quantiles: exact, interpolated linearly, an array in the order of ps. Null and NaN are no values; a group without
    any has n 0 and null. Without `by` there is one row, also for an empty table.
    """
    keys = list(by)
    value = (F.col(x) if isinstance(x, str) else x).cast("double")
    held = df.select(*keys, F.when(~F.isnan(value), value).alias("__x"))
    margin = 3 / accuracy
    marks = [m for p in ps for m in (max(0.0, p - margin), min(1.0, p + margin))]
    sizes = held.groupBy(*keys).agg(F.count("__x").alias("n"), F.min("__x").alias("__a"), F.max("__x").alias("__z"), F.percentile_approx("__x", F.array(*map(F.lit, marks)), F.lit(accuracy)).alias("__m"))
    few = F.col("n") <= accuracy  # the margin is less than a rank then
    each = [F.struct(F.lit(j).alias("j"), (F.col("n") - 1).cast("double").alias("last"), F.lit(float(p)).alias("p"), F.when(few, F.col("__a")).otherwise(F.get("__m", F.lit(2 * j))).alias("low"), F.when(few, F.col("__z")).otherwise(F.get("__m", F.lit(2 * j + 1))).alias("high")) for j, p in enumerate(ps)]
    brackets = sizes.filter("n > 0").select(*keys, F.col("n").alias("__n"), F.array(*each).alias("__b"))
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    brackets = brackets.withColumnsRenamed(names)
    rows = held.filter("__x IS NOT NULL")
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    if keys:
        hot, others = F.broadcast(brackets.filter(F.col("__n") >= HOT)), brackets.filter(F.col("__n") < HOT)
        rows = rows.join(hot, same).union(rows.join(hot, same, "left_anti").join(others, same))
    else:
        rows = rows.crossJoin(F.broadcast(brackets))
    rows = rows.select(*keys, "__x", F.explode("__b").alias("b")).filter(F.col("__x") <= F.col("b.high"))
    inside = F.when(F.col("__x") >= F.col("b.low"), F.col("__x"))
    counted = rows.groupBy(*keys, F.col("b.j").alias("__j"), F.col("b.last").alias("__last"), F.col("b.p").alias("__p"), inside.alias("__v")).agg(F.count(F.lit(1)).alias("__w"))
    upto = W.partitionBy(*keys, "__j").orderBy(F.asc_nulls_first("__v")).rowsBetween(W.unboundedPreceding, 0)
    rank = F.col("__last") * F.col("__p")
    at = counted.withColumn("__c", F.sum("__w").over(upto)).withColumn("__k", F.floor(rank)).withColumn("__f", rank - F.floor(rank))
    first = lambda k: F.min(F.when(F.col("__c") > k, F.col("__v")))
    found = at.groupBy(*keys, "__j").agg(first(F.col("__k")).alias("__lo"), first(F.least(F.col("__k") + 1, F.col("__last"))).alias("__hi"), F.max("__f").alias("__f"))
    found = found.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("__j", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__f")).alias("q")))), lambda s: s["q"]).alias("quantiles"))
    found = found.withColumnsRenamed(names)
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    joined = sizes.join(found, on, "left") if keys else sizes.join(found, F.lit(True), "left")  # one row each
    return joined.select(*keys, "n", F.when(F.col("n") > 0, F.col("quantiles")).alias("quantiles"))
