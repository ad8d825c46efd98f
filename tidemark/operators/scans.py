"""Running values over long series without ordering them in one task.

A series is cut into spans of its order column (a day, a month, a thousand numbers; `span` is a column that grows with the
order). Windows run inside a span. Each span leaves a state; the states, one row a span, are scanned in order, and every row
joins what its span starts from. So no task holds more rows than a span, and the one ordered table has a row for each span (and
key: `by` names the columns that tell several series apart).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Steps = list[Callable[..., dict[str, Column]]]


def span_of(df: DataFrame, order: str) -> Column:
    """Years of a date, days of a timestamp, four thousand of a number."""
    kind = df.schema[order].dataType.typeName()
    return F.year(order) if kind == "date" else F.to_date(F.col(order)) if kind.startswith("timestamp") else F.floor(F.col(order) / 4096)


def scan(df: DataFrame, order: str, span: Column, by: list[str] | tuple[str, ...], local: Steps, state: dict[str, Column], carry: Steps, out: dict[str, Column]) -> DataFrame:
    """df with the columns of `out`, which may use what `local` and `carry` define; names start with __ and go.

    local: functions of the window over a span's rows, up to each row; state: aggregates over a span's rows; carry: functions of
    two windows over spans, all before this one and up to this one.
    """
    inside = W.partitionBy(*by, "__span").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    held = df.withColumn("__span", span)
    for step in local:
        held = held.withColumns(step(inside))
    spans = held.groupBy(*by, "__span").agg(*[c.alias(n) for n, c in state.items()])
    line = W.partitionBy(*by).orderBy("__span")
    for step in carry:
        spans = spans.withColumns(step(line.rowsBetween(W.unboundedPreceding, -1), line.rowsBetween(W.unboundedPreceding, 0)))
    names = {c: f"__of_{k}" for k, c in enumerate((*by, "__span"))}
    spans = spans.withColumnsRenamed(names)
    joined = held.join(spans, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    joined = joined.withColumns(out)
    return joined.select(*[c for c in joined.columns if not c.startswith("__") or c in df.columns or c in out])


def _plus(x: str, y: str) -> Column:
    """The sum of what is there; null if neither is."""
    return F.coalesce(F.col(x) + F.col(y), F.col(x), F.col(y))


def running_sum(df: DataFrame, x: Column, order: str, span: Column, out: str, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The sum of all values so far; null before the first."""
    held = df.withColumn("__x", x)
    made = scan(held, order, span, by, [lambda w: {"__s": F.sum("__x").over(w)}], {"__t": F.sum("__x")}, [lambda before, _: {"__c": F.sum("__t").over(before)}], {out: _plus("__s", "__c")})
    return made.drop("__x")


def numbered(df: DataFrame, order: str, span: Column, out: str = "n", by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Each row's place in the order, from 0. Equal rows of the order column are numbered in any order."""
    return scan(df, order, span, by, [lambda w: {"__k": F.count(F.lit(1)).over(w)}], {"__t": F.count(F.lit(1))}, [lambda before, _: {"__c": F.sum("__t").over(before)}], {out: F.col("__k") + F.coalesce("__c", F.lit(0)) - 1})


def last_known(df: DataFrame, x: Column, order: str, span: Column, out: str, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The last value that is not null, of this row or an earlier one."""
    held = df.withColumn("__x", x)
    made = scan(
        held, order, span, by, [lambda w: {"__l": F.last("__x", ignorenulls=True).over(w)}], {"__t": F.max_by("__x", F.when(F.col("__x").isNotNull(), F.col(order)))},
        [lambda before, _: {"__c": F.last("__t", ignorenulls=True).over(before)}], {out: F.coalesce("__l", "__c")},
    )
    return made.drop("__x")


def streaks(df: DataFrame, flag: Column, order: str, span: Column, out: str = "streak", by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """How many rows in a row the flag has held, 0 where it does not."""
    held = df.withColumn("__f", F.coalesce(flag, F.lit(False)))
    local = [lambda w: {"__k": F.count(F.lit(1)).over(w)}, lambda w: {"__r": F.col("__k") - F.coalesce(F.max(F.when(~F.col("__f"), F.col("__k"))).over(w), F.lit(0))}]
    run = W.partitionBy(*by, "__g").orderBy("__span").rowsBetween(W.unboundedPreceding, 0)
    carry = [  # a span that holds throughout goes on with the run of the one before
        lambda _, upto: {"__g": F.sum(F.when(F.col("__end") == F.col("__n"), 0).otherwise(1)).over(upto)},
        lambda *_: {"__run": F.sum("__end").over(run)},
        lambda before, _: {"__c": F.last("__run").over(before)},
    ]
    whole = F.col("__r") == F.col("__k")
    made = scan(held, order, span, by, local, {"__n": F.count(F.lit(1)), "__end": F.max_by("__r", F.col("__k"))}, carry, {out: F.col("__r") + F.when(whole, F.coalesce("__c", F.lit(0))).otherwise(0)})
    return made.drop("__f")


def drawdowns(df: DataFrame, ret: Column, order: str, span: Column, compound: bool, out: str = "drawdown", by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Distance from the running peak: of the running sum, or relative to the running product of 1 + ret."""
    held = df.withColumn("__x", F.log1p(ret) if compound else ret)
    local = [lambda w: {"__s": F.sum("__x").over(w)}, lambda w: {"__m": F.max("__s").over(w)}]
    carry = [
        lambda before, _: {"__c": F.coalesce(F.sum("__t").over(before), F.lit(0.0))},
        lambda before, _: {"__p": F.max(F.col("__c") + F.col("__top")).over(before)},
    ]
    gap = F.col("__s") + F.col("__c") - F.greatest(F.col("__p"), F.col("__c") + F.col("__m"))
    made = scan(held, order, span, by, local, {"__t": F.sum("__x"), "__top": F.max("__s")}, carry, {out: F.expm1(gap) if compound else gap})
    return made.drop("__x")


def zscores(df: DataFrame, x: str, order: str, span: Column, out: str = "z", by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(x - mean) / deviation of all values so far; null without deviation. Moments are taken around the mean of each span,
    and joined as such, so that values far from 0 lose no digits.
    """
    local = [
        lambda w: {"__n": F.count(x).over(w), "__a": F.avg(x).over(w), "__v": F.var_pop(x).over(w)},
    ]
    state = {"__bn": F.count(x), "__ba": F.avg(x), "__bv": F.var_pop(x)}
    carry = [  # of all spans before: how many, their mean, and the squares around it
        lambda before, _: {"__cn": F.coalesce(F.sum("__bn").over(before), F.lit(0)), "__ca": F.sum(F.col("__bn") * F.col("__ba")).over(before)},
        lambda *_: {"__ca": F.coalesce(F.try_divide("__ca", "__cn"), F.lit(0.0))},
        # squares around the mean so far, span by span: each adds its own and those between it and what came before
        lambda before, _: {"__cs": F.coalesce(F.sum(F.coalesce(F.col("__bn") * F.col("__bv") + F.try_divide(F.col("__cn") * F.col("__bn"), F.col("__cn") + F.col("__bn")) * F.pow(F.col("__ba") - F.col("__ca"), 2), F.lit(0.0))).over(before), F.lit(0.0))},
    ]
    n = F.col("__n") + F.col("__cn")
    a, v = F.coalesce("__a", F.lit(0.0)), F.coalesce("__v", F.lit(0.0))
    mean = F.try_divide(F.col("__n") * a + F.col("__cn") * F.col("__ca"), n)
    squares = F.col("__n") * v + F.col("__cs") + F.try_divide(F.col("__n") * F.col("__cn"), n) * F.pow(a - F.col("__ca"), 2)
    sd = F.sqrt(F.try_divide(squares, n - 1))
    return scan(df, order, span, by, local, state, carry, {out: F.when(n > 1, F.try_divide(F.col(x) - mean, F.when(sd > 0, sd)))})


def reach(df: DataFrame, order: str, span: Column, before: int, after: int, columns: Callable[..., dict[str, Column]], size: int = 4096) -> DataFrame:
    """df with columns(w), where w is the window over the whole order: frames in them must not reach further than `before` rows
    back and `after` rows ahead. Rows are numbered, dealt into blocks of `size`, and blocks get copies of their neighbours' edges.
    """
    held = numbered(df, order, span, "__n")
    block, at = F.floor(F.col("__n") / size), F.col("__n") % size
    own = F.struct(block.alias("__block"), F.lit(True).alias("__own"))
    to = lambda shift, when: F.when(when, F.struct((block + shift).alias("__block"), F.lit(False).alias("__own")))
    copies = [own] + [to(-k, at + size * (k - 1) < after) for k in range(1, -(-after // size) + 1)] + [to(k, size * k - at <= before) for k in range(1, -(-before // size) + 1)]
    held = held.withColumn("__c", F.explode(F.array_compact(F.array(*copies)))).select("*", "__c.*").drop("__c")
    made = held.withColumns(columns(W.partitionBy("__block").orderBy("__n"))).filter("__own")
    return made.drop("__n", "__block", "__own")
