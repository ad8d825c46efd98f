"""Order statistics of all rows so far: exact expanding quantiles and ranks in n log n.

One series in one task: values are sorted once, rows are taken away from the last to the first, and the place of each quantile
moves by a step or two, so a series costs its sort (`_walk`). Ranks are counts of earlier smaller values, found by the bits of
the places (`earlier_smaller`).

A series too long for a task is cut into spans of its order column. For ranks, what lies in earlier spans is counted over pairs
(span, value) in buckets of values, and what lies in lower buckets by sums over the counts of (span, bucket). For quantiles, a
span of m rows can only reach order statistics within m places of where it starts; the same counts say which buckets hold
those, and their values go to the span. No task holds more than a few spans or buckets; the counts are spans x buckets numbers
a key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def _walk(values: np.ndarray, ps: list[float], prior: bool, known: np.ndarray, times: np.ndarray, below: int) -> np.ndarray:
    """Quantiles (rows x ps) of `below` values that are less than all others, of the known values (as often as times says) and of
    values[: i + 1] (with prior: values[:i]), for each i. NaN where there is nothing. Linear interpolation.
    """
    m, out = len(values), np.full((len(values), len(ps)), np.nan)
    names, where = np.unique(np.concatenate([known, values]), return_inverse=True)
    weight = np.zeros(len(names) + 2, np.int64)
    np.add.at(weight, where[: len(known)] + 1, times)
    np.add.at(weight, where[len(known) :] + 1, 1)
    places, total = (where[len(known) :] + 1).tolist(), below + int(times.sum()) + m
    names, w0 = names.tolist(), weight.tolist()
    last = len(names)
    for j, p in enumerate(ps):
        w, n = list(w0), total
        after, before = list(range(1, last + 3)), list(range(-1, last + 1))  # neighbours among those that are left
        at, seen, column = 1, below, [np.nan] * m
        for i in range(m - 1, -1, -1):
            gone = places[i]
            for take in (True, False) if prior else (False, True):
                if take:
                    w[gone] -= 1
                    n -= 1
                    seen -= gone < at
                    if not w[gone]:
                        a, b = before[gone], after[gone]
                        after[a], before[b] = b, a
                        if gone == at:
                            at = b if b <= last else a
                            seen -= 0 if b <= last else w[a] if a else 0
                elif n:
                    h = (n - 1) * p
                    k = int(h)
                    while k < seen and before[at]:
                        at = before[at]
                        seen -= w[at]
                    while k >= seen + w[at] and after[at] <= last:
                        seen += w[at]
                        at = after[at]
                    x = names[at - 1]
                    if h > k:
                        y = x if k + 1 < seen + w[at] else names[after[at] - 1]
                        x += (y - x) * (h - k)
                    column[i] = x
        out[:, j] = column
    return out


def quantile_columns(df: DataFrame, wanted: dict[str, tuple[str, float, bool, int]], order: str, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """df with several expanding quantiles: out -> (x, p, prior_only, least), as in expanding_quantiles without a span, in one pass
    over each series.
    """
    arrow = df.limit(0).toArrow().schema
    for out in wanted:
        arrow = arrow.append(pa.field(out, pa.float64()))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{out}` double" for out in wanted)])

    def one(table: pa.Table) -> pa.Table:
        table, made = table.sort_by([(order, "ascending")]), {}
        for out, (x, p, prior, least) in wanted.items():
            values = table.column(x).cast(pa.float64()).to_numpy()
            there = ~np.isnan(values)
            rows = _quantile_rows(there, values[there], [p], prior, least, [(np.zeros(0), np.zeros(0, np.int64), 0)], 0)
            made[out] = pc.list_element(rows, 0)
        for out, column in made.items():
            table = table.append_column(arrow.field(out), column)
        return table.cast(arrow)

    return df.groupBy(*(by or [F.lit(0).alias("__one")])).applyInArrow(one, fields)


def earlier_smaller(group: np.ndarray, value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each i the weights of all j with group[j] < group[i] and value[j] < value[i]; groups are numbers from 0."""
    out = np.zeros(len(group), np.int64)
    by_value = np.argsort(value, kind="stable")
    rank = np.empty(len(value), np.int64)
    rank[by_value] = np.cumsum(np.concatenate([[0], value[by_value][1:] != value[by_value][:-1]])) if len(value) else 0
    for bit in range(int(group.max(initial=0)).bit_length()):
        # of two neighbouring halves, those in the first count for those in the second
        parent = group >> (bit + 1)
        order = by_value[np.argsort(parent[by_value], kind="stable")]
        second = (group[order] >> bit & 1).astype(bool)
        sums = np.concatenate([[0], np.cumsum(np.where(second, 0, weight[order]))])
        fresh = np.concatenate([[True], (parent[order][1:] != parent[order][:-1]) | (rank[order][1:] != rank[order][:-1])])
        of_parent = np.concatenate([[True], parent[order][1:] != parent[order][:-1]])
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        start = np.maximum.accumulate(np.where(of_parent, np.arange(len(order)), 0))
        out[order] += np.where(second, sums[first] - sums[start], 0)
    return out


def _typed(df: DataFrame, out: str, kind: str) -> tuple[pa.Schema, str]:
    arrow = df.limit(0).toArrow().schema
    added = pa.list_(pa.float64()) if kind == "array<double>" else pa.int64()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return arrow.append(pa.field(out, added)), f"{fields}, `{out}` {kind}"


def _sorted(table: pa.Table, order: str, x: str) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows in order; which have a value; those values."""
    table = table.sort_by([(order, "ascending")])
    values = table.column(x).cast(pa.float64()).to_numpy()
    there = ~np.isnan(values)
    return table, there, values[there]


def expanding_quantiles(df: DataFrame, x: str, ps: list[float], order: str, by: list[str] | tuple[str, ...] = (), span: Column | None = None, prior_only: bool = False, least: int = 1, out: str = "quantiles") -> DataFrame:
    """df with an array of the exact quantiles ps of x over all rows so far in the order (with prior_only: before this one), for
    each series that `by` tells apart; null where fewer than `least` values are there. Nulls of x count as no value.

    Without a span a series is one group, in one task, which suits series of days. With one, a column that grows with the
    order, no task holds more than a few spans.
    """
    if span is not None:
        return _spanned(df, x, ps, order, list(by), span, prior_only, least, out)
    arrow, sql = _typed(df, out, "array<double>")

    def one(table: pa.Table) -> pa.Table:
        table, there, values = _sorted(table, order, x)
        near = [(np.zeros(0), np.zeros(0, np.int64), 0)] * len(ps)
        return table.append_column(arrow.field(out), _quantile_rows(there, values, ps, prior_only, least, near, 0)).cast(arrow)

    keys = list(by) or [F.lit(0).alias("__one")]
    return df.groupBy(*keys).applyInArrow(one, sql)


def _quantile_rows(there: np.ndarray, values: np.ndarray, ps: list[float], prior: bool, least: int, near: list[tuple[np.ndarray, np.ndarray, int]], n: int) -> pa.Array:
    """Quantiles at every row, where n values come before the first; near: for each p, those of them that matter, how often each
    comes, and how many lie below.
    """
    counts = np.cumsum(there) - (there if prior else 0)
    values = np.append(values, 0.0)  # a row after the last, for what holds after all of them
    q = np.hstack([_walk(values, [p], True, *x) for p, x in zip(ps, near, strict=True)])[counts]
    few = n + counts < max(1, least)
    return pa.array([None if f else row for f, row in zip(few.tolist(), q.tolist(), strict=True)], pa.list_(pa.float64()))


def _bucketed(df: DataFrame, x: str, rows: int) -> DataFrame:
    """df with __bucket: about equal shares of the values of x, by approximate quantiles (a few thousand numbers)."""
    n = max(1, min(2000, df.count() // max(1, rows)))
    edges = sorted(set(df.approxQuantile(x, [k / n for k in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    splits = [float("-inf"), *(edges or [0.0]), float("inf")]
    held = df.withColumn("__x", F.col(x).cast("double"))
    return Bucketizer(splits=splits, inputCol="__x", outputCol="__bucket", handleInvalid="keep").transform(held).withColumn("__bucket", F.col("__bucket").cast("int"))


def _counted(df: DataFrame, x: str, by: list[str], span: Column, rows: int) -> DataFrame:
    """by, __span, __bucket, __v, __w: how often each value comes in each span."""
    held = _bucketed(df.filter(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))), x, rows)
    return held.groupBy(*by, span.alias("__span"), "__bucket", F.col("__x").alias("__v")).agg(F.count(F.lit(1)).alias("__w"))


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> tuple[DataFrame, list[Column]]:
    names = {c: f"__r_{k}" for k, c in enumerate(columns)}
    return right.withColumnsRenamed(names), [left[c].eqNullSafe(F.col(n)) for c, n in names.items()]


def _joined(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    renamed, on = _same(left, right, columns)
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in range(len(columns))])


def _spanned(df: DataFrame, x: str, ps: list[float], order: str, by: list[str], span: Column, prior: bool, least: int, out: str, rows: int = 4096) -> DataFrame:
    keys = by or ["__one"]
    held = df.withColumn("__span", span) if by else df.withColumn("__span", span).withColumn("__one", F.lit(0))
    values = _counted(held, x, keys, F.col("__span"), rows)
    sizes = held.groupBy(*keys, "__span").agg(F.count(x).alias("__m"))
    matrix = values.groupBy(*keys, "__span", "__bucket").agg(F.sum("__w").alias("__w"))
    both = sizes.select(*keys, "__span", F.lit(-1).alias("__bucket"), F.col("__m").alias("__w")).union(matrix.select(*keys, "__span", "__bucket", "__w"))
    kind = {f.name: f.dataType.simpleString() for f in held.schema.fields}
    fields = ", ".join(f"`{k}` {kind[k]}" for k in [*keys, "__span"])
    arrow = both.limit(0).toArrow().schema

    def needed(table: pa.Table) -> pa.Table:
        """For each span and quantile the buckets that it needs of the spans before, how many values lie below them, and how many
        there are in all.
        """
        table = table.sort_by([("__span", "ascending")]).combine_chunks()
        codes = table.column("__span").combine_chunks().dictionary_encode()
        spans, at = np.arange(len(codes.dictionary)), np.array(codes.indices)
        bucket, w = table.column("__bucket").to_numpy(), table.column("__w").to_numpy()
        m = np.zeros(len(spans), np.int64)
        m[at[bucket < 0]] = w[bucket < 0]
        counts = np.zeros((len(spans), int(bucket.max()) + 1 if len(bucket) and bucket.max() >= 0 else 1), np.int64)
        np.add.at(counts, (at[bucket >= 0], bucket[bucket >= 0]), w[bucket >= 0])
        ahead = np.cumsum(counts, 0) - counts  # of earlier spans, by bucket
        picked, names = [], codes.dictionary
        key = {k: table.column(k)[0].as_py() for k in keys}
        for s in range(len(spans)):
            n, upto = int(ahead[s].sum()), np.cumsum(ahead[s])
            for j, p in enumerate(ps):
                low, high = int(max(0, n - 1) * p) - int(m[s]) - 1, int((n + int(m[s])) * p) + 2
                chosen = np.flatnonzero((ahead[s] > 0) & (upto > low) & (upto - ahead[s] <= high)).tolist()
                base = int((upto - ahead[s])[chosen[0]]) if chosen else 0
                picked += [{**key, "__span": names[s].as_py(), "__p": j, "__bucket": b, "__base": base, "__n": n} for b in chosen or [-1]]
        return pa.Table.from_pylist(picked, pa.schema([*(arrow.field(k) for k in [*keys, "__span"]), pa.field("__p", pa.int32()), pa.field("__bucket", pa.int32()), pa.field("__base", pa.int64()), pa.field("__n", pa.int64())]))

    pairs = both.groupBy(*keys).applyInArrow(needed, f"{fields}, __p int, __bucket int, __base long, __n long")
    # a bucket may be wanted by all spans: both sides are salted by the span that asks
    pairs = pairs.withColumn("__salt", F.pmod(F.hash("__span"), F.lit(SALTS)))
    wide = values.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("__span", "__from")
    near = _joined(pairs, wide, [*keys, "__bucket", "__salt"], "left").filter(F.col("__from").isNull() | (F.col("__from") < F.col("__span")))
    near = near.groupBy(*keys, "__span", "__p", "__base", "__n", "__v").agg(F.coalesce(F.sum("__w"), F.lit(0)).alias("__w"))
    target, sql = _typed(df, out, "array<double>")
    names = df.columns

    def one(rows_: pa.Table, known: pa.Table) -> pa.Table:
        table, there, own = _sorted(rows_, order, x)
        of, v, w, base = (known.column(c).to_numpy() for c in ("__p", "__v", "__w", "__base"))
        n, near_ = known.column("__n")[0].as_py() if known.num_rows else 0, []
        for j in range(len(ps)):
            here = (of == j) & ~np.isnan(v)
            low = int(base[of == j][0]) if (of == j).any() else 0
            top = n - low - int(w[here].sum())  # values above all that are near: they only have to be there
            near_.append((np.append(v[here], np.inf), np.append(w[here], top).astype(np.int64), low) if top else (v[here], w[here].astype(np.int64), low))
        return table.select(names).append_column(target.field(out), _quantile_rows(there, own, ps, prior, least, near_, n)).cast(target)

    return held.groupBy(*keys, "__span").cogroup(near.groupBy(*keys, "__span")).applyInArrow(one, sql)


def expanding_ranks(df: DataFrame, x: str, order: str, span: Column, by: list[str] | tuple[str, ...] = (), out: str = "rank_pct", rows: int = 4096) -> DataFrame:
    """df with the percentile rank of each value among those so far in the order, this one included, ties averaged; null where x is.

    Values of the same span are compared in its task; of earlier spans, those in lower buckets are counted by sums over
    (span, bucket), those in the same bucket over its pairs (span, value).
    """
    by, keys = list(by), list(by) or ["__one"]
    held = df.withColumn("__span", span) if by else df.withColumn("__span", span).withColumn("__one", F.lit(0))
    held = _bucketed(held.withColumn("__in", F.col(x).cast("double")), "__in", rows).drop("__in")
    values = held.filter("__x IS NOT NULL").groupBy(*keys, "__span", "__bucket", F.col("__x").alias("__v")).agg(F.count(F.lit(1)).alias("__w"))
    pair_kind, pair_sql = _typed(values, "__below", "bigint")

    def spans_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        names = table.column("__span").combine_chunks()
        codes = names.dictionary_encode()
        place = np.empty(len(codes.dictionary), np.int64)
        place[np.array(pc.sort_indices(codes.dictionary))] = np.arange(len(place))
        return place[np.array(codes.indices)], place

    def in_bucket(table: pa.Table) -> pa.Table:
        at, _ = spans_of(table)
        v, w = table.column("__v").to_numpy(), table.column("__w").to_numpy()
        low = earlier_smaller(at, v, w)
        order_ = np.lexsort((at, v))
        sums = np.cumsum(w[order_]) - w[order_]
        fresh = np.concatenate([[True], v[order_][1:] != v[order_][:-1]])
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(v)), 0))
        tied = np.empty(len(v), np.int64)
        tied[order_] = sums - sums[first]
        # two counts in one number would not fit: twice the smaller ones and the equal ones, which is what a rank needs
        return table.append_column(pair_kind.field("__below"), pa.array(2 * low + tied)).cast(pair_kind)

    inner = values.groupBy(*keys, "__bucket").applyInArrow(in_bucket, pair_sql).select(*keys, "__span", "__v", "__below")
    matrix = values.groupBy(*keys, "__span", "__bucket").agg(F.sum("__w").alias("__w"))
    cell_kind, cell_sql = _typed(matrix, "__lower", "bigint")

    def lower(table: pa.Table) -> pa.Table:
        at, place = spans_of(table)
        b, w = table.column("__bucket").to_numpy(), table.column("__w").to_numpy()
        return table.append_column(cell_kind.field("__lower"), pa.array(earlier_smaller(at, b.astype(np.float64), w))).cast(cell_kind)

    def ahead(table: pa.Table) -> pa.Table:
        at, _ = spans_of(table)
        m = table.column("__w").to_numpy()
        order_ = np.argsort(at, kind="stable")
        n = np.empty(len(at), np.int64)
        n[order_] = np.cumsum(m[order_]) - m[order_]
        return table.append_column(size_kind.field("__n"), pa.array(n)).cast(size_kind)

    cells = matrix.groupBy(*keys).applyInArrow(lower, cell_sql).select(*keys, "__span", "__bucket", "__lower")
    sizes = values.groupBy(*keys, "__span").agg(F.sum("__w").alias("__w"))
    size_kind, size_sql = _typed(sizes, "__n", "bigint")
    counts = sizes.groupBy(*keys).applyInArrow(ahead, size_sql).select(*keys, "__span", "__n")
    looked = _joined(_joined(_joined(values, inner, [*keys, "__span", "__v"]), cells, [*keys, "__span", "__bucket"]), counts, [*keys, "__span"])
    looked = looked.select(*keys, "__span", "__v", (F.col("__below") + 2 * F.col("__lower")).alias("__twice"), "__n")
    rows_ = _joined(held.withColumnRenamed("__x", "__v").drop("__bucket"), looked, [*keys, "__span", "__v"], "left")
    final, final_sql = df.limit(0).toArrow().schema.append(pa.field(out, pa.float64())), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` double"

    names = df.columns

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([(order, "ascending")])
        v = table.column("__v").to_numpy()
        there = np.flatnonzero(~np.isnan(v))
        place, one_ = np.arange(len(there)), np.ones(len(there), np.int64)
        low = earlier_smaller(place, v[there], one_)
        order_ = np.lexsort((place, v[there]))
        fresh = np.concatenate([[True], v[there][order_][1:] != v[there][order_][:-1]])[: len(there)]
        nth = np.empty(len(there), np.int64)
        nth[order_] = np.arange(len(there)) - np.maximum.accumulate(np.where(fresh, np.arange(len(there)), 0)) + 1
        twice, n = table.column("__twice").to_numpy()[there], table.column("__n").to_numpy()[there]
        rank = np.full(len(v), np.nan)
        rank[there] = (twice / 2 + low + (nth + 1) / 2) / (n + place + 1)
        return table.select(names).append_column(final.field(out), pa.array(rank, from_pandas=True)).cast(final)

    return rows_.groupBy(*keys, "__span").applyInArrow(one, final_sql)
