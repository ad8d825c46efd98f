"""Gaussian hidden Markov models (diagonal): many keyed series at once, or one series too long for a task.

A keyed series is fitted in its own group. For a long one, the forward and backward messages are a scan: a row is the matrix
diag(likelihood) x transition, matrices multiply associatively, each span of the order leaves its product, the products are scanned in
order (one row a span), and each span then computes its posteriors and sums from the message that enters it on either side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Params:
    start: np.ndarray
    move: np.ndarray
    mean: np.ndarray
    var: np.ndarray


def initial(x: np.ndarray, states: int) -> Params:
    """Means of equal parts of the values of the first column, one spread, and states that mostly stay."""
    order = np.argsort(x[:, 0], kind="stable")
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9)
    mean = np.stack([x[p].mean(0) if len(p) else x.mean(0) for p in np.array_split(order, states)])
    return Params(np.full(states, 1 / states), move, mean, np.stack([x.var(0) + 1e-6] * states))


def _likelihood(x: np.ndarray, q: Params) -> tuple[np.ndarray, np.ndarray]:
    """Of each row under each state, divided by the largest, and the logarithm of that."""
    logs = -0.5 * (((x[:, None] - q.mean) ** 2 / q.var) + np.log(2 * np.pi * q.var)).sum(2)
    top = logs.max(1)
    return np.exp(logs - top[:, None]), top


def _span_product(x: np.ndarray, q: Params) -> tuple[np.ndarray, float]:
    """The product of the rows' matrices, divided by e to the second number."""
    like, top = _likelihood(x, q)
    made, scale = np.eye(len(q.start)), float(top.sum())
    for row in like:
        made = (made * row) @ q.move
        size = made.sum()
        made, scale = made / size, scale + float(np.log(size))
    return made, scale


def _span_posteriors(x: np.ndarray, q: Params, ahead: np.ndarray, behind: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of a span's rows and expected transitions out of them. ahead: what is predicted for its first row; behind:
    what follows its last one says of that row's successor.
    """
    like, _ = _likelihood(x, q)
    n, states = like.shape
    p, r = np.empty((n, states)), np.empty((n + 1, states))
    r[n] = behind / behind.sum()
    for t in range(n - 1, -1, -1):
        r[t] = like[t] * (q.move @ r[t + 1])
        r[t] /= r[t].sum()
    now = ahead / ahead.sum()
    for t in range(n):
        p[t] = now * like[t]
        p[t] /= p[t].sum()
        now = p[t] @ q.move
    post = p * (r[1:] @ q.move.T)
    post /= post.sum(1, keepdims=True)
    pairs = p[:, :, None] * q.move * r[1:, None, :]
    pairs /= pairs.sum((1, 2), keepdims=True)
    return post, pairs[: n - 1 if last else n].sum(0)


def _updated(q: Params, first: np.ndarray, pairs: np.ndarray, total: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> Params:
    mean = sums / total[:, None]
    var = np.maximum(squares / total[:, None] - mean**2, 0) + 1e-6
    rows = pairs.sum(1, keepdims=True)
    return Params(first, np.where(rows > 0, pairs / np.where(rows > 0, rows, 1), q.move), mean, var)


def fit(x: np.ndarray, states: int = 3, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Baum-Welch on one series -> posteriors, means, log likelihood of each round; states by the mean of the first column."""
    q, seen = initial(x, states), []
    for _ in range(rounds):
        made, scale = _span_product(x, q)
        seen.append(scale + float(np.log((q.start @ made).sum())))
        post, pairs = _span_posteriors(x, q, q.start, np.ones(states), True)
        q = _updated(q, post[0], pairs, post.sum(0), post.T @ x, post.T @ x**2)
    rank = np.argsort(q.mean[:, 0], kind="stable")
    return post[:, rank], q.mean[rank], seen


def _scaled(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)


def states(df: DataFrame, columns: list[str], order: str, by: list[str] | tuple[str, ...] = (), n_states: int = 3, rounds: int = 60) -> DataFrame:
    """by, order, state (0: lowest mean of the first column), posterior, log_likelihood: each series fitted on its own, in its own
    group. Rows with a null are left out; a series shorter than two rows a state has none.
    """
    keys = list(by)
    rows = df.na.drop(subset=columns).select(*keys, order, *columns)
    schema = rows.select(*keys, order).limit(0).toArrow().schema
    schema = pa.schema([*schema, pa.field("state", pa.int32()), pa.field("posterior", pa.list_(pa.float64())), pa.field("log_likelihood", pa.float64())])
    sql = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys, order).schema.fields) + ", state int, posterior array<double>, log_likelihood double"

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([(order, "ascending")])
        x = np.column_stack([table.column(c).cast(pa.float64()).to_numpy() for c in columns])
        if len(x) < 2 * n_states:
            return schema.empty_table()
        post, _, seen = fit(_scaled(x), n_states, rounds)
        added = [pa.array(post.argmax(1).astype(np.int32)), pa.array(list(post), pa.list_(pa.float64())), pa.array(np.full(len(x), seen[-1]))]
        return pa.table([*(table.column(c) for c in [*keys, order]), *added], schema=schema)

    return rows.groupBy(*(keys or [F.lit(0).alias("__one")])).applyInArrow(one, sql)


def scan_posteriors(df: DataFrame, columns: list[str], order: str, span: Column, q: Params, sums: bool = False) -> DataFrame:
    """Posteriors of one long series under given parameters: order, state, posterior. With sums one row for each span instead:
    first, pairs, total, sums, squares (what the next parameters need) and log_likelihood (of the series).
    """
    rows = df.na.drop(subset=columns).select(order, *columns, span.alias("__span"))
    kind = rows.schema["__span"].dataType.simpleString()
    k = len(q.start)
    spans = rows.select("__span").limit(0).toArrow().schema

    def product(table: pa.Table) -> pa.Table:
        table = table.sort_by([(order, "ascending")])
        made, scale = _span_product(np.column_stack([table.column(c).cast(pa.float64()).to_numpy() for c in columns]), q)
        return pa.table([table.column("__span").slice(0, 1), pa.array([list(made.ravel())], pa.list_(pa.float64())), pa.array([scale])], schema=pa.schema([*spans, pa.field("m", pa.list_(pa.float64())), pa.field("scale", pa.float64())]))

    def messages(table: pa.Table) -> pa.Table:
        """One row a span: the message that enters it from either side."""
        table = table.sort_by([("__span", "ascending")])
        ms = [np.array(m).reshape(k, k) for m in table.column("m").to_pylist()]
        ahead, behind, now, total = [], [], q.start, float(np.sum(table.column("scale").to_numpy()))
        for m in ms:
            ahead.append(list(now))
            now = now @ m
            total += float(np.log(now.sum()))
            now = now / now.sum()
        back = np.ones(k)
        for m in reversed(ms):
            behind.append(list(back))
            back = m @ back
            back = back / back.sum()
        lists = pa.list_(pa.float64())
        cols = [table.column("__span"), pa.array(ahead, lists), pa.array(behind[::-1], lists), pa.array([i == 0 for i in range(len(ms))]), pa.array([i == len(ms) - 1 for i in range(len(ms))]), pa.array([total] * len(ms))]
        return pa.table(cols, schema=pa.schema([*spans, pa.field("ahead", lists), pa.field("behind", lists), pa.field("first", pa.bool_()), pa.field("last", pa.bool_()), pa.field("total", pa.float64())]))

    products = rows.groupBy("__span").applyInArrow(product, f"__span {kind}, m array<double>, scale double")
    told = products.groupBy(F.lit(0).alias("__one")).applyInArrow(messages, f"__span {kind}, ahead array<double>, behind array<double>, first boolean, last boolean, total double")
    base = rows.select(order).limit(0).toArrow().schema
    lists = pa.list_(pa.float64())
    rank = np.argsort(q.mean[:, 0], kind="stable")

    def posteriors(table: pa.Table, told: pa.Table) -> pa.Table:
        table, m = table.sort_by([(order, "ascending")]), told.to_pylist()[0]
        x = np.column_stack([table.column(c).cast(pa.float64()).to_numpy() for c in columns])
        post, pairs = _span_posteriors(x, q, np.array(m["ahead"]), np.array(m["behind"]), m["last"])
        if sums:
            flat = [list(v) for v in (post[0] if m["first"] else np.zeros(k), pairs.ravel(), post.sum(0), (post.T @ x).ravel(), (post.T @ x**2).ravel())]
            return pa.table([*(pa.array([v], lists) for v in flat), pa.array([m["total"]])], names=["first", "pairs", "total", "sums", "squares", "log_likelihood"])
        post = post[:, rank]
        return pa.table([table.column(order), pa.array(post.argmax(1).astype(np.int32)), pa.array(list(post), lists)], schema=pa.schema([*base, pa.field("state", pa.int32()), pa.field("posterior", lists)]))

    made = "first array<double>, pairs array<double>, total array<double>, sums array<double>, squares array<double>, log_likelihood double" if sums else f"`{order}` {rows.schema[order].dataType.simpleString()}, state int, posterior array<double>"
    return rows.groupBy("__span").cogroup(told.groupBy("__span")).applyInArrow(posteriors, made)


def scan_fit(df: DataFrame, columns: list[str], order: str, span: Column, q: Params, rounds: int) -> tuple[Params, list[float]]:
    """Baum-Welch on one long series from given parameters -> parameters and the log likelihood of each round. A round is one
    job; the driver gets its sums, added up over spans: a few numbers a state.
    """
    k, m, seen = len(q.start), len(columns), []
    add = lambda c, n: F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(n)]).alias(c)
    for _ in range(rounds):
        r = scan_posteriors(df, columns, order, span, q, True).agg(add("first", k), add("pairs", k * k), add("total", k), add("sums", k * m), add("squares", k * m), F.max("log_likelihood").alias("ll")).first()
        seen.append(r.ll)
        q = _updated(q, np.array(r.first), np.array(r.pairs).reshape(k, k), np.array(r.total), np.array(r["sums"]).reshape(k, m), np.array(r.squares).reshape(k, m))
    return q, seen
