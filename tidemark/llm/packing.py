"""Packing documents' token ids into windows by non-negative least squares over shallow length combinations.

1. Every text is encoded; its ids are cut into full windows and a tail. Full windows are sequences of their own.
2. The histogram of tail lengths (at most WINDOW - 1 counts, whatever the input) goes to the driver. Combinations of two
   or three lengths that fill a window are enumerated, non-negative least squares gives how often to repeat each, and
   the counts are rounded down and held to what is there.
3. The residual histogram is packed greedily, largest length first, into exact fillings of any depth; what still fits
   nowhere is laid end to end, cut at window borders, and its last part at powers of two, which need no padding.
4. The plan is a bounded table of (length, ranks) -> (sequence, offset). A tail's rank among those of its length is the
   sum of the counts in earlier tasks plus its rank within its task, so no length is ever gathered in one place.

Defined cases: a null text is empty and still has its end id; null and repeated ids are kept, row by row; an empty table
gives no pieces; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage
from .tokens import MOST, encoder

WINDOW = 1024
_FULL = 1 << 40  # sequences of full windows: (task + 1) * _FULL + rank in the task; all others are below


def _cut(tokenizer: str, window: int, end_id: int, memo: int = MOST):
    """Batches of (id, text) -> (task, rank, id, doc_tokens, start, length, tokens), a row for each window or tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, task = encoder(tokenizer, memo).one, np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        ranks = np.zeros(window + 1, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows: list[tuple] = []
                for i, t in zip(batch.column(0)[lo : lo + 500].to_pylist(), batch.column(1)[lo : lo + 500].to_pylist(), strict=True):
                    tokens = encode(t or "") + last
                    n = len(tokens) // 4
                    for start in range(0, n, window):
                        size = min(window, n - start)
                        rows.append((task, ranks[size], i, n, start, size, tokens[4 * start : 4 * (start + size)]))
                        ranks[size] += 1
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["task", "rank", "id", "doc_tokens", "start", "length", "tokens"])

    return run


def combinations(window: int, step: int = 32) -> np.ndarray:
    """Rows of three lengths (0: none) that fill the window: all pairs, and triples with one length on a grid."""
    a = np.arange(1, window // 2 + 1)
    pairs = np.stack([a, window - a, 0 * a], 1)
    x, y = np.meshgrid(np.arange(1, window), np.arange(step, window, step), indexing="ij")
    x, y = x.ravel(), y.ravel()
    triples = np.stack([x, y, window - x - y], 1)[x + y < window]
    return np.concatenate([pairs, np.unique(np.sort(triples, 1), axis=0)])


def least_squares(counts: np.ndarray, combos: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeats x >= 0 that bring sum(x[j] * uses of each length in j) near counts: accelerated projected gradient."""
    window = len(counts) - 1
    lengths = combos.ravel()

    def made(x: np.ndarray) -> np.ndarray:
        y = np.bincount(lengths, np.repeat(x, combos.shape[1]), window + 1)
        y[0] = 0
        return y

    def back(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return r[combos].sum(1)

    v = np.ones(len(combos))
    for _ in range(20):
        v = back(made(v))
        top = np.linalg.norm(v)
        v /= top
    x, z, t = np.zeros(len(combos)), np.zeros(len(combos)), 1.0
    for _ in range(rounds):
        new = np.maximum(0, z - back(made(z) - counts) / (1.05 * top))
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        z, x = new + (was - 1) / t * (new - x), new
    return x


def plan(counts: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """-> [(lengths that fill a window, repeats)], and the counts left for the last stage."""
    window, left, made = len(counts) - 1, counts.astype(np.int64).copy(), []
    left[0] = left[window] = 0

    def take(lengths: tuple[int, ...], most: float) -> int:
        uses = {n: lengths.count(n) for n in lengths}
        k = int(min(most, *(left[n] // m for n, m in uses.items())))
        if k > 0:
            for n, m in uses.items():
                left[n] -= k * m
            made.append((lengths, k))
        return k

    if left.sum():
        combos = combinations(window)
        x = np.floor(least_squares(left.astype(float), combos) + 1e-6)
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 1:
                break
            take(tuple(int(n) for n in combos[j] if n), x[j])
    for largest in range(window - 1, 0, -1):
        while left[largest]:
            chosen, gap, own = [largest], window - largest, left.copy()
            own[largest] -= 1
            while gap:
                fit = np.flatnonzero(own[1 : gap + 1])
                if not len(fit):
                    break
                n = int(fit[-1]) + 1
                chosen.append(n)
                own[n] -= 1
                gap -= n
            if gap or not take(tuple(chosen), float("inf")):
                break
    return made, left


def _places(counts: np.ndarray, made: list[tuple[tuple[int, ...], int]], left: np.ndarray) -> dict[str, np.ndarray]:
    """Intervals of ranks, by length: the first rank, the sequence it goes to and the offset there."""
    used, rows, sequence = np.zeros_like(counts), [], 0
    for lengths, k in made:
        offset = 0
        for n in lengths:
            rows.append((n, used[n], sequence, offset))
            used[n] += k
            offset += n
        sequence += k
    position = np.zeros(len(counts), np.int64)
    position[1:] = np.cumsum(left * np.arange(len(counts)))[:-1]
    rows += [(n, used[n], -1, position[n]) for n in np.flatnonzero(left)]
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 40) + table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3], "next": np.array([sequence]), "total": np.array([int((left * np.arange(len(counts))).sum())])}


def _cuts(at: int, size: int, total: int, window: int) -> list[tuple[int, int, int]]:
    """Parts of [at, at + size) of the last stage's line: (sequence from 0, offset there, length)."""
    out, whole = [], total // window * window
    borders = [whole]
    while borders[-1] < total:  # the rest of the line: powers of two, largest first
        borders.append(borders[-1] + (1 << ((total - borders[-1]).bit_length() - 1)))
    end = at + size
    while at < end:
        if at < whole:
            k, begin = at // window, at // window * window
            stop = begin + window
        else:
            j = int(np.searchsorted(borders, at, side="right")) - 1
            k, begin, stop = whole // window + j, borders[j], borders[j + 1]
        n = min(end, stop) - at
        out.append((k, at - begin, n))
        at += n
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, memo: int = MOST) -> DataFrame:
    """-> id, start, length, doc_tokens, sequence_id, offset, tokens (little-endian unsigned 32-bit ids of the piece). memo: words that
    a worker remembers; it decides memory and time, never results.
    """
    work = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    cut = stage(work.mapInArrow(_cut(tokenizer, window, end_id, memo), "task int, rank long, id long, doc_tokens long, start long, length int, tokens binary"), "pack-pieces")
    per_task = cut.filter(F.col("length") < window).groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    per_task = stage(per_task.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n")), "pack-counts")
    counts = np.zeros(window + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most window - 1 rows
        counts[r.length] = r.n
    made, left = plan(counts)
    places = _places(counts, made, left)
    columns = ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "tokens"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        base, total = int(places["next"][0]), int(places["total"][0])
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            k = np.searchsorted(places["key"], (length.astype(np.int64) << 40) + rank, side="right") - 1
            nth, sequence, offset = rank - places["rank"][k], places["sequence"][k], places["offset"][k]
            rows = []
            for j, (i, n, start, size, _, tokens) in enumerate(zip(*[c.to_pylist() for c in batch.columns], strict=True)):
                if sequence[j] >= 0:
                    rows.append((i, start, size, n, sequence[j] + nth[j], offset[j], tokens))
                    continue
                done = 0
                for q, o, m in _cuts(int(offset[j] + nth[j] * size), size, total, window):
                    rows.append((i, start + done, m, n, base + q, o, tokens[4 * done : 4 * (done + m)]))
                    done += m
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], columns)

    tails = cut.filter(F.col("length") < window).join(per_task.select(F.col("task").alias("t"), F.col("length").alias("l"), "before"), (F.col("task") == F.col("t")) & (F.col("length") == F.col("l")))
    ranked = tails.select("id", "doc_tokens", "start", "length", (F.col("before") + F.col("rank")).alias("rank"), "tokens")
    schema = "id long, start long, length long, doc_tokens long, sequence_id long, offset long, tokens binary"
    full = cut.filter(F.col("length") == window).select("id", "start", F.col("length").cast("long").alias("length"), "doc_tokens", ((F.col("task") + F.lit(1).cast("long")) * F.lit(_FULL) + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "tokens")
    return full.unionByName(ranked.mapInArrow(assign, schema))


def padding(lengths: list[int], window: int = WINDOW) -> int:
    """Ids of padding that sequences of these lengths need: up to the window, none at a power of two."""
    return sum(window - n for n in lengths if n & (n - 1))


__all__ = ["WINDOW", "combinations", "least_squares", "pack", "padding", "plan"]
