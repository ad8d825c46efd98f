"""Periodic runs of words: maximal stretches that repeat with a smallest period, found by Main-Lorentz divide and conquer.

Words are interned as whole numbers. A segment is halved; for each period q the repetitions across the midpoint follow from
how far the text agrees with itself at distance q before and after it. Two Z-functions at the midpoint (one forwards, one
backwards) give that for all q at once. Then both halves are searched. A repetition that goes on beyond its segment is left
to an ancestor, whose midpoint it crosses; intervals found with several periods keep the smallest.

Only segments that can hold a run are searched. With `least` words and `exponent` periods at least, a run agrees with itself
at distance q on K = max(least - q, (exponent - 1) * q) words or more. So (1) all grams of ceil(K / 2) words in its first part
occur again q words on: the stretches of recurring grams bound the search, and q; (2) across a midpoint one of the grams that
end or begin there recurs at distance q, or there is nothing to find. Grams are compared by hashes, which can only add work.

A document is one row and is searched in one task, in n log n steps; nothing is shuffled.

Defined cases: null, empty and blank texts have no words, no runs and an empty rest; repeated rows and null ids are rows like
any other; an empty table gives an empty result; other columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

LEAST, EXPONENT = 24, 3
_U = np.uint64


class _Interned(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self)
        return value


def _grams(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k words at each place."""
    n = len(ids) - k + 1
    with np.errstate(over="ignore"):
        h = (ids.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
        s = h[:n].copy()
        for j in range(1, k):
            s = s * _U(0xD6E8FEB86659FD93) + h[j : n + j]
    return s


def _stretches(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2) if b - a >= least]


def _regions(grams: np.ndarray, k: int, most: int, exponent: int, end: int) -> list[tuple[int, int]]:
    """Segments of the text outside which no run lies. most: K for the period that makes it least."""
    order = np.argsort(grams, kind="stable")
    again = grams[order[1:]] == grams[order[:-1]]
    if not again.any():
        return []
    gap = np.full(len(grams), np.iinfo(np.int64).max)
    gap[order[:-1][again]] = order[1:][again] - order[:-1][again]
    found = _stretches(gap < np.iinfo(np.int64).max, most - k + 1)
    while True:
        # the period is no less than any gap, and the run's first part lies in the stretch
        inner = [(u + a, u + b) for u, v in found for a, b in _stretches(gap[u:v] <= (v - u + k - 1) // (exponent - 1), most - k + 1)]
        if inner == found:
            return [(u, min(end, v + (v - u + k - 1) // (exponent - 1) + k)) for u, v in found]
        found = inner


def z_function(s: list[int]) -> list[int]:
    """How many elements from i on equal the first ones, for each i (0 at 0)."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _across(ids: list[int], lo: int, mid: int, hi: int) -> tuple[np.ndarray, ...]:
    """First places, ends and periods of the longest repetitions across mid within [lo, hi), one of each kind and period."""
    before, after = ids[lo:mid], ids[mid:hi]
    fore = np.array(z_function([*after, -1, *before]), np.int64)
    back = np.array(z_function([*before[::-1], -1, *after[::-1], *before[::-1]]), np.int64)
    m, n = len(before), len(after)
    q, p = np.arange(1, n + 1), np.arange(1, m + 1)
    ahead = np.append(fore[1:n], 0)  # of mid with mid + q
    behind = back[m + 1 + n - q]
    ahead_p, behind_p = fore[n + 1 + m - p], np.append(back[1:m], 0)  # of mid - p with mid
    return np.concatenate([mid - behind, mid - p - behind_p]), np.concatenate([mid + q + ahead, mid + ahead_p]), np.concatenate([q, p])


def find(ids: list[int], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least `least` elements and `exponent` periods, in that order."""
    most = min(max(least - q, (exponent - 1) * q) for q in range(1, least + 1))
    k, n = -(-most // 2), len(ids)
    if n < least:
        return []
    grams = _grams(np.array(ids, np.int64), k)
    found: dict[tuple[int, int], int] = {}
    open_ = _regions(grams, k, most, exponent, n)
    while open_:
        lo, hi = open_.pop()
        if hi - lo < least:
            continue
        mid = (lo + hi) // 2
        open_ += [(lo, mid), (mid, hi)]
        inside = grams[lo : hi - k + 1]
        if max((inside == grams[mid]).sum() if mid + k <= hi else 2, (inside == grams[mid - k]).sum() if mid - k >= lo else 2) < 2:
            continue
        start, end, period = _across(ids, lo, mid, hi)
        for i in np.flatnonzero(end - start >= np.maximum(least, exponent * period)):
            a, b, q = int(start[i]), int(end[i]), int(period[i])
            if (a == 0 or ids[a - 1] != ids[a - 1 + q]) and (b == n or ids[b] != ids[b - q]):
                found[a, b] = min(q, found.get((a, b), q))
    return sorted((a, b - a, q) for (a, b), q in found.items())


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _searched(least: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _Interned()
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                sizes, found, rest = [], [], []
                for t in part.column(1).to_pylist():
                    if len(names) > 400_000:
                        names.clear()
                    own = t.encode("utf-8", "surrogatepass").split() if t else []  # of bytes: ASCII white space alone
                    runs = find([names[w] for w in own], least, exponent) if len(own) >= least else []
                    sizes.append(len(own))
                    found.append([{"start": a, "length": n, "period": q} for a, n, q in runs])
                    if runs:
                        keep = np.ones(len(own), bool)
                        for a, n, q in runs:
                            keep[a + q : a + n] = False
                        own = [own[i] for i in np.flatnonzero(keep)]
                    rest.append(b" ".join(own))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(found, _RUNS), pa.array(rest, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """-> id, n_words, runs (start, length, period; by start, then period), collapsed (the text's words without those that any
    run repeats after its first period, joined by one space).
    """
    if exponent < 2 or least < 4:
        raise ValueError("a run has two periods and four words at least")
    kind = docs.schema[id_col].dataType.simpleString()
    work = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return work.mapInArrow(_searched(least, exponent), f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first. Null if there is none."""
    better = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda best, x: F.when(better(best, x), x).otherwise(best))


def plant(id_: Column, text: Column) -> Column:
    """The text, for one id in ten with its words from some place on made periodic (by crc32 of the id)."""
    h = F.crc32(id_.cast("string"))
    g = F.floor(h / 10)

    def periodic(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n.cast("long"))
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.get(w, place(i))), " ")).otherwise(text)

    return F.when(h % 10 == 0, let(words(text), periodic)).otherwise(text)
