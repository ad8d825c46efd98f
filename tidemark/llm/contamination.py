"""Benchmark decontamination: an exact join of documents with the word windows of benchmark items, filtered by rare shingles.

Windows of `width` item words (an item with fewer words is one window) are the sets; their shingles of up to SHINGLE
consecutive words are the tokens. Containment of the whole window needs every one of its shingles, so a prefix of one token
is enough: the rarest, by its count in all documents. Steps:

1. Shingles of the windows set bits in a table of fixed size. Documents are read once; only stretches whose shingles all have
   their bit, long enough for some window, leave the task, as words. The table can only let too much through.
2. Shingles of these stretches are counted. A window that lacks one of its shingles cannot occur and goes; of the others the
   rarest shingle, and its offset in the window, is the key.
3. The places of key shingles in stretches join the windows by that shingle. Length and position bounds (the window must fit
   into the stretch around the shingle) come first, then the words themselves are compared.
4. Places are merged to spans for each document, and windows joined to the items that have them.

What is broadcast is the table of bits: 16 for each distinct shingle, 2 ** 27 (16 MB) at most whatever the benchmark's size.
Equal windows of many items are one window, and equal items of one document are named once.

Defined cases: a null, empty or wordless text has no words and is not hit; an item without words has no window; a null
item_id is an item named by the empty string; rows that repeat an item_id belong to one item; repeated documents and null
ids are rows like any other; empty tables give an empty result, or no hits; other columns of the inputs do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage

WIDTH, SHINGLE = 10, 5
MOST_BITS = 27
_U = np.uint64
_FOLD = bytes(ord(" ") if x < 0x30 or 0x3A <= x <= 0x40 or 0x5B <= x <= 0x60 or 0x7B <= x <= 0x7F else x | 0x20 if 0x41 <= x <= 0x5A else x for x in range(256))


def split(text: str | None) -> list[bytes]:
    """Words of letters, digits and all that is not ASCII, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def _tokens(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k words at each place."""
    if len(h) < k:
        return h[:0]
    with np.errstate(over="ignore"):
        s = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            s = s * _U(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
        return _mix(s + _U(k))


class _Table:
    """Bits of a fixed number of places; has(tokens) is true for every token that was set, and for few others."""

    def __init__(self, rows: list, log: int) -> None:
        self.shift, self.bits = _U(64 - log), np.zeros(1 << max(0, log - 6), np.int64)
        for r in rows:
            self.bits[r.place] = r.bits
        self.bits = self.bits.view(_U)

    def has(self, tokens: np.ndarray) -> np.ndarray:
        place = tokens >> self.shift
        return (self.bits[(place >> _U(6)).astype(np.int64)] >> (place & _U(63))) & _U(1) != 0


def _table(tokens: DataFrame) -> _Table:
    """tokens (token) -> their table; what the driver gets is bounded by the table's size."""
    log = min(MOST_BITS, max(16, int(16 * tokens.select(F.approx_count_distinct("token")).first()[0]).bit_length()))
    place = F.shiftrightunsigned("token", 64 - log)
    # Spark's shifts take their count from a column only in SQL
    words = tokens.select(place.alias("p")).select(F.shiftright("p", 6).alias("place"), F.expr("shiftleft(1L, cast(p & 63 AS int))").alias("bit"))
    return _Table(words.groupBy("place").agg(F.bit_or("bit").alias("bits")).collect(), log)


def _windows(width: int):
    """(item_id, text) -> (item, words) of each window of the item, once a task and item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = split(t)
                found = list(dict.fromkeys(b" ".join(own[i : i + width]) for i in range(max(1, len(own) - width + 1)))) if own else []
                for lo in range(0, len(found), 5000):
                    part = found[lo : lo + 5000]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string())], ["item", "words"])

    return run


def _shingles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(wid, words) of windows -> (wid, token, offset, kind) of each shingle; kind: how many words it has."""
    names = _Hashes()
    for batch in batches:
        cols: list[list] = [[], [], [], []]
        for wid, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = _hashed(names, t.encode().split(b" "))
            k = min(SHINGLE, len(h))
            found = _tokens(h, k).view(np.int64).tolist()
            for c, x in zip(cols, ([wid] * len(found), found, range(len(found)), [k] * len(found)), strict=True):
                c.extend(x)
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], ["wid", "token", "offset", "kind"])


def _hashed(names: _Hashes, own: list[bytes]) -> np.ndarray:
    if len(names) > 400_000:
        names.clear()
    return np.fromiter(map(names.__getitem__, own), _U, len(own))


def _stretches(table: _Table, kinds: dict[int, int]):
    """(uid, text, id) -> a row (uid, id, n_words) for each document, and a row (uid, first, kind, words) for each stretch of
    words that may hold windows. kinds: by length of shingles, how many consecutive ones the shortest window has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _Hashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part, sizes, rows = batch.slice(lo, 500), [], []
                for uid, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own = split(t)
                    sizes.append(len(own))
                    h = _hashed(names, own)
                    for k, need in kinds.items():
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], table.has(_tokens(h, k)).view(np.int8), [0]])))
                        rows += [(uid, a, k, b" ".join(own[a : b + k - 1])) for a, b in edges.reshape(-1, 2).tolist() if b - a >= need]
                yield _rows(uid=part.column(0), id=part.column(2), n_words=pa.array(sizes, pa.int64()), kind=part.column(2).type)
                if rows:
                    uid, first, k, words = zip(*rows, strict=True)
                    yield _rows(uid=pa.array(uid, pa.int64()), first=pa.array(first, pa.int64()), k=pa.array(k, pa.int32()), words=pa.array(words, pa.binary()).cast(pa.string()), kind=part.column(2).type)

    return run


def _rows(*, uid: pa.Array, kind: pa.DataType, **columns) -> pa.RecordBatch:
    """Columns that are not given are null."""
    types = {"id": kind, "n_words": pa.int64(), "first": pa.int64(), "k": pa.int32(), "words": pa.string()}
    return pa.RecordBatch.from_arrays([uid, *(columns.get(c, pa.nulls(len(uid), t)) for c, t in types.items())], ["uid", *types])


def _places(keys: _Table | None, reach: int):
    """(uid, first, k, words) -> (uid, place, token) of each shingle; with keys, of those that may be keys only, and with
    the words around the shingle (around; left: how many of them stand before it).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _Hashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                uids, places, tokens, lefts, around = [], [], [], [], []
                for uid, first, k, t in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                    own = t.encode().split(b" ")
                    found = _tokens(_hashed(names, own), k)
                    at = np.arange(len(found)) if keys is None else np.flatnonzero(keys.has(found))
                    uids += [uid] * len(at)
                    places.append(at + first)
                    tokens.append(found[at].view(np.int64))
                    if keys is not None:
                        n = reach if k == SHINGLE else 0
                        lefts += [min(n, i) for i in at.tolist()]
                        around += [[w.decode() for w in own[max(0, i - n) : i + k + n]] for i in at.tolist()]
                none = np.zeros(0, np.int64)
                cols = [pa.array(uids, pa.int64()), pa.array(np.concatenate([none, *places])), pa.array(np.concatenate([none, *tokens]))]
                if keys is not None:
                    cols += [pa.array(lefts, pa.int32()), pa.array(around, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, ["uid", "place", "token", "left", "around"][: len(cols)])

    return run


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """-> id, n_words, n_hit (words inside an occurrence of a window), spans (first, end: the merged occurrences, in words),
    items (sorted names of the items with occurring windows) for each document.
    """
    spark = docs.sparkSession
    named = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    of_items = stage(named.mapInArrow(_windows(width), "item string, words string").distinct(), "windows-of-items")
    windows = stage(of_items.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    shingles = stage(windows.select("wid", "words").mapInArrow(_shingles_of, "wid long, token long, offset int, kind int"), "window-shingles")
    needs = shingles.groupBy("wid").agg(F.max("kind").alias("kind"), F.count(F.lit(1)).alias("n")).groupBy("kind").agg(F.min("n").alias("need"))
    kinds = {r.kind: r.need for r in needs.collect()}  # SHINGLE rows at most

    work = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    scan = work.select("uid", "text", "id").mapInArrow(_stretches(_table(shingles), kinds), f"uid long, id {kind}, n_words long, first long, k int, words string")
    read = stage(scan, "contaminated-stretches")
    texts = read.filter("words IS NOT NULL").select("uid", "first", "k", "words")

    # rarity: counts of shingles in all documents; a window needs them all
    counts = texts.mapInArrow(_places(None, 0), "uid long, place long, token long").groupBy("token").agg(F.count(F.lit(1)).alias("times"))
    rated = shingles.join(counts.hint("shuffle_hash"), "token")
    least = rated.groupBy("wid").agg(F.count(F.lit(1)).alias("there"), F.min(F.struct("times", "token", "offset")).alias("key"))
    whole = least.join(shingles.groupBy("wid").agg(F.count(F.lit(1)).alias("n")).hint("shuffle_hash"), "wid").filter("there = n")
    keyed = whole.join(windows.hint("shuffle_hash"), "wid").select("wid", F.col("key.token").alias("token"), F.col("key.offset").alias("offset"), F.split("words", " ").alias("window"))
    keyed = stage(keyed, "window-keys")

    found = texts.mapInArrow(_places(_table(keyed.select("token")), max(0, width - SHINGLE)), "uid long, place long, token long, left int, around array<string>")
    fits = (F.col("left") >= F.col("offset")) & (F.col("left") - F.col("offset") + F.size("window") <= F.size("around"))
    pairs = found.join(keyed.hint("merge"), "token").filter(fits)
    same = F.slice("around", F.col("left") - F.col("offset") + 1, F.size("window")) == F.col("window")
    hits = pairs.filter(same).select("uid", "wid", (F.col("place") - F.col("offset")).alias("first"), (F.col("place") - F.col("offset") + F.size("window")).alias("end"))
    hits = stage(hits, "window-hits")

    order = W.partitionBy("uid").orderBy("first", "end")
    reached = hits.select("uid", "first", "end").distinct().withColumn("before", F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)))
    islands = reached.withColumn("island", F.sum(F.when(F.col("first") <= F.col("before"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    spans = islands.groupBy("uid", "island").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    spans = spans.groupBy("uid").agg(F.sum(F.col("end") - F.col("first")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("first", "end"))).alias("spans"))
    of = windows.join(of_items.hint("shuffle_hash"), "words").select("wid", "item")
    listed = hits.select("uid", "wid").distinct().join(of.hint("merge"), "wid").select("uid", "item").distinct().groupBy("uid").agg(F.sort_array(F.collect_list("item")).alias("items"))
    each = read.filter("words IS NULL").select("uid", "id", "n_words")
    joined = each.join(spans.hint("merge"), "uid", "left").join(listed.hint("merge"), "uid", "left")
    none = F.array().cast("array<struct<first:bigint,end:bigint>>")
    return joined.select("id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
