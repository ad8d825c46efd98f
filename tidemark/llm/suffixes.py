"""Exact removal of repeated byte strings with suffix arrays by two-stage sorting.

A byte goes if a string of WIDTH bytes that covers it also starts anywhere else, in any document.

1. Anchors: each window of WIDTH bytes names the place of the least hash among its GRAM-byte strings. Equal windows name
   equal strings at equal offsets, so windows can only be equal where their anchors are. Anchors are dealt out by hash;
   those with one place in the corpus end here.
2. Segments: for an anchor with several places, the stretch of bytes of all windows that name it goes to the anchor's
   partition. A task's equal segments are combined first: all of their windows repeat, and one stands for them.
   Segments of an anchor with more than MANY places (a line that many documents share in different surroundings) are
   anchored anew, by longer strings, which hold more of the surroundings: GRAMS, the last of them the window itself. An
   anchor that is common again goes on to the next.
3. Each partition takes its segments by anchors, half a megabyte or so at a time, and builds their suffix array by
   two-stage sorting: suffixes smaller than their successors are sorted directly (to WIDTH bytes), the others are induced
   by scanning the buckets of first bytes in ascending order. Windows whose common prefix with their neighbour has WIDTH
   bytes repeat.
4. Repeated windows become byte spans, merged for each document.

Equal texts are one text: if there are two or more and they have WIDTH bytes, all of it goes.

Defined cases: a null text is empty; texts under WIDTH bytes lose nothing; null and repeated ids are kept row by row;
an empty table gives an empty result. Partitions grow in number, not in size, with the input, whatever the session's number
of shuffle partitions; an anchor, too, has a bounded number of segments. The common anchors, one at most for each MANY
places, are collected and sent to the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stage

WIDTH = 200
GRAM = 32
#: Lengths of the strings that anchor windows: the first for all, each other where the one before it is common.
GRAMS = (GRAM, 104, 168, WIDTH)
#: Places from which an anchor is common.
MANY = 1000
_CHUNK = 1 << 19
#: Bytes of segments in a suffix array, but for the last anchor's; bytes of texts for a partition of anchors.
_ARRAY, _SHARE = 1 << 19, 1 << 25
_U = np.uint64
_PLACE = _U((1 << 24) - 1)


def _gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the gram bytes at each place, by doubling."""
    part, r, n = raw.astype(_U) + _U(1), 0x9E3779B97F4A7C15, 1
    h, m = None, 0
    while n <= gram:
        if gram & n:
            h, m = (part if h is None else h[: len(part) - m] * _U(r) + part[m:]), m + n
        if 2 * n <= gram:
            part = part[:-n] * _U(r) + part[n:]
        r, n = r * r % 2**64, 2 * n
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    return h


def anchors(raw: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first window, number of windows) for runs of windows that name one anchor."""
    windows = len(raw) - width + 1
    if windows < 1:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    span, out = width - gram + 1, []
    for lo in range(0, windows, _CHUNK):
        n = min(_CHUNK, windows - lo)
        h = _gram_hashes(raw[lo : lo + n + width - 1], gram)
        key = (h & ~_PLACE) | np.arange(len(h), dtype=_U)
        blocks = -(-len(key) // span)
        grid = np.full(blocks * span, ~_U(0), _U)
        grid[: len(key)] = key
        grid = grid.reshape(blocks, span)
        ahead = np.minimum.accumulate(grid, 1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        out.append((h[(least[first] & _PLACE).astype(np.int64)], first + lo, np.diff(np.append(first, n))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_ANCHORS = ["anchor", "tid", "first", "n", "known"]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of a task's distinct texts; from an anchor's third place in the task on, its rows are known to be shared."""
    seen: set[int] = set()
    times: dict[int, int] = {}
    for batch in batches:
        held, size = [], 0
        tids = batch.column(0).to_pylist()
        for lo in range(0, batch.num_rows, 500):
            for tid, t in zip(tids[lo : lo + 500], batch.column(1)[lo : lo + 500].to_pylist(), strict=True):
                if tid not in seen and len(t) >= WIDTH // 4:
                    seen.add(tid)
                    h, first, n = anchors(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8))
                    held.append((h.view(np.int64), np.full(len(h), tid, np.int64), first, n))
                    size += len(h)
            if size > 100_000 or (lo + 500 >= batch.num_rows and size):
                rows = [np.concatenate(x) for x in zip(*held, strict=True)]
                known = np.zeros(len(rows[0]), bool)
                if len(times) > 1_000_000:
                    times.clear()
                for k, anchor in enumerate(rows[0].tolist()):
                    times[anchor] = n = times.get(anchor, 0) + 1
                    known[k] = n > 2
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in rows), pa.array(known)], _ANCHORS)
                held, size = [], 0


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All unknown rows of some anchors -> those of anchors with two or more places; known rows pass through."""
    held = []
    for b in batches:
        known = b.filter(b.column(4))
        if known.num_rows:
            yield pa.RecordBatch.from_arrays(known.columns[:4], _ANCHORS[:4])
        rest = b.filter(pc.invert(b.column(4)))
        if rest.num_rows:
            held.append([rest.column(c).to_numpy() for c in range(4)])
    if not held:
        return
    anchor, tid, first, n = (np.concatenate(x) for x in zip(*held, strict=True))
    del held
    order = np.lexsort((first, tid, anchor))
    anchor, tid, first, n = anchor[order], tid[order], first[order], n[order]
    same = anchor[1:] == anchor[:-1]
    fresh = np.concatenate([[True], ~(same & (tid[1:] == tid[:-1]) & (first[1:] == first[:-1]))])
    anchor, tid, first, n = anchor[fresh], tid[fresh], first[fresh], n[fresh]
    same = anchor[1:] == anchor[:-1]
    keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (anchor, tid, first, n)], _ANCHORS[:4])


def _finer(raw: bytes, segment: tuple[int, int, int], common: list[set[int]]) -> tuple[list[tuple], list[tuple]]:
    """A segment (anchor, first, n) -> its pieces by anchors that are not common, and those by the gram after the last of common."""
    done, rows = [], [segment]
    for gram, many in zip(GRAMS[1:], common, strict=False):
        done += [x for x in rows if x[0] not in many]
        again = [x for x in rows if x[0] in many]
        rows = []
        for _, first, n in again:
            h, at, m = anchors(np.frombuffer(raw[first : first + n + WIDTH - 1], np.uint8), gram=gram)
            rows += zip(h.view(np.int64).tolist(), (at + first).tolist(), m.tolist(), strict=True)
    return done, rows


def _segments(common: list[np.ndarray], sent: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts with their shared anchors -> segments; rows without bytes are windows already known to repeat.

    common: for each gram but the last, as far as they are known, its common anchors. Without sent: only the anchors that the
    next gram gives to the segments of the last of common, once for each row that would be sent with its bytes.
    """
    names, kinds = ["anchor", "tid", "first", "n", "bytes"], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [set(x.tolist()) for x in common]
        stands: dict[bytes, list] = {}
        rows: list[tuple] = []

        def fresh(piece: bytes, whole: bool, tid: int, first: int, n: int) -> bool:
            """Whether the task has not seen the piece; if it has, its places are known."""
            name = hashlib.blake2b(piece, digest_size=16, person=b"whole" if whole else b"").digest()
            if name not in stands:
                if len(stands) > 400_000:
                    stands.clear()
                stands[name] = [tid ^ first, tid, first, n]
                return True
            if stands[name] is not None:
                rows.append((*stands[name], None))
                stands[name] = None
            rows.append((tid ^ first, tid, first, n, None))
            return False

        for batch in batches:
            if not sent:
                found = batch.column(2)
                held = np.isin(found.flatten().field("anchor").to_numpy(), common[0])
                batch = batch.take(pa.array(np.unique(pc.list_parent_indices(found).to_numpy()[held])))
            for lo in range(0, batch.num_rows, 200):
                keys: list[int] = []
                for tid, t, found in zip(*(c[lo : lo + 200].to_pylist() for c in batch.columns), strict=True):
                    raw = t.encode("utf-8", "surrogatepass")
                    for x in found:
                        segment = anchor, first, n = x["anchor"], x["first"], x["n"]
                        many = bool(sets) and anchor in sets[0]
                        if not sent and not many or many and not fresh(raw[first : first + n + WIDTH - 1], True, tid, first, n):
                            continue
                        done, last = _finer(raw, segment, sets)
                        for key, at, m in last if not sent else done + last:
                            piece = raw[at : at + m + WIDTH - 1]
                            if fresh(piece, False, tid, at, m):
                                if sent:
                                    rows.append((key, tid, at, m, piece))
                                else:
                                    keys.append(key)
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], names[:1])
                if rows and sent:
                    yield made(rows)
                rows.clear()

    return run


def dealt(texts: DataFrame, shared: DataFrame, many: int = MANY) -> DataFrame:
    """Texts with their shared anchors (tid, text, found) -> segments (anchor, tid, first, n, bytes), no anchor with many of them."""
    common: list[np.ndarray] = []
    keys = shared.select("anchor")
    for _ in GRAMS[1:]:
        found = keys.groupBy("anchor").count().filter(F.col("count") > many).select("anchor").collect()
        if not found:
            break
        common.append(np.array([r.anchor for r in found], np.int64))
        keys = texts.mapInArrow(_segments([*common], False), "anchor long")
    return texts.mapInArrow(_segments(common), "anchor long, tid long, first long, n long, bytes binary")


def suffix_array(text: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Suffixes of text (bytes without 0) in order, exact to `width` bytes, by two-stage sorting."""
    m = len(text)
    if not m:
        return np.zeros(0, np.int64)
    after = np.append(text[1:], 0)
    change = np.flatnonzero(text != after)
    end = change[np.searchsorted(change, np.arange(m))]  # the last place of each run of one byte
    smaller = text[end] < after[end]  # than the suffix that starts one later
    padded = np.concatenate([text, np.zeros(width, np.uint8)])
    direct = np.flatnonzero(smaller)
    ahead = as_strided(padded, (m, width), (1, 1))
    strings = np.ascontiguousarray(ahead[direct]).view(f"S{width}").ravel() if len(direct) else np.zeros(0, "S1")
    direct = direct[np.argsort(strings, kind="stable")]
    del strings
    ends = np.cumsum(np.bincount(text[direct], minlength=257))
    pieces: list[list[np.ndarray]] = [[] for _ in range(257)]
    pieces[int(text[-1])].append(np.array([m - 1]))
    out = []

    def induce(sorted_: np.ndarray, c: int) -> None:
        before = sorted_[sorted_ > 0] - 1
        before = before[text[before] > c]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.diff(first)) + 1
        for part in np.split(before, cuts):
            if len(part):
                pieces[int(text[part[0]])].append(part)

    for c in range(257):
        own = pieces[c]
        frontier = np.concatenate(own) if own else np.zeros(0, np.int64)
        if c == int(text[-1]) and smaller[-1]:
            raise AssertionError("the last suffix is never smaller than the empty one")
        bucket = []
        while len(frontier):
            bucket.append(frontier)
            before = frontier[frontier > 0] - 1
            frontier = before[text[before] == c]
        low = ends[c - 1] if c else 0
        bucket.append(direct[low : ends[c]])
        whole = np.concatenate(bucket)
        if len(whole):
            out.append(whole)
            induce(whole, c)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Bytes that each suffix of order shares with the one before, in steps of 8, at most width."""
    padded = np.concatenate([text, np.zeros(width, np.uint8)])
    words = as_strided(padded, (len(text), width // 8, 8), (1, 8, 1))
    out = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), 1 << 16):
        hi = min(len(order), lo + (1 << 16))
        one = np.ascontiguousarray(words[order[lo - 1 : hi]]).view(_U)[..., 0]
        differs = one[1:] != one[:-1]
        out[lo:hi] = 8 * np.where(differs.any(1), differs.argmax(1), width // 8)
    return out


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of some anchors -> (tid, first, end) spans of bytes in repeated windows."""
    names = ["tid", "first", "end"]
    held: dict[int, dict[bytes, set]] = {}
    for batch in batches:
        known = batch.filter(pc.is_null(batch.column(4)))
        if known.num_rows:
            end = pc.add(pc.add(known.column(2), known.column(3)), WIDTH - 1)
            yield pa.RecordBatch.from_arrays([known.column(1), known.column(2), end], names)
        rest = batch.filter(pc.is_valid(batch.column(4)))
        for anchor, tid, first, _, piece in zip(*(c.to_pylist() for c in rest.columns), strict=True):
            held.setdefault(anchor, {}).setdefault(piece, set()).add((tid, first))

    def out(spans: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(spans), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*spans[lo : lo + 50_000], strict=True)], names)

    part: dict[bytes, set] = {}
    size = 0
    while held:
        _, of = held.popitem()
        if len(of) > 1 or len(next(iter(of.values()))) > 1:  # the windows of one segment differ
            for piece, places in of.items():
                part[piece] = part.get(piece, set()) | places
                size += len(piece)
        if part and (size > _ARRAY or not held):
            yield from out(_repeated(part))
            part, size = {}, 0


def _repeated(by_piece: dict[bytes, set]) -> list[tuple[int, int, int]]:
    """Pieces and their places (tid, first) -> (tid, first, end) spans of bytes in windows that repeat among them."""
    spans = [(tid, first, first + len(piece)) for piece, places in by_piece.items() if len(places) > 1 for tid, first in places]
    pieces = list(by_piece)
    if len(pieces) > 1:
        sizes = np.array([len(p) for p in pieces])
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        text = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8) + np.uint8(2)  # no byte of UTF-8 is 0xFE or 0xFF
        order = suffix_array(text)
        able = np.zeros(len(text), bool)
        for a, n in zip(starts, sizes, strict=True):
            able[a : a + n - WIDTH + 1] = True
        order = order[able[order]]
        equal = common_prefixes(text, order) >= WIDTH
        again = np.zeros(len(text), bool)
        again[order[equal]] = True
        again[order[np.flatnonzero(equal) - 1]] = True
        at = np.flatnonzero(again)
        if len(at):
            which = np.searchsorted(starts, at, side="right") - 1
            cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(which) > 0)) + 1
            for run in np.split(np.arange(len(at)), cut):
                j = which[run[0]]
                a, b = int(at[run[0]] - starts[j]), int(at[run[-1]] - starts[j]) + WIDTH
                spans += [(tid, first + a, first + b) for tid, first in by_piece[pieces[j]]]
    return spans


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            rows = []
            for tid, t, found in zip(*(c[lo : lo + 200].to_pylist() for c in batch.columns), strict=True):
                raw, spans = t.encode("utf-8", "surrogatepass"), merged([(x["first"], x["end"]) for x in found])
                edges = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((tid, [{"first": a, "end": b} for a, b in spans], kept))
            kinds = (pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["tid", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", many: int = MANY) -> tuple[DataFrame, DataFrame]:
    """-> (id, tid, n_bytes, text_sha256, copies) for each document, and (tid, spans, kept) for each text that loses bytes
    and has no copy. A text with copies > 1 and WIDTH bytes or more loses everything; all others keep everything.
    many: places from which an anchor is common; results do not depend on it.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    work = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text, F.length(text)).alias("tid"), text.alias("text"))
    narrow = stage(work.select("id", "tid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256")), "suffix-texts")
    size = narrow.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // _SHARE))
    rows = work.select("tid", "text").mapInArrow(_anchor_rows, "anchor long, tid long, first long, n long, known boolean")
    place = F.when(F.col("known"), F.xxhash64("tid", "first")).otherwise(F.col("anchor"))
    shared = stage(rows.repartition(parts, place).mapInArrow(_shared, "anchor long, tid long, first long, n long"), "suffix-anchors")
    release(spark)
    per_text = narrow.groupBy("tid").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("rep"))
    found = shared.groupBy("tid").agg(F.collect_set(F.struct("first", "n", "anchor")).alias("found"))
    named = found.join(per_text.select(F.col("tid").alias("pt"), "rep"), F.col("tid") == F.col("pt")).select(F.col("tid").alias("ft"), "rep", "found")
    texts = work.join(named.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("rep")) & (F.col("tid") == F.col("ft"))).select("tid", "text", "found")
    texts = stage(texts, "suffix-shared")
    release(spark)
    segments = dealt(texts, shared, many)
    spans = stage(segments.repartition(2 * parts, "anchor").mapInArrow(_repeats, "tid long, first long, end long"), "suffix-spans")
    release(spark)
    of = spans.groupBy("tid").agg(F.collect_set(F.struct("first", "end")).alias("all")).withColumnRenamed("tid", "st")
    alone = per_text.filter("copies = 1").select(F.col("tid").alias("at"))
    lost = texts.select("tid", "text").join(of.join(alone, F.col("st") == F.col("at"), "left_semi").hint("shuffle_hash"), F.col("tid") == F.col("st"))
    result = stage(lost.select("tid", "text", "all").mapInArrow(_removed, "tid long, spans array<struct<first:long,end:long>>, kept binary"), "suffix-kept")
    counted = narrow.join(per_text.filter("copies > 1").select(F.col("tid").alias("ct"), "copies"), F.col("tid") == F.col("ct"), "left").select("id", "tid", "n_bytes", "text_sha256", F.coalesce("copies", F.lit(1)).alias("copies"))
    return counted, result
