"""Language identification by prediction by partial matching (PPM).

For each language, byte contexts of 0 to DEPTH bytes hold how often each byte followed. A byte's probability comes from
the longest known context; a byte unseen there costs an escape (as often as the context has distinct bytes) and is
looked for in the next shorter context, where the bytes already ruled out share nothing; at the end all 256 bytes are
equally likely. A text's code length under a language is the sum over its bytes; the shortest wins, and the score is
the probability that code lengths give it among the languages.

Statistics are frozen after training, so the cost of a byte after a context is one number, in fixed point. Contexts of up
to two bytes are a table of (longest known context) x (byte) x (language); those of three bytes are sparse: a row for each
byte that followed, and an escape for all others. Bytes that training never saw share one column, as nothing tells them
apart. Texts are scored as arrays: sums are whole numbers, so equal texts score alike in any batch.

Bound: at most PER_LANGUAGE training texts for each language (those with the smallest hash of their id); every context in
them is kept, and all texts are scored whole.

Defined cases: a null text, or one without a letter, is "und" with score 0; ties go to the language first in order;
rows are scored one by one, so repeated rows agree; without training rows every text is "und".
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEPTH = 3
PER_LANGUAGE = 250
UNKNOWN = "und"
_CHUNK = 1 << 19
_POINT = 4096  # fixed point: a bit is this many units


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Training rows (lang, text). Ids are ranked alone; at most PER_LANGUAGE for each language meet the texts again."""
    able = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    order = W.partitionBy(lang_col).orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col)
    ids = able.select(id_col, lang_col).withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= PER_LANGUAGE)
    # bounded: PER_LANGUAGE ids for each language
    return able.join(F.broadcast(ids.select(F.col(id_col).alias("__id")).distinct()), F.col(id_col) == F.col("__id")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> counts of each gram of 1 to DEPTH + 1 bytes, packed into a long, summed within the batch."""
    for batch in batches:
        sums: dict[tuple[str, int], dict[int, int]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = np.frombuffer(text.encode(), np.uint8).astype(np.int64)
            for n in range(1, DEPTH + 2):
                if len(raw) >= n:
                    key = sum(raw[k : len(raw) - n + 1 + k] << (8 * (n - 1 - k)) for k in range(n))
                    own = sums.setdefault((lang, n), {})
                    for gram, times in zip(*(x.tolist() for x in np.unique(key, return_counts=True)), strict=True):
                        own[gram] = own.get(gram, 0) + times
        rows = [(lang, n, gram, times) for (lang, n), own in sums.items() for gram, times in own.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["lang", "n", "gram", "times"])


@dataclass
class Model:
    languages: list[str]
    classes: np.ndarray  # byte -> class; 0 is every byte that training never saw
    low: np.ndarray  # class x class -> longest known context of up to two bytes
    low_costs: np.ndarray  # such a context x class -> cost for each language
    full: np.ndarray  # class x class x class -> context of three bytes, or -1
    after: np.ndarray  # such a context x class -> place in full_costs, or -1
    full_costs: np.ndarray
    escapes: np.ndarray  # such a context -> cost of leaving it, for each language


def train(texts: DataFrame) -> Model:
    """From rows (lang, text), a bounded sample. Grams are counted on the executors."""
    counted = texts.mapInArrow(_grams, "lang string, n int, gram long, times long").groupBy("lang", "n", "gram").agg(F.sum("times").alias("times"))
    return build(counted.toPandas())


def build(counted) -> Model:
    """From a pandas frame of lang, n (bytes in the gram), gram, times."""
    languages = sorted(counted["lang"].unique())
    code = {x: k for k, x in enumerate(languages)}
    by_n = {n: g for n, g in counted.groupby("n")}
    classes = np.zeros(256, np.uint16)
    if not languages:
        none = np.zeros((0, 0), np.int32)
        return Model([], classes, np.zeros((1, 1), np.int32), none, np.full((1, 1, 1), -1, np.int32), none, none, none)
    seen_bytes = np.unique(by_n[1]["gram"].to_numpy()) if 1 in by_n else np.zeros(0, np.int64)
    classes[seen_bytes] = np.arange(1, len(seen_bytes) + 1)
    size, width = len(seen_bytes) + 1, len(languages)
    others = 256 - len(seen_bytes)

    def split(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Grams of n bytes: context (classes in base size), next class, language, times."""
        g = by_n.get(n)
        if g is None:
            return (np.zeros(0, np.int64),) * 4
        gram, context = g["gram"].to_numpy(), np.zeros(len(g), np.int64)
        for k in range(n - 1, 0, -1):
            context = context * size + classes[(gram >> (8 * k)) & 255]
        return context, classes[gram & 255].astype(np.int64), g["lang"].map(code).to_numpy(), g["times"].to_numpy()

    bottom = np.full((size, width), 1 / 256)
    bottom[0] = others / 256
    tables, known = [], []
    for n in range(1, DEPTH + 1):
        context, after, lang, times = split(n)
        found, at = np.unique(context, return_inverse=True)
        if n == 1 and not len(found):
            found = np.zeros(1, np.int64)  # the empty context is always there
        seen = np.zeros((len(found), size, width), np.float32)
        np.add.at(seen, (at, after, lang), times)
        below = np.broadcast_to(bottom, seen.shape) if n == 1 else tables[-1][_place(known[-1], found % size ** (n - 2))]
        kinds, sums = (seen > 0).sum(1, keepdims=True), seen.sum(1, keepdims=True, dtype=np.float64)
        left = np.maximum(1 - np.where(seen > 0, below, 0).sum(1, keepdims=True), 1e-12)
        own = np.where(seen > 0, seen / np.maximum(sums + kinds, 1), kinds / np.maximum(sums + kinds, 1) * below / left)
        tables.append(np.where(sums > 0, own, below))
        known.append(found)
    # contexts of full depth, as rows of what followed
    context, after, lang, times = split(DEPTH + 1)
    found, at = np.unique(context, return_inverse=True)
    pair, row = np.unique(at * size + after, return_inverse=True)
    seen = np.zeros((len(pair), width))
    np.add.at(seen, (row, lang), times)
    of, byte = pair // size, pair % size
    below = tables[-1][_place(known[-1], found % size ** (DEPTH - 1))[of], byte] if len(pair) else seen
    kinds, sums, gone = (np.zeros((len(found), width)) for _ in range(3))
    for out, values in ((kinds, seen > 0), (sums, seen), (gone, np.where(seen > 0, below, 0))):
        np.add.at(out, of, values)
    leave = np.where(sums > 0, kinds / np.maximum(sums + kinds, 1) / np.maximum(1 - gone, 1e-12), 1.0)
    own = np.where(seen > 0, seen / np.maximum(sums + kinds, 1)[of], leave[of] * below)
    table = np.full((len(found), size), -1, np.int32)
    table[of, byte] = np.arange(len(pair))
    full = np.full((size, size, size), -1, np.int32)
    full.ravel()[found] = np.arange(len(found))
    first = np.cumsum([0, *(len(x) for x in known)])
    low = np.zeros((size, size), np.int32)
    low[:, known[1]] = first[1] + np.arange(len(known[1]))
    low.ravel()[known[2]] = first[2] + np.arange(len(known[2]))
    bits = _bits(np.concatenate(tables))
    bits[:, 0] += np.log2(max(others, 1))
    return Model(languages, classes, low, _fixed(bits), full, table, _fixed(_bits(own)), _fixed(-np.log2(leave)))


def _place(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each context's shorter one stands; training has every context's end as a context."""
    return np.minimum(np.searchsorted(known, wanted), len(known) - 1)


def _bits(p: np.ndarray) -> np.ndarray:
    return -np.log2(np.maximum(p, 1e-9))


def _fixed(bits: np.ndarray) -> np.ndarray:
    return np.rint(bits * _POINT).astype(np.int32)


def code_lengths(model: Model, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Units of each text (bytes starts to ends of raw, texts one after another) under each language."""
    out = np.zeros((len(starts), len(model.languages)), np.int64)
    if not len(raw) or not model.languages:
        return out
    size, width = model.low.shape[0], len(model.languages)
    low_costs, low, full, after = model.low_costs.reshape(-1, width), model.low.ravel(), model.full.ravel(), model.after.ravel()
    filled = np.flatnonzero(ends > starts)
    begin = starts[filled]
    for lo in range(0, len(raw), _CHUNK):
        hi = min(len(raw), lo + _CHUNK)
        pad = min(lo, DEPTH)
        c = np.concatenate([np.zeros(DEPTH - pad, np.int32), model.classes[raw[lo - pad : hi]].astype(np.int32)])
        a, b, d, now = c[:-3].copy(), c[1:-2].copy(), c[2:-1].copy(), c[3:]
        # contexts never reach into the text before
        near = begin[np.searchsorted(begin, lo - DEPTH) : np.searchsorted(begin, hi)] - lo
        for k, before in ((0, (a, b, d)), (1, (a, b)), (2, (a,))):
            at = near + k
            at = at[(at >= 0) & (at < hi - lo)]
            for x in before:
                x[at] = 0
        two = b * size + d
        three = full[a * size * size + two]
        at = np.flatnonzero(three >= 0)
        three, row = three[at], after[three[at].astype(np.int64) * size + now[at]]
        costs = np.take(low_costs, low[two] * size + now, axis=0)
        hit = row >= 0
        costs[at[hit]] = np.take(model.full_costs, row[hit], axis=0)
        costs[at[~hit]] += np.take(model.escapes, three[~hit], axis=0)
        j = np.searchsorted(begin, lo, side="right") - 1
        inside = begin[(begin > lo) & (begin < hi)] - lo
        sums = np.add.reduceat(costs, np.concatenate([[0], inside]).astype(np.int64), axis=0, dtype=np.int64)
        out[filled[j : j + len(sums)]] += sums
    return out


def decide(model: Model, units: np.ndarray, able: np.ndarray) -> tuple[list[str], np.ndarray]:
    if not model.languages:
        return [UNKNOWN] * len(units), np.zeros(len(units))
    best = units.argmin(1)
    gaps = np.minimum((units - units.min(1, keepdims=True)) / _POINT, 1000)
    score = np.where(able, 1 / np.exp2(-gaps).sum(1), 0.0)
    return [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, able, strict=True)], score


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score; only the text is looked at."""
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "__letter")]
    work = docs.select(*kept, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema if f.name != "__letter") + ", lang_pred string, score double"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen = shared.value
        for batch in batches:
            text = batch.column(text_col).cast(pa.large_string())
            _, offsets, data = text.buffers()
            edges = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
            raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None and len(edges) else np.zeros(0, np.uint8)
            units = code_lengths(frozen, raw, edges[:-1] - edges[0], edges[1:] - edges[0])
            names, score = decide(frozen, units, batch.column("__letter").to_numpy(zero_copy_only=False).astype(bool))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(score, pa.float64())], [*kept, "lang_pred", "score"])

    return work.mapInArrow(run, schema)
