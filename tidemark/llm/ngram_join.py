"""Exact n-gram Jaccard self-join by parity sketches.

A document's set of N-word shingles is hashed into the parts of a sketch; each part holds the XOR of its shingles' hashes,
so parts differ only where the symmetric difference fell, and the number of differing parts is at most its size.
Jaccard similarity >= 3/4 bounds that size by d = (a + b) / 7 for sets of a and b shingles. Hence, of each set's non-empty
parts in one global order, the first d + 1 hold one that both sets have (pigeonhole). Sets of every size join by the value
of these parts, in bands of sizes (a factor of 2, about as many parts as the band's least size). A set with no more than d
non-empty parts joins with all of them, and again in a sketch of 16 times the places; in the smallest sketch in which one
of two sets has more than d parts, the argument holds for both. Parts that a sample of documents shares often come last in
the order, and the most frequent go straight to the large groups below; this changes cost, never results.

Documents with equal sets are one node (a 128-bit hash of the set), so copies are never paired. Groups of up to SMALL nodes
under one part name the pairs that sizes allow. Large groups that share their commonest node are one group. It gets a leader,
the member of a sample nearest to the shingles that most of the sample have, and every member that sizes and sketches allow meets
the leader on the whole texts. Members linked with the leader are closed: among themselves they need no comparison, as only
connectivity counts. Open members are held against all members of the group by their bit sketches, in cells of two blocks of
about BLOCK members each, which are spread over tasks; only pairs within the Hamming bound leave a cell. A group of near copies has
few open members and costs about its size; a group whose members share a part and little else costs a sketch distance for each
pair of which one is open.

Pairs are filtered by size and by the Hamming distance of bit sketches, then verified on the whole texts.

Defined cases: a null, empty or blank text has an empty set, no links and its own component; fewer than N words are one
shingle; ids are whole numbers (others raise Spark's cast error); null ids take part, and a component's id is the least
non-null one in it (null if there is none); repeated rows are copies; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alone, release, spare, stage
from .components import components

N = 5
SMALL = 48  # groups up to this size name the pairs whose sizes allow a link: at most (SMALL - 1) / 2 a member
SAMPLE = 32  # members of a large group, about, from which its leader is taken
BLOCK, BLOCK_BYTES = 1024, 16 << 20  # members, and bytes of sketches, of a block of a large group
HOT_RATE, HOT_TIMES, HOT_MOST = 16, 2, 200_000  # a part is hot if a sample of one text in 16 has it twice,
HOT_DIRECT = 8  # and its rows are not even brought together if the sample has it this often
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all (the splitmix64 finalizer, with its constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _Words()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    if not text:
        return np.zeros(0, _U)
    if len(_WORDS) > 400_000:
        _WORDS.clear()
    found = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space alone
    h = np.array([_WORDS[w] for w in found], _U)
    n = min(N, len(h))
    if not n:
        return h
    s = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        s = s * _U(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return np.unique(_mix(s + _U(n % N)))


def set_id(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name the set; (0, 0) is the empty one."""
    if not len(s):
        return 0, 0
    one, two = _mix(s + _U(1)).sum(dtype=_U) ^ _U(len(s)), _mix(s ^ _U(0xD1B54A32D192ED03)).sum(dtype=_U)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def sketch_parts(s: np.ndarray, bits: int, salt: int) -> np.ndarray:
    """Distinct values of the non-empty of 2 ** bits parts: XOR of the shingles in each, mixed with its place and the salt."""
    place = s >> _U(64 - bits) if bits else np.zeros(len(s), _U)
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return np.unique(_mix(np.bitwise_xor.reduceat(s, starts) ^ _mix(place[starts] + _mix(np.array([salt], _U)))))


def _sketches(s: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """The sketches in which a set joins: their parts, and how many of these it needs (d + 1)."""
    n = len(s)
    top = 4 * n // 3
    for band in range(n.bit_length() - 1, top.bit_length()) if n else ():
        need = (n + min(top, (2 << band) - 1)) // 7 + 1
        for bits in range(band, 68, 4):
            parts = sketch_parts(s, min(bits, 63), 256 * band + bits + 1)
            yield parts, need
            if len(parts) >= need:
                break


def join_keys(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The parts by which a set joins; those in hot (sorted) come last in the order."""
    found = [s[:0]]
    for parts, need in _sketches(s):
        late = _among(parts, hot)
        found.append(np.concatenate([parts[~late], parts[late]])[:need])
    return np.concatenate(found)


def _among(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(values), bool)
    return listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values


def _texts(batch: pa.RecordBatch, k: int) -> Iterator[str | None]:
    alone("shingles", _WORDS.clear)
    for lo in range(0, batch.num_rows, 500):
        yield from batch.column(k)[lo : lo + 500].to_pylist()


def sketch(s: np.ndarray) -> bytes:
    """Parity bits of a set, about two for each shingle: bit k is the parity of the hashes that end in k."""
    bits = 64 << max(0, int(2 * len(s) - 1).bit_length() - 6)
    return np.packbits((np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """At most the symmetric difference of the two sets; a longer sketch is folded to the shorter one's length."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


_ROW = pa.schema([("key", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("z", pa.int64()), ("id", pa.int64()), ("sketch", pa.binary())])
_ROW_SQL = "key long, x long, y long, z long, id long, sketch binary"


def _batch(schema: pa.Schema, rows: int, /, **columns) -> pa.RecordBatch:
    """Columns that are not given are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def _rows_of(hot: np.ndarray, direct: np.ndarray):
    """(id, text) -> a row (key, x, z) for each part that a set joins by, once a task for equal sets, with z twice the set's
    size, and one more for a direct part; and for each document a row (x, y, z, id, sketch) without a key, with z its size; only
    a set's first row in a task has the sketch. A node is the pair (x, y); x alone stands for it in groups, as these rows are
    many, and what a group names by x is looked for in every node that has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys, late, nodes, docs = [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), _texts(batch, 1), strict=True):
                s = shingles(t)
                node, own = set_id(s), None
                if len(s) and node not in seen:
                    seen.add(node)
                    own = sketch(s)
                    keys.append(join_keys(s, hot))
                    late.append(_among(keys[-1], direct))
                    nodes.append((node[0], len(s), len(keys[-1])))
                docs.append((*node, i, len(s), own))
                if len(keys) >= 500:
                    yield _key_rows(keys, late, nodes)
                    keys, late, nodes = [], [], []
            if keys:
                yield _key_rows(keys, late, nodes)
            if docs:
                yield _batch(_ROW, len(docs), **dict(zip(("x", "y", "id", "z", "sketch"), zip(*docs, strict=True), strict=True)))

    return run


def _key_rows(keys: list, late: list, nodes: list) -> pa.RecordBatch:
    x, z, n = (np.array(c, np.int64) for c in zip(*nodes, strict=True))
    return _batch(_ROW, int(n.sum()), key=np.concatenate(keys).view(np.int64), x=np.repeat(x, n), z=2 * np.repeat(z, n) + np.concatenate(late))


def _all_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> all parts and shingles of their distinct sets, to count which are frequent."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        for t in _texts(batch, 0):
            s = shingles(t)
            if len(s) and (node := set_id(s)) not in seen:
                seen.add(node)
                parts = np.concatenate([s, *(p for p, _ in _sketches(s))])
                yield pa.RecordBatch.from_arrays([pa.array(parts.view(np.int64)), pa.array(np.full(len(parts), node[0], np.int64))], ["key", "x"])


_GROUP = pa.schema([*((c, pa.int64()) for c in ("key", "x", "y", "bx", "id", "size")), ("sketch", pa.binary())])
_GROUP_SQL = "key long, x long, y long, bx long, id long, size long, sketch binary"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their keys -> pairs (x, bx) of small groups, each once a batch; members (key, x) of large ones.

    No group is held: once it is large, its members pass as they come. Direct rows pass at once, documents (without a key) too.
    """
    held = np.zeros((3, 0), np.int64)
    running = None  # the key of the large group that may go on

    def large(rows: np.ndarray) -> pa.RecordBatch:
        return _batch(_GROUP, rows.shape[1], key=rows[0], x=rows[1])

    def closed(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, sizes = _runs(rows[0])
        rows = _distinct(rows[:, np.repeat(sizes > 1, sizes)])
        if not rows.shape[1]:
            return
        starts, sizes = _runs(rows[0])
        first, within = np.repeat(starts, sizes), np.repeat(np.where(sizes <= SMALL, sizes, 0), sizes)
        place = np.arange(len(first)) - first
        pairs = [np.flatnonzero((place > k) & (within > k)) for k in range(within.max())]
        if pairs:
            a, b = np.concatenate([first[x] + k for k, x in enumerate(pairs)]), np.concatenate(pairs)
            fit = 4 * np.minimum(rows[2, a], rows[2, b]) >= 3 * np.maximum(rows[2, a], rows[2, b])
            two = _distinct(np.stack([rows[1, a[fit]], rows[1, b[fit]]]))
            yield _batch(_GROUP, two.shape[1], x=two[0], bx=two[1])
        rest = rows[:, np.repeat(sizes > SMALL, sizes)]
        if rest.shape[1]:
            yield large(rest)

    for b in batches:
        is_doc = b.column(0).is_null()
        if pc.any(is_doc).as_py():
            docs = b.filter(is_doc)
            yield _batch(_GROUP, docs.num_rows, **{c: docs.column(c) for c in ("x", "y", "id", "sketch")}, size=docs.column("z"))
            b = b.filter(pc.invert(is_doc))
        rows = np.stack([b.column(k).to_numpy() for k in (0, 1, 3)])
        direct = (rows[2] & 1).astype(bool)
        rows[2] >>= 1
        if direct.any():
            yield large(rows[:, direct])
            rows = rows[:, ~direct]
        if running is not None and (going := rows[0] == running).any():
            yield large(rows[:, going])
            rows = rows[:, ~going]
        rows = np.concatenate([held, rows], 1)
        if not rows.shape[1]:
            continue
        last = rows[0] == rows[0, -1]
        yield from closed(rows[:, ~last])
        held = _distinct(rows[:, last])
        if held.shape[1] > SMALL:
            running = int(held[0, 0])
            yield large(held)
            held = held[:, :0]
    yield from closed(held)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(key)))


def _distinct(rows: np.ndarray) -> np.ndarray:
    """By key and x; of rows with equal ones, one."""
    rows = rows[:, np.lexsort((rows[1], rows[0]))]
    fresh = np.ones(rows.shape[1], bool)
    fresh[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(0)
    return rows[:, fresh]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sizes, sketches) -> pairs whose sizes and sketches allow the similarity."""
    for batch in batches:
        keep = []
        for k, (n, m, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True)):
            if 4 * min(n, m) >= 3 * max(n, m) and sketch_distance(x, y) <= (n + m) // 7:
                keep.append(k)
        kept = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])


def _linked(same: int, a: int, b: int) -> bool:
    return 100 * same >= 75 * (a + b - same)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, texts) -> the linked pairs; the second text's set is kept while it stays the same."""
    last: tuple[int | None, np.ndarray] = (None, np.zeros(0, _U))
    for batch in batches:
        keep = []
        for k, (b, s, t) in enumerate(zip(batch.column(1).to_pylist(), _texts(batch, 2), _texts(batch, 3), strict=True)):
            if last[0] != b:
                last = (b, shingles(t))
            one, two = shingles(s), last[1]
            if _linked(len(np.intersect1d(one, two, assume_unique=True)), len(one), len(two)):
                keep.append(k)
        yield batch.take(pa.array(keep, pa.int64())).select(["a", "b"])


_LED = pa.schema([("up", pa.int64()), ("leader", pa.int64())])


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(up, no, text) of a few members of each group, in the order of up -> the group's leader: the member nearest to the shingles
    that more than half of them have, of equal ones the first.
    """
    now, held = None, []

    def made() -> pa.RecordBatch:
        values, times = np.unique(np.concatenate([s for _, s in held]), return_counts=True)
        centre = values[2 * times > len(held)]
        _, no = min((-len(np.intersect1d(s, centre, assume_unique=True)) / max(1, len(np.union1d(s, centre))), no) for no, s in held)
        return _batch(_LED, 1, up=[now], leader=[no])

    for batch in batches:
        for up, no, t in zip(*(batch.column(k).to_pylist() for k in range(2)), _texts(batch, 2), strict=True):
            if up != now:
                if held:
                    yield made()
                now, held = up, []
            held.append((no, shingles(t)))
    if held:
        yield made()


def _folded(sketches: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length in 64-bit words -> places, and the sketches of that length as rows."""
    lengths = np.array([len(x) >> 3 for x in sketches], np.int64)
    return {int(n): (at := np.flatnonzero(lengths == n), np.frombuffer(b"".join([sketches[i] for i in at]), _U).reshape(-1, n)) for n in np.unique(lengths)}


def _close(left: tuple, right: tuple | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of two blocks (numbers, sizes, sketches), or within one, whose sizes and sketches allow the similarity."""
    n, m = left[1], (right or left)[1]
    for words, (at, rows) in _folded(left[2]).items():
        for other, (to, cols) in _folded((right or left)[2]).items():
            short, x, y = min(words, other), rows, cols
            if max(words, other) > 2 * short:  # a set of more than twice the size
                continue
            if words > short:
                x = x[:, :short] ^ x[:, short:]
            if other > short:
                y = y[:, :short] ^ y[:, short:]
            step = max(1, (1 << 21) // max(1, short * len(y)))
            for lo in range(0, len(x), step):
                a, part = at[lo : lo + step], x[lo : lo + step]
                most = (n[a][:, None] + m[to][None, :]) // 7
                able = 4 * np.minimum(n[a][:, None], m[to][None, :]) >= 3 * np.maximum(n[a][:, None], m[to][None, :])
                if right is None:
                    able &= a[:, None] < to[None, :]
                able &= np.bitwise_count(part[:, None] ^ y[None]).sum(2, dtype=np.int64) <= most
                i, j = np.nonzero(able)
                yield a[i], to[j]


def _celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, second, no, size, sketch) in the order of cell and second -> pairs (a, b) of a cell's two blocks, or of its one."""
    now, held = None, ([], [])

    def made() -> Iterator[pa.RecordBatch]:
        if not held[0]:
            return
        blocks = [(np.array([r[0] for r in h], np.int64), np.array([r[1] for r in h], np.int64), [r[2] for r in h]) for h in held if h]
        one, two = blocks[0], blocks[1] if held[1] else None
        for i, j in _close(one, two):
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(one[0][i]), pa.array((two or one)[0][j])], ["a", "b"])

    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            for cell, second, *row in zip(*(c.to_pylist() for c in batch.slice(lo, 1000).columns), strict=True):
                if cell != now:
                    yield from made()
                    now, held = cell, ([], [])
                held[second].append(row)
    yield from made()


def _with(rows: DataFrame, table: DataFrame, on: dict[str, str], how: str = "inner") -> DataFrame:
    """A join by value (rows' column: table's column) that no size estimate turns into a broadcast; Spark splits hot keys."""
    held = table.withColumnsRenamed({c: f"__t_{c}" for c in on.values()}).hint("merge")
    joined = rows.join(held, [F.col(a) == F.col(f"__t_{b}") for a, b in on.items()], how)
    return joined.drop(*(f"__t_{b}" for b in on.values())) if how in ("inner", "left") else joined


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    both = _with(pairs, texts.select("no", F.col("text").alias("ta")), {"a": "no"})
    both = _with(both, texts.select("no", F.col("text").alias("tb")), {"b": "no"})
    return both.select("a", "b", "ta", "tb").mapInArrow(_verified, "a long, b long")


def _once(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def _able(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs that sizes and sketches allow."""
    both = _with(pairs, nodes.select("no", F.col("size").alias("sa"), F.col("sketch").alias("ka")), {"a": "no"})
    both = _with(both, nodes.select("no", F.col("size").alias("sb"), F.col("sketch").alias("kb")), {"b": "no"})
    return both.select("a", "b", "sa", "sb", "ka", "kb").mapInArrow(_near, "a long, b long")


def _regroup(rows: DataFrame, parts: int) -> DataFrame:
    """Rows dealt by key (direct ones and documents by node), in order, to their pairs and large groups."""
    by = F.when(F.col("key").isNull() | (F.col("z") % 2 == 1), F.xxhash64("key", "x")).otherwise(F.col("key"))
    return rows.repartition(parts, by).sortWithinPartitions("key").mapInArrow(_groups, _GROUP_SQL)


def _of_large(large: DataFrame, nodes: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Large groups (key, no) -> the links of their members with a leader, and the pairs that sizes and sketches allow of which
    one is open.
    """
    degree = large.groupBy("no").agg(F.count(F.lit(1)).alias("degree"))
    common = _with(large, degree, {"no": "no"}).groupBy("key").agg(F.max(F.struct("degree", "no"))["no"].alias("up"))
    members = stage(_with(large, common, {"key": "key"}).select("up", "no").distinct(), "join-members")
    sizes = members.groupBy("up").agg(F.count(F.lit(1)).alias("n"))
    some = _with(members, sizes, {"up": "up"}).filter((F.pmod(F.xxhash64("up", "no"), F.greatest(F.lit(1), F.floor(F.col("n") / SAMPLE))) == 0) | (F.col("no") == F.col("up")))
    some = _with(some.select("up", "no"), texts, {"no": "no"}).repartition("up").sortWithinPartitions("up", "no")
    led = stage(some.select("up", "no", "text").mapInArrow(_leaders, "up long, leader long"), "join-leaders")
    known = _with(members, led, {"up": "up"})
    met = known.select(F.col("leader").alias("a"), F.col("no").alias("b"))
    links = stage(_verify(_able(_once(met), nodes), texts), "join-led")

    both = links.select(F.col("a").alias("l"), F.col("b").alias("m")).union(links.select(F.col("b").alias("l"), F.col("a").alias("m")))
    told = _with(known, both.withColumn("closed", F.lit(True)), {"leader": "l", "no": "m"}, "left")
    told = told.withColumn("closed", F.coalesce("closed", F.lit(False)) | (F.col("no") == F.col("leader")))
    told = stage(_with(told, nodes.select("no", "size", "sketch"), {"no": "no"}).select("up", "no", "closed", "size", "sketch"), "join-told")
    amount = lambda c: F.greatest(F.ceil(F.count(F.when(c, 1)) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(c, F.octet_length("sketch"))), F.lit(0)) / BLOCK_BYTES))
    blocks = told.groupBy("up").agg(amount(~F.col("closed")).alias("n_open"), amount(F.col("closed")).alias("n_closed")).filter("n_open > 0")
    rows = _with(told, blocks, {"up": "up"}).withColumn("own", F.pmod(F.xxhash64("no", "up"), F.when(F.col("closed"), F.col("n_closed")).otherwise(F.col("n_open"))))
    # cells (i, j): two blocks of open members, i <= j; cells (i, n_open + j): one of open and one of closed ones
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    cell = lambda i, j, second: F.struct(i.alias("i"), j.alias("j"), second.alias("second"))
    own, n_open = F.col("own"), F.col("n_open")
    of_open = F.concat(
        F.transform(upto(n_open), lambda j: cell(F.least(own, j), F.greatest(own, j), (own > j).cast("int"))),
        F.transform(upto(F.col("n_closed")), lambda j: cell(own, n_open + j, F.lit(0))),
    )
    of_closed = F.transform(upto(n_open), lambda i: cell(i, n_open + own, F.lit(1)))
    spread = rows.withColumn("c", F.explode(F.when(F.col("closed"), of_closed).otherwise(of_open)))
    spread = spread.select(F.struct("up", "c.i", "c.j").alias("cell"), "c.second", "no", "size", "sketch").withColumn("cell", F.concat_ws(":", "cell.up", "cell.i", "cell.j"))
    pairs = spread.repartition("cell").sortWithinPartitions("cell", "second").mapInArrow(_celled, "a long, b long")
    return links, pairs


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """-> (id, x, y, n, no) for each document (no: its node's number, null where nothing may be linked with it), and the
    links (a, b) between numbers that make the components.

    Links within one large group are found up to connectivity: two members that are linked with its leader are not compared.
    """
    spark = docs.sparkSession
    work = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    some = work.filter(F.pmod(F.xxhash64("text"), F.lit(HOT_RATE)) == 0).select("text")
    often = some.mapInArrow(_all_parts, "key long, x long").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    often = often.filter((F.col("n") >= HOT_TIMES) & (F.col("x0") < F.col("x1")))
    # at most HOT_MOST keys; they order work and decide nothing
    listed = sorted((r.key, r.n) for r in often.orderBy(F.desc("n"), "key").limit(HOT_MOST).select("key", "n").collect())
    hot, direct = (np.sort(np.array([k for k, n in listed if n >= least], np.int64).view(_U)) for least in (HOT_TIMES, HOT_DIRECT))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = stage(_regroup(work.mapInArrow(_rows_of(hot, direct), _ROW_SQL), parts), "join-groups")
    release(spark)
    sets = grouped.filter("size IS NOT NULL").select("id", "x", "y", F.col("size").alias("n"))
    named = grouped.filter("size IS NULL").select(F.explode(F.array("x", "bx")).alias("x")).filter("x IS NOT NULL").distinct()

    # a number, one document and one sketch for each node that any group names
    found = _with(grouped.filter("size > 0").select("x", "y", "id", "size", "sketch"), named, {"x": "x"}, "left_semi")
    found = found.groupBy("x", "y").agg(F.min_by("id", F.struct(F.col("id").isNull(), F.col("id"))).alias("pid"), F.max("size").alias("size"), F.max("sketch").alias("sketch"))
    nodes = stage(found.withColumn("no", F.monotonically_increasing_id()), "join-nodes")
    number, half = nodes.select("x", "y", "no"), nodes.select("x", "no")
    pairs = grouped.filter("bx IS NOT NULL").select("x", "bx").distinct()
    pairs = _with(_with(pairs, half.withColumnRenamed("no", "a"), {"x": "x"}), half.withColumnRenamed("no", "b"), {"bx": "x"}).select("a", "b")
    near = stage(_able(_once(pairs), nodes), "join-near")
    large = _with(grouped.filter("key IS NOT NULL").select("key", "x"), half, {"x": "x"})
    large = stage(large.select("key", "no").distinct(), "join-large")

    # the texts of nodes in pairs that are left and of those in large groups, which may yet add pairs
    wanted = near.select(F.explode(F.array("a", "b")).alias("no")).union(large.select("no")).distinct()
    picked = _with(nodes.select("no", "x", "y", "pid"), wanted, {"no": "no"}, "left_semi")
    holders = work.join(picked.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("pid"))).select("no", "x", "y", "text")
    texts = stage((_right_text(holders).dropDuplicates(["no"]) if _repeated(sets) else holders).select("no", "text"), "join-texts")
    release(spark)

    if large.isEmpty():
        return _with(sets, number, {"x": "x", "y": "y"}, "left"), _verify(near, texts)
    links, pairs = _of_large(large, nodes, texts)
    linked = _verify(_once(near.union(pairs)), texts).union(links)
    return _with(sets, number, {"x": "x", "y": "y"}, "left"), linked


def _repeated(sets: DataFrame) -> bool:
    """Whether any id comes with different sets."""
    return not sets.groupBy("id").agg(((F.min("x") < F.max("x")) | (F.min("y") < F.max("y"))).alias("mixed")).filter("mixed").isEmpty()


def _right_text(holders: DataFrame) -> DataFrame:
    """Ids may repeat with other texts: keep the rows whose text has the node's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            keep = [set_id(shingles(t)) == node for node, t in zip(wanted, _texts(batch, 3), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return holders.mapInArrow(run, "no long, x long, y long, text string")


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """-> id, x, y, n, c (the same for a component's documents, null for empty sets), least (its least id)."""
    sets, links = similar(docs, id_col, text_col)
    part = components(links)
    joined = _with(sets, part, {"no": "node"}, "left")
    zero, none = F.lit(0).cast("long"), F.col("component").isNull()
    whole = F.struct(F.when(none, F.col("x")).otherwise(zero).alias("x"), F.when(none, F.col("y")).otherwise(zero).alias("y"), F.coalesce("component", F.lit(-1)).alias("of"))
    joined = stage(joined.select("id", "x", "y", "n", F.when(F.col("n") > 0, whole).alias("c")), "join-components")
    least = joined.filter("c IS NOT NULL").groupBy("c").agg(F.min("id").alias("least"))
    return _with(joined, least, {"c": "c"}, "left")


def group_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> id, n_shingles, component_id (the least id reachable by links) for each document."""
    placed = _placed(docs, id_col, text_col)
    return placed.select("id", F.col("n").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that with the least id, of rows that repeat it with the least hash of the row.
    Documents with an empty set are linked with nothing and all stay.
    """
    placed = _placed(docs, id_col, text_col)
    kept = placed.filter(F.col("c").isNull() | F.col("id").eqNullSafe(F.col("least")))
    named, x, y, order = (spare(docs, k) for k in ("id", "x", "y", "order"))
    number = F.col(id_col).cast("long")
    if placed.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").isEmpty():
        return docs.join(kept.select(F.col("id").alias(named)), number.eqNullSafe(F.col(named)), "left_semi")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [set_id(shingles(t)) for t in _texts(batch, at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([n[k] for n in names], pa.int64()) for k in (0, 1))], [*batch.schema.names, x, y])

    rows = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(x, T.LongType()), T.StructField(y, T.LongType())]))
    first = kept.filter("c IS NOT NULL").groupBy("c").agg(F.min(F.struct("id", "x", "y")).alias("first")).select(F.col("first.id").alias(named), F.col("first.x").alias("__x"), F.col("first.y").alias("__y"))
    ours = rows.join(first, number.eqNullSafe(F.col(named)) & (F.col(x) == F.col("__x")) & (F.col(y) == F.col("__y")), "left_semi")
    ranked = ours.withColumn(order, F.row_number().over(W.partitionBy(id_col, x, y).orderBy(F.xxhash64(*docs.columns))))
    empty = rows.filter((F.col(x) == 0) & (F.col(y) == 0))
    return ranked.filter(F.col(order) == 1).select(*docs.columns).union(empty.select(*docs.columns))
