"""Repair of a conversation's structure at least cost, by a scan of min-plus matrices.

Rows of a conversation are edited so that the role initials read `(s?(ua)+)?`. Four states follow what has been given out:
nothing, s, u, a. Each row is a 4 x 4 matrix whose entry (i, j) is the cheapest way (cost, audit) from i to j by that row
alone; min-plus products are associative, so rows, blocks of a partition and partitions are multiplied as a tree. Costs
are compared first, then audits (one letter an edit) as ASCII. Insertions are closed: a matrix holds any insertions before
and after its row. Of two ways of equal cost through the same rows no audit begins the other (what is longer has an
insertion more, which costs), so the order survives what is appended, and the product is exact.

Edits: Keep costs 0; Rerole to user or assistant RETYPE; Delete DROP (required for blank and duplicate rows); Insert an empty
user or assistant row INSERT; a truncated row that is not deleted adds TRUNCATED.

A long conversation is spread over partitions by ranges of (conversation, turn). Each partition multiplies its part; the
first and last conversation of a partition may go on elsewhere, and only these meet again, 16 parts at a time. An audit
has a letter for each row, so it is as long as its conversation, and so is the row that carries it.

Defined cases: rows are ordered by turn (nulls first), equal turns by a hash of role and text; a null role or text counts as
one space; a null conv_id is a conversation; equal rows are counted, not listed, before they are sorted, and all but the first
are duplicates; other roles than s, u, a can be kept by no rule; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

RETYPE, DROP, INSERT, TRUNCATED = 3, 4, 3, 3
FANOUT, LEAF = 16, 8
SPACE = " \t\n\x0b\f\r"
_GO = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}  # states that a row with this initial joins
_LEGAL = {"su", "ua", "au"}
Matrix = tuple  # 16 entries (cost, audit) or None, by rows


def product(x: Matrix, y: Matrix) -> Matrix:
    out = []
    for i in (0, 4, 8, 12):
        for j in range(4):
            ways = [(a[0] + b[0], a[1] + b[1]) for k in range(4) if (a := x[i + k]) and (b := y[4 * k + j])]
            out.append(min(ways) if ways else None)
    return tuple(out)


def _entries(*ways: tuple[int, int, int, str]) -> Matrix:
    out: list = [None] * 16
    for i, j, cost, audit in ways:
        out[4 * i + j] = min(x for x in (out[4 * i + j], (cost, audit)) if x)
    return tuple(out)


_ONE = _entries(*((i, i, 0, "") for i in range(4)))
_STEP = _entries(*((i, i, 0, "") for i in range(4)), *((i, j, INSERT, "I") for i, j in _GO["u"] + _GO["a"]))
CLOSURE = reduce(product, [_STEP] * 3)  # no cheapest way inserts more than three rows at one place


@lru_cache(maxsize=64)
def _row(code: str) -> Matrix:
    """code: the row's initial (s, u, a, or x for others) and what it is (d: goes, t: truncated, k: neither)."""
    ways = [(i, i, DROP, "D") for i in range(4)]
    if code[1] != "d":
        more = TRUNCATED * (code[1] == "t")
        ways += [(i, j, more, "K") for i, j in _GO.get(code[0], ())] + [(i, j, RETYPE + more, "R") for i, j in _GO["u"] + _GO["a"]]
    return product(product(CLOSURE, _entries(*ways)), CLOSURE)


@lru_cache(maxsize=100_000)
def _leaf(codes: str) -> Matrix:
    return reduce(product, (_row(codes[i : i + 2]) for i in range(0, len(codes), 2)))


def dropped(times: int) -> Matrix:
    """A number of rows that all go."""
    return product(product(CLOSURE, _entries(*((i, i, DROP * times, "D" * times) for i in range(4)))), CLOSURE)


def tree(parts: list[Matrix]) -> Matrix:
    while len(parts) > 1:
        parts = [product(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else _ONE


def cheapest(m: Matrix) -> tuple[int, str]:
    return min(x for x in (m[0], m[3]) if x)


_SUMS = ("n", "blank", "duplicate", "truncated", "illegal")
_PART_SQL = "conv {0}, seg long, open boolean, n long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, initials string, costs array<long>, audits array<string>"


class _Part:
    """What is known of consecutive rows of a conversation."""

    def __init__(self, conv) -> None:
        self.conv, self.sums, self.turns, self.low, self.high, self.ends = conv, dict.fromkeys(_SUMS, 0), 0, None, None, ""
        self.codes: list[str] = []
        self.levels: list[tuple[int, Matrix]] = []  # as in a binary counter: sizes fall, so each row meets few products

    def add(self, turn, initial: str, times: int, fault: str) -> None:
        s = self.sums
        s["n"] += times
        s["blank"] += times if fault == "blank" else 0
        s["duplicate"] += 0 if fault == "blank" else times if fault == "duplicate" else times - 1
        s["truncated"] += fault == "truncated"
        s["illegal"] += (bool(s["n"] > times) and self.ends[-1] + initial not in _LEGAL) + times - 1
        self.ends = (self.ends or initial)[0] + initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.codes.append(initial + {"blank": "d", "duplicate": "d", "truncated": "t"}.get(fault, "k"))
        if len(self.codes) == LEAF or times > 1:
            self._push(_leaf("".join(self.codes)))
            self.codes.clear()
        if times > 1:
            self._push(dropped(times - 1))

    def _push(self, m: Matrix) -> None:
        size = 1
        while self.levels and self.levels[-1][0] <= size:
            n, left = self.levels.pop()
            m, size = product(left, m), n + size
        self.levels.append((size, m))

    def row(self, seg: int, open_: bool) -> dict:
        m = reduce(product, [x for _, x in self.levels] + ([_leaf("".join(self.codes))] if self.codes else []))
        return {"conv": self.conv, "seg": seg, "open": open_, **self.sums, "turns": self.turns, "low": self.low, "high": self.high, "initials": self.ends, "costs": [x and x[0] for x in m], "audits": [x and x[1] for x in m]}


def _scanned(kind: pa.DataType):
    """Rows of a partition in order -> a part for each of its conversations; the first and last are open."""
    schema = pa.schema(
        [("conv", kind), ("seg", pa.int64()), ("open", pa.bool_()), *((c, pa.int64()) for c in (*_SUMS, "turns", "low", "high")), ("initials", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, part, first, rows = TaskContext.get().partitionId(), None, True, []
        for batch in batches:
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part is None or conv != part.conv:
                    if part is not None:
                        rows.append(part.row(seg, first))
                        first = False
                    part = _Part(conv)
                part.add(*row)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if part is not None:
            yield pa.RecordBatch.from_pylist([part.row(seg, True)], schema)

    return run


def _matrix(costs: list, audits: list) -> Matrix:
    return tuple(None if c is None else (c, a) for c, a in zip(costs, audits, strict=True))


def _joined(table: pa.Table) -> pa.Table:
    """Parts of one conversation, at most FANOUT of them -> their product."""
    parts = sorted(table.to_pylist(), key=lambda r: r["seg"])
    out, known = dict(parts[0]), [r for r in parts if r["turns"]]
    out |= {c: sum(r[c] for r in parts) for c in (*_SUMS, "turns")}
    ends = [r["initials"] for r in parts]
    out["illegal"] += sum(x[-1] + y[0] not in _LEGAL for x, y in zip(ends, ends[1:], strict=False))
    out["initials"] = ends[0][0] + ends[-1][-1]
    out["turns"] -= sum(x["high"] == y["low"] for x, y in zip(known, known[1:], strict=False))
    if known:
        out["low"], out["high"] = known[0]["low"], known[-1]["high"]
    m = tree([_matrix(r["costs"], r["audits"]) for r in parts])
    out["costs"], out["audits"] = [x and x[0] for x in m], [x and x[1] for x in m]
    return pa.Table.from_pylist([out], table.schema)


def ordered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """-> conv, turn, initial, times, fault, role, text, digest: equal rows as one with how often they come, and the first fault."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))
    named = named.withColumn("digest", F.sha2(F.concat("role", F.lit("\n"), "text"), 256))
    rows = named.groupBy("conv", "turn", "digest").agg(F.count(F.lit(1)).alias("times"), F.any_value("role").alias("role"), F.any_value("text").alias("text"))
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = named.groupBy(F.col("conv").alias("c2"), F.col("digest").alias("d2")).agg(F.min(at).alias("first"))
    rows = rows.join(first.hint("merge"), F.col("conv").eqNullSafe(F.col("c2")) & (F.col("digest") == F.col("d2")))
    end = F.rtrim("text", F.lit(SPACE))
    fault = F.when(end == "", "blank").when(~at.eqNullSafe(F.col("first")), "duplicate").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    initial = F.substring("role", 1, 1)
    return rows.select("conv", "turn", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), "times", fault.alias("fault"), "role", "text", "digest")


def audit(rows: DataFrame) -> DataFrame:
    """ordered(...) -> conv, gaps, blank, duplicate, truncated, illegal, cost, audit for each conversation that has rows."""
    spark = rows.sparkSession
    kind, arrow = rows.schema["conv"].dataType, rows.select("conv").limit(0).toArrow().schema.field(0).type
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "conv", "turn", "digest").sortWithinPartitions("conv", "turn", "digest")
    sql = _PART_SQL.format(kind.simpleString())
    scanned = stage(dealt.select("conv", "turn", "initial", "times", "fault").mapInArrow(_scanned(arrow), sql), "conversation-parts")
    whole, loose, width = scanned.filter(~F.col("open")), scanned.filter("open"), 1
    while width < parts:  # 16 parts at a time, as many rounds as that takes
        width *= FANOUT
        loose = loose.groupBy("conv", F.floor(F.col("seg") / width).alias("block")).applyInArrow(_joined, sql)
    all_ = whole.union(loose)
    best = all_.mapInArrow(_closed(arrow), f"conv {kind.simpleString()}, blank long, duplicate long, truncated long, illegal long, gaps long, cost long, audit string")
    return best.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _closed(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = [cheapest(_matrix(c, a)) for c, a in zip(b.column("costs").to_pylist(), b.column("audits").to_pylist(), strict=True)]
            gaps = [0 if low is None else high - low + 1 - n for low, high, n in zip(*(b.column(c).to_pylist() for c in ("low", "high", "turns")), strict=True)]
            cols = [b.column("conv").cast(kind), *(b.column(c) for c in _SUMS[1:]), pa.array(gaps, pa.int64()), pa.array([c for c, _ in best], pa.int64()), pa.array([a for _, a in best], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["conv", *_SUMS[1:], "gaps", "cost", "audit"])

    return run


def edited(rows: list[tuple[str, str]] | Iterator[tuple[str, str]], letters: str) -> Iterator[tuple[str, str]]:
    """Rows (role, text) in order, and the audit -> the repaired rows. The number of rows given out says where roles start."""
    left = 1 - (len(letters) - letters.count("D")) % 2  # 0: the first row out is a kept system row
    rows = iter(rows)
    for x in letters:
        role, text = ("", "") if x == "I" else next(rows)
        if x != "D":
            if x != "K":
                role = "user" if left % 2 else "assistant"
            left += 1
            yield role, text


def _repaired(kind: pa.DataType, digest: bool):
    """Sorted rows (conv, audit, times, role, text), the audit's first -> repaired rows, or the digest of each conversation."""
    schema = pa.schema([("conv", kind), ("sha256", pa.string())] if digest else [("conv", kind), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                yield from zip(*(c.to_pylist() for c in batch.slice(lo, 500).columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, out = stream(batches), []
        ahead = next(source, None)
        while ahead is not None:
            conv, letters = ahead[0], ahead[1]

            def own(conv=conv) -> Iterator[tuple[str, str]]:
                nonlocal ahead
                while (ahead := next(source, None)) is not None and ahead[1] is None:
                    for _ in range(ahead[2]):
                        yield ahead[3], ahead[4]

            rows = own()
            sha = hashlib.sha256()
            for k, (role, text) in enumerate(edited(rows, letters)):
                if digest:
                    sha.update((("\n" if k else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                else:
                    out.append({"conv": conv, "position": k, "role": role, "text": text})
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            for _ in rows:  # up to the next audit
                pass
            if digest:
                out.append({"conv": conv, "sha256": sha.hexdigest()})
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def repaired(rows: DataFrame, audits: DataFrame, digest: bool = False) -> DataFrame:
    """ordered(...) and audit(...) -> the repaired rows (conv, position, role, text), or with digest the SHA-256 of each
    conversation's `role:text` lines (conv, sha256).

    A conversation is streamed in one task, as its digest needs; memory holds its audit and a batch of rows.
    """
    kind, arrow = rows.schema["conv"].dataType.simpleString(), rows.select("conv").limit(0).toArrow().schema.field(0).type
    null = lambda t, c: F.lit(None).cast(t).alias(c)
    lines = rows.select("conv", null("string", "audit"), "times", "role", "text", F.lit(1).alias("at"), "turn", "digest")
    heads = audits.select("conv", "audit", null("long", "times"), null("string", "role"), null("string", "text"), F.lit(0).alias("at"), null("long", "turn"), null("string", "digest"))
    dealt = heads.union(lines).repartition("conv").sortWithinPartitions("conv", "at", "turn", "digest")
    sql = f"conv {kind}, sha256 string" if digest else f"conv {kind}, position long, role string, text string"
    return dealt.select("conv", "audit", "times", "role", "text").mapInArrow(_repaired(arrow, digest), sql)


def damage(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text), broken by crc32 of `conv_id:turn` modulo 20: 0 goes, 1 loses its text, 2 its sentence
    ends, 3 comes twice, 4 becomes a user's. Nulls count as one space.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(named("text"), "[.!?]", "")).otherwise(named("text"))
    return turns.filter(code != 0).select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(named("role")).alias("role"), text.alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(code == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")
