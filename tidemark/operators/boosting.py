"""Second-order boosted trees for a two-class label, with L1 and L2 penalties and importances by gain.

Values are binned once by approximate quantiles, and rows are packed into blocks, which are checkpointed. For each level
of a tree every task sums gradients and hessians of its blocks by (node, feature, bin); the driver gets these sums, a few
thousand numbers whatever the number of rows, and picks the splits. A leaf is -soft(G, l1) / (H + l2) times the rate, where soft(G, l1)
takes l1 off the size of G. Margins of earlier trees are kept in the blocks and renewed every few trees.

Which rows and features a tree sees follows from hashes of the row's values and of the tree's number, so lost blocks that are made
again, in whatever order, give the same trees.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 1 << 16  # of a block
KEEP = 25  # trees after which margins are written into the blocks
PARTS = 64  # sums of more tasks than this are added up on executors first
_U = np.uint64


@dataclass
class Tree:
    """Nodes in level order, children of i at 2 i + 1 and 2 i + 2; feature -1: a leaf. Rows with bin <= split go left."""

    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n))

    def place(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row reaches, going down at most depth levels."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(depth):
            f = self.feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (bins[rows, f] > self.split[at]), at)
        return at


@dataclass
class Model:
    columns: list[str]
    edges: list[np.ndarray]
    base: float
    depth: int
    trees: list[Tree] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]).astype(np.uint8)

    def margin(self, bins: np.ndarray, trees: list[Tree]) -> np.ndarray:
        return sum((t.value[t.place(bins, self.depth)] for t in trees), np.zeros(len(bins)))

    def importances(self) -> dict[str, float]:
        """Mean gain of the splits on each feature, of all one."""
        total, times = np.zeros(len(self.columns)), np.zeros(len(self.columns))
        for t in self.trees:
            used = t.feature >= 0
            np.add.at(total, t.feature[used], t.gain[used])
            np.add.at(times, t.feature[used], 1)
        mean = np.divide(total, times, out=np.zeros_like(total), where=times > 0)
        return dict(zip(self.columns, (mean / mean.sum() if mean.sum() > 0 else mean).tolist(), strict=True))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _soft(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def _seen(keys: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    x = keys.view(_U) ^ _U((tree * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) % (1 << 64))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return (x ^ (x >> _U(31))) <= _U(min(int(share * 2.0**64), 2**64 - 1))


_BLOCK = pa.schema([("keys", pa.binary()), ("bins", pa.binary()), ("label", pa.binary()), ("margin", pa.binary())])
_BLOCK_SQL = "keys binary, bins binary, label binary, margin binary"


def _unpacked(row: dict, width: int) -> tuple[np.ndarray, ...]:
    kinds = (("keys", np.int64), ("bins", np.uint8), ("label", np.float64), ("margin", np.float64))
    keys, bins, label, margin = (np.frombuffer(row[c], k) for c, k in kinds)
    return keys, bins.reshape(-1, width), label, margin


def _blocks(df: DataFrame, label: str, model: Model, n: int) -> DataFrame:
    width = len(model.columns)
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in model.columns]
    rows = df.select(F.xxhash64(*values, F.col(label)).alias("key"), F.col(label).cast("double").alias("y"), F.array(*values).alias("x"))

    def packed(keys: np.ndarray, y: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(keys, kind="stable")
        parts = (keys[order], model.bins(x[order]), y[order], np.zeros(len(keys)))
        return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts], schema=_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).flatten().to_numpy().reshape(-1, width)))
            if sum(len(h[0]) for h in held) >= ROWS:
                yield packed(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held = []
        if sum(len(h[0]) for h in held):
            yield packed(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return rows.filter("y IS NOT NULL").repartition(-(-n // ROWS), "key").mapInArrow(run, _BLOCK_SQL)


def _written(blocks: DataFrame) -> tuple[DataFrame, int]:
    """blocks as checkpointed files, which end their plan, and how many tasks read them. The folder is the session's
    spark.checkpoint.dir; a folder of this machine only where none is named and executors are threads of the driver.
    """
    context = blocks.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir") or blocks.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='boosting-')}")
    held = blocks.checkpoint()
    return held, held._jdf.rdd().getNumPartitions()


def _histograms(blocks: DataFrame, parts: int, model: Model, recent: list[Tree], tree: Tree, number: int, level: int, n_bins: int, share: float, seed: int) -> np.ndarray:
    """(node of the level, feature, bin, gradient or hessian) summed over all rows that the tree sees."""
    width, base, depth = len(model.columns), model.base, model.depth
    first, nodes = 2**level - 1, 2**level
    shape = (nodes, width, n_bins, 2)
    light = Model(model.columns, [], base, depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for row in b.to_pylist():
                keys, bins, y, margin = _unpacked(row, width)
                p = _sigmoid(base + margin + light.margin(bins, recent))
                at = tree.place(bins, level) - first
                use = _seen(keys, number, seed, share) & (at >= 0)
                flat = (at[use][:, None] * width + np.arange(width)) * n_bins + bins[use]
                for k, v in enumerate((p - y, p * (1 - p))):
                    total[..., k] += np.bincount(flat.ravel(), np.repeat(v[use], width), nodes * width * n_bins).reshape(shape[:3])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((np.frombuffer(s, float) for b in batches for s in b.column(0).to_pylist()), np.zeros(int(np.prod(shape))))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    sums = blocks.mapInArrow(run, "sums binary")
    if parts > PARTS:
        sums = sums.repartition(PARTS).mapInArrow(add, "sums binary")
    return sum((np.frombuffer(r.sums, float) for r in sums.collect()), np.zeros(int(np.prod(shape)))).reshape(shape)


def split(tree: Tree, level: int, sums: np.ndarray, allowed: np.ndarray, l1: float, l2: float, least: float, rate: float) -> bool:
    """Set the nodes of a level from their sums, and the values of those below a split; whether any was split."""
    score = lambda g, h: _soft(g, l1) ** 2 / (h + l2)
    any_split = False
    for k in range(2**level):
        node = 2**level - 1 + k
        if level and tree.feature[(node - 1) // 2] < 0:
            continue
        g, h = sums[k, 0].sum(0)
        worth = lambda g, h: -rate * float(_soft(g, l1) / (h + l2))
        tree.value[node] = worth(g, h)
        left = sums[k].cumsum(1)[:, :-1]
        gl, hl = left[..., 0], left[..., 1]
        gain = score(gl, hl) + score(g - gl, h - hl) - score(g, h)
        gain = np.where((hl >= least) & (h - hl >= least) & allowed[:, None], gain, -np.inf)
        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[f, b] > 1e-12:
            tree.feature[node], tree.split[node], tree.gain[node] = f, b, gain[f, b]
            tree.value[2 * node + 1], tree.value[2 * node + 2] = worth(gl[f, b], hl[f, b]), worth(g - gl[f, b], h - hl[f, b])
            any_split = True
    return any_split


def fit(df: DataFrame, columns: list[str], label: str, trees: int = 300, depth: int = 4, rate: float = 0.05, l1: float = 0.1, l2: float = 1.0, least: float = 10.0, rows: float = 0.8, features: float = 0.8, n_bins: int = 64, seed: int = 42) -> Model:
    """A model of the label (0 or 1) from columns; nulls count as 0, rows without a label are left out. least: the hessian that each
    side of a split needs; rows and features: shares that each tree sees.
    """
    if not 2 <= n_bins <= 256:
        raise ValueError("between 2 and 256 bins")
    marks = [k / n_bins for k in range(1, n_bins)]
    known = df.filter(F.col(label).isNotNull())
    cuts = known.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.array(*map(F.lit, marks)), F.lit(10_000)).alias(f"c{j}") for j, c in enumerate(columns)]).first()
    model = Model(list(columns), [np.unique(np.array(cuts[f"c{j}"] or [], float)) for j in range(len(columns))], 0.0, depth)
    if not cuts.n:
        return model
    blocks, parts = _written(_blocks(df, label, model, cuts.n))
    recent: list[Tree] = []
    for number in range(trees):
        tree = Tree.empty(depth)
        order = np.random.default_rng([seed, number]).permutation(len(columns))
        allowed = np.isin(np.arange(len(columns)), order[: max(1, round(features * len(columns)))])
        for level in range(depth):
            sums = _histograms(blocks, parts, model, recent, tree, number, level, n_bins, rows, seed)
            if not split(tree, level, sums, allowed, l1, l2, least, rate):
                break
        model.trees.append(tree)
        recent.append(tree)
        if len(recent) == KEEP and number + 1 < trees:
            blocks, parts = _written(_renewed(blocks, model, recent))
            recent = []
    return model


def _renewed(blocks: DataFrame, model: Model, recent: list[Tree]) -> DataFrame:
    """blocks with the recent trees in their margins."""
    light, width = Model(model.columns, [], 0.0, model.depth), len(model.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                _, bins, _, margin = _unpacked(row, width)
                row["margin"] = (margin + light.margin(bins, recent)).tobytes()
                yield pa.RecordBatch.from_pylist([row], _BLOCK)

    return blocks.mapInArrow(run, _BLOCK_SQL)


def predicted(model: Model, df: DataFrame) -> DataFrame:
    """df with probability (of label 1) and prediction (0 or 1)."""
    arrow = df.limit(0).toArrow().schema.append(pa.field("probability", pa.float64())).append(pa.field("prediction", pa.int32()))
    sql = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "probability double", "prediction int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([np.nan_to_num(b.column(c).cast(pa.float64()).fill_null(0.0).to_numpy()) for c in model.columns])
            p = _sigmoid(model.base + model.margin(model.bins(x), model.trees))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p > 0.5).astype(np.int32))], schema=arrow)

    return df.mapInArrow(run, sql)


def importances(df: DataFrame, model: Model) -> DataFrame:
    """feature, importance: the mean gain of its splits, of all one."""
    return df.sparkSession.createDataFrame(list(model.importances().items()), "feature string, importance double")
