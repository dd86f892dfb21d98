"""Regularised gradient boosting on histograms, with the model as a table of nodes.

Squared loss on binned features. A leaf of gradient sum G over H rows gets the weight
``-T(G) / (H + l2)``, ``T(G) = sign(G) max(|G| - l1, 0)``, times the learning rate; a split's
gain is the rise of ``T(G)^2 / (H + l2)`` summed over its sides. Rows are drawn per tree by a
hash of their key, columns per tree.

Training rows are stored once as blocks of one byte per feature, with target, key hash and the
running prediction. A tree grows in two kinds of Spark jobs:

* nodes of more than ``small_node`` rows, level by level: every task adds its rows into one
  histogram per (node, feature), the histograms are shuffled by (node, feature) and summed, and
  the best split of each leaves the task; the driver sees one row per (node, feature);
* all smaller nodes at once: their rows are shuffled by node, and a task grows the rest of the
  subtree below each node from at most ``small_node`` rows.

Both search splits with the same function. Gradients are fixed-point integers, so sums do not
depend on the order or the number of tasks, and neither does the model.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cosignal.session import cut_lineage

# Functions that run inside tasks travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = float(1 << 28)      # gradients per unit: n * max|g| may reach 3e10
BLOCK_ROWS = 65_536
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class BoostParams:
    """The defaults are the reference's full-size settings."""
    trees: int = 800
    depth: int = 10
    rate: float = 0.03
    row_share: float = 0.85
    column_share: float = 0.85
    l2: float = 5.0
    l1: float = 1.0
    bins: int = 256              # at most 256: one byte per value
    least_rows: int = 1          # rows on either side of a split
    seed: int = 42
    small_node: int = 65_536     # rows one task may take to finish a subtree
    trees_per_write: int = 32    # trees between two writes of the running predictions


#: A tree's nodes: parallel arrays; a leaf's children are itself.
@dataclass
class Tree:
    feature: list[int]
    cut: list[int]          # bin: values in bins up to this one go left
    left: list[int]
    right: list[int]
    grad: list[int]
    cover: list[int]
    gain: list[float]

    @staticmethod
    def root() -> Tree:
        return Tree([0], [0], [0], [0], [0], [0], [0.0])

    def split(self, node: int, feature: int, cut: int, gain: float, sides: list[tuple[int, int]]) -> list[int]:
        made = []
        for grad, cover in sides:
            made.append(len(self.feature))
            for column, value in zip((self.feature, self.cut, self.left, self.right, self.grad, self.cover, self.gain),
                                     (0, 0, made[-1], made[-1], grad, cover, 0.0)):
                column.append(value)
        self.feature[node], self.cut[node], self.gain[node] = feature, cut, gain
        self.left[node], self.right[node] = made
        return made

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(c) for c in (self.feature, self.cut, self.left, self.right))


def threshold_l1(g: np.ndarray | float, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def leaf_value(grad: float, cover: float, p: BoostParams):
    return -p.rate * threshold_l1(grad / SCALE, p.l1) / (cover + p.l2)


def best_splits(grad: np.ndarray, cover: np.ndarray, p: BoostParams
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per histogram (last axis: bins): gain, bin, gradient and rows of the left side of its
    best split; ties go to the lowest bin. A gain of 0 means no split."""
    g, h = np.cumsum(grad, -1), np.cumsum(cover, -1)
    all_g, all_h = g[..., -1:], h[..., -1:]

    def worth(a, b):
        return threshold_l1(a / SCALE, p.l1) ** 2 / (b + p.l2)

    gain = worth(g, h) + worth(all_g - g, all_h - h) - worth(all_g, all_h)
    gain = np.where((h >= p.least_rows) & (all_h - h >= p.least_rows) & (gain > LEAST_GAIN), gain, 0.0)
    at = np.argmax(gain, -1)
    take = lambda x: np.take_along_axis(x, at[..., None], -1)[..., 0]
    return take(gain), at, take(g), take(h)


def histograms(bins: np.ndarray, grad: np.ndarray, node: np.ndarray, nodes: int, p: BoostParams
               ) -> tuple[np.ndarray, np.ndarray]:
    """(node, feature, bin) sums of gradients and rows; sums are exact (integers below 2^53)."""
    features = len(bins)
    slot = (node * features + np.arange(features)[:, None]) * p.bins + bins
    shape, size = (nodes, features, p.bins), nodes * features * p.bins
    g = np.bincount(slot.ravel(), np.broadcast_to(grad.astype(float), bins.shape).ravel(), size).astype(np.int64)
    return g.reshape(shape), np.bincount(slot.ravel(), minlength=size).reshape(shape)


def grow(tree: Tree, frontier: list[int], bins: np.ndarray, grad: np.ndarray, node: np.ndarray,
         columns: list[int], levels: int, p: BoostParams) -> None:
    """Grow ``tree`` below ``frontier`` in place, all rows in memory; ``node`` is each row's node."""
    for _ in range(levels):
        frontier = [f for f in frontier if tree.cover[f] >= 2 * p.least_rows]
        if not frontier:
            return
        place = np.full(len(tree.feature), -1)
        place[frontier] = np.arange(len(frontier))
        rows = np.flatnonzero(place[node] >= 0)
        part, made = place[node[rows]], []
        order = np.argsort(part, kind="stable")
        rows, part = rows[order], part[order]
        for first in range(0, len(frontier), 64):           # 64 nodes' histograms at a time
            some = frontier[first:first + 64]
            lo, hi = np.searchsorted(part, [first, first + len(some)])
            g, h = histograms(bins[columns][:, rows[lo:hi]], grad[rows[lo:hi]], part[lo:hi] - first, len(some), p)
            gain, at, left_g, left_h = best_splits(g, h, p)
            best = np.argmax(gain, 1)
            for i, n in enumerate(some):
                f = best[i]
                if gain[i, f] > 0:
                    gl, hl = int(left_g[i, f]), int(left_h[i, f])
                    made += tree.split(n, columns[f], int(at[i, f]), float(gain[i, f]),
                                       [(gl, hl), (tree.grad[n] - gl, tree.cover[n] - hl)])
        node[rows] = step(tree.arrays(), bins[:, rows], node[rows])
        frontier = made


def step(arrays: tuple[np.ndarray, ...], bins: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Each row one level further down (rows at a leaf stay)."""
    feature, cut, left, right = arrays
    goes_left = bins[feature[node], np.arange(bins.shape[1])] <= cut[node]
    return np.where(goes_left, left[node], right[node])


def descend(tree: Tree, bins: np.ndarray, depth: int) -> np.ndarray:
    node, arrays = np.zeros(bins.shape[1], np.int64), tree.arrays()
    for _ in range(depth):
        node = step(arrays, bins, node)
    return node


def drawn(key: np.ndarray, tree: int, p: BoostParams) -> np.ndarray:
    """Rows of a tree's sample, by their key hash and the tree's number."""
    with np.errstate(over="ignore"):
        x = key.view(np.uint64) ^ np.uint64((p.seed * 0x9E3779B97F4A7C15 + tree * 0xBF58476D1CE4E5B9) % 2 ** 64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)) < np.uint64(int(p.row_share * 2 ** 53))


def drawn_columns(n: int, tree: int, p: BoostParams) -> list[int]:
    some = np.random.default_rng([p.seed, tree]).permutation(n)[:max(1, int(p.column_share * n))]
    return sorted(some.tolist())


# -- data ------------------------------------------------------------------------------

def cut_points(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Upper ends of the bins of each feature: its distinct approximate quantiles (exact up to
    10,000 distinct values). At most ``bins - 1`` numbers per feature reach the driver."""
    at = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), at, 10_000).alias(c) for c in features]).first()
    return [sorted(set(found[c] or [])) for c in features]


KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(),
         "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


class Rows:
    """Column names and kinds of an intermediate table, for Spark and for Arrow."""

    def __init__(self, **kinds: str) -> None:
        self.ddl = ", ".join(f"`{c}` {k.replace('long', 'bigint')}" for c, k in kinds.items())
        self.arrow = pa.schema([(c, KINDS[k]) for c, k in kinds.items()])

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, self.arrow)


BLOCK = Rows(n="int", bins="binary", target="binary", key="binary", margin="binary")
HISTOGRAM = Rows(node="int", col="int", g="binary", h="binary")
SPLIT = Rows(node="int", col="int", gain="double", cut="int", left_g="long", left_h="long", g="long", h="long")
PIECE = Rows(node="int", n="int", bins="binary", grad="binary")
SUBTREE = Rows(root="int", feature="array<long>", cut="array<long>", left="array<long>", right="array<long>",
               grad="array<long>", cover="array<long>", gain="array<double>")


def store_blocks(rows: DataFrame, features: list[str], label: str, keys: list[str], cuts: list[list[float]],
                 base: float) -> DataFrame:
    """Rows as blocks of at most ``BLOCK_ROWS``; a null feature goes to the lowest bin, a row
    without target is left out."""
    given = rows.filter(F.col(label).isNotNull()).select(
        *[F.col(c).cast("double") for c in features], F.col(label).cast("double").alias("_y"),
        F.xxhash64(*keys).alias("_key"))
    edges = [np.array(c) for c in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                made = []
                for c, e in zip(features, edges):
                    x = part.column(c).to_numpy(zero_copy_only=False)
                    made.append(np.where(np.isnan(x), 0, np.searchsorted(e, x, "left")).astype(np.uint8))
                y = part.column("_y").to_numpy(zero_copy_only=False)
                key = part.column("_key").to_numpy(zero_copy_only=False)
                yield BLOCK.batch(
                    [{"n": len(y), "bins": np.stack(made).tobytes(), "target": y.tobytes(), "key": key.tobytes(),
                      "margin": np.full(len(y), base).tobytes()}])

    return cut_lineage(given.mapInArrow(run, BLOCK.ddl), "boost-blocks")


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    for r in batch.to_pylist():
        yield (np.frombuffer(r["bins"], np.uint8).reshape(-1, r["n"]), np.frombuffer(r["target"]),
               np.frombuffer(r["key"], np.int64), np.frombuffer(r["margin"]))


def tree_state(batch: pa.RecordBatch, tree: Tree, number: int, recent: list[Tree], p: BoostParams):
    """Per block: bins, fixed-point gradients and nodes of the rows drawn for the tree."""
    for bins, y, key, margin in unpacked(batch):
        rows = np.flatnonzero(drawn(key, number, p))
        bins, margin = bins[:, rows], margin[rows].copy()
        for t in recent:
            margin += tree_values(t, bins, p)
        grad = np.rint((margin - y[rows]) * SCALE).astype(np.int64)
        yield bins, grad, descend(tree, bins, p.depth)


def tree_values(t: Tree, bins: np.ndarray, p: BoostParams) -> np.ndarray:
    values = np.array([leaf_value(g, c, p) for g, c in zip(t.grad, t.cover)])
    return values[descend(t, bins, p.depth)]


class Grower:
    """Grows trees over stored blocks, one after the other."""

    def __init__(self, blocks: DataFrame, features: int, p: BoostParams) -> None:
        self.blocks, self.features, self.p = blocks, features, p
        self.rows = int(blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        self.tasks = blocks.sparkSession.sparkContext.defaultParallelism
        self.done: list[Tree] = []

    def _level(self, tree: Tree, number: int, recent: list[Tree], nodes: list[int], columns: list[int]) -> list[tuple]:
        """(node, gain, column, bin, left gradient, left rows, gradient, rows) per (node, column)."""
        p = self.p
        place = {n: i for i, n in enumerate(nodes)}

        def add(batches):
            total = None
            for batch in batches:
                for bins, grad, node in tree_state(batch, tree, number, recent, p):
                    at = np.full(len(tree.feature), -1)
                    at[list(place)] = list(place.values())
                    rows = np.flatnonzero(at[node] >= 0)
                    made = histograms(bins[columns][:, rows], grad[rows], at[node[rows]], len(nodes), p)
                    total = made if total is None else (total[0] + made[0], total[1] + made[1])
            if total is not None:
                yield HISTOGRAM.batch(
                    [{"node": n, "col": c, "g": total[0][i, j].tobytes(), "h": total[1][i, j].tobytes()}
                     for n, i in place.items() for j, c in enumerate(columns)])

        def find(batches):
            sums: dict[tuple[int, int], list[np.ndarray]] = {}
            for batch in batches:
                for r in batch.to_pylist():
                    pair = [np.frombuffer(r["g"], np.int64), np.frombuffer(r["h"], np.int64)]
                    old = sums.get((r["node"], r["col"]))
                    sums[r["node"], r["col"]] = pair if old is None else [old[0] + pair[0], old[1] + pair[1]]
            if sums:
                out = []
                for (n, c), (g, h) in sums.items():
                    gain, cut, left_g, left_h = best_splits(g, h, p)
                    out.append({"node": n, "col": c, "gain": float(gain), "cut": int(cut), "left_g": int(left_g),
                                "left_h": int(left_h), "g": int(g.sum()), "h": int(h.sum())})
                yield SPLIT.batch(out)

        parts = min(self.tasks * 4, len(nodes) * len(columns))
        found = (self.blocks.mapInArrow(add, HISTOGRAM.ddl).repartition(parts, "node", "col").mapInArrow(find, SPLIT.ddl)).collect()
        return sorted(found, key=lambda r: (r.node, -r.gain, r.col))

    def _finish(self, tree: Tree, number: int, recent: list[Tree], small: dict[int, int], columns: list[int]) -> None:
        """Grow the subtrees below ``small`` (node -> levels left) and hang them into ``tree``."""
        p = self.p

        def deal(batches):
            for batch in batches:
                for bins, grad, node in tree_state(batch, tree, number, recent, p):
                    for n in small:
                        rows = np.flatnonzero(node == n)
                        if len(rows):
                            yield PIECE.batch([{"node": n, "n": len(rows), "bins": bins[:, rows].tobytes(),
                                                "grad": grad[rows].tobytes()}])

        def finish(batches):
            held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for batch in batches:
                for r in batch.to_pylist():
                    held.setdefault(r["node"], []).append((np.frombuffer(r["bins"], np.uint8).reshape(-1, r["n"]),
                                                           np.frombuffer(r["grad"], np.int64)))
            for n, pieces in held.items():
                bins, grad = (np.concatenate(x, axis=-1) for x in zip(*pieces))
                sub = Tree.root()
                sub.grad[0], sub.cover[0] = int(grad.sum()), len(grad)
                grow(sub, [0], bins, grad, np.zeros(len(grad), np.int64), columns, small[n], p)
                yield SUBTREE.batch([{"root": n, **vars(sub)}])

        parts = min(self.tasks * 4, len(small))
        for r in sorted(self.blocks.mapInArrow(deal, PIECE.ddl).repartition(parts, "node").mapInArrow(finish, SUBTREE.ddl).collect(),
                        key=lambda r: r.root):
            offset = len(tree.feature) - 1                   # node 0 of the subtree is ``root`` itself
            where = [r.root if i == 0 else i + offset for i in range(len(r.feature))]
            for i, at in enumerate(where):
                values = (r.feature[i], r.cut[i], where[r.left[i]], where[r.right[i]], r.grad[i], r.cover[i], r.gain[i])
                for column, value in zip((tree.feature, tree.cut, tree.left, tree.right, tree.grad, tree.cover, tree.gain),
                                         values):
                    if i == 0:
                        column[at] = value
                    else:
                        column.append(value)

    def next_tree(self) -> Tree:
        p, number = self.p, len(self.done)
        recent = self.done[number - number % p.trees_per_write:]
        if number and not recent:
            self._write(self.done[-p.trees_per_write:])
        columns, tree = drawn_columns(self.features, number, p), Tree.root()
        tree.cover[0] = self.rows
        frontier, small = [0], {}
        for level in range(p.depth):
            small.update({n: p.depth - level for n in frontier if tree.cover[n] <= p.small_node
                          and tree.cover[n] >= 2 * p.least_rows})
            frontier = [n for n in frontier if tree.cover[n] > p.small_node]
            if not frontier:
                break
            made, seen = [], set()
            for r in self._level(tree, number, recent, frontier, columns):
                if r.node in seen:
                    continue
                seen.add(r.node)
                tree.grad[r.node], tree.cover[r.node] = r.g, r.h
                if r.gain > 0:
                    made += tree.split(r.node, r.col, r.cut, r.gain, [(r.left_g, r.left_h), (r.g - r.left_g, r.h - r.left_h)])
            frontier = made
        if small:
            self._finish(tree, number, recent, small, columns)
        self.done.append(tree)
        return tree

    def _write(self, trees: list[Tree]) -> None:
        """Add the trees' values to the stored running predictions."""
        p = self.p

        def run(batches):
            for batch in batches:
                out = []
                for row, (bins, _, _, margin) in zip(batch.to_pylist(), unpacked(batch)):
                    margin = margin.copy()
                    for t in trees:
                        margin += tree_values(t, bins, p)
                    out.append({**row, "margin": margin.tobytes()})
                yield BLOCK.batch(out)

        self.blocks = cut_lineage(self.blocks.mapInArrow(run, BLOCK.ddl), "boost-blocks")


# -- model -----------------------------------------------------------------------------

NODE = T.StructType([T.StructField(*f) for f in (
    ("tree", T.IntegerType()), ("node", T.IntegerType()), ("parent", T.IntegerType()), ("feature", T.StringType()),
    ("threshold", T.DoubleType()), ("left", T.IntegerType()), ("right", T.IntegerType()), ("value", T.DoubleType()),
    ("gain", T.DoubleType()), ("cover", T.LongType()))])


@dataclass
class BoostedModel:
    """``base`` and a table of nodes: (tree, node, parent, feature, threshold, left, right, value,
    gain, cover). A row goes left where ``feature <= threshold`` (a null goes left); ``value`` is
    what the node would add to the prediction if it were a leaf."""
    base: float
    features: list[str]
    nodes: list[tuple]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes, NODE)

    def save(self, spark: SparkSession, path: str) -> None:
        meta = [(self.base, self.features)]
        spark.createDataFrame(meta, "base double, features array<string>").write.mode("overwrite").parquet(f"{path}/meta")
        self.table(spark).write.mode("overwrite").parquet(f"{path}/nodes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedModel:
        meta = spark.read.parquet(f"{path}/meta").first()
        nodes = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect()
        return BoostedModel(meta.base, list(meta.features), [tuple(r) for r in nodes])

    def flat(self) -> list[tuple[np.ndarray, ...]]:
        """Per tree: feature number, threshold, left, right, value."""
        number = {f: i for i, f in enumerate(self.features)}
        trees: list[list[tuple]] = []
        for n in self.nodes:
            if n[1] == 0:
                trees.append([])
            trees[-1].append((number.get(n[3], 0), n[4] if n[4] is not None else 0.0, n[5], n[6], n[7]))
        return [tuple(np.array(c) for c in zip(*t)) for t in trees]


def fit(rows: DataFrame, features: list[str], label: str, keys: list[str], p: BoostParams = BoostParams()) -> BoostedModel:
    """Fit on the rows with a target. ``keys`` name a row (for the row sample). Rows that repeat
    count as often as they occur; without any row the model predicts 0."""
    if not 2 <= p.bins <= 256:
        raise ValueError("bins must be 2 to 256")
    base = rows.agg(F.avg(F.col(label).cast("double"))).first()[0]
    if base is None:
        return BoostedModel(0.0, list(features), [])
    cuts = cut_points(rows, features, p.bins)
    grower = Grower(store_blocks(rows, features, label, keys, cuts, base), len(features), p)
    nodes: list[tuple] = []
    for number in range(p.trees):
        t = grower.next_tree()
        parent = [-1] * len(t.feature)
        for i, (a, b) in enumerate(zip(t.left, t.right)):
            if a != i:
                parent[a] = parent[b] = i
        for i in range(len(t.feature)):
            inner = t.left[i] != i
            nodes.append((number, i, parent[i], features[t.feature[i]] if inner else None,
                          float(cuts[t.feature[i]][t.cut[i]]) if inner else None, t.left[i], t.right[i],
                          float(leaf_value(t.grad[i], t.cover[i], p)), float(t.gain[i]), int(t.cover[i])))
    return BoostedModel(float(base), list(features), nodes)


def _scored(model: BoostedModel, df: DataFrame, schema: T.StructType, columns) -> DataFrame:
    """``df`` with columns made from the matrix of its features, a batch at a time."""
    wide = df.select("*", *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(model.features)])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(len(model.features))])
            x = np.where(np.isnan(x), -np.inf, x)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns(x)],
                                             names=[f.name for f in schema])

    return wide.mapInArrow(run, schema)


def _walk(tree: tuple[np.ndarray, ...], x: np.ndarray, on_step=None) -> np.ndarray:
    feature, threshold, left, right, value = tree
    node, rows = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1])
    while True:
        down = np.where(x[feature[node], rows] <= threshold[node], left[node], right[node])
        moved = down != node
        if not moved.any():
            return value[node]
        if on_step is not None:
            on_step(rows[moved], feature[node[moved]], value[down[moved]] - value[node[moved]])
        node = down


def predict(model: BoostedModel, df: DataFrame, name: str = "prediction") -> DataFrame:
    """``df`` with the model's prediction."""
    trees = model.flat()

    def columns(x):
        total = np.full(x.shape[1], model.base)
        for t in trees:
            total += _walk(t, x)
        return [pa.array(total)]

    return _scored(model, df, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]), columns)


def contributions(model: BoostedModel, df: DataFrame) -> DataFrame:
    """``df`` with ``prediction``, ``bias`` and ``contributions`` (feature -> what the splits on it
    added along the row's paths); bias and contributions sum to the prediction."""
    trees = model.flat()
    bias = model.base + sum(float(t[4][0]) for t in trees)
    schema = T.StructType([*df.schema.fields, T.StructField("prediction", T.DoubleType()),
                           T.StructField("bias", T.DoubleType()),
                           T.StructField("contributions", T.MapType(T.StringType(), T.DoubleType()))])

    def columns(x):
        total, parts = np.full(x.shape[1], model.base), np.zeros(x.shape)
        for t in trees:
            total += _walk(t, x, lambda rows, f, d: np.add.at(parts, (f, rows), d))
        lists = [list(zip(model.features, col)) for col in parts.T.tolist()]
        return [pa.array(total), pa.array(np.full(x.shape[1], bias)), pa.array(lists, pa.map_(pa.string(), pa.float64()))]

    return _scored(model, df, schema, columns)


def per_tree_errors(model: BoostedModel, df: DataFrame, label: str) -> DataFrame:
    """iteration, squared_error: the mean over ``df`` after each tree; summed by Spark."""
    trees = model.flat()
    wide = df.filter(F.col(label).isNotNull()).select(
        F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(model.features)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(len(trees)), 0
        for batch in batches:
            x = np.stack([batch.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(len(model.features))])
            x = np.where(np.isnan(x), -np.inf, x)
            y, total = batch.column("_y").to_numpy(zero_copy_only=False), np.full(x.shape[1], model.base)
            n += len(y)
            for i, t in enumerate(trees):
                total = total + _walk(t, x)
                sums[i] += ((total - y) ** 2).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, len(trees) + 1), pa.int32()), pa.array(sums),
                                          pa.array(np.full(len(trees), n), pa.int64())], names=["iteration", "sse", "n"])

    parts = wide.mapInArrow(run, "iteration int, sse double, n long")
    return parts.groupBy("iteration").agg((F.sum("sse") / F.sum("n")).alias("squared_error"))


def importances(model: BoostedModel, spark: SparkSession) -> DataFrame:
    """name, importance: each feature's share of the summed gains (0 for one never split on)."""
    gains = model.table(spark).filter("feature IS NOT NULL").groupBy(F.col("feature").alias("name")).agg(F.sum("gain").alias("gain"))
    names = spark.createDataFrame([(f,) for f in model.features], "name string")
    total = gains.agg(F.sum("gain")).scalar()
    return names.join(gains, "name", "left").select("name", F.coalesce(F.col("gain") / total, F.lit(0.0)).alias("importance"))


def as_column(model: BoostedModel) -> Column:
    """The prediction as one column expression (for models of some hundred nodes: Spark compiles
    the whole expression)."""
    total = F.lit(model.base)
    by_tree: dict[int, dict[int, tuple]] = {}
    for n in model.nodes:
        by_tree.setdefault(n[0], {})[n[1]] = n

    def at(nodes: dict[int, tuple], i: int) -> Column:
        _, _, _, feature, threshold, left, right, value, _, _ = nodes[i]
        if feature is None:
            return F.lit(value)
        x = F.col(feature).cast("double")
        return F.when((x > F.lit(threshold)) & ~F.isnan(x), at(nodes, right)).otherwise(at(nodes, left))

    for nodes in by_tree.values():
        total = total + at(nodes, 0)
    return total
