"""Nearest neighbours by inner product with a hierarchical k-means tree.

1. The tree is fitted on a bounded sample: k-means splits it, level by level, until a node
   holds few sample vectors. The tree (centres only) is bounded by the sample.
2. Every vector descends to a leaf in the task that reads it. Leaves next to each other
   form shards of at most ``SHARD_ROWS`` vectors; a larger leaf is cut into several shards
   by hash of the id.
3. A query visits leaves best-bin-first: a priority queue holds the nodes seen so far by
   the inner product of query and centre, and the best is opened next. How many leaves to
   visit is widened until the recall measured on calibration queries, whose exact
   neighbours come from a pass over all vectors in blocks, reaches the target. A query whose
   leaves hold fewer than k vectors besides its own goes on to further leaves.
4. Queries meet the shards that hold their leaves; a task holds one shard and streams its
   queries, and each (query, shard) gives its own best k, which are merged at the end.

Candidates are screened with matrix products and scored again by one fixed summation, so
equal vectors have equal scores and ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cosignal.llm.common import column, shuffle_partitions, stage

SAMPLE = 32_768          # vectors the tree is fitted on, at most
BRANCHES = 8
LEAF_SAMPLE = 32         # a node with so few sample vectors is a leaf
LEAF_ROWS = 256          # vectors wanted in a leaf, as far as the sample allows
SHARD_ROWS = 16_384
QUERIES_PER_SHARD = 65_536   # a shard wanted by more queries is copied
CALIBRATION = 128        # calibration queries
TARGET = 0.95            # recall wanted on them
K = 20
SEED = 7


@dataclass(frozen=True)
class Tree:
    centres: np.ndarray      # [nodes x dim]
    first: np.ndarray        # first child of a node, -1 for a leaf
    last: np.ndarray         # one past its last child
    leaf: np.ndarray         # leaf number, -1 for inner nodes

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row: at each node the child with the nearest centre."""
        node = np.zeros(len(x), np.int64)
        while True:
            open_ = np.flatnonzero(self.first[node] >= 0)
            if not len(open_):
                return self.leaf[node]
            for parent in np.unique(node[open_]):
                rows = open_[node[open_] == parent]
                c = self.centres[self.first[parent]:self.last[parent]]
                far = (c ** 2).sum(axis=1) - 2 * x[rows] @ c.T
                node[rows] = self.first[parent] + far.argmin(axis=1)

    def visit(self, q: np.ndarray, leaves: int, size: np.ndarray | None = None,
              least: int = 0) -> list[int]:
        """The first ``leaves`` leaves that best-bin-first traversal reaches for ``q``, and
        more until they hold ``least`` vectors, ``size`` being the vectors of each leaf."""
        worth = -(self.centres @ q)
        queue, found, held = [(worth[0], 0)], [], 0
        while queue and (len(found) < leaves or held < least):
            _, node = heapq.heappop(queue)
            if self.first[node] < 0:
                found.append(int(self.leaf[node]))
                held += 0 if size is None else int(size[self.leaf[node]])
            else:
                for child in range(self.first[node], self.last[node]):
                    heapq.heappush(queue, (worth[child], child))
        return found


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """Cluster of every row; empty clusters vanish."""
    centres = x[rng.choice(len(x), k, replace=False)]
    label = np.full(len(x), -1)
    for _ in range(rounds):
        new = ((centres ** 2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        if np.array_equal(new, label):
            break
        label = new
        centres = np.array([x[label == c].mean(axis=0) if (label == c).any() else centres[c]
                            for c in range(k)])
    return np.unique(label, return_inverse=True)[1]


def fit(sample: np.ndarray, leaf_sample: int = LEAF_SAMPLE, branches: int = BRANCHES) -> Tree:
    """Hierarchical k-means tree over ``sample``. A node whose vectors do not separate
    (all alike) stays a leaf."""
    rng = np.random.default_rng(SEED)
    centres, first, last = [sample.mean(axis=0)], [-1], [-1]
    work = [(0, np.arange(len(sample)))]
    while work:
        node, rows = work.pop()
        if len(rows) <= leaf_sample:
            continue
        label = kmeans(sample[rows], min(branches, len(rows)), rng)
        if label.max() == 0:
            continue
        first[node] = len(centres)
        for c in range(label.max() + 1):
            own = rows[label == c]
            work.append((len(centres), own))
            centres.append(sample[own].mean(axis=0))
            first.append(-1)
            last.append(-1)
        last[node] = len(centres)
    first, last = np.array(first), np.array(last)
    leaf = np.full(len(first), -1)
    # Leaves are numbered depth first, so near numbers are near in space.
    stack, n = [0], 0
    while stack:
        node = stack.pop()
        if first[node] < 0:
            leaf[node] = n
            n += 1
        else:
            stack.extend(range(last[node] - 1, first[node] - 1, -1))
    return Tree(np.array(centres), first, last, leaf)


def best(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int,
         allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row of x, score) of each query's ``k`` largest inner products among
    the ``allowed`` rows but its own id; ties go to the smaller id."""
    rough = q @ x.T
    bad = q_ids[:, None] == ids[None, :]
    if allowed is not None:
        bad |= ~allowed
    rough[bad] = -np.inf
    if k < len(ids):
        cut = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k]
    else:
        cut = np.full(len(q), -np.inf)
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(cut), cut, 0)))
    who, row = np.nonzero((rough >= (cut - slack)[:, None]) & (rough > -np.inf))
    score = np.empty(len(who))
    for at in range(0, len(who), 100_000):
        part = slice(at, at + 100_000)
        score[part] = (q[who[part]] * x[row[part]]).sum(axis=1)
    order = np.lexsort((ids[row], -score, who))
    who, row, score = who[order], row[order], score[order]
    place = np.arange(len(who)) - np.searchsorted(who, who)
    keep = place < k
    return who[keep], row[keep], score[keep]


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 1)


def usable(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id long, v array<double>): one row per id, without vectors that are null, zero, or
    hold null or non-finite components, and without null ids. Should vectors differ in
    length, only the most frequent length takes part (ties: the shorter); rows that repeat
    an id count once, with the largest vector in array order."""
    rows = table.select(column(table, id_col, "long").alias("id"),
                        column(table, vec_col, "array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
                        & finite & F.exists("v", lambda c: c != 0))
            .groupBy("id").agg(F.max("v").alias("v")))


def search(table: DataFrame, queries_of, k: int = K, target: float = TARGET,
           id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id column satisfies
    ``queries_of`` the ``k`` nearest found among all other rows, nearest first, by the
    inner product in double precision.

    Rows that cannot take part are named in ``usable``; a table without usable rows gives
    no rows. With at most ``k`` candidates all of them are returned.
    """
    spark = table.sparkSession
    rows = stage(usable(table, id_col, vec_col), "vectors")
    dims = (rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "d").limit(1).collect())
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = dims[0].d, dims[0].n
    rows = rows.filter(F.size("v") == dim)

    def chosen(df: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
        got = df.orderBy(F.xxhash64("id"), "id").limit(n).collect()
        return (np.array([r.id for r in got], np.int64),
                np.array([r.v for r in got], np.float64).reshape(len(got), dim))

    _, sample = chosen(rows, SAMPLE)
    # As many leaves as give LEAF_ROWS vectors each, as far as the sample can carry them.
    per_leaf = max(LEAF_SAMPLE, round(len(sample) * LEAF_ROWS / total))
    tree = fit(sample, per_leaf)
    shared = spark.sparkContext.broadcast((tree.centres, tree.first, tree.last, tree.leaf))

    def to_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tree(*shared.value)
        for b in batches:
            leaf = t.assign(_matrix(b.column("v"))) if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(leaf.astype(np.int32))],
                                             names=["id", "v", "leaf"])

    index = stage(rows.mapInArrow(to_leaf, "id long, v array<double>, leaf int"), "index")

    # Shards: consecutive leaves up to SHARD_ROWS vectors; a larger leaf gets several.
    size = np.zeros(tree.leaves, np.int64)
    for r in index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():
        size[r.leaf] = r.n
    first_shard, parts = np.zeros(tree.leaves, np.int64), np.ones(tree.leaves, np.int64)
    shard, held = 0, 0
    for leaf in range(tree.leaves):
        if held and held + size[leaf] > SHARD_ROWS:
            shard, held = shard + 1, 0
        first_shard[leaf] = shard
        parts[leaf] = max(1, -(-int(size[leaf]) // SHARD_ROWS))
        held += size[leaf]
        if parts[leaf] > 1:
            shard, held = shard + int(parts[leaf]), 0

    is_query = queries_of(F.col("id"))
    cal_ids, cal = chosen(rows.filter(is_query), CALIBRATION)
    visits = calibrate(index, tree, size, cal_ids, cal, k, target)

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tree(*shared.value)
        for b in batches:
            out_row, out_shard, out_leaves = [], [], []
            for i, q in enumerate(_matrix(b.column("v")) if b.num_rows else ()):
                wanted: dict[int, list[int]] = {}
                for leaf in t.visit(q, visits, size, k + 1):     # the query itself may be among them
                    for part in range(parts[leaf]):
                        wanted.setdefault(int(first_shard[leaf]) + part, []).append(leaf)
                for s, leaves in wanted.items():
                    out_row.append(i)
                    out_shard.append(s)
                    out_leaves.append(leaves)
            at = pa.array(out_row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(at), b.column("v").take(at), pa.array(out_shard, pa.int32()),
                 pa.array(out_leaves, pa.list_(pa.int32()))], names=["id", "v", "shard", "leaves"])

    asked = stage(rows.filter(is_query).mapInArrow(
        to_shards, "id long, v array<double>, shard int, leaves array<int>"), "asked")
    # A shard that very many queries want is copied, and its queries are dealt over the copies.
    hot = stage(asked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > QUERIES_PER_SHARD)
                .select("shard", F.ceil(F.col("n") / QUERIES_PER_SHARD).cast("int").alias("copies")), "hot-shards")
    copies = {r.shard: r.copies for r in hot.collect()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, leaf = b.column("id").to_numpy(), b.column("leaf").to_numpy()
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            s = first_shard[leaf] + (mixed % parts[leaf].astype(np.uint64)).astype(np.int64)
            times = np.array([copies.get(int(x), 1) for x in s], np.int64)
            at = np.repeat(np.arange(len(s)), times)
            copy = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(s[at].astype(np.int32)), pa.array(copy.astype(np.int32)),
                 pa.array(np.zeros(len(at), np.int8)), b.column("id").take(take), b.column("v").take(take),
                 b.column("leaf").take(take), pa.nulls(len(at), pa.list_(pa.int32()))],
                names=["shard", "copy", "kind", "id", "v", "leaf", "leaves"])

    columns = "shard int, copy int, kind byte, id long, v array<double>, leaf int, leaves array<int>"
    copy_of = F.coalesce(F.pmod(F.xxhash64("id"), F.col("copies")), F.lit(0))
    both = index.mapInArrow(place, columns).unionByName(asked.join(hot, "shard", "left").select(
        "shard", copy_of.cast("int").alias("copy"), F.lit(1).cast("byte").alias("kind"), "id", "v",
        F.lit(None).cast("int").alias("leaf"), "leaves"))
    met = (both.repartition(shuffle_partitions(spark), "shard", "copy")
           .sortWithinPartitions("shard", "copy", "kind"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []          # vectors of the shard that is read just now
        ids = x = leaf = None
        for b in batches:
            key = b.column("shard").to_numpy().astype(np.int64) << 32 | b.column("copy").to_numpy()
            kind = b.column("kind").to_numpy()
            mark = key * 2 + kind
            cuts = np.concatenate([[0], np.flatnonzero(mark[1:] != mark[:-1]) + 1, [len(mark)]])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if key[lo] != here:
                    here, held, x = key[lo], [], None
                if kind[lo] == 0:
                    held.append((part.column("id").to_numpy(), _matrix(part.column("v")),
                                 part.column("leaf").to_numpy()))
                    x = None
                elif held:
                    if x is None:
                        ids, x, leaf = (np.concatenate(c) for c in zip(*held))
                        held = [(ids, x, leaf)]
                    q_ids, q = part.column("id").to_numpy(), _matrix(part.column("v"))
                    wanted = part.column("leaves").to_pylist()
                    step = max(1, 4_000_000 // len(ids))
                    for at in range(0, len(q), step):
                        allowed = np.zeros((len(q[at:at + step]), int(leaf.max()) + 1), bool)
                        for i, leaves in enumerate(wanted[at:at + step]):
                            allowed[i, [w for w in leaves if w < allowed.shape[1]]] = True
                        who, row, score = best(ids, x, q_ids[at:at + step], q[at:at + step], k,
                                               allowed[:, leaf])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(q_ids[at:at + step][who]), pa.array(ids[row]), pa.array(score)],
                            names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(answer, "query_id long, vec_id long, score double")
    return top(found, k)


def top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def exact(table: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score, leaf): the ``k`` best rows of ``table`` (id, v, leaf) for a
    bounded set of queries, by a pass over all rows in blocks."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None
        for b in batches:
            if not b.num_rows:
                continue
            ids, x, leaf = b.column("id").to_numpy(), _matrix(b.column("v")), b.column("leaf").to_numpy()
            who, row, score = best(ids, x, q_ids, q, k)
            new = (who, ids[row], score, leaf[row])
            keep = new if keep is None else tuple(map(np.concatenate, zip(keep, new)))
            order = np.lexsort((keep[1], -keep[2], keep[0]))
            keep = tuple(c[order] for c in keep)
            first = np.arange(len(order)) - np.searchsorted(keep[0], keep[0]) < k
            keep = tuple(c[first] for c in keep)
        if keep is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_ids[keep[0]]), pa.array(keep[1]), pa.array(keep[2]), pa.array(keep[3])],
                names=["query_id", "vec_id", "score", "leaf"])

    found = table.mapInArrow(scan, "query_id long, vec_id long, score double, leaf int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def calibrate(index: DataFrame, tree: Tree, size: np.ndarray, q_ids: np.ndarray, q: np.ndarray,
              k: int, target: float) -> int:
    """Leaves to visit at least: widened by a tenth at a time until the calibration queries,
    which go on as in ``search`` until their leaves hold k + 1 vectors, find the ``target``
    share of their exact neighbours; all leaves if nothing less does."""
    if not len(q_ids):
        return tree.leaves
    order, least = {}, {}
    for i, v in zip(q_ids, q):
        order[int(i)] = {leaf: n for n, leaf in enumerate(tree.visit(v, tree.leaves))}
        least[int(i)] = len(tree.visit(v, 0, size, k + 1))
    found = exact(index, q_ids, q, k).collect()
    need = np.array([order[r.query_id][r.leaf] for r in found])
    anyway = np.array([least[r.query_id] for r in found])
    visits = 1
    while visits < tree.leaves and len(need) and (need < np.maximum(visits, anyway)).mean() < target:
        visits = max(visits + 1, visits * 11 // 10)
    return min(visits, tree.leaves)
