"""SimHash near-duplicates by the generalised pigeonhole principle.

Two 64-bit fingerprints within distance ``tau`` must, for any split of the bits into
parts with thresholds t_1..t_m whose sum is tau - m + 1, differ by at most t_i bits in
some part i. So parts may have different thresholds, and a threshold of -1 skips a part.

1. ``fingerprints``: the texts' fingerprints, computed inside Arrow batches.
2. ``plan``: from a bounded sample of the distinct fingerprints, bits that correlate are
   put in the same part, and dynamic programming gives each part the threshold that
   minimises estimated candidates plus probes. The plan steers cost only; any plan is exact.
3. ``links``: every distinct fingerprint is indexed by its value in each part and probes
   the values within that part's threshold. Rows of equal (part, value) meet in one
   bucket; inside a bucket all pairs are verified on the full 64 bits, and only a spanning
   forest of the verified pairs leaves the task (not every pair). Buckets above
   ``BUCKET_ROWS`` rows are cut into blocks, and every two blocks meet in a bucket of
   their own, so no task gets an unbounded group.
4. ``components``: alternating large-star and small-star steps, each written to the
   shared checkpoint folder, until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cosignal.llm.common import column, shuffle_partitions, stage

BITS = 64
SHINGLE = 4
TAU = 4
SEED = 42
SAMPLE = 2048           # fingerprints the plan is estimated from, at most
PARTS = 3               # most parts of the bits, as long as such a plan exists
MAX_PROBES = 1000       # values one fingerprint may probe in one part
BUCKET_ROWS = 4096      # larger buckets are cut into blocks
PAIRS_AT_ONCE = 2_000_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a UTF-8 text; 0 if it has no word."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return int(np.uint64(digest(b" ".join(words), SEED)).view(np.int64))
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-shingle]]).tolist()
    stops = (ends[shingle - 1:] - 1).tolist()
    ones, n = np.zeros(BITS, np.int64), len(starts)
    for at in range(0, n, 65536):
        h = np.array([digest(joined[a:b], SEED)
                      for a, b in zip(starts[at:at + 65536], stops[at:at + 65536])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, carry: list[str] = ("doc_id",)
                 ) -> DataFrame:
    """(doc struct of the ``carry`` columns, fp long): one row per input row; texts that
    are null or without words have fingerprint 0."""
    given = docs.select(F.struct(*[docs[c] for c in carry]).alias("doc"),
                        column(docs, "text", "string").cast("binary").alias("_text"))
    schema = T.StructType([given.schema["doc"]]).add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(fps, pa.int64())], names=["doc", "fp"])

    return given.mapInArrow(run, schema)


@dataclass(frozen=True)
class Plan:
    parts: tuple[tuple[int, ...], ...]   # bit positions of every part
    thresholds: tuple[int, ...]          # -1 skips the part

    def __post_init__(self):
        assert sorted(b for p in self.parts for b in p) == list(range(BITS))


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """``m`` parts of about equal size: each grows from a free bit by the free bit with the
    largest total absolute correlation to the bits already in it."""
    centred = bits - bits.mean(axis=0)
    scale = np.sqrt((centred ** 2).sum(axis=0))
    scale[scale == 0] = 1.0
    corr = np.abs((centred / scale).T @ (centred / scale)).astype(np.float64)
    np.fill_diagonal(corr, 0)
    free, parts = set(range(BITS)), []
    for i in range(m):
        size = BITS // m + (i < BITS % m)
        part = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.remove(part[0])
        while len(part) < size:
            best = max(sorted(free), key=lambda b: corr[b, part].sum())
            part.append(best)
            free.remove(best)
        parts.append(sorted(part))
    return parts


def allocate(costs: list[list[float]], tau: int) -> tuple[float, tuple[int, ...]]:
    """Thresholds t_i >= -1 with sum tau - m + 1 and least total cost, by dynamic
    programming; ``costs[i][t + 1]`` is the cost of threshold t in part i."""
    best = {0: (0.0, ())}
    for row in costs:
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for spent, (cost, chosen) in best.items():
            for t1, c in enumerate(row):
                now = (cost + c, (*chosen, t1 - 1))
                if spent + t1 <= tau + 1 and (spent + t1 not in step or now < step[spent + t1]):
                    step[spent + t1] = now
        best = step
    return best.get(tau + 1, (float("inf"), ()))


def part_costs(bits: np.ndarray, part: list[int], total: int, tau: int) -> list[float]:
    """Cost of the thresholds -1, 0, 1, ... in one part: values probed by ``total`` fingerprints,
    and pairs that meet; up to the last threshold of at most ``MAX_PROBES`` values."""
    n, x = len(bits), bits[:, part]
    ones = x.sum(axis=1)
    apart = (ones[:, None] + ones[None, :] - 2 * (x @ x.T)).round().astype(np.int8)
    seen = np.bincount(apart[np.triu_indices(n, 1)], minlength=tau + 1)
    row, probes = [0.0], 0
    for t in range(min(tau, len(part)) + 1):
        probes += comb(len(part), t)
        if probes > MAX_PROBES:
            break
        # Pairs at most t apart in this part, never estimated below chance.
        share = max(seen[:t + 1].sum() / max(1, n * (n - 1) / 2), probes / 2.0 ** len(part))
        row.append(total * probes + share * total * (total - 1) / 2)
    return row


def make_plan(sample: np.ndarray, total: int, tau: int = TAU, m: int | None = None) -> Plan:
    """The cheapest plan for ``total`` distinct fingerprints, judged on ``sample``
    (distinct int64 fingerprints, at most ``SAMPLE``), with ``m`` parts if that is given.

    Fewer, longer parts cost more probes a fingerprint and fewer chance pairs, whose number grows
    with the square of ``total``; so few parts win for many fingerprints. Up to ``PARTS``
    parts are compared; more are tried where no threshold within ``MAX_PROBES`` does, that is
    for large ``tau``. With more parts than that small tables would need fewer probes, but
    the probes a fingerprint would jump as a table grows.
    """
    if not 0 <= tau < BITS:
        raise ValueError(f"tau must be 0 to {BITS - 1}, not {tau}")
    raw = sample.astype("<i8").view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
    few, many = range(2, PARTS + 1), range(PARTS + 1, max(PARTS, min(tau, BITS - 1) + 1) + 1)
    for choices in ((m,),) if m else (few, many):
        found = []
        for k in choices:
            parts = group_bits(bits, k) if len(sample) > 1 else [list(range(i, BITS, k)) for i in range(k)]
            cost, chosen = allocate([part_costs(bits, p, total, tau) for p in parts], tau)
            if chosen:
                found.append((cost, Plan(tuple(map(tuple, parts)), chosen)))
        if found:
            return min(found, key=lambda x: x[0])[1]
    raise ValueError(f"no plan for distance {tau}: every choice of parts needs more than {MAX_PROBES} probes in one of them")


def plan(fps: DataFrame, tau: int = TAU, sample: int = SAMPLE) -> Plan:
    """Plan for the distinct fingerprints ``fps`` (column fp) from the ``sample`` of them
    with the smallest hashes."""
    total = fps.count()
    chosen = fps.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()
    return make_plan(np.array([r.fp for r in chosen], np.int64), total, tau)


def _masks(part: tuple[int, ...], threshold: int) -> list[int]:
    """XOR masks that change at most ``threshold`` of the part's bits."""
    found = []
    for t in range(threshold + 1):
        for chosen in combinations(part, t):
            found.append(int(np.array([sum(1 << b for b in chosen)], np.uint64).view(np.int64)[0]))
    return found


def bucket_rows(fps: DataFrame, plan: Plan) -> DataFrame:
    """(part, value, fp, probe): the index row (probe false) and the probes of every
    fingerprint in every part whose threshold is not -1."""
    each = []
    for i, (part, t) in enumerate(zip(plan.parts, plan.thresholds)):
        if t < 0:
            continue
        keep = int(np.array([sum(1 << b for b in part)], np.uint64).view(np.int64)[0])
        masks = _masks(part, t)
        each.append(F.array(*[F.struct(
            F.lit(i).alias("part"),
            F.col("fp").bitwiseXOR(F.lit(m)).bitwiseAND(F.lit(keep)).alias("value"),
            F.lit(k > 0).alias("probe")) for k, m in enumerate(masks)]))
    rows = F.explode(F.concat(*each)).alias("b")
    return fps.select("fp", rows).select("b.part", "b.value", "fp", "b.probe")


def cut_buckets(rows: DataFrame, limit: int = BUCKET_ROWS) -> DataFrame:
    """Add (block_a, block_b). Rows of a bucket with at most ``limit`` rows get (0, 0); a
    larger bucket is cut by hash into blocks, and a row joins every pair of blocks that
    contains its own."""
    sizes = rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    # Stored, so its real size (usually next to nothing) decides how it is joined.
    large = stage(sizes.select(F.col("part").alias("_p"), F.col("value").alias("_v"),
                               F.ceil(F.col("n") / limit).cast("int").alias("_blocks")), "large-buckets")
    at = rows.join(large, (rows.part == large._p) & (rows.value == large._v), "left")
    own = F.pmod(F.xxhash64("fp"), F.col("_blocks")).cast("int")
    at = at.withColumn("_own", F.when(F.col("_blocks").isNull(), F.lit(0)).otherwise(own))
    other = F.explode(F.when(F.col("_blocks").isNull(), F.array(F.lit(0)))
                      .otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return (at.withColumn("_other", other)
            .select("part", "value", F.least("_own", "_other").alias("block_a"),
                    F.greatest("_own", "_other").alias("block_b"), "fp", "probe"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per connected component of the edges (a, b): (member, smallest member)."""
    if not len(a):
        return a, b
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)     # hook roots, then shorten all paths
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    member = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[member], nodes[label[member]]


def verified(fp: np.ndarray, probe: np.ndarray, starts: np.ndarray, tau: int
             ) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the linked pairs inside the buckets that begin at ``starts``
    (rows of one bucket are adjacent, index rows first)."""
    sizes = np.diff(np.append(starts, len(fp)))
    place = np.arange(len(fp)) - np.repeat(starts, sizes)
    # Index rows come first in a bucket; each meets all rows after it, probes meet none.
    partners = np.where(probe, 0, np.repeat(sizes, sizes) - place - 1)
    found_a, found_b, at = [], [], 0
    ends = np.cumsum(partners)
    while at < len(fp):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + PAIRS_AT_ONCE, "right")))
        count = partners[at:to]
        left = np.repeat(np.arange(at, to), count)
        step = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
        right = left + 1 + step
        x, y = fp[left], fp[right]
        ok = (x != y) & (np.bitwise_count(x ^ y) <= tau)
        if ok.any():
            a, b = forest(x[ok], y[ok])
            found_a.append(a)
            found_b.append(b)
        at = to
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = forest(np.concatenate(found_a).view(np.int64), np.concatenate(found_b).view(np.int64))
    return a, b


def links(fps: DataFrame, plan: Plan, tau: int = TAU, limit: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints within ``tau`` that connect the same
    components as all links do. ``fps`` must be distinct."""
    key = ["part", "value", "block_a", "block_b"]
    spark = fps.sparkSession
    rows = cut_buckets(bucket_rows(fps, plan), limit)
    sorted_rows = rows.repartition(shuffle_partitions(spark), *key).sortWithinPartitions(*key, "probe", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def emit(cols, last):
            """Verify the closed buckets of ``cols``; return the open last one."""
            new = np.zeros(len(cols[0]), bool)
            new[:1] = True
            for c in cols[:4]:
                new[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(new)
            stop = len(cols[0]) if last else starts[-1]
            a, b = verified(cols[4][:stop].view(np.uint64), cols[5][:stop],
                            starts[starts < stop], tau)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"]), \
                [c[stop:] for c in cols]

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in [*key, "fp", "probe"]]
            if rest is not None:
                cols = [np.concatenate(c) for c in zip(rest, cols)]
            out, rest = emit(cols, False)
            if out.num_rows:
                yield out
        if rest is not None and len(rest[0]):
            out, _ = emit(rest, True)
            if out.num_rows:
                yield out

    return sorted_rows.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node with an edge. ``edges``
    has columns a, b (long). Hubs are safe: a hub's edges meet only its smallest
    neighbour, one aggregated row, in a join that adaptive execution can split."""
    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"),
                                              F.least("a", "b").alias("b")).distinct(), "edges")

    def mark(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = (both.join(low, both.a == low.k).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .filter("a <> b").distinct())
        large = stage(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = (large.join(low, large.a == low.k).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select(F.col("k").alias("a"), F.col("m").alias("b")))
                 .distinct())
        now = stage(small, "small-star")
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, tau: int = TAU,
                    limit: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fp long, root long, component_id): ``component_id`` is the smallest doc_id
    that is reachable over links of at most ``tau`` bits, the row's own included; ``root``
    is the component's smallest fingerprint.

    One row per input row. Null doc_ids count in the links but never as the smallest (a
    component of only such rows has a null component_id). Repeated rows and equal texts
    share a fingerprint, so they are one node and cost nothing more; null, empty and blank
    texts have fingerprint 0, linked like any other. An empty table gives no rows.
    """
    docs_fp = stage(fingerprints(docs, shingle).select(
        F.col("doc.doc_id").cast("long").alias("doc_id"), "fp"), "fingerprints")
    nodes = stage(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    distinct = nodes.select("fp")
    found = components(links(distinct, plan(distinct, tau), tau, limit))
    rooted = stage(nodes.join(found, nodes.fp == found.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("_fp"), "root", "component_id")
    return (docs_fp.join(named, docs_fp.fp == named._fp)
            .select("doc_id", "fp", "root", "component_id"))


def keep_first(docs: DataFrame, shingle: int = SHINGLE, tau: int = TAU) -> DataFrame:
    """The rows of ``docs`` with one document of each component: the one with the smallest
    doc_id, then the smallest fingerprint, then the smallest row as JSON. A row without a
    doc_id stays only where its whole component has none, one for each such component. Same
    columns as ``docs``."""
    found = stage(near_duplicates(docs, shingle, tau), "near-duplicates")
    ids = (found.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id"))
           .agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(F.expr("doc_id = component_id"), F.lit(False))).alias("least"))
           .filter("least"))
    own, shared = ids.filter("n = 1"), ids.filter("n > 1")
    kept = docs.join(own, docs.doc_id == own._id, "left_semi")
    if not shared.isEmpty():
        # Rows that share a doc_id may lie in several components: told apart by fingerprint.
        first = (found.filter("doc_id = component_id").groupBy("root")
                 .agg(F.min(F.struct("doc_id", "fp")).alias("f")).select(F.col("f.doc_id").alias("_id"), F.col("f.fp").alias("_fp")))
        rows = (fingerprints(docs.join(shared, docs.doc_id == shared._id, "left_semi"), shingle, docs.columns)
                .groupBy(F.col("doc.doc_id").alias("_doc_id"), "fp").agg(F.min_by("doc", F.to_json("doc")).alias("doc")))
        kept = kept.unionByName(rows.join(first, (rows._doc_id == first._id) & (rows.fp == first._fp)).select("doc.*"))
    nameless = found.filter("component_id IS NULL").select(F.col("fp").alias("_fp"), "root").distinct()
    if nameless.isEmpty():
        return kept
    rows = fingerprints(docs.filter("doc_id IS NULL"), shingle, docs.columns)
    alone = (rows.join(nameless, rows.fp == nameless._fp).dropDuplicates(["root"]).select("doc.*"))
    return kept.unionByName(alone)
