"""Drug graph: nodes with dense ids and standardised features, doubled edges, and
neighbourhood propagation (mean aggregation over in-edges, hop by hop)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cosignal.session import cut_lineage, scratch_path
from cosignal.sources.buckets import Bucketed, write_bucketed

STD_GUARD = 1e-6
ROWS_PER_RANGE = 100_000
_POS_BITS = 33  # monotonically_increasing_id keeps the row position in the low 33 bits


def drug_catalog(df: DataFrame, cols=("drug_a", "drug_b")) -> DataFrame:
    """Distinct, non-null drug names over both pair columns."""
    first, *rest = cols
    u = df.select(F.col(first).alias("drug"))
    for c in rest:
        u = u.union(df.select(F.col(c).alias("drug")))
    return u.distinct().dropna()


def dense_index(df: DataFrame, col: str | list[str], idx_col: str = "idx",
                partitions: int | None = None) -> DataFrame:
    """0-based ids in ``col`` order (one column or several) without funnelling all rows
    through one task.

    Range-partition and sort by ``col``, tag each row with its partition and position,
    count rows per partition (one row per partition, a bounded table), turn the counts
    into running offsets and add them back. The tagged rows are checkpointed so the ids
    stay fixed however often the result is read.
    """
    if partitions is None:
        # One partition per ROWS_PER_RANGE rows, whatever the session's shuffle setting.
        df = cut_lineage(df, "to-index")
        partitions = -(-df.count() // ROWS_PER_RANGE)
    cols = [col] if isinstance(col, str) else col
    if partitions <= 1:      # one range: the position is the id
        return cut_lineage(df.coalesce(1).sortWithinPartitions(*cols).withColumn(
            idx_col, F.monotonically_increasing_id()), "indexed")
    tagged = (df.repartitionByRange(partitions, *cols).sortWithinPartitions(*cols)
              .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = cut_lineage(tagged, "indexed")
    part = F.shiftright(F.col("_mid"), _POS_BITS)
    pos = F.col("_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1))
    tagged = tagged.withColumn("_part", part).withColumn("_pos", pos)
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # One row per partition of the range sort: a size bound known before the job runs.
    return (tagged.join(F.broadcast(offsets), "_part")
            .withColumn(idx_col, (F.col("_off") + F.col("_pos")).cast("bigint"))
            .drop("_mid", "_part", "_pos", "_off"))


def node_features(features: DataFrame) -> DataFrame:
    """drug, freq, mean_risk per drug: values from the drug's A role, else its B role."""
    a = features.groupBy(F.col("drug_a").alias("drug")).agg(
        F.max("drug_a_freq").alias("_fa"), F.max("drug_a_mean_risk").alias("_ma"))
    b = features.groupBy(F.col("drug_b").alias("drug")).agg(
        F.max("drug_b_freq").alias("_fb"), F.max("drug_b_mean_risk").alias("_mb"))
    j = drug_catalog(features).join(a, "drug", "left").join(b, "drug", "left")
    use_b = F.coalesce(F.col("_fa"), F.lit(0)) == 0
    return j.select(
        "drug",
        F.when(use_b, F.coalesce(F.col("_fb"), F.lit(0))).otherwise(F.col("_fa")).cast("double").alias("freq"),
        F.when(use_b, F.coalesce(F.col("_mb"), F.lit(0.0))).otherwise(F.col("_ma")).cast("double").alias("mean_risk"))


def standardise(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Add ``(x - mean) / (stddev_samp + 1e-6)`` columns; the statistics are scalar
    subqueries over the same table (one aggregation job, no join)."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols] +
                   [F.stddev_samp(c).alias(f"s_{c}") for c in cols])
    out = df
    for c, name in cols.items():
        m = stats.select(f"m_{c}").scalar()
        s = stats.select(f"s_{c}").scalar()
        out = out.withColumn(name, (F.col(c) - m) / (s + F.lit(STD_GUARD)))
    return out


def graph_nodes(features: DataFrame) -> DataFrame:
    """idx, drug, freq, mean_risk, freq_z, risk_z; idx follows the sorted drug names."""
    nodes = dense_index(node_features(features), "drug")
    nodes = standardise(nodes, {"freq": "freq_z", "mean_risk": "risk_z"})
    return nodes.select("idx", "drug", "freq", "mean_risk", "freq_z", "risk_z")


def graph_edges(features: DataFrame, nodes: DataFrame, weight: str = "log_max_risk") -> DataFrame:
    """src, dst, w for every pair in both directions (same weight)."""
    ids = nodes.select("drug", "idx")
    e = (features.select("drug_a", "drug_b", F.col(weight).cast("double").alias("w"))
         .join(ids.withColumnRenamed("drug", "drug_a").withColumnRenamed("idx", "src"), "drug_a")
         .join(ids.withColumnRenamed("drug", "drug_b").withColumnRenamed("idx", "dst"), "drug_b")
         .select("src", "dst", "w"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def neighbour_mean(edges: DataFrame | Bucketed, values: DataFrame, cols: list[str]) -> DataFrame:
    """idx, <cols>: mean of the in-neighbours' values (0 for a node without in-edges).

    The aggregation is partial per task before the shuffle, so a hub node's edges are
    combined map-side rather than in one task.
    """
    sources = values.withColumnRenamed("idx", "src")
    if isinstance(edges, Bucketed):
        edges, sources = edges.table, edges.match(sources)
    msgs = (edges.join(sources, "src")
            .groupBy(F.col("dst").alias("idx")).agg(*[F.avg(c).alias(c) for c in cols]))
    base = values.select("idx")
    return base.join(msgs, "idx", "left").select(
        "idx", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in cols])


def bucketed_edges(edges: DataFrame) -> Bucketed:
    """The edges stored in buckets by source."""
    stored = cut_lineage(edges, "edges")
    return write_bucketed(stored, scratch_path(edges.sparkSession, f"edges-by-source-{uuid.uuid4().hex}"), ["src"])


def propagate(nodes: DataFrame, edges: DataFrame, cols: list[str], hops: int = 3) -> DataFrame:
    """Own features followed by the neighbour means of each hop.

    Hop k averages the hop k-1 values of the in-neighbours (mean aggregation as in
    GraphSAGE; linear, without learned weights). Each hop is checkpointed into the shared
    checkpoint folder so the plan does not grow with the number of hops. The edges are
    bucketed by source once, for all hops: a hop moves node values and partial sums only.
    """
    cur = nodes.select("idx", *cols)
    edges = bucketed_edges(edges) if hops > 1 else edges
    out = nodes
    for k in range(1, hops + 1):
        cur = cut_lineage(neighbour_mean(edges, cur, cols))
        out = out.join(cur.select("idx", *[F.col(c).alias(f"h{k}_{c}") for c in cols]), "idx")
    return out
