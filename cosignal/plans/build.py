"""End-to-end batch build: report files -> every stage table, each written once.

    python -m cosignal.plans.build --raw /data/reports --out /data/signals \
        --quarters 2025q1,2025q2,2025q3,2025q4 --trees 800 --depth 10 --learning-rate 0.03

Stages (each a set of Spark jobs; the outputs are the inputs of the next stage):
1. read the three report kinds of each quarter (raw pair-event rows on request);
2. per-quarter counters (idempotent partition overwrite) and their merge;
3. the signal table in two layouts (by score, and by pair for lookups);
4. pair features and the drug encoders;
5. graph nodes and edges, propagated node embeddings;
6. the boosted-tree and edge regressors with their held-out metrics.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from cosignal.operators import features as FE
from cosignal.operators import learn as L
from cosignal.operators import pairs as P
from cosignal.operators import signals as S
from cosignal.operators.boosting import BoostParams
from cosignal.session import drop_scratch, get_spark
from cosignal.sources import tables as T
from cosignal.sources.reports import (Reports, complete_quarters, discover_quarters,
                                      read_quarters)
from cosignal.streaming import counters as R


def artefacts(out: str) -> dict[str, str]:
    """Where a build keeps each of its tables and models."""
    return {k: f"{out}/{k}" for k in ("pair_events", "counters", "signals", "signals_by_pair",
                                      "features", "encoders", "graph", "embeddings",
                                      "models/tree", "models/edge", "metrics")}


def build(spark: SparkSession, rep: Reports, out: str, min_support: int = 3,
          tree_params: BoostParams | L.TreeParams | None = None, edge_params: L.TreeParams | None = None, hops: int = 3, threshold: float = 5.0,
          write_rows: bool = False, quarters: list[str] | None = None) -> dict[str, str]:
    """Write every stage table under ``out``. The pair explosion runs once, for the counters;
    ``write_rows`` also stores the raw pair-event rows (a second, much larger explosion that
    nothing here reads)."""
    paths = artefacts(out)
    if write_rows:
        T.write_pair_events(P.pair_events(rep), paths["pair_events"])
    R.write_counters(R.report_batch_counts(rep), paths["counters"], quarters)
    counts = R.merge_counters(R.read_counters(spark, paths["counters"]))
    S.write_signals(S.signals(counts, min_support=min_support), paths["signals"], layout="score")
    signals = spark.read.parquet(paths["signals"])
    S.write_signals(signals, paths["signals_by_pair"], layout="pair")
    signals = spark.read.parquet(paths["signals_by_pair"])

    T.write_features(FE.pair_features(signals), paths["features"])
    T.write_encoders(FE.drug_encoders(signals), paths["encoders"])
    features = spark.read.parquet(paths["features"])

    nodes, edges = L.write_graph_tables(features, paths["graph"])
    T.write_embeddings(L.node_embeddings(nodes, edges, hops), paths["embeddings"])

    tree, _, ttest = L.fit_tree_model(features, tree_params)
    L.save_model(tree, paths["models/tree"])
    emb = spark.read.parquet(paths["embeddings"])
    edge, _, etest = L.fit_edge_model(features, emb, edge_params)
    L.save_model(edge, paths["models/edge"])
    T.append_metrics(L.evaluate(tree, ttest, threshold, "boosted_trees")
                     .unionByName(L.evaluate(edge, etest, threshold, "edge_regressor")),
                     paths["metrics"])
    return paths


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--raw", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--quarters", help="comma list; default: every quarter folder under --raw")
    ap.add_argument("--min-support", type=int, default=3)
    ap.add_argument("--write-rows", action="store_true", help="also store the raw pair-event rows")
    ap.add_argument("--require-complete", action="store_true",
                    help="fail if a quarter misses one of its three report kinds")
    ap.add_argument("--hops", type=int, default=3, help="neighbourhood hops in the embeddings")
    ap.add_argument("--threshold", type=float, default=5.0, help="risk above which a pair counts as significant")
    d, e = BoostParams(), L.TreeParams()
    ap.add_argument("--trees", type=int, default=d.trees)
    ap.add_argument("--depth", type=int, default=d.depth)
    ap.add_argument("--learning-rate", type=float, default=d.rate)
    ap.add_argument("--row-share", type=float, default=d.row_share)
    ap.add_argument("--column-share", type=float, default=d.column_share)
    ap.add_argument("--l1", type=float, default=d.l1)
    ap.add_argument("--l2", type=float, default=d.l2)
    ap.add_argument("--edge-trees", type=int, default=e.max_iter)
    ap.add_argument("--edge-depth", type=int, default=e.max_depth)
    ap.add_argument("--edge-learning-rate", type=float, default=e.step_size)
    a = ap.parse_args()
    spark = get_spark(profile="cluster")
    wanted = a.quarters.split(",") if a.quarters else discover_quarters(spark, a.raw)
    found, skipped = complete_quarters(spark, a.raw, wanted)
    for q, kinds in skipped.items():
        print(f"skipped quarter {q}: no {', '.join(kinds)} files")
    if skipped and a.require_complete:
        raise SystemExit("incomplete quarters")
    trees = BoostParams(trees=a.trees, depth=a.depth, rate=a.learning_rate, row_share=a.row_share,
                        column_share=a.column_share, l1=a.l1, l2=a.l2)
    edges = L.TreeParams(max_iter=a.edge_trees, max_depth=a.edge_depth, step_size=a.edge_learning_rate)
    build(spark, read_quarters(spark, a.raw, found), a.out.rstrip("/"), a.min_support, trees, edges,
          a.hops, a.threshold, a.write_rows, found)
    drop_scratch(spark)


if __name__ == "__main__":
    main()
