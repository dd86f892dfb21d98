"""Stored layouts that need no shuffle: plans, row groups read, and equal results."""
import tempfile

from pyspark.sql import functions as F

from cosignal.operators import graph as G
from cosignal.operators import report as RP
from cosignal.operators import signals as S
from cosignal.plans import catalog as K
from cosignal.sources import buckets as B
from cosignal.sources.proxy import pair_requests


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_scanned(df):
    """Rows the file scans of ``df`` put out when it runs (whole row groups, before any filter)."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        found = (leaf.executedPlan() if "QueryStage" in leaf.getClass().getSimpleName() else leaf).collectLeaves()
        for j in range(found.size()):
            m = found.apply(j).metrics()
            if m.contains("numOutputRows") and "Scan" in found.apply(j).nodeName():
                total += m.apply("numOutputRows").value()
    return total


def test_lookup_reads_the_signals_as_they_lie(spark, sf_dir):
    sig = K.stage_signals(spark, sf_dir)
    path = tempfile.mkdtemp(prefix="cosignal-buckets-") + "/s"
    stored = S.write_signals_bucketed(sig, path, buckets=4)
    again = B.read_bucketed(spark, path)
    req = pair_requests(spark, sf_dir)
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before, adaptive = spark.conf.get(conf), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set(conf, "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for table in (stored, again):
            made = RP.pair_summary(RP.of_bucketed(table, RP.request_status(req)))
            text = plan(made)
            assert "SortMergeJoin" in text
            # The signal side, from the join down to its scan, has no exchange, nor has the summary.
            assert "Exchange" not in text[:text.index("Bucketed: true")]
            plain = plan(RP.pair_summary(RP.of_requests(sig, RP.request_status(req))))
            assert "Exchange" in plain[:plain.index("FileScan")]
    finally:
        spark.conf.set(conf, before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    want = RP.pair_lookup(req, sig)
    got = RP.bucketed_lookup(req, again)
    assert want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0


def test_short_request_lists_skip_row_groups(spark, sf_dir):
    sig = K.stage_signals(spark, sf_dir)
    n, pairs = sig.count(), sig.select("drug_a", "drug_b").distinct().orderBy("drug_a", "drug_b").limit(2)
    path = tempfile.mkdtemp(prefix="cosignal-bloom-") + "/s"
    small = {"parquet.block.size": 4096, "parquet.page.size": 1024, "parquet.block.size.row.check.min": 10,
             "parquet.page.size.row.check.min": 10}
    table = S.write_signals_bucketed(sig, path, buckets=2, options=small)
    few = RP.of_bucketed(table, pairs.withColumn("status", F.lit("ok")))
    assert few.count() == sig.join(pairs, ["drug_a", "drug_b"], "left_semi").count() > 0
    keys = [r[0] for r in pairs.select(S.pair_key()).collect()]
    assert rows_scanned(table.table.filter(F.col("pair_key").isin(keys))) < n / 2
    assert rows_scanned(table.table.select("pair_key")) == n


def test_buckets_follow_the_rows_and_survive_awkward_tables(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), ("a", 2), ("it's", None)], "k string, v int")
    base = tempfile.mkdtemp(prefix="cosignal-b-")
    for i, some in enumerate((df, df.limit(0))):
        B.write_bucketed(some, f"{base}/{i}", ["k"])
        back = B.read_bucketed(spark, f"{base}/{i}").table
        assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, some.collect()), key=str)
    assert B.buckets_for(spark.range(10), 3) == 4 and B.buckets_for(df.limit(0)) == 1


def test_edges_are_exchanged_once(spark, sf_dir):
    """The hops read the bucketed edges without an exchange of them."""
    f = K.build_features(spark, sf_dir)
    nodes = G.graph_nodes(f)
    edges = G.graph_edges(f, nodes)
    stored = G.bucketed_edges(edges)
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before, adaptive = spark.conf.get(conf), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set(conf, "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        values = nodes.select("idx", "freq_z")
        text = plan(G.neighbour_mean(stored, values, ["freq_z"]))
        scan = text.index("Bucketed: true")
        assert "Exchange" not in text[text.rindex("SortMergeJoin", 0, scan):scan]
    finally:
        spark.conf.set(conf, before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert stored.table.exceptAll(edges).count() == 0 and edges.exceptAll(stored.table).count() == 0
    two = G.propagate(nodes, edges, ["freq_z"], 2).select("idx", F.round("h2_freq_z", 9).alias("h"))
    h1 = G.neighbour_mean(edges, values, ["freq_z"])
    plain = G.neighbour_mean(edges, h1, ["freq_z"]).select("idx", F.round("freq_z", 9).alias("h"))
    assert two.exceptAll(plain).count() == 0 and two.count() == nodes.count()
