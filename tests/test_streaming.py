import os
import tempfile

from pyspark.sql import functions as F

from cosignal.operators import counts as C
from cosignal.operators import pairs as P
from cosignal.sources.proxy import proxy_reports
from cosignal.streaming import counters as R


def test_counters_batch_and_stream(spark, sf_dir):
    base = tempfile.mkdtemp(prefix="cosignal-stream-")
    pe = P.pair_events(proxy_reports(spark, sf_dir))
    # the pair-event table arrives as two drops of files
    src = os.path.join(base, "pair_events")
    pe.filter("quarter < '1995'").write.parquet(src + "/part1")
    pe.filter("quarter >= '1995'").write.parquet(src + "/part2")
    inbox = os.path.join(base, "inbox")
    os.makedirs(inbox)
    out = os.path.join(base, "counters")
    schema = pe.schema
    for i, part in enumerate(["part1", "part2"]):
        for f in os.listdir(os.path.join(src, part)):
            if f.endswith(".parquet"):
                os.link(os.path.join(src, part, f), os.path.join(inbox, f"{i}-{f}"))
        R.stream_counters(spark, inbox, schema, out, os.path.join(base, "ckpt"))
    merged = R.merge_counters(R.read_counters(spark, out))
    direct = C.count_rows(pe)
    assert merged.pair_event.exceptAll(direct.pair_event).count() == 0
    assert direct.pair_event.exceptAll(merged.pair_event).count() == 0
    assert spark.range(1).select(merged.n).first()[0] == 64079
    # re-writing one batch's counters is idempotent
    batch = R.rows_batch_counts(pe.filter("quarter < '1995'").withColumn("b", F.lit("00000000")), "b")
    R.write_counters(batch, out, ["00000000"])
    again = R.merge_counters(R.read_counters(spark, out))
    assert spark.range(1).select(again.n).first()[0] == 64079


def test_backlog_becomes_several_micro_batches(spark, sf_dir):
    base = tempfile.mkdtemp(prefix="cosignal-backlog-")
    pe = P.pair_events(proxy_reports(spark, sf_dir))
    pe.repartition(6).write.parquet(base + "/in")
    R.stream_counters(spark, base + "/in", pe.schema, base + "/out", base + "/ckpt", max_files=2)
    counters = R.read_counters(spark, base + "/out")
    assert counters["batch_rows"].count() == 3
    assert spark.range(1).select(R.merge_counters(counters).n).first()[0] == 64079
    files = [f for _, _, names in os.walk(base + "/out/pair_agg") for f in names if f.endswith(".parquet")]
    assert len(files) == 3              # tiny batches: one file each
