"""Incremental counter maintenance, one batch (quarter or micro-batch) at a time.

Counters are additive, so each batch writes its own partial counters into a table
partitioned by ``batch``; re-running a batch overwrites only its partition (dynamic
partition overwrite), which makes every write idempotent. The merged view sums the
partitions; the support filter is applied only after that merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosignal.operators.counts import PAIR, Counts, pair_event_counts
from cosignal.operators.pairs import DEFAULT_CELL_DRUGS
from cosignal.session import cut_lineage
from cosignal.sources.reports import Reports

MAX_FILES_PER_TRIGGER = 64   # input files in one micro-batch
COUNTER_TABLES = ("pair_event_agg", "pair_agg", "event_agg", "batch_rows")


def batch_counters(pec_by_batch: DataFrame) -> dict[str, DataFrame]:
    """Partial counters of each batch from (batch, drug_a, drug_b, event, a)."""
    pair = pec_by_batch.groupBy("batch", *PAIR).agg(F.sum("a").cast("bigint").alias("pair_total"))
    event = pec_by_batch.groupBy("batch", "event").agg(F.sum("a").cast("bigint").alias("event_total"))
    rows = pec_by_batch.groupBy("batch").agg(F.sum("a").cast("bigint").alias("n"))
    return {"pair_event_agg": pec_by_batch, "pair_agg": pair, "event_agg": event, "batch_rows": rows}


def report_batch_counts(rep: Reports, mode: str = "clean",
                        cell_drugs: int = DEFAULT_CELL_DRUGS) -> DataFrame:
    """(batch, drug_a, drug_b, event, a) straight from the report tables (quarter = batch)."""
    return (pair_event_counts(rep, mode, cell_drugs, by_batch=True)
            .withColumnRenamed("quarter", "batch"))


def report_batch_counters(rep: Reports, mode: str = "clean",
                          cell_drugs: int = DEFAULT_CELL_DRUGS) -> dict[str, DataFrame]:
    """Per-quarter counters: the explosion runs once, into a stored table."""
    return batch_counters(cut_lineage(report_batch_counts(rep, mode, cell_drugs), "batch-counts"))


def rows_batch_counts(pair_events: DataFrame, batch_col: str = "quarter") -> DataFrame:
    """(batch, drug_a, drug_b, event, a) from pair-event rows."""
    return (pair_events.groupBy(F.col(batch_col).cast("string").alias("batch"), *PAIR, "event")
            .agg(F.count(F.lit(1)).alias("a")))


def write_counters(pec_by_batch: DataFrame, base: str, batches: list[str] | None = None) -> None:
    """Overwrite the partitions of the batches present; other batches stay.

    ``pec_by_batch`` (see ``report_batch_counts``) is computed once, by the write of
    ``pair_event_agg``; the other tables are derived from the stored partitions: those named
    in ``batches``, or all. Rows are rebalanced by batch: adaptive execution splits a large
    batch and puts small ones into one task, so tasks and files follow the bytes.
    """
    spark = pec_by_batch.sparkSession

    def write(name: str, df: DataFrame) -> None:
        (df.hint("rebalance", "batch").write.mode("overwrite").partitionBy("batch")
         .option("partitionOverwriteMode", "dynamic").parquet(f"{base}/{name}"))

    write("pair_event_agg", pec_by_batch)
    stored = spark.read.schema(pec_by_batch.schema).parquet(f"{base}/pair_event_agg")
    if batches is not None:
        stored = stored.filter(F.col("batch").isin(batches))
    for name, df in batch_counters(stored).items():
        if name != "pair_event_agg":
            write(name, df)


def read_counters(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{base}/{name}") for name in COUNTER_TABLES}


def merge_counters(counters: dict[str, DataFrame]) -> Counts:
    """Sum the batches. ``pair_event`` is unfiltered; apply the support filter after."""
    pec = (counters["pair_event_agg"].groupBy(*PAIR, "event")
           .agg(F.sum("a").cast("bigint").alias("a")))
    pair = counters["pair_agg"].groupBy(*PAIR).agg(F.sum("pair_total").cast("bigint").alias("pair_total"))
    event = counters["event_agg"].groupBy("event").agg(
        F.sum("event_total").cast("bigint").alias("event_total"))
    n = counters["batch_rows"].agg(F.sum("n").cast("bigint")).scalar()
    return Counts(pair_event=pec, pair=pair, event=event, n=n)


def stream_counters(spark: SparkSession, pair_events_path: str, schema, out_base: str,
                    checkpoint: str, max_files: int = MAX_FILES_PER_TRIGGER):
    """Structured Streaming: new pair-event files -> per-micro-batch counters.

    Each micro-batch (at most ``max_files`` files, so a backlog becomes many bounded ones)
    reads its input once and writes its partial counters into partition
    ``batch=<batch_id>`` by dynamic overwrite, so a replay of a micro-batch after a failure
    rewrites the same partition. Runs with ``availableNow`` and returns the finished query.
    """
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
           .parquet(pair_events_path))

    def _write(batch_df: DataFrame, batch_id: int) -> None:
        name = f"{batch_id:08d}"
        counted = rows_batch_counts(batch_df.withColumn("_batch", F.lit(name)), "_batch")
        write_counters(counted, out_base, [name])

    q = (src.writeStream.foreachBatch(_write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
