"""Parquet sinks and sources for every stage table, plus the path fallback and the
literal example pairs.

All writes are whole-table or whole-partition overwrites, so re-running a stage after a
failure gives the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The quick-start example pairs (drug A, drug B, expected level, reason).
EXAMPLE_PAIRS = [
    ("WARFARIN", "ASPIRIN", "HIGH", "Major bleeding risk synergy"),
    ("METFORMIN", "INSULIN", "MOD", "Hypoglycaemia compounding"),
    ("ATORVASTATIN", "AMLODIPINE", "LOW", "Common co-prescription"),
    ("CLOPIDOGREL", "OMEPRAZOLE", "MOD", "CYP2C19 metabolic interaction"),
    ("LISINOPRIL", "SPIRONOLACTONE", "HIGH", "Hyperkalaemia risk"),
    ("FLUOXETINE", "TRAMADOL", "HIGH", "Serotonin syndrome risk"),
]


def example_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXAMPLE_PAIRS, "drug_a string, drug_b string, level string, reason string")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def drop_table(spark: SparkSession, path: str) -> bool:
    """Remove a stage table the caller owns (e.g. merged-away batch counters), like
    ``DROP TABLE IF EXISTS``; returns whether something was removed."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p) and fs.delete(p, True))


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path the file system reports (e.g. full table, else the sample table)."""
    for p in paths:
        if path_exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def read_first(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.parquet(first_existing(spark, paths))


def write_pair_events(pair_events: DataFrame, path: str) -> None:
    """Pair-event rows partitioned by quarter; only the quarters present are replaced. Rows are
    rebalanced by quarter: adaptive execution splits a large quarter and puts small ones into
    one task, so tasks and files follow the bytes (advisory partition size). Equal pairs are
    neighbours in a file (better compression, tighter statistics)."""
    (pair_events.hint("rebalance", "quarter").sortWithinPartitions("quarter", "drug_a", "drug_b", "event")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("quarter").parquet(path))


def read_pair_events(spark: SparkSession, path: str, quarters: list[str] | None = None) -> DataFrame:
    """Read pair-event rows; a quarter list becomes a partition filter (only those
    folders are listed and read)."""
    df = spark.read.parquet(path)
    return df.filter(F.col("quarter").isin(quarters)) if quarters else df


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_features(features: DataFrame, path: str) -> None:
    """The pair feature table, ordered by max risk (descending) as stored originally."""
    write_table(features.orderBy(F.col("max_risk").desc(), "drug_a", "drug_b"), path)


def write_encoders(encoders: DataFrame, path: str) -> None:
    """Encoders as one lookup table (drug, freq, mean_risk), not a driver-side map."""
    write_table(encoders.select("drug", "freq", "mean_risk"), path)


def write_graph(nodes: DataFrame, edges: DataFrame, base: str) -> None:
    write_table(nodes, f"{base}/nodes")
    write_table(edges, f"{base}/edges")


def read_graph(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{base}/nodes"), spark.read.parquet(f"{base}/edges")


def write_embeddings(emb: DataFrame, path: str) -> None:
    write_table(emb.select("idx", "drug", "z"), path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics rows are appended (one run, one or more rows), stamped with the write time."""
    metrics.withColumn("written_at", F.current_timestamp()).write.mode("append").json(path)
