"""Session helpers: one place for the settings every job in the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for the plans in this library. AQE re-plans joins at run time
# (broadcast only when the measured side is under the threshold, skew splitting,
# partition coalescing); the thresholds are the size checks behind every lookup join.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Stage checkpoints are removed once nothing references them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# Sizing for large inputs (tens of TB on hundreds of executors): start with many shuffle
# partitions and let AQE coalesce them towards the advisory size, so no partition
# outgrows executor memory; read input splits of at most 256 MB; split skewed join
# partitions above 512 MB. Scale shuffle partitions with the input (about one per
# 256 MB of the largest shuffle).
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
}


def get_spark(master: str | None = None, app_name: str = "cosignal",
              shuffle_partitions: int | None = None, extra: dict | None = None,
              profile: str = "default") -> SparkSession:
    """Create or fetch the session with the library's defaults.

    ``master`` is only for local runs and tests; on a cluster leave it ``None`` and let
    ``spark-submit`` decide. ``profile='cluster'`` adds ``CLUSTER_CONF``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if profile == "cluster":
        conf.update(CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make ``DataFrame.checkpoint()`` usable and return the directory.

    The shared folder named by ``spark.checkpoint.dir`` wins. Only a local-mode session
    without that setting (tests) gets a fresh scratch folder; a cluster session without
    it is an error, because a machine-local folder would not survive a lost executor. Whether a
    ``file:`` path or one without scheme is a mount that all machines share cannot be seen from
    here, so on a cluster such a folder only draws a warning.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        remote = sc.master.startswith("local-cluster") or not sc.master.startswith("local")
        default = sc._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        if remote and (configured if "://" in configured or configured.startswith("file:") else default).startswith("file:"):
            warnings.warn(f"spark.checkpoint.dir {configured} must be a mount that all machines share", stacklevel=2)
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="cosignal-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, name: str = "stage", as_table: bool = True) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder (never a local one) and
    continue from the stored copy, which survives the loss of executors.

    The copy is a Parquet table: columnar and compressed, later reads take only their
    columns, and its real size feeds the planner's broadcast decisions. It is removed when
    the job ends normally (see ``drop_scratch``). ``as_table=False`` takes
    ``DataFrame.checkpoint()`` instead.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if not as_table:
        return df.checkpoint(eager=True)
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def collecting(spark: SparkSession):
    """While a table of lists collected from sorted rows is stored: aggregations over sorted rows
    take one group after the other in place of a hash map of many groups, which would be built
    twice."""
    name = "spark.sql.execution.replaceHashWithSortAgg"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_scratch(spark: SparkSession) -> None:
    """Remove the intermediate tables this session wrote; call it once results are stored.
    Only the session's own folder below the checkpoint folder is touched."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        p = sc._jvm.org.apache.hadoop.fs.Path(os.path.join(sc.getCheckpointDir(), "tables"))
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the checkpoint folder for intermediate tables written by a job."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", name)
