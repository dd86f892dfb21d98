"""Counter log: additive counter runs under an atomic manifest, fed by report files.

A run is an immutable folder with the four counter tables of one commit. The manifest lists
the runs that count, the report files of every quarter already counted, and the last committed
micro-batch. A commit writes its run first and then the next manifest version, by renaming a
finished file to a name that must not exist; readers take the newest version and only the runs
it lists. So a crash before the rename leaves an unlisted folder that nobody reads, a replayed
micro-batch is recognised and skipped, and a reader never sees half a merge.

Runs are only ever added. When a quarter gets more files after it was counted, the commit holds
the counts of all its files less those of the files counted before. Small runs fold into
larger ones (``compact``): the smallest ``fan_in`` at a time, so a row is rewritten about
log(runs) times.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosignal.operators.counts import PAIR, Counts, pair_event_counts
from cosignal.session import cut_lineage
from cosignal.sources import reports as RS
from cosignal.streaming.counters import MAX_FILES_PER_TRIGGER, merge_counters

TABLES = {"pair_event_agg": ([*PAIR, "event"], "a"), "pair_agg": (PAIR, "pair_total"),
          "event_agg": (["event"], "event_total"), "batch_rows": ([], "n")}
FAN_IN = 8
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


@dataclass
class Manifest:
    version: int = 0
    runs: dict[str, int] = field(default_factory=dict)             # run folder -> rows
    files: dict[str, list[str]] = field(default_factory=dict)      # quarter -> report files counted
    last_batch: int = -1


class Conflict(RuntimeError):
    """Another writer committed the version this one wanted to write."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, base: str) -> list[int]:
    _, p, fs = _fs(spark, f"{base}/manifest")
    names = [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def read_manifest(spark: SparkSession, base: str) -> Manifest:
    versions = _versions(spark, base)
    if not versions:
        return Manifest()
    text = spark.read.text(f"{base}/manifest/{versions[-1]:08d}.json", wholetext=True).first()[0]
    return Manifest(**json.loads(text))


def write_manifest(spark: SparkSession, base: str, m: Manifest) -> None:
    """Commit ``m`` as the next version, or raise ``Conflict`` if that version exists."""
    jvm, target, fs = _fs(spark, f"{base}/manifest/{m.version:08d}.json")
    _, draft, _ = _fs(spark, f"{base}/manifest/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(json.dumps(asdict(m)).encode())
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise Conflict(f"manifest version {m.version} of {base} is taken")


def write_run(spark: SparkSession, base: str, pair_event: DataFrame) -> tuple[str, int]:
    """(name, rows) of a new run holding the counters of ``pair_event`` (keys and a). Tables are
    rebalanced, so their files follow their bytes."""
    run = uuid.uuid4().hex
    path = f"{base}/runs/{run}"
    pair_event.hint("rebalance").write.parquet(f"{path}/pair_event_agg")
    stored = spark.read.schema(pair_event.schema).parquet(f"{path}/pair_event_agg")
    for name, (keys, total) in TABLES.items():
        if name != "pair_event_agg":
            stored.groupBy(*keys).agg(F.sum("a").cast("bigint").alias(total)).hint("rebalance").write.parquet(f"{path}/{name}")
    return run, stored.count()


def read_runs(spark: SparkSession, base: str, runs: list[str]) -> dict[str, DataFrame]:
    if not runs:
        text = {"drug_a", "drug_b", "event"}
        return {name: spark.createDataFrame([], ", ".join([f"{k} string" for k in keys if k in text] + [f"{total} bigint"]))
                for name, (keys, total) in TABLES.items()}
    return {name: spark.read.parquet(*[f"{base}/runs/{r}/{name}" for r in runs]) for name in TABLES}


def read_counts(spark: SparkSession, base: str) -> Counts:
    """Merged counters of the newest manifest."""
    return merge_counters(read_runs(spark, base, list(read_manifest(spark, base).runs)))


def whole_quarters(files: dict[str, list[str]], layout: str) -> dict[str, list[str]]:
    """The quarters with files of all three kinds; the others count nothing."""
    return {q: fs for q, fs in files.items() if RS.kinds_of(fs, layout) == set(RS.KINDS)}


def quarter_counts(spark: SparkSession, source: str, files: dict[str, list[str]], layout: str,
                   touched: DataFrame | None = None) -> DataFrame | None:
    """Summed pair-event counts of the quarters, from exactly these files; quarters that lack a
    kind count nothing. With ``touched`` (quarter, PRIMARYID) only those reports count. None if
    there is no quarter to count."""
    whole = whole_quarters(files, layout)
    if not whole:
        return None
    rep = RS.read_files(spark, source, whole, layout)
    if touched is not None:
        rep = RS.Reports(*(df.join(touched, ["quarter", "PRIMARYID"], "left_semi") for df in (rep.demo, rep.drug, rep.reac)))
    return pair_event_counts(RS.stored(rep))


def reports_in(spark: SparkSession, source: str, files: dict[str, list[str]], layout: str) -> DataFrame:
    """quarter, PRIMARYID of the reports that have a row in these files, stored."""
    rep = RS.read_files(spark, source, files, layout)
    keys = [df.select("quarter", "PRIMARYID") for df in (rep.demo, rep.drug, rep.reac)]
    return cut_lineage(keys[0].unionByName(keys[1]).unionByName(keys[2]).distinct(), "touched-reports")


def commit_files(spark: SparkSession, base: str, source: str, new_files: list[str], batch_id: int,
                 layout: str = RS.DEFAULT_LAYOUT) -> Manifest:
    """Count the report files that arrived and commit; a batch already committed changes nothing."""
    m = read_manifest(spark, base)
    if batch_id <= m.last_batch:
        return m
    arrived: dict[str, list[str]] = {}
    for f in sorted(set(new_files)):
        quarter = RS.quarter_of(f, layout)
        if quarter is not None and f not in m.files.get(quarter, []):
            arrived.setdefault(quarter, []).append(f)
    before = {q: m.files.get(q, []) for q in arrived}
    after = {q: before[q] + fs for q, fs in arrived.items()}
    runs = dict(m.runs)
    # A quarter counted before changes by the reports that the new files hold rows of, and by
    # no other: those are counted with and without the new files.
    late = {q: fs for q, fs in after.items() if q in whole_quarters(before, layout)}
    counts = [quarter_counts(spark, source, {q: fs for q, fs in after.items() if q not in late}, layout)]
    if late:
        touched = reports_in(spark, source, {q: arrived[q] for q in late}, layout)
        counts.append(quarter_counts(spark, source, late, layout, touched))
        old = quarter_counts(spark, source, {q: before[q] for q in late}, layout, touched)
        counts.append(old.withColumn("a", -F.col("a")))
    counts = [c for c in counts if c is not None]
    if counts:
        added = counts[0]
        if len(counts) > 1:
            for c in counts[1:]:
                added = added.unionByName(c)
            added = added.groupBy(*PAIR, "event").agg(F.sum("a").cast("bigint").alias("a")).filter("a != 0")
        run, rows = write_run(spark, base, added)
        runs[run] = rows
    done = Manifest(m.version + 1, runs, {**m.files, **after}, batch_id)
    write_manifest(spark, base, done)
    return done


def compact(spark: SparkSession, base: str, fan_in: int = FAN_IN) -> Manifest:
    """Fold the ``fan_in`` smallest runs into one while there are that many."""
    m = read_manifest(spark, base)
    while len(m.runs) >= max(2, fan_in):
        small = sorted(m.runs, key=lambda r: (m.runs[r], r))[:fan_in]
        keys, total = TABLES["pair_event_agg"]
        rows = (read_runs(spark, base, small)["pair_event_agg"].groupBy(*keys)
                .agg(F.sum(total).cast("bigint").alias(total)).filter("a != 0"))
        run, n = write_run(spark, base, rows)
        left = {r: k for r, k in m.runs.items() if r not in small}
        m = Manifest(m.version + 1, {**left, run: n}, m.files, m.last_batch)
        write_manifest(spark, base, m)
    return m


def vacuum(spark: SparkSession, base: str) -> int:
    """Remove runs and manifests the newest manifest does not need; returns how many runs went.
    To be called when no reader still works on an older manifest and no writer is at work."""
    m = read_manifest(spark, base)
    _, p, fs = _fs(spark, f"{base}/runs")
    gone = [st.getPath() for st in (fs.listStatus(p) if fs.exists(p) else []) if st.getPath().getName() not in m.runs]
    for path in gone:
        fs.delete(path, True)
    for v in _versions(spark, base)[:-1]:
        fs.delete(_fs(spark, f"{base}/manifest/{v:08d}.json")[1], False)
    return len(gone)


def stream_reports(spark: SparkSession, source: str, base: str, checkpoint: str, layout: str = RS.DEFAULT_LAYOUT,
                   max_files: int = MAX_FILES_PER_TRIGGER, fan_in: int = FAN_IN):
    """Structured Streaming: report files arriving under ``source`` -> the counter log ``base``.

    The stream carries file names (contents are not read by it); every micro-batch of at most
    ``max_files`` names is read by the files' own headers and counted per quarter. A quarter
    counts from the moment all three kinds are there; files that come later add what they
    change. Runs what is available and returns the finished query.
    """
    names = (spark.readStream.schema(FILE_SCHEMA).format("binaryFile").option("recursiveFileLookup", True)
             .option("maxFilesPerTrigger", max_files).load(source).select("path"))

    def take(batch: DataFrame, batch_id: int) -> None:
        commit_files(spark, base, source, [r.path for r in batch.collect()], batch_id, layout)
        compact(spark, base, fan_in)

    q = (names.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
