"""Counter log fed by report files: replay, crash, late files, folding; sinks sized by bytes."""
import os
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from cosignal.operators import counts as C
from cosignal.operators import pairs as P
from cosignal.sources import reports as RS
from cosignal.sources import tables as T
from cosignal.sources.proxy import proxy_reports
from cosignal.streaming import ledger as LG


@pytest.fixture(scope="module")
def text(spark):
    """Report files of a few quarters, and the counts of each quarter from the tables."""
    base = tempfile.mkdtemp(prefix="cosignal-ledger-")
    rep = proxy_reports(spark, "/root/testdata/sf0.001")
    some = [f"199{y}q{q}" for y in (5, 6) for q in (1, 2, 3)]
    rep = RS.Reports(*(df.filter(F.col("quarter").isin(some)) for df in (rep.demo, rep.drug, rep.reac)))
    RS.write_quarters(rep, base)
    counted = C.pair_event_counts(rep, by_batch=True).collect()
    want = {}
    for r in counted:
        want.setdefault(r.quarter, {})[r.drug_a, r.drug_b, r.event] = r.a
    return base, want


def files(base, *quarters, kinds=("DEMO", "DRUG", "REAC")):
    out = []
    for k in kinds:
        for q in quarters:
            folder = f"{base}/{k}/quarter={q}"
            out += [f"file:{folder}/{f}" for f in sorted(os.listdir(folder)) if f.endswith(".csv")]
    return out


def state(spark, log):
    c = LG.read_counts(spark, log)
    pairs = {(r.drug_a, r.drug_b, r.event): r.a for r in c.pair_event.collect()}
    total = spark.range(1).select(c.n).first()[0]
    assert (total or 0) == sum(pairs.values())
    assert sum(r.pair_total for r in c.pair.collect()) == sum(r.event_total for r in c.event.collect()) == sum(pairs.values())
    return pairs


def summed(want, *quarters):
    out = {}
    for q in quarters:
        for k, v in want[q].items():
            out[k] = out.get(k, 0) + v
    return out


def commit(spark, text, log, batch, *quarters, kinds=("DEMO", "DRUG", "REAC")):
    return LG.commit_files(spark, log, text[0], files(text[0], *quarters, kinds=kinds), batch, RS.TEXT_LAYOUT)


def test_replay_crash_and_conflict(spark, text, monkeypatch):
    log, (_, want) = tempfile.mkdtemp(prefix="cosignal-log-") + "/log", text
    assert state(spark, log) == {}
    commit(spark, text, log, 0, "1995q1", "1995q2")
    assert state(spark, log) == summed(want, "1995q1", "1995q2")
    # A replayed batch, and files already counted in a new one, change nothing.
    assert commit(spark, text, log, 0, "1995q1", "1995q2").version == 1
    commit(spark, text, log, 1, "1995q1")
    assert state(spark, log) == summed(want, "1995q1", "1995q2")
    # A crash between the run and the manifest: the run is there, nobody reads it.
    runs = len(os.listdir(f"{log}/runs"))
    with monkeypatch.context() as m:
        m.setattr(LG, "write_manifest", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            commit(spark, text, log, 2, "1995q3")
    assert len(os.listdir(f"{log}/runs")) == runs + 1
    assert state(spark, log) == summed(want, "1995q1", "1995q2")
    commit(spark, text, log, 2, "1995q3")                      # the replay after it
    assert state(spark, log) == summed(want, "1995q1", "1995q2", "1995q3")
    assert LG.vacuum(spark, log) == 1 and state(spark, log) == summed(want, "1995q1", "1995q2", "1995q3")
    # Two writers: the second one's version is taken.
    m = LG.read_manifest(spark, log)
    with pytest.raises(LG.Conflict):
        LG.write_manifest(spark, log, m)
    assert LG.read_manifest(spark, log) == m and not any(f.startswith(".draft") for f in os.listdir(f"{log}/manifest"))


def test_quarters_count_once_complete_and_late_files_add(spark, text):
    log, (base, want) = tempfile.mkdtemp(prefix="cosignal-log-") + "/log", text
    commit(spark, text, log, 0, "1996q1", kinds=("DEMO", "DRUG"))
    assert state(spark, log) == {}
    commit(spark, text, log, 1, "1996q1", kinds=("REAC",))
    assert state(spark, log) == want["1996q1"]
    # A late second file of drugs: the log then equals counting all files at once.
    late = f"{base}/DRUG/quarter=1996q1/late.csv"
    ids = RS.read_quarters(spark, base, ["1996q1"], layout=RS.TEXT_LAYOUT).reac.select("PRIMARYID").distinct().limit(3).collect()
    with open(late, "w") as f:
        f.write("PRIMARYID$DRUGNAME\n" + "".join(f"{r[0]}$late drug\n{r[0]}$Late Drug.\n" for r in ids))
    try:
        LG.commit_files(spark, log, base, ["file:" + late], 2, RS.TEXT_LAYOUT)
        whole = C.pair_event_counts(RS.read_quarters(spark, base, ["1996q1"], layout=RS.TEXT_LAYOUT))
        now = {(r.drug_a, r.drug_b, r.event): r.a for r in whole.collect()}
        assert len(now) > len(want["1996q1"]) and state(spark, log) == now
        assert len(LG.read_manifest(spark, log).runs) == 2
    finally:
        os.remove(late)


def test_folding_keeps_the_counts(spark, text, monkeypatch):
    log, (_, want) = tempfile.mkdtemp(prefix="cosignal-log-") + "/log", text
    quarters = sorted(want)[:4]
    for i, q in enumerate(quarters):
        commit(spark, text, log, i, q)
    before = state(spark, log)
    assert before == summed(want, *quarters) and len(LG.read_manifest(spark, log).runs) == 4
    with monkeypatch.context() as m:                           # a crash in the middle of a fold
        m.setattr(LG, "write_manifest", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            LG.compact(spark, log, 3)
    assert state(spark, log) == before
    m = LG.compact(spark, log, 3)
    assert len(m.runs) == 2 and state(spark, log) == before and m.last_batch == 3
    assert LG.vacuum(spark, log) == 4 and len(os.listdir(f"{log}/runs")) == 2 and state(spark, log) == before
    assert [f for f in os.listdir(f"{log}/manifest") if f.endswith(".json")] == [f"{m.version:08d}.json"]


def test_stream_of_report_files(spark, text):
    base, (source, want) = tempfile.mkdtemp(prefix="cosignal-stream-"), text
    inbox, log = f"{base}/in", f"{base}/log"
    for step, quarters in enumerate((["1995q1", "1995q2", "1995q3"], ["1996q2", "1996q3"])):
        for f in files(source, *quarters):
            target = f.removeprefix("file:").replace(source, inbox)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            shutil.copy(f.removeprefix("file:"), target)
        LG.stream_reports(spark, inbox, log, f"{base}/ckpt", RS.TEXT_LAYOUT, max_files=4, fan_in=2)
        seen = [q for q in want if q in ("1995q1", "1995q2", "1995q3")] + (["1996q2", "1996q3"] if step else [])
        assert state(spark, log) == summed(want, *seen)
    assert len(LG.read_manifest(spark, log).runs) == 1


def written(path):
    return [os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_sinks_follow_the_bytes(spark, sf_dir):
    """A large quarter is split, small ones share a task: files are bounded both ways."""
    rows = P.pair_events(proxy_reports(spark, sf_dir)).withColumn(
        "quarter", F.when(F.col("quarter") < "1999", "big").otherwise(F.col("quarter")))
    rows = rows.crossJoin(spark.range(4)).drop("id")
    base, counts = tempfile.mkdtemp(prefix="cosignal-sink-"), {}
    conf = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(conf)
    try:
        for size in ("64m", "400k", "100k"):
            spark.conf.set(conf, size)
            T.write_pair_events(rows, f"{base}/{size}")
            counts[size] = {q: len(written(f"{base}/{size}/{q}")) for q in os.listdir(f"{base}/{size}") if "=" in q}
    finally:
        spark.conf.set(conf, before)
    assert set(counts["64m"].values()) == {1}
    big = [counts[size]["quarter=big"] for size in ("64m", "400k", "100k")]
    assert big[0] == 1 < big[1] < big[2]
    assert max(written(f"{base}/400k")) < max(written(f"{base}/64m")) / 1.5
    assert spark.read.parquet(f"{base}/100k").count() == rows.count()
