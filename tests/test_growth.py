"""Steps whose tasks, shuffles or files must not grow faster than the input."""
import os
import re
import tempfile

from pyspark.sql import functions as F

from cosignal.operators import cells as CE
from cosignal.operators import counts as C
from cosignal.operators import dictionary as D
from cosignal.operators import pairs as P
from cosignal.operators import report as RP
from cosignal.operators import score as SC
from cosignal.operators import signals as S
from cosignal.operators.dictionary import build_dictionary
from cosignal.plans import catalog as K
from cosignal.session import collecting, cut_lineage
from cosignal.sources import reports as RS
from cosignal.sources.proxy import proxy_reports
from cosignal.streaming import ledger as LG


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def joins(df):
    return len(re.findall(r"\bJoin ", plan(df)))


def reports(spark, n=200):
    i = spark.range(n).withColumn("quarter", F.lit("1999q1"))
    key = [F.col("quarter"), F.col("id").alias("PRIMARYID")]
    drug = i.select(*key, F.explode(F.array(*map(F.lit, "abc"))).alias("DRUGNAME"))
    reac = i.select(*key, F.explode(F.array(F.lit("Pain"), F.lit("Pain"), F.lit("Rash"))).alias("PT"))
    demo = i.select(*key, F.lit(40.0).alias("AGE"), F.lit("F").alias("SEX"))
    return RS.Reports(demo, drug, reac)


def test_names_meet_the_reports_by_stored_tables(spark, sf_dir):
    rep = proxy_reports(spark, sf_dir)
    assert joins(rep.drug) == joins(rep.reac) == joins(build_dictionary(rep).raw) == 0


def test_tasks_follow_the_report_rows(spark, monkeypatch):
    rep = reports(spark)
    monkeypatch.setattr(P, "ROWS_PER_PART", 20)
    assert P.parts_for(rep) == 70
    dealt = P.merged_rows(rep, rep.drug, "DRUGNAME").select(F.spark_partition_id().alias("p")).distinct().count()
    assert dealt > 40
    event, n = C.event_totals_factored(rep)
    assert {r.event: r.event_total for r in event.collect()} == {"Pain": 1200, "Rash": 600}
    assert spark.range(1).select(n).first()[0] == 1800 and C.batch_totals(rep).first()["n"] == 1800


def test_pair_events_need_no_join(spark):
    rows = P.pair_events(reports(spark), cell_drugs=2, cell_rows=2)
    assert joins(rows) == 0 and rows.count() == 1800
    assert rows.select("drug_a", "drug_b", "age", "gender", "quarter").distinct().count() == 3


def test_small_budgets_store_no_more_cells(spark, monkeypatch):
    rep, kept = reports(spark), {}
    monkeypatch.setattr(P, "cut_lineage", lambda df, name: kept.setdefault(name, cut_lineage(df, name)))
    rows = P.pair_events(rep, cell_drugs=2, cell_rows=2)
    assert kept["pair-event-cells"].count() == 200 and rows.count() == 1800
    cells = P.split_cells(kept["pair-event-cells"].select("da", "db", F.expr("flatten(transform(fs, f -> array_repeat(f.event, f.n)))")
                                                          .alias("events")), 2, 2).collect()
    sizes = [sum(a < b for a in c.da for b in c.db) * len(c.events) for c in cells]
    assert (len(cells), max(sizes), sum(sizes), max(len(c.da) for c in cells)) == (200 * 5, 2, 1800, 2)
    assert dict(map(tuple, rows.groupBy("event").count().collect())) == {"Pain": 1200, "Rash": 600}


def test_only_reports_of_many_rows_are_dealt(spark, monkeypatch):
    """One report yields 435 pairs x 400 events, 200 others nine rows each."""
    rep, key = reports(spark), [F.lit("1999q1").alias("quarter"), F.lit(-1).cast("long").alias("PRIMARYID")]
    rep = RS.Reports(rep.demo.unionByName(spark.range(1).select(*key, F.lit(40.0).alias("AGE"), F.lit("F").alias("SEX"))),
                     rep.drug.unionByName(spark.range(30).select(*key, F.concat(F.lit("D"), "id").alias("DRUGNAME"))),
                     rep.reac.unionByName(spark.range(400).select(*key, F.concat(F.lit("E"), "id").alias("PT"))))
    monkeypatch.setattr(P, "DEFAULT_CELL_ROWS", 4_000)
    rows, small = P.pair_events(rep, cell_rows=4_000), P.pair_events(rep, cell_drugs=4, cell_rows=50)
    by_many = {r.many: (r.n, r.most) for r in P.pair_event_cells(rep, cell_rows=4_000).groupBy("many").agg(
        F.sum("rows").alias("n"), F.max("rows").alias("most")).collect()}
    assert by_many == {False: (1800, 9), True: (174_000, 435 * 9)}
    for made in (rows, small):
        assert len(re.findall("RepartitionByExpression", plan(made))) == 1 and "many#" in plan(made)
        per_task = [r["count"] for r in made.filter("drug_a like 'D%'").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(per_task) == 174_000 and len(per_task) >= 4 and max(per_task) <= 0.5 * sum(per_task)
        assert made.filter("drug_a not like 'D%'").count() == 1800
    assert rows.exceptAll(small).isEmpty() and small.exceptAll(rows).isEmpty()


def signal_rows(spark):
    return spark.createDataFrame([("A", "B", "Pain", 5, 9, 7, 2.0, 2.0, 1.5), ("A", "B", "Rash", 4, 9, 7, 2.0, 2.0, 1.0)],
                                 "drug_a string, drug_b string, event string, a long, pair_total long, event_total long, "
                                 "PRR double, ROR double, risk_score double")


def test_requests_are_merged_before_they_meet_a_bucket(spark):
    table = S.write_signals_bucketed(signal_rows(spark), tempfile.mkdtemp(prefix="cosignal-g-") + "/s", buckets=1)
    req = spark.range(1000).select("id", F.lit("a").alias("drug_a"), F.lit("b").alias("drug_b"))
    text = plan(RP.of_bucketed(table, RP.request_status(req)))
    assert text.index("RepartitionByExpression") < text.index("Aggregate", text.index("RepartitionByExpression"))
    made = RP.bucketed_lookup(req, table)
    assert joins(made) == 1 and "RepartitionByExpression" not in plan(made)
    assert made.groupBy("status", "total_reports", "unique_events").count().collect() == [("ok", 9, 2, 1000)]


def test_requests_meet_one_record_a_pair(spark, monkeypatch):
    req = spark.createDataFrame([(1, "a", "b"), (2, "B", "A"), (3, "a", "zz"), (4, "a", "")], "request_id long, drug_a string, drug_b string")
    made = RP.pair_reports(req, signal_rows(spark))
    assert "missing_drug" not in plan(made)                    # requests come from their stored table
    assert {r.request_id: (r.status, r.top_event) for r in made.collect()} == {
        1: ("ok", "Pain"), 2: ("ok", "Pain"), 3: ("no_evidence", None), 4: ("missing_drug", None)}
    score = F.struct(F.lit(1.0).alias("score"), F.lit("LOW").alias("label"))
    monkeypatch.setattr(SC, "tree_scores", lambda p, *_: p.withColumn("tree", score))
    monkeypatch.setattr(SC, "graph_scores", lambda p, *_: p.withColumn("graph", score))
    made = SC.score_pairs(req, None, None, None, None, signal_rows(spark))
    assert joins(made) == 1
    assert {r.request_id: (r.tree is not None, len(r.evidence)) for r in made.collect()} == {
        1: (True, 2), 2: (True, 2), 3: (True, 0), 4: (False, 0)}


def test_report_files_follow_the_bytes(spark):
    rep, base = reports(spark), tempfile.mkdtemp(prefix="cosignal-g-")
    RS.write_quarters(RS.Reports(*(df.repartition(8) for df in (rep.demo, rep.drug, rep.reac))), base)
    for kind in ("DEMO", "DRUG", "REAC"):
        assert len([f for f in os.listdir(f"{base}/{kind}/quarter=1999q1") if f.endswith(".csv")]) == 1


def test_late_files_count_the_reports_they_touch(spark, monkeypatch):
    base = tempfile.mkdtemp(prefix="cosignal-g-")
    RS.write_quarters(reports(spark), base)
    first = [f"file:{d}/{f}" for d, _, fs in os.walk(base) for f in fs if f.endswith(".csv")]
    LG.commit_files(spark, f"{base}-log", base, first, 0, RS.TEXT_LAYOUT)
    late = f"{base}/DRUG/quarter=1999q1/late.csv"
    with open(late, "w") as f:
        f.write("PRIMARYID$DRUGNAME\n7$d\n9$d\n9$a\n")
    counted, seen = LG.pair_event_counts, []
    monkeypatch.setattr(LG, "pair_event_counts", lambda rep: (seen.append(rep.demo.count()), counted(rep))[1])
    LG.commit_files(spark, f"{base}-log", base, ["file:" + late], 1, RS.TEXT_LAYOUT)
    assert seen == [2, 2]
    got = {(r.drug_a, r.drug_b, r.event): r.a for r in LG.read_counts(spark, f"{base}-log").pair_event.collect()}
    whole = C.pair_event_counts(RS.read_quarters(spark, base, ["1999q1"], layout=RS.TEXT_LAYOUT))
    assert got == {(r.drug_a, r.drug_b, r.event): r.a for r in whole.collect()} and got["A", "D", "Pain"] == 4


def test_tree_and_artefacts_share_one_signal_table(spark, sf_dir, monkeypatch):
    made, count = K.build_signals, []
    monkeypatch.setattr(K, "build_signals", lambda *a: (count.append(1), made(*a))[1])
    monkeypatch.setattr(K, "_STORED", {})
    assert K._signals_by_pair(spark, sf_dir) == K._signals_by_pair(spark, sf_dir) and len(count) == 1


def test_reports_take_one_shuffle_and_one_sort(spark):
    rep = reports(spark)
    with collecting(spark):
        for made in (CE.report_cells(rep, build_dictionary(rep)), P.pair_event_cells(rep)):
            text = made._jdf.queryExecution().executedPlan().toString()
            assert text.count("REPARTITION_BY_NUM") == 1 and "HashAggregate" not in text and text.count("- Sort [") == 1
    assert sum(r["rows"] for r in P.pair_event_cells(rep).collect()) == 1800      # right without it too


def test_names_are_cleaned_once_each(spark, monkeypatch):
    seen = []
    for module in (D, P):
        monkeypatch.setattr(module, "cut_lineage", lambda df, name: (seen.append(plan(df)), cut_lineage(df, name))[1])
    rep = reports(spark)
    build_dictionary(rep), P.report_facts(rep)
    assert sum("regexp_replace" in x for x in seen) == 2
    assert not any("regexp_replace" in x and "Aggregate" in x for x in [*seen, plan(P.report_facts(rep))])


def test_report_is_made_once_a_pair(spark, monkeypatch):
    req = spark.createDataFrame([(1, "a", "b"), (2, "B", "A"), (3, "a", "zz"), (4, "a", ""), (5, "a", "a-")],
                                "request_id long, drug_a string, drug_b string")
    score = F.struct(F.lit(8.0).alias("score"), F.lit("LOW").alias("label"))
    monkeypatch.setattr(SC, "tree_scores", lambda p, *_: p.withColumn("tree", score))
    monkeypatch.setattr(SC, "graph_scores", lambda p, *_: p.withColumn("graph", score))
    monkeypatch.setattr(SC, "stored", lambda s, _: (None, None, None, None, signal_rows(s)))
    made, whole = SC.report_stored(req, {}), SC.score_report(SC.score_stored(req, {}))
    assert joins(made) == 1 and "evidence#" not in plan(made) and made.dtypes == whole.dtypes
    assert sorted(map(str, made.collect())) == sorted(map(str, whole.collect()))
    assert [r.evidence_count for r in made.orderBy("request_id").collect()] == [2, 2, 0, None, None]


def test_documents_are_read_once_a_pair(spark, monkeypatch):
    req = spark.createDataFrame([(1, "a", "b"), (2, "B", "A"), (3, "a", 'zz"\\'), (4, "a", ""), (5, "a", "a-"), (6, "a", None), (6, "b", "a")],
                                "request_id long, drug_a string, drug_b string")
    score = F.struct(F.lit(8.125).alias("score"), F.lit("LOW").alias("label"))
    tree = F.struct("score.*", F.array().cast("array<string>").alias("feature_drivers"))
    monkeypatch.setattr(SC, "tree_scores", lambda p, *_: p.withColumn("score", score).withColumn("tree", tree).drop("score"))
    monkeypatch.setattr(SC, "graph_scores", lambda p, *_: p.withColumn("graph", score))
    monkeypatch.setattr(SC, "stored", lambda s, _: (None, None, None, None, signal_rows(s)))
    monkeypatch.setattr(K, "pair_requests", lambda *_: req)
    monkeypatch.setattr(K, "store_artefacts", lambda *_: {})
    kept = {}
    monkeypatch.setattr(K, "cut_lineage", lambda df, name: kept.setdefault(name, cut_lineage(kept.setdefault("text", df), name)))
    made = K.report_json_facts(spark, "")
    assert kept["document-facts"].count() == 4                  # pairs (A, B), (A, ZZ), ("", A), (A, A) of seven requests
    assert len(re.findall("from_json", plan(kept["text"]))) == 1 and "json" not in plan(made) and joins(made) == 1
    at = lambda path, kind="string": F.get_json_object("json", path).cast(kind)
    whole = SC.score_json(SC.score_stored(req, {})).select(
        "request_id", F.array_join(F.json_object_keys("json"), ",").alias("keys"), at("$.drug_a").alias("drug_a"),
        at("$.drug_b").alias("drug_b"), at("$.status").alias("status"),
        F.json_array_length(at("$.historical_evidence")).cast("bigint").alias("evidence_count"),
        at("$.historical_evidence[0].event").alias("top_event"),
        at("$.historical_evidence[0].co_occurrences", "bigint").alias("top_co_occurrences"),
        (at("$.phase2_xgb.score", "double") == F.round(at("$.phase2_xgb.score", "double"), 2)).cast("int").alias("score_rounded"))
    assert made.dtypes == whole.dtypes and made.count() == 7
    assert sorted(map(str, made.collect())) == sorted(map(str, whole.collect()))
    assert sorted((r.request_id, r.status, r.top_event) for r in made.collect())[:3] == [
        (1, "ok", "Pain"), (2, "ok", "Pain"), (3, "ok", None)]
