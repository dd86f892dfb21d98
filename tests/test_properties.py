"""Invariants on the stand-in tables (sf0.001)."""
from pyspark.sql import functions as F

from cosignal.operators import counts as C
from cosignal.operators import signals as S
from cosignal.sources.proxy import proxy_reports
from cosignal.streaming import counters as R


def test_signal_invariants(spark, sf_dir):
    rep = proxy_reports(spark, sf_dir)
    c = C.count_pair_events(rep)
    n = spark.range(1).select(c.n).first()[0]
    assert n == 64079  # pair-event rows at sf0.001, as measured independently in DuckDB
    assert c.pair_event.agg(F.sum("a")).first()[0] == n
    sig = S.signals(c, min_support=3)
    bad = sig.filter((F.col("drug_a") >= F.col("drug_b"))
                     | (F.col("a") > F.least("pair_total", "event_total"))
                     | (F.lit(n) - F.col("pair_total") - F.col("event_total") + F.col("a") < 0)
                     | (F.col("PRR") <= 0))
    assert bad.count() == 0
    assert sig.count() == 5232


def test_factored_equals_one_scan(spark, sf_dir):
    rep = proxy_reports(spark, sf_dir)
    one, fac = C.count_pair_events(rep), C.count_factored(rep)
    assert one.pair_event.exceptAll(fac.pair_event).count() == 0
    assert fac.pair_event.exceptAll(one.pair_event).count() == 0
    assert one.pair.exceptAll(fac.pair).count() == 0
    assert one.event.exceptAll(fac.event).count() == 0
    assert spark.range(1).select(one.n, fac.n).first() == (64079, 64079)


def test_grid_salting_is_exact(spark, sf_dir):
    rep = proxy_reports(spark, sf_dir)
    plain = C.count_pair_events(rep).pair_event
    salted = C.count_pair_events(rep, cell_drugs=2).pair_event
    assert plain.exceptAll(salted).count() == 0 and salted.exceptAll(plain).count() == 0


def test_batch_split_invariance(spark, sf_dir):
    rep = proxy_reports(spark, sf_dir)
    merged = R.merge_counters(R.report_batch_counters(rep))
    direct = C.count_pair_events(rep)
    assert merged.pair_event.exceptAll(direct.pair_event).count() == 0
    assert merged.pair.exceptAll(direct.pair).count() == 0
    assert spark.range(1).select(merged.n).first()[0] == 64079


def test_any_budget_gives_the_same_rows(spark, sf_dir):
    from cosignal.operators import pairs as P
    rep = proxy_reports(spark, sf_dir)
    base = C.pair_event_counts(rep)
    for drugs, rows in ((2, 4), (3, 1_000_000), (512, 1)):
        other = C.pair_event_counts(rep, cell_drugs=drugs, cell_rows=rows)
        assert base.exceptAll(other).count() == 0 and other.exceptAll(base).count() == 0
    rows, small = P.pair_events(rep), P.pair_events(rep, cell_drugs=2, cell_rows=3)
    assert rows.exceptAll(small).count() == 0 and small.exceptAll(rows).count() == 0


def test_hot_report_is_spread(spark):
    """One report with 40 drugs and 20,000 events: its 15.6 million rows come from many cells,
    none much over the budget, and the sums are exact."""
    from cosignal.operators import cells as CE
    from cosignal.operators import pairs as P
    from cosignal.operators.dictionary import build_dictionary
    from cosignal.sources.reports import Reports
    drug = spark.range(40).select(F.lit("q").alias("quarter"), F.lit(1).cast("long").alias("PRIMARYID"),
                                  F.concat(F.lit("D"), F.col("id").cast("string")).alias("DRUGNAME"))
    reac = spark.range(20_000).select(F.lit("q").alias("quarter"), F.lit(1).cast("long").alias("PRIMARYID"),
                                      F.concat(F.lit("E"), F.col("id").cast("string")).alias("PT"))
    demo = spark.createDataFrame([("q", 1, 40.0, "F")], "quarter string, PRIMARYID long, AGE double, SEX string")
    rep = Reports(demo=demo, drug=drug, reac=reac)
    names = build_dictionary(rep)
    cells = CE.store_cells(rep, names, cell_rows=100_000)
    bound = 2 * 100_000 // CE.CELL_DRUGS ** 2 * 780          # facts of a slice x pairs of the chunk
    sizes = [r.rows for r in cells.table.collect()]
    assert sum(sizes) == 780 * 20_000 and max(sizes) <= bound
    per_task = [r["count"] for r in CE.triples(cells).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 780 * 20_000 and len(per_task) >= 4
    assert max(per_task) <= 0.5 * sum(per_task)
    assert C.pair_event_counts(rep, cell_rows=100_000).count() == 780 * 20_000
    facts = P.event_counts_of_reports(rep)
    plan = P.cell_plan(P.clean_drugs(drug), facts, cell_rows=100_000).first()
    assert plan.g == 1 and plan.s == 160


def test_one_event_very_often(spark):
    """A reaction repeated 50,000 times is cut into chunks and multiplied out exactly."""
    from cosignal.operators import pairs as P
    from cosignal.sources.reports import Reports
    drug = spark.createDataFrame([("q", 1, x) for x in "abc"], "quarter string, PRIMARYID long, DRUGNAME string")
    reac = spark.range(50_000).select(F.lit("q").alias("quarter"), F.lit(1).cast("long").alias("PRIMARYID"),
                                      F.lit("Pain").alias("PT"))
    demo = spark.createDataFrame([("q", 1, None, "F"), ("q", 1, None, "F")],
                                 "quarter string, PRIMARYID long, AGE double, SEX string")
    rep = Reports(demo=demo, drug=drug, reac=reac)
    assert P.pair_events(rep, cell_rows=1000).groupBy("drug_a", "drug_b", "age").count().select("count").distinct().collect() == [(100_000,)]
    assert C.pair_event_counts(rep, cell_rows=1000).agg(F.sum("a")).first()[0] == 300_000


def test_build_explodes_once(spark, sf_dir):
    """The counters come from one explosion: no other counter table reads the reports."""
    counters = R.report_batch_counters(proxy_reports(spark, sf_dir))
    for df in counters.values():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan and "Generate" not in plan
