"""The hand-worked example: expected counts and measures computed by hand/DuckDB."""
import pytest
from pyspark.sql import functions as F

from cosignal.operators import counts as C
from cosignal.operators import pairs as P
from cosignal.operators import signals as S
from cosignal.sources.reports import reports_from_tables

DRUGS = [(1, "warfarin"), (1, "ASPIRIN"), (1, "Aspirin."),
         (2, "Warfarin"), (2, "aspirin"), (2, "omeprazole"),
         (3, "WARFARIN "), (3, "a-spirin"),
         (4, "omeprazole"), (4, "aspirin"),
         (5, "aspirin"),
         (6, "warfarin"), (6, "aspirin"),
         (7, ""), (7, "omeprazole")]
REACS = [(1, "Bleeding"), (1, "Nausea"), (2, "Bleeding"), (2, "Headache"), (3, "Bleeding"),
         (4, "Nausea"), (4, "Headache"), (5, "Bleeding"), (7, "Rash")]
DEMOS = [(1, 70.0, "M"), (2, 55.0, "F"), (3, None, "F"), (4, 33.0, "M"), (5, 20.0, "F"),
         (6, 41.0, "M"), (7, 9.0, "F")]

EXPECTED = [
    ("ASPIRIN", "WARFARIN", "Bleeding", 3, 1.633333, 2.520000, 1.342280),
    ("ASPIRIN", "OMEPRAZOLE", "Headache", 2, 1.600000, 2.200000, 1.049737),
    ("ASPIRIN", "OMEPRAZOLE", "Bleeding", 1, 0.533333, 0.333333, 0.296282),
    ("ASPIRIN", "OMEPRAZOLE", "Nausea", 1, 1.600000, 1.857143, 0.662310),
    ("ASPIRIN", "WARFARIN", "Headache", 1, 0.500000, 0.333333, 0.281047),
    ("ASPIRIN", "WARFARIN", "Nausea", 1, 1.166667, 1.222222, 0.535934),
    ("OMEPRAZOLE", "WARFARIN", "Bleeding", 1, 1.111111, 1.222222, 0.517930),
    ("OMEPRAZOLE", "WARFARIN", "Headache", 1, 1.428571, 1.857143, 0.615032),
]


def make_reports(spark, drugs=DRUGS, reacs=REACS, demos=DEMOS, quarter="2025q1"):
    q = F.lit(quarter).alias("quarter")
    d = spark.createDataFrame(drugs, "PRIMARYID bigint, DRUGNAME string").select(q, "*")
    r = spark.createDataFrame(reacs, "PRIMARYID bigint, PT string").select(q, "*")
    m = spark.createDataFrame(demos, "PRIMARYID bigint, AGE double, SEX string").select(q, "*")
    return reports_from_tables(m, d, r)


def _signals(spark, rep, min_support=1, **kw):
    return S.signals(C.count_pair_events(rep, **kw), min_support=min_support)


def test_totals(spark):
    c = C.count_pair_events(make_reports(spark))
    assert spark.range(1).select(c.n).first()[0] == 11
    assert {r.event: r.event_total for r in c.event.collect()} == {"Bleeding": 5, "Headache": 4, "Nausea": 2}
    pt = {(r.drug_a, r.drug_b): r.pair_total for r in c.pair.collect()}
    assert pt == {("ASPIRIN", "OMEPRAZOLE"): 4, ("ASPIRIN", "WARFARIN"): 5, ("OMEPRAZOLE", "WARFARIN"): 2}


@pytest.mark.parametrize("cell_drugs", [2000, 1])
def test_signal_values(spark, cell_drugs):
    got = _signals(spark, make_reports(spark), cell_drugs=cell_drugs).collect()
    got = sorted((r.drug_a, r.drug_b, r.event, r.a, round(r.PRR, 6), round(r.ROR, 6), round(r.risk_score, 6))
                 for r in got)
    assert got == sorted(EXPECTED)


def test_support_filter_and_order(spark):
    rows = S.ordered(_signals(spark, make_reports(spark), min_support=3)).collect()
    assert [(r.drug_a, r.drug_b, r.event) for r in rows] == [("ASPIRIN", "WARFARIN", "Bleeding")]
    rows = S.ordered(_signals(spark, make_reports(spark))).collect()
    assert [round(r.risk_score, 6) for r in rows] == sorted((e[6] for e in EXPECTED), reverse=True)


def test_pair_events_rows(spark):
    pe = P.pair_events(make_reports(spark))
    assert pe.count() == 11
    assert pe.filter("drug_a >= drug_b").count() == 0
    c = C.count_rows(pe)
    assert spark.range(1).select(c.n).first()[0] == 11


def test_null_event_counts_in_totals_only(spark):
    rep = make_reports(spark, reacs=REACS + [(1, None)])
    c = C.count_pair_events(rep)
    assert spark.range(1).select(c.n).first()[0] == 12
    pt = {(r.drug_a, r.drug_b): r.pair_total for r in c.pair.collect()}
    assert pt[("ASPIRIN", "WARFARIN")] == 6
    sig = S.signals(c, min_support=1)
    assert sig.filter(F.col("event").isNull()).count() == 0


def test_doubled_reaction_row_doubles_counts(spark):
    rep = make_reports(spark, reacs=REACS + [(3, "Bleeding")])
    c = C.count_pair_events(rep)
    a = {(r.drug_a, r.drug_b, r.event): r.a for r in c.pair_event.collect()}
    assert a[("ASPIRIN", "WARFARIN", "Bleeding")] == 4


def test_same_id_two_quarters_counted_twice(spark):
    r1 = make_reports(spark, quarter="2025q1")
    r2 = make_reports(spark, quarter="2025q2")
    from cosignal.sources.reports import Reports
    rep = Reports(r1.demo.unionByName(r2.demo), r1.drug.unionByName(r2.drug), r1.reac.unionByName(r2.reac))
    c = C.count_pair_events(rep)
    assert spark.range(1).select(c.n).first()[0] == 22


def test_factored_plan_equals_one_scan(spark):
    rep = make_reports(spark, reacs=REACS + [(1, None), (3, "Bleeding")])
    one, fac = C.count_pair_events(rep), C.count_factored(rep)
    assert sorted(map(tuple, one.pair_event.collect()), key=str) == sorted(map(tuple, fac.pair_event.collect()), key=str)
    assert sorted(map(tuple, one.pair.collect())) == sorted(map(tuple, fac.pair.collect()))
    assert sorted(map(tuple, one.event.collect()), key=str) == sorted(map(tuple, fac.event.collect()), key=str)
    assert spark.range(1).select(one.n).first()[0] == spark.range(1).select(fac.n).first()[0]
