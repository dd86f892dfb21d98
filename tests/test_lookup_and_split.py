from pyspark.sql import functions as F

from cosignal.operators import report as RP
from cosignal.operators.split import hash_split, split_bucket
from tests.test_worked_example import make_reports
from cosignal.operators import counts as C
from cosignal.operators import signals as S


def test_lookup_statuses(spark):
    sig = S.signals(C.count_pair_events(make_reports(spark)), min_support=1)
    req = spark.createDataFrame(
        [(1, "warfarin", " Aspirin."), (2, "aspirin", "ASPIRIN"), (3, "", "aspirin"),
         (4, "aspirin", "metformin"), (5, None, "x")],
        "request_id long, drug_a string, drug_b string")
    out = {r.request_id: r for r in RP.pair_lookup(req, sig).collect()}
    assert (out[1].drug_a, out[1].drug_b, out[1].status) == ("ASPIRIN", "WARFARIN", "ok")
    assert out[1].total_reports == 5 and out[1].unique_events == 3
    assert out[2].status == "same_drug"
    assert out[3].status == "missing_drug" and out[5].status == "missing_drug"
    assert out[4].status == "no_evidence" and out[4].total_reports is None


def test_upper_trim_mode_keeps_punctuation(spark):
    req = spark.createDataFrame([(1, " aspirin.", "warfarin")], "request_id long, drug_a string, drug_b string")
    row = RP.request_status(req, mode="upper_trim").first()
    assert (row.drug_a, row.drug_b) == ("ASPIRIN.", "WARFARIN")


def test_hash_split_is_undirected_and_stable(spark):
    df = spark.range(2000).select(F.concat(F.lit("D"), F.col("id").cast("string")).alias("drug_a"),
                                  F.concat(F.lit("E"), (F.col("id") * 7).cast("string")).alias("drug_b"))
    b1 = df.select(split_bucket().alias("b")).collect()
    b2 = df.select(split_bucket("drug_b", "drug_a").alias("b")).collect()
    assert b1 == b2
    train, test = hash_split(df)
    n_train, n_test = train.count(), test.count()
    assert n_train + n_test == 2000 and 0.75 < n_train / 2000 < 0.85
    assert train.join(test, ["drug_a", "drug_b"]).count() == 0


def test_lookup_prunes_before_it_summarises(spark):
    sig = S.signals(C.count_pair_events(make_reports(spark)), min_support=1)
    from cosignal.session import cut_lineage
    stored = cut_lineage(sig)
    req = spark.createDataFrame([(1, "warfarin", "aspirin")], "request_id long, drug_a string, drug_b string")
    plan = RP.pair_reports(req, stored)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    semi = [i for i, x in enumerate(lines) if "Join LeftSemi" in x]
    above = [i for i, x in enumerate(lines) if "Aggregate [drug_a" in x and "unique_events" in x]
    ranked = [i for i, x in enumerate(lines) if "Window" in x]
    assert semi and above and ranked
    assert min(above) < semi[0] and min(ranked) < semi[-1]
