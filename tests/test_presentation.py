from pyspark.sql import functions as F

from cosignal.functions import presentation as X


def _col(spark, values, fn, typ="double"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_risk_labels(spark):
    assert _col(spark, [10.0, 10.01, 5.0, 5.01], X.risk_label) == [
        "MEDIUM RISK", "HIGH RISK", "LOW RISK", "MEDIUM RISK"]


def test_map_to_100(spark):
    got = _col(spark, [0.0, 2.5, 5.0, 7.5, 10.0, 15.0, 20.0, 25.0, 40.0, -1.0], X.map_to_100)
    assert [round(g, 6) for g in got] == [0, 20, 40, 57.5, 75, 82.5, 90, 95, 100, -8]


def test_composite(spark):
    df = spark.createDataFrame([(10.0, 10.0), (5.0, 5.0)], "a double, b double")
    rows = df.select(X.composite_score("a", "b").alias("c")).select(
        "c", X.composite_label("c")).collect()
    assert [tuple(r) for r in rows] == [(75, "MODERATE RISK"), (40, "LOW RISK")]


def test_prr_bands(spark):
    assert _col(spark, [2.0, 2.01, 10.0, 10.01], X.prr_band) == ["LOW", "MOD", "MOD", "HIGH"]


def test_texts(spark):
    assert _col(spark, ["a" * 25, "short"], X.truncate_label, "string") == ["a" * 20 + "…", "short"]
    assert _col(spark, [1234567.0], X.thousands) == ["1,234,567"]
    assert _col(spark, [1, 12], X.rank_label, "int") == ["01", "12"]
    assert _col(spark, [10.0, 40.0], X.bar_width) == [50.0, 100.0]
    df = spark.createDataFrame([(80, True), (80, False), (50, True), (10, False)], "c int, e boolean")
    adv = [r[0] for r in df.select(X.advice_text("c", F.col("e"))).collect()]
    assert adv[0].startswith("Significant") and adv[1].startswith("Theoretical risk")
    assert adv[2].startswith("Moderate interaction") and adv[3].startswith("Low theoretical")
