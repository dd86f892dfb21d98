from pyspark.sql import Window
from pyspark.sql import functions as F

from cosignal.operators import graph as G


def test_dense_index_matches_row_number(spark):
    df = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("drug"))
    got = G.dense_index(df, "drug", partitions=7)
    ref = df.withColumn("ref", F.row_number().over(Window.orderBy("drug")) - 1)
    j = got.join(ref, "drug")
    assert j.count() == 5000
    assert j.filter(F.col("idx") != F.col("ref")).count() == 0


def test_propagation_small_graph(spark):
    nodes = spark.createDataFrame([(0, "A", 1.0), (1, "B", 2.0), (2, "C", 4.0), (3, "D", 8.0)],
                                  "idx long, drug string, x double")
    e = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0)], "src long, dst long, w double")
    edges = e.unionByName(e.selectExpr("dst as src", "src as dst", "w"))
    out = {r.drug: (r.h1_x, r.h2_x) for r in G.propagate(nodes, edges, ["x"], 2).collect()}
    assert out["A"] == (3.0, 1.0) and out["B"] == (1.0, 3.0) and out["D"] == (0.0, 0.0)
