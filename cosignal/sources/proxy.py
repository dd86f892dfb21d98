"""Stand-in report tables built from the TPC-H-like test tables.

This only produces rows in the report schema; all the work happens in the operators.

| report column | test-table expression |
|---|---|
| PRIMARYID | lineitem.l_orderkey |
| DRUGNAME | part.p_name through l_partkey (one row per line item) |
| PT | concat_ws(' ', p_brand, p_type) (one row per line item, not de-duplicated) |
| AGE, SEX | try_cast(substr(o_orderpriority, 1, 1) as int), o_orderstatus |
| quarter | concat(year(o_orderdate), 'q', quarter(o_orderdate)) |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cosignal.session import cut_lineage
from cosignal.sources.reports import Reports


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("PRIMARYID"),
        F.concat(F.year("o_orderdate").cast("string"), F.lit("q"),
                 F.quarter("o_orderdate").cast("string")).alias("quarter"),
        F.substring("o_orderpriority", 1, 1).try_cast("int").cast("double").alias("AGE"),
        F.col("o_orderstatus").alias("SEX"),
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("PRIMARYID"), F.col("l_partkey").alias("p_partkey"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    quarters = _orders(spark, sf_dir).select("PRIMARYID", "quarter")
    # The narrow columns meet the orders first, names come last; stored, because every operator
    # reads the drugs and the reactions several times. The event's name is made once, here.
    lines = li.join(quarters, "PRIMARYID").join(part, "p_partkey")
    return cut_lineage(lines.select("quarter", "PRIMARYID", F.col("p_name").alias("DRUGNAME"),
                                    F.concat_ws(" ", "p_brand", "p_type").alias("PT")), "lines")


def proxy_reports(spark: SparkSession, sf_dir: str) -> Reports:
    lines = _lines(spark, sf_dir)
    demo = _orders(spark, sf_dir).select("quarter", "PRIMARYID", "AGE", "SEX")
    return Reports(demo=demo, drug=lines.select("quarter", "PRIMARYID", "DRUGNAME"),
                   reac=lines.select("quarter", "PRIMARYID", "PT"))


# The same stand-in as DuckDB views; shared by every oracle query.
PROXY_SQL = """
proxy_orders AS (
  SELECT o_orderkey AS PRIMARYID,
         concat(CAST(year(o_orderdate) AS VARCHAR), 'q', CAST(quarter(o_orderdate) AS VARCHAR)) AS quarter,
         CAST(try_cast(substr(o_orderpriority, 1, 1) AS INTEGER) AS DOUBLE) AS AGE,
         o_orderstatus AS SEX
  FROM orders
),
proxy_lines AS (
  SELECT l.l_orderkey AS PRIMARYID, o.quarter, p.p_name, p.p_brand, p.p_type
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  JOIN proxy_orders o ON l.l_orderkey = o.PRIMARYID
),
demo AS (SELECT quarter, PRIMARYID, AGE, SEX FROM proxy_orders),
drug AS (SELECT quarter, PRIMARYID, p_name AS DRUGNAME FROM proxy_lines),
reac AS (SELECT quarter, PRIMARYID, concat_ws(' ', p_brand, p_type) AS PT FROM proxy_lines)
"""


def pair_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested pairs as raw text, like user input: every line item's part name with the
    next line's of its order (the last line has no partner: a missing name; a repeated part
    gives a same-drug request), and every customer's name with a nation's (names no report
    has). ``request_id`` is unique: a running number within the order, negative for
    customers.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("drug_a"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = (li.join(names, "l_partkey").withColumn("n", F.row_number().over(order))
             .withColumn("drug_b", F.lead("drug_a").over(order))
             .select((F.col("l_orderkey") * 1000 + F.col("n")).cast("bigint").alias("request_id"), "drug_a", "drug_b"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("drug_b"))
    unseen = (table(spark, sf_dir, "customer").join(nation, "c_nationkey")
              .select((-F.col("c_custkey") - 1).cast("bigint").alias("request_id"), F.col("c_name").alias("drug_a"), "drug_b"))
    return lines.unionByName(unseen)


REQUESTS_SQL = """
requests AS (
  SELECT CAST(l_orderkey * 1000 + row_number() OVER w AS BIGINT) AS request_id, p_name AS drug_a,
         lead(p_name) OVER w AS drug_b
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)
  UNION ALL
  SELECT CAST(-c_custkey - 1 AS BIGINT), c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
)
"""
