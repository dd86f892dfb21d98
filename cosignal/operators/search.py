"""Substring search on names through an inverted index of character n-grams.

Every name is posted under its distinct grams of one, two and three characters, and under the
empty gram. A query of three or more characters looks up its trigrams, a shorter one the gram
that it is, so every query is an equality join with the postings, never a scan per query. Of a
long query's trigrams only the ``GRAMS_USED`` with the fewest names are intersected; what is left is
verified against the name itself, so the result is exactly that of a scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRAM = 3
GRAMS_USED = 3


@dataclass(frozen=True)
class SearchIndex:
    postings: DataFrame      # gram, name
    sizes: DataFrame         # gram, names


def grams(text: Column, size: int) -> Column:
    """The distinct ``size``-character grams of a text, empty if it is shorter."""
    starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(size))))
                  ).otherwise(F.array().cast("array<string>"))


def build_index(catalog: DataFrame, path: str, name: str = "drug") -> SearchIndex:
    """Write the index of the distinct non-null names to ``path``; a name has at most three grams a
    character."""
    spark = catalog.sparkSession
    names = catalog.select(F.col(name).alias("name")).dropna().distinct().withColumn("low", F.lower("name"))
    every = F.concat(F.array(F.lit("")), *[grams(F.col("low"), k) for k in range(1, GRAM + 1)])
    (names.select(F.explode(every).alias("gram"), "name").hint("rebalance", "gram").sortWithinPartitions("gram", "name")
     .write.mode("overwrite").parquet(f"{path}/postings"))
    postings = spark.read.schema("gram string, name string").parquet(f"{path}/postings")
    postings.groupBy("gram").agg(F.count(F.lit(1)).alias("names")).write.mode("overwrite").parquet(f"{path}/sizes")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> SearchIndex:
    return SearchIndex(spark.read.schema("gram string, name string").parquet(f"{path}/postings"),
                       spark.read.schema("gram string, names long").parquet(f"{path}/sizes"))


def search(index: SearchIndex, queries: DataFrame, query: str = "query", name: str = "drug") -> DataFrame:
    """(query, name): the names that hold each distinct query, whatever the case. A null query finds
    nothing, an empty one every name."""
    asked = queries.select(F.col(query).alias("_query")).dropna().distinct().withColumn("_low", F.lower("_query"))
    looked = asked.withColumn("gram", F.explode(F.when(F.length("_low") >= GRAM, grams(F.col("_low"), GRAM))
                                                .otherwise(F.array("_low"))))
    # A gram that no name has makes its query find nothing: it counts, but joins no posting.
    sized = looked.join(index.sizes, "gram", "left").fillna(0, ["names"])
    rarest = F.row_number().over(Window.partitionBy("_query").orderBy("names", "gram"))
    used = sized.withColumn("_r", rarest).filter(F.col("_r") <= GRAMS_USED)
    needed = used.withColumn("_needed", F.count(F.lit(1)).over(Window.partitionBy("_query")))
    met = (needed.join(index.postings, "gram").groupBy("_query", "_low", "name", "_needed")
           .agg(F.count(F.lit(1)).alias("_met")).filter("_met = _needed"))
    return met.filter(F.lower("name").contains(F.col("_low"))).select(F.col("_query").alias(query), F.col("name").alias(name))
