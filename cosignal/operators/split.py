"""Deterministic train/test split by hashing the undirected pair key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_bucket(a: str = "drug_a", b: str = "drug_b") -> Column:
    """0..99 from the first 32 bits of md5('drug_a#drug_b'); pairs are canonical, so
    both directions of an edge get the same bucket."""
    key = F.concat_ws("#", F.least(a, b), F.greatest(a, b))
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(100))


def hash_split(df: DataFrame, train_pct: int = 80, a: str = "drug_a",
               b: str = "drug_b") -> tuple[DataFrame, DataFrame]:
    """(train, test): bucket < train_pct is train. Stable across runs and engines."""
    tagged = df.withColumn("_bucket", split_bucket(a, b))
    train = tagged.filter(F.col("_bucket") < train_pct).drop("_bucket")
    test = tagged.filter(F.col("_bucket") >= train_pct).drop("_bucket")
    return train, test
