"""Helpers shared by the text operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cosignal.session import cut_lineage

# ASCII blanks: space, tab, newline, vertical tab, form feed, carriage return. Python's
# bytes.split() and bytes.strip() use exactly this set.
BLANKS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back, so
    later steps neither recompute it nor depend on executors that may be lost."""
    return cut_lineage(df, name, as_table=True)


def column(df: DataFrame, name: str, kind: str) -> Column:
    """``df[name]`` as ``kind``, or a null of that type when the table lacks the column."""
    if name in df.columns:
        return df[name].cast(kind)
    return F.lit(None).cast(kind)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
