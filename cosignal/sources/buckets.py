"""Bucketed Parquet tables: hash-partitioned and sorted by their join key at rest.

A join or aggregation on the key of a bucketed table reads it as it lies, without exchange;
only the other side is shuffled, into as many partitions as there are buckets (``Bucketed.match``;
Spark would shuffle the side with fewer partitions otherwise). Each bucket is written by one task into one file, and the
number of buckets follows from the rows. Optional Bloom filters on a column let a scan with a
short list of values skip row groups.

Spark keeps bucketing in its catalog, so a table is registered under a name of its own in the
session that reads it; the layout travels in a small table beside the data, and other sessions
register it again from there.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_BUCKET = 2_000_000


@dataclass(frozen=True)
class Layout:
    keys: tuple[str, ...]
    sort: tuple[str, ...]
    buckets: int


@dataclass(frozen=True)
class Bucketed:
    table: DataFrame
    layout: Layout

    def match(self, other: DataFrame, keys: list[str] | None = None) -> DataFrame:
        """``other`` dealt like the buckets by its ``keys`` (default the table's)."""
        return other.repartition(self.layout.buckets, *(keys or self.layout.keys))


def buckets_for(df: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """At least one bucket per core of a small cluster would be many tiny files: the number
    follows from the rows alone."""
    return max(1, -(-df.count() // rows_per_bucket))


def write_bucketed(df: DataFrame, path: str, keys: list[str], sort: list[str] | None = None, buckets: int | None = None,
                   bloom: str | None = None, options: dict | None = None) -> Bucketed:
    """Write ``df`` to ``path`` in buckets by ``keys``, sorted by ``sort`` (default the keys) within
    each, and return it. ``bloom`` names a column that gets Bloom filters.
    ``df`` is counted first unless ``buckets`` is given, so it should be stored."""
    spark = df.sparkSession
    layout = Layout(tuple(keys), tuple(sort or keys), buckets or buckets_for(df))
    name = f"bucketed_{uuid.uuid4().hex}"
    # The same hash as the buckets': every bucket lies in one partition.
    writer = (df.repartition(layout.buckets, *keys).write.format("parquet").mode("overwrite")
              .bucketBy(layout.buckets, *keys).sortBy(*layout.sort).option("path", path))
    if bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{bloom}", "true")
    for k, v in (options or {}).items():
        writer = writer.option(k, v)
    writer.saveAsTable(name)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    spark.createDataFrame([(list(layout.keys), list(layout.sort), layout.buckets, columns)],
                          "keys array<string>, sort array<string>, buckets int, columns string"
                          ).write.mode("overwrite").parquet(f"{path}-layout")
    return Bucketed(spark.table(name), layout)


def read_bucketed(spark: SparkSession, path: str) -> Bucketed:
    """The table at ``path`` with its bucketing, registered in this session."""
    made = spark.read.parquet(f"{path}-layout").first()
    name, quoted = f"bucketed_{uuid.uuid4().hex}", path.replace("'", "\\'")
    listed = lambda cs: ", ".join(f"`{c}`" for c in cs)
    spark.sql(f"CREATE TABLE {name} ({made['columns']}) USING parquet CLUSTERED BY ({listed(made['keys'])}) "
              f"SORTED BY ({listed(made['sort'])}) INTO {made['buckets']} BUCKETS LOCATION '{quoted}'")
    return Bucketed(spark.table(name), Layout(tuple(made["keys"]), tuple(made["sort"]), made["buckets"]))
