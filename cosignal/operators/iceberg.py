"""Support-pruned counting with a count-min sketch.

Only groups of ``min_support`` or more rows are wanted, and most groups of real reports are
rarer than that. The first pass adds every row's weight to one bucket per sketch row; sketches
of tasks merge by adding. A group's bucket sums are never below its own sum, so a group with
any bucket under the support cannot reach it. The second pass drops those rows before the
shuffle by the full key; what stays is counted exactly and filtered exactly, so the result
does not depend on the sketch's size, only the number of rows shuffled does.

After the first pass one bit per bucket is left (sum reaches the support or not), packed into
64-bit words: ``rows * 2^bits / 8`` bytes, which bounds the broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cosignal.session import cut_lineage

WORDS = 1024                # 64-bit words in one block of the bit map
BLOCK_BITS = 16             # 1024 words of 64 bits
MAX_BITS = 27


@dataclass(frozen=True)
class SketchSize:
    """``rows`` sketch rows of ``2^bits`` buckets. The bit map takes rows * 2^(bits - 3) bytes:
    2 MB a row by default, at most 16 MB. The sketch prunes while the summed weight is not
    far above ``min_support * 2^bits``."""
    bits: int = 24
    rows: int = 1

    def __post_init__(self) -> None:
        if not BLOCK_BITS <= self.bits <= MAX_BITS or not 1 <= self.rows <= 4:
            raise ValueError(f"sketch of {self.rows} rows of 2^{self.bits} buckets: bits must be "
                             f"{BLOCK_BITS} to {MAX_BITS}, rows 1 to 4")


def bucket(keys: list[str], row: int, size: SketchSize) -> Column:
    return F.pmod(F.xxhash64(F.lit(row), *keys), F.lit(1 << size.bits)).cast("int")


def sketch(rows: DataFrame, keys: list[str], weight: str, size: SketchSize) -> DataFrame:
    """row, bucket, total: the count-min sketch, summed per task before its shuffle."""
    cells = F.explode(F.array(*[F.struct(F.lit(j).cast("byte").alias("row"), bucket(keys, j, size).alias("bucket"))
                                for j in range(size.rows)]))
    return (rows.select(F.col(weight).alias("w"), cells.alias("c"))
            .groupBy(F.col("c.row").alias("row"), F.col("c.bucket").alias("bucket"))
            .agg(F.sum("w").alias("total")))


def heavy_buckets(sketched: DataFrame, min_support: int, size: SketchSize) -> DataFrame:
    """row, block, words: one bit per bucket whose total reaches ``min_support``."""
    spark = sketched.sparkSession
    heavy = sketched.filter(F.col("total") >= min_support).select(
        "row", F.shiftright("bucket", 6).alias("word"), F.expr("shiftleft(1L, bucket & 63)").alias("bits"))
    zero = spark.range(1 << (size.bits - 6)).select(
        F.explode(F.array(*[F.lit(j).cast("byte") for j in range(size.rows)])).alias("row"),
        F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = heavy.unionByName(zero).groupBy("row", "word").agg(F.bit_or("bits").alias("bits"))
    return (words.groupBy("row", F.shiftright("word", BLOCK_BITS - 6).alias("block"))
            .agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("ws"))
            .select("row", "block", F.transform("ws", lambda w: w["bits"]).alias("words")))


def keep_heavy(rows: DataFrame, keys: list[str], heavy: DataFrame, size: SketchSize) -> DataFrame:
    """The rows none of whose buckets is under the support."""
    for j in range(size.rows):
        # Bounded by SketchSize: 2^(bits - 3) bytes.
        part = F.broadcast(heavy.filter(F.col("row") == j).select(
            F.col("block").alias("_block"), F.col("words").alias("_words")))
        at = rows.withColumn("_b", bucket(keys, j, size))
        joined = at.join(part, F.shiftright("_b", BLOCK_BITS) == F.col("_block"))
        bit = F.expr(f"shiftright(get(_words, shiftright(_b, 6) & {WORDS - 1}), _b & 63) & 1L")
        rows = joined.filter(bit == 1).select(*rows.columns)
    return rows


def frequent(rows: DataFrame, keys: list[str], weight: str, min_support: int, size: SketchSize | None,
             total: str = "a") -> DataFrame:
    """``keys`` and their summed weight, for groups of at least ``min_support``; with a
    ``size`` the rows are pruned by a sketch first. The result is the same either way.
    ``rows`` is read twice then: it should come from a stored table."""
    if size is not None:
        heavy = cut_lineage(heavy_buckets(sketch(rows, keys, weight, size), min_support, size), "heavy-buckets")
        rows = keep_heavy(rows, keys, heavy, size)
    return (rows.groupBy(*keys).agg(F.sum(weight).cast("bigint").alias(total))
            .filter(F.col(total) >= min_support))
