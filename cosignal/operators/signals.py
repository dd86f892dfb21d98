"""Signal table: support filter, the two joins with the totals, PRR / ROR / risk score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cosignal.functions.measures import DEFAULT_EPS, prr, risk_score, ror
from cosignal.operators.counts import PAIR, Counts
from cosignal.operators.dictionary import decode
from cosignal.sources.buckets import Bucketed, write_bucketed

SIGNAL_COLS = ["drug_a", "drug_b", "event", "a", "pair_total", "event_total",
               "PRR", "ROR", "risk_score"]


def signal_order(rank_digits: int | None = None) -> list:
    """Total order for the signal table: score, support, then the key (ties broken).

    ``rank_digits`` ranks on the score rounded to that many digits, so that engines whose
    logarithms differ in the last bit still agree on ties.
    """
    score = F.col("risk_score") if rank_digits is None else F.round("risk_score", rank_digits)
    return [score.desc(), F.col("a").desc(), F.col("drug_a"), F.col("drug_b"), F.col("event")]


def signals(counts: Counts, min_support: int = 3, eps: float = DEFAULT_EPS) -> DataFrame:
    """One row per (pair, event) with a >= min_support and a non-null event.

    The support filter runs on the merged counts, before the joins; counters over ids are
    joined as ids and get their names last. The event side is small (one row per event term);
    AQE turns that join into a broadcast only when the measured size is under the broadcast
    threshold.
    """
    given = counts.coded or counts
    pec = given.pair_event.filter((F.col("a") >= min_support) & F.col("event").isNotNull())
    j = pec.join(given.pair, PAIR).join(given.event, "event")
    if counts.coded:
        j = decode(j, counts.names)
    p = prr("a", "pair_total", "event_total", counts.n, eps)
    return (j.withColumn("PRR", p)
            .withColumn("ROR", ror("a", "pair_total", "event_total", counts.n, eps))
            .withColumn("risk_score", risk_score("a", F.col("PRR")))
            .select(*SIGNAL_COLS))


def ordered(signals_df: DataFrame) -> DataFrame:
    """Global order by risk score, then support, then key."""
    return signals_df.orderBy(*signal_order())


def top_signals(signals_df: DataFrame, k: int = 20, rank_digits: int | None = 9) -> DataFrame:
    """The k strongest signals (a top-k report: the limit is the feature)."""
    return signals_df.orderBy(*signal_order(rank_digits)).limit(k)


def pair_key(a: str = "drug_a", b: str = "drug_b") -> F.Column:
    """64-bit hash of a canonical pair: one column for filters on pairs."""
    return F.xxhash64(a, b)


def write_signals_bucketed(signals_df: DataFrame, path: str, buckets: int | None = None, options: dict | None = None) -> Bucketed:
    """The signal table bucketed by pair and sorted by it, with ``pair_key`` under Bloom filters:
    joins and aggregations by pair need no exchange, short request lists skip row groups.
    ``signals_df`` should be stored. Returns the stored table."""
    return write_bucketed(signals_df.withColumn("pair_key", pair_key()), path, PAIR, [*PAIR, "risk_score"],
                          buckets, "pair_key", options)


def write_signals(signals_df: DataFrame, path: str, layout: str = "score",
                  partitions: int | None = None) -> None:
    """Write the signal table.

    ``layout='score'``: globally ordered by score (range-partitioned sort).
    ``layout='pair'``: range-partitioned and sorted by (drug_a, drug_b) so that pair
    lookups skip row groups by min/max statistics.
    """
    if layout == "score":
        out = signals_df.orderBy(*signal_order())
    elif layout == "pair":
        n = partitions or signals_df.sparkSession.sparkContext.defaultParallelism
        out = (signals_df.repartitionByRange(n, *PAIR)
               .sortWithinPartitions(*PAIR, F.col("risk_score").desc(), "event"))
    else:
        raise ValueError(layout)
    out.write.mode("overwrite").parquet(path)
