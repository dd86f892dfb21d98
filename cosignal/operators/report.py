"""Per-pair reports over the signal table, for any number of pairs at once.

Ranking within a pair is a window partitioned by the pair; with a rank limit Spark
plans a per-partition ``WindowGroupLimit`` before the shuffle, so a pair with very many
events contributes only its top rows to the exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cosignal.functions import presentation as X
from cosignal.functions.names import canonical_pair
from cosignal.operators.graph import drug_catalog as distinct_drugs
from cosignal.session import cut_lineage
from cosignal.sources.buckets import Bucketed
from cosignal.sources.tables import path_exists, read_first

PAIR = ["drug_a", "drug_b"]
RANK_DIGITS = 9


def rank_events(signals: DataFrame, k: int | None = 10, rank_digits: int = RANK_DIGITS) -> DataFrame:
    """Rows ranked within their pair by risk score (desc), ties by event; ``rank`` <= k."""
    w = Window.partitionBy(*PAIR).orderBy(F.round("risk_score", rank_digits).desc(), F.col("event"))
    out = signals.withColumn("rank", F.row_number().over(w).cast("bigint"))
    return out.filter(F.col("rank") <= k) if k else out


def topk_events(signals: DataFrame, k: int = 10) -> DataFrame:
    """Top-k evidence rows per pair with the two-digit rank label."""
    return (rank_events(signals, k)
            .select(*PAIR, "rank", X.rank_label("rank").alias("rank_label"), "event",
                    F.col("a").alias("co_occurrences"), "PRR", "ROR", "risk_score"))


def pair_summary(signals: DataFrame) -> DataFrame:
    """Per pair: total co-occurrences, distinct events, highest risk and its label."""
    return (signals.groupBy(*PAIR)
            .agg(F.max("pair_total").cast("bigint").alias("total_reports"),
                 F.count(F.lit(1)).alias("unique_events"),
                 F.max("risk_score").alias("max_risk"))
            .withColumn("risk_label", X.risk_label("max_risk")))


def prr_bands(evidence: DataFrame) -> DataFrame:
    """Per pair and PRR band, the number of evidence rows; empty bands are left out."""
    return (evidence.groupBy(*PAIR, X.prr_band("PRR").alias("band"))
            .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0))


def band_histogram(evidence: DataFrame) -> DataFrame:
    """Per pair: counts of HIGH, MOD and LOW PRR rows in one row."""
    p = F.col("PRR")
    return evidence.groupBy(*PAIR).agg(
        F.count_if(p > X.PRR_HIGH).alias("high_prr"),
        F.count_if((p > X.PRR_MODERATE) & (p <= X.PRR_HIGH)).alias("mod_prr"),
        F.count_if(p <= X.PRR_MODERATE).alias("low_prr"))


def peak_signal(evidence: DataFrame, shown: int = 3) -> DataFrame:
    """Per pair from ranked evidence: top event, its PRR ("peak PRR", the PRR of the row
    with the highest score, not the largest PRR), evidence count and how many are not shown."""
    return (evidence.groupBy(*PAIR)
            .agg(F.min_by("event", "rank").alias("top_event"),
                 F.min_by("PRR", "rank").alias("peak_prr"),
                 F.count(F.lit(1)).alias("evidence_count"))
            .withColumn("more", F.greatest(F.col("evidence_count") - shown, F.lit(0))))


def explanations(signals: DataFrame) -> DataFrame:
    """Per pair, the sentence about its top event."""
    top = rank_events(signals, 1)
    return top.select(*PAIR, F.col("event").alias("top_event"),
                      X.explanation("event", "a", "PRR", "ROR", "drug_a", "drug_b").alias("explanation"))


def evidence_display(evidence: DataFrame) -> DataFrame:
    """Display values of ranked evidence rows: rank label, shortened event, formatted
    count, PRR band and bar width."""
    return evidence.select(
        *PAIR, "rank", X.rank_label("rank").alias("rank_label"),
        X.truncate_label("event").alias("event_label"),
        X.thousands("co_occurrences").alias("co_occurrences_text"),
        X.prr_band("PRR").alias("band"), X.bar_width("PRR").alias("bar_width"),
        X.signal_flag("risk_score").alias("is_signal"))


def drug_catalog(signals: DataFrame) -> DataFrame:
    """Sorted distinct drug names over both pair columns, nulls dropped."""
    return distinct_drugs(signals).orderBy("drug")


def encoder_catalog(encoders: DataFrame) -> DataFrame:
    """Sorted drug names of the stored encoders: the first choice for a catalog, the signal
    table (``drug_catalog``) the second."""
    return encoders.select("drug").distinct().dropna().orderBy("drug")


def stored_catalog(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Sorted drug names of a build (``plans.build.artefacts``): of its encoders, or, where those
    are missing or empty, of its signal table in either layout."""
    if path_exists(spark, paths["encoders"]):
        found = encoder_catalog(spark.read.parquet(paths["encoders"]))
        if not found.isEmpty():
            return found
    return drug_catalog(read_first(spark, [paths["signals_by_pair"], paths["signals"]]))


def drug_search(catalog: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring match on drug names."""
    return catalog.filter(F.lower("drug").contains(query.lower()))


def composite(scores: DataFrame, score_a: str, score_b: str, has_evidence: str) -> DataFrame:
    """Composite 0-100 score of two model scores, its label, colour and advice text."""
    c = X.composite_score(score_a, score_b)
    return (scores.withColumn("composite", c)
            .withColumn("composite_label", X.composite_label("composite"))
            .withColumn("composite_colour", X.composite_colour("composite"))
            .withColumn("advice", X.advice_text("composite", F.col(has_evidence))))


def model_agreement(scores: DataFrame, label_a: str, label_b: str) -> DataFrame:
    """Counts per (label_a, label_b) cell with an agreement flag."""
    return (scores.groupBy(F.col(label_a).alias("label_a"), F.col(label_b).alias("label_b"))
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("agree", (F.col("label_a") == F.col("label_b")).cast("int")))


def request_status(requests: DataFrame, a: str = "drug_a", b: str = "drug_b",
                   mode: str = "clean") -> DataFrame:
    """Canonicalise raw requested pairs and flag missing sides and self pairs."""
    ca, cb = canonical_pair(a, b, mode)
    out = requests.select("*", ca.alias("_a"), cb.alias("_b"))
    status = (F.when((F.col("_a") == "") | (F.col("_b") == ""), "missing_drug")
              .when(F.col("_a") == F.col("_b"), "same_drug").otherwise("ok"))
    return (out.withColumn("status", status).drop(a, b)
            .withColumnRenamed("_a", "drug_a").withColumnRenamed("_b", "drug_b"))


def of_requests(signals: DataFrame, requests: DataFrame) -> DataFrame:
    """The signal rows of the requested pairs: a semi-join on the distinct canonical pairs,
    below any aggregation or ranking. Read ``signals`` from the pair layout, so that a
    small request table skips most row groups."""
    wanted = requests.filter(F.col("status") == "ok").select(*PAIR).distinct()
    return signals.join(wanted, PAIR, "left_semi")


FILTERED_PAIRS = 1_000       # requested pairs up to this number become a filter on the pair key


def of_bucketed(signals: Bucketed, requests: DataFrame) -> DataFrame:
    """As ``of_requests`` for a table of ``write_signals_bucketed``: the signal side of the join is
    read as it lies. A request table of at most ``FILTERED_PAIRS`` pairs also becomes a filter
    on ``pair_key``, so the scan skips row groups by their Bloom filters; the join decides."""
    # Merged in the tasks that read the requests before they are dealt like the buckets: there may
    # be one bucket only.
    wanted = signals.match(requests.filter(F.col("status") == "ok").select(*PAIR).distinct())
    rows = signals.table
    few = [r[0] for r in wanted.select(F.xxhash64(*PAIR)).limit(FILTERED_PAIRS + 1).collect()]
    if len(few) <= FILTERED_PAIRS:
        rows = rows.filter(F.col("pair_key").isin(few))
    return rows.join(wanted, PAIR, "left_semi").drop("pair_key")


def bucketed_lookup(requests: DataFrame, signals: Bucketed, mode: str = "clean") -> DataFrame:
    """``pair_lookup`` on a bucketed signal table: the distinct requested pairs meet the buckets, the
    requests only the summaries, which are stored so that few of them are broadcast."""
    req = cut_lineage(request_status(requests, mode=mode), "requests")
    return _looked_up(req, cut_lineage(pair_summary(of_bucketed(signals, req)), "summaries"))


def pair_lookup(requests: DataFrame, signals: DataFrame, mode: str = "clean") -> DataFrame:
    """Per requested pair (raw names): canonical pair, status and its summary, or the
    'no evidence' status when the pair has no signal rows. An equi-join on the canonical
    pair, never an OR of both orders. ``mode='upper_trim'`` normalises names with upper
    case and trim only."""
    req = request_status(requests, mode=mode)
    return _looked_up(req, pair_summary(of_requests(signals, req)))


def _looked_up(req: DataFrame, summ: DataFrame) -> DataFrame:
    j = req.join(summ, PAIR, "left")
    status = F.when((F.col("status") == "ok") & F.col("total_reports").isNull(), "no_evidence") \
        .otherwise(F.col("status"))
    return j.withColumn("status", status)


def pair_reports(requests: DataFrame, signals: DataFrame, mode: str = "clean") -> DataFrame:
    """``pair_lookup`` plus the sentence on each pair's top event; only requested pairs are
    ranked."""
    req = cut_lineage(request_status(requests, mode=mode), "requests")
    rows = of_requests(signals, req)
    # One record a pair: the requests, stored once, meet them in one join.
    return _looked_up(req, pair_summary(rows).join(explanations(rows), PAIR, "left"))
