"""Pair-level features with frequency and target encodings of each drug."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIR = ["drug_a", "drug_b"]

# The feature order of the regression models.
FEATURES = [
    "drug_a_freq", "drug_b_freq", "drug_a_mean_risk", "drug_b_mean_risk",
    "combined_risk_interaction", "risk_difference", "freq_ratio",
    "drug_a_log_freq", "drug_b_log_freq", "log_combined_risk", "log_risk_difference",
]
TARGET = "log_max_risk"
RATIO_GUARD = 1e-6


def log1p_clip(c) -> Column:
    """log(1 + max(x, 0))."""
    c = F.col(c) if isinstance(c, str) else c
    return F.log1p(F.greatest(c.cast("double"), F.lit(0.0)))


def pair_max_risk(signals: DataFrame) -> DataFrame:
    """drug_a, drug_b, max_risk, total_reports, log_max_risk (one row per pair).

    ``pair_total`` is constant within a pair, so ``max`` picks it deterministically.
    """
    return (signals.groupBy(*PAIR)
            .agg(F.max("risk_score").alias("max_risk"),
                 F.max("pair_total").cast("bigint").alias("total_reports"))
            .withColumn(TARGET, log1p_clip("max_risk")))


def drug_freq(signals: DataFrame) -> DataFrame:
    """drug, freq: number of signal rows (pair-event triples) the drug is part of."""
    both = (signals.select(F.col("drug_a").alias("drug"))
            .unionAll(signals.select(F.col("drug_b").alias("drug"))))
    return both.groupBy("drug").agg(F.count(F.lit(1)).alias("freq"))


def drug_mean_risk(pairs: DataFrame) -> DataFrame:
    """drug, mean_risk: mean over the drug's two roles of the mean max_risk in that role.

    A drug seen in one role only gets that role's mean (a mean of means, not a mean of
    all the drug's pairs).
    """
    as_a = pairs.groupBy(F.col("drug_a").alias("drug")).agg(F.avg("max_risk").alias("m"))
    as_b = pairs.groupBy(F.col("drug_b").alias("drug")).agg(F.avg("max_risk").alias("m"))
    return as_a.unionAll(as_b).groupBy("drug").agg(F.avg("m").alias("mean_risk"))


def drug_encoders(signals: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One lookup table: drug, freq, mean_risk."""
    pairs = pairs if pairs is not None else pair_max_risk(signals)
    return drug_freq(signals).join(drug_mean_risk(pairs), "drug", "full_outer")


def with_encodings(pairs: DataFrame, encoders: DataFrame) -> DataFrame:
    """Attach both drugs' encodings (0 when the drug is unknown) and the crosses.

    The encoder table has one row per drug; the two lookups are equi-joins, broadcast
    by AQE only when the measured encoder table is under the threshold.
    """
    ea = encoders.select(F.col("drug").alias("drug_a"), F.col("freq").alias("_fa"),
                         F.col("mean_risk").alias("_ma"))
    eb = encoders.select(F.col("drug").alias("drug_b"), F.col("freq").alias("_fb"),
                         F.col("mean_risk").alias("_mb"))
    j = pairs.join(ea, "drug_a", "left").join(eb, "drug_b", "left")
    fa = F.coalesce(F.col("_fa"), F.lit(0)).cast("bigint")
    fb = F.coalesce(F.col("_fb"), F.lit(0)).cast("bigint")
    ma = F.coalesce(F.col("_ma"), F.lit(0.0)).cast("double")
    mb = F.coalesce(F.col("_mb"), F.lit(0.0)).cast("double")
    j = (j.withColumn("drug_a_freq", fa).withColumn("drug_b_freq", fb)
         .withColumn("drug_a_mean_risk", ma).withColumn("drug_b_mean_risk", mb))
    fa, fb = F.col("drug_a_freq").cast("double"), F.col("drug_b_freq").cast("double")
    ma, mb = F.col("drug_a_mean_risk"), F.col("drug_b_mean_risk")
    j = (j.withColumn("drug_a_log_freq", F.log1p(fa))
         .withColumn("drug_b_log_freq", F.log1p(fb))
         .withColumn("combined_risk_interaction", ma * mb)
         .withColumn("risk_difference", F.abs(ma - mb))
         .withColumn("freq_ratio", F.least(fa, fb) / (F.greatest(fa, fb) + F.lit(RATIO_GUARD))))
    j = (j.withColumn("log_combined_risk", log1p_clip("combined_risk_interaction"))
         .withColumn("log_risk_difference", log1p_clip("risk_difference")))
    return j.drop("_fa", "_fb", "_ma", "_mb")


def pair_features(signals: DataFrame) -> DataFrame:
    """The pair feature table: pair, max_risk, total_reports, log_max_risk + 11 features."""
    pairs = pair_max_risk(signals)
    enc = drug_encoders(signals, pairs)
    out = with_encodings(pairs, enc)
    return out.select(*PAIR, "max_risk", "total_reports", TARGET, *FEATURES)
