"""Scalar report expressions: labels, bands, the 0-100 score map, texts and formats.

All are native column expressions; thresholds are parameters with the reference's
values as defaults.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Risk label thresholds and texts.
RISK_HIGH, RISK_MEDIUM = 10.0, 5.0
RISK_LABELS = ("HIGH RISK", "MEDIUM RISK", "LOW RISK")
NOT_IN_GRAPH = "NOT FOUND IN GRAPH"
# Composite thresholds and texts.
COMPOSITE_HIGH, COMPOSITE_MODERATE = 75, 40
COMPOSITE_LABELS = ("HIGH RISK", "MODERATE RISK", "LOW RISK")
# PRR bands.
PRR_HIGH, PRR_MODERATE = 10.0, 2.0
PRR_BANDS = ("HIGH", "MOD", "LOW")
# Colour codes of the risk and composite levels.
RISK_COLOURS = ("#ef4444", "#f59e0b", "#10b981")
COMPOSITE_COLOURS = ("#ef4444", "#f59e0b", "#3b82f6")

# Advice text by composite level, with and without historical evidence.
ADVICE = {
    ("HIGH", False): "Significant interaction risk detected. Clinical review strongly recommended "
                     "before co-prescribing. Consider therapeutic alternatives or enhanced monitoring.",
    ("HIGH", True): "Theoretical risk inferred via ML based on individual drug profiles. No historical "
                    "FAERS co-occurrences exist. Clinical review recommended.",
    ("MODERATE", False): "Moderate interaction signal. Prescriber awareness advised. Monitor for adverse "
                         "effects and consider dose adjustments where applicable.",
    ("MODERATE", True): "Theoretical moderate signal inferred via ML. No historical FAERS data exists.",
    ("LOW", False): "Low interaction signal from current FAERS data. Standard clinical monitoring "
                    "applies. See Statistical Analysis tab for the full PRR breakdown.",
    ("LOW", True): "Low theoretical interaction signal from ML. No historical FAERS data exists.",
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def risk_label(score, high: float = RISK_HIGH, medium: float = RISK_MEDIUM) -> Column:
    """Strict thresholds: > high is HIGH, > medium is MEDIUM, else LOW."""
    s = _c(score)
    return (F.when(s > high, RISK_LABELS[0]).when(s > medium, RISK_LABELS[1])
            .otherwise(RISK_LABELS[2]))


def risk_colour(score, high: float = RISK_HIGH, medium: float = RISK_MEDIUM) -> Column:
    s = _c(score)
    return (F.when(s > high, RISK_COLOURS[0]).when(s > medium, RISK_COLOURS[1])
            .otherwise(RISK_COLOURS[2]))


def signal_flag(score, threshold: float = RISK_MEDIUM) -> Column:
    return _c(score) > F.lit(float(threshold))


def prr_band(prr, high: float = PRR_HIGH, moderate: float = PRR_MODERATE) -> Column:
    """PRR > high: HIGH; moderate < PRR <= high: MOD; else LOW."""
    p = _c(prr)
    return F.when(p > high, PRR_BANDS[0]).when(p > moderate, PRR_BANDS[1]).otherwise(PRR_BANDS[2])


def map_to_100(score) -> Column:
    """Piecewise map of a risk score to 0-100 (no lower clamp)."""
    s = _c(score).cast("double")
    return (F.when(s >= 20, F.least(F.lit(100.0), 90 + (s - 20)))
            .when(s >= 10, 75 + ((s - 10) / 10) * 15)
            .when(s >= 5, 40 + ((s - 5) / 5) * 35)
            .otherwise((s / 5) * 40))


def round_half_up(x) -> Column:
    """Round to the nearest integer, halves up (as JavaScript's Math.round)."""
    return F.floor(_c(x) + F.lit(0.5)).cast("bigint")


def composite_score(score_a, score_b) -> Column:
    return round_half_up((map_to_100(score_a) + map_to_100(score_b)) / 2)


def composite_level(composite) -> Column:
    c = _c(composite)
    return (F.when(c > COMPOSITE_HIGH, "HIGH").when(c > COMPOSITE_MODERATE, "MODERATE")
            .otherwise("LOW"))


def composite_label(composite) -> Column:
    c = _c(composite)
    return (F.when(c > COMPOSITE_HIGH, COMPOSITE_LABELS[0])
            .when(c > COMPOSITE_MODERATE, COMPOSITE_LABELS[1]).otherwise(COMPOSITE_LABELS[2]))


def composite_colour(composite) -> Column:
    c = _c(composite)
    return (F.when(c > COMPOSITE_HIGH, COMPOSITE_COLOURS[0])
            .when(c > COMPOSITE_MODERATE, COMPOSITE_COLOURS[1]).otherwise(COMPOSITE_COLOURS[2]))


def advice_text(composite, has_evidence) -> Column:
    level, ev = composite_level(composite), _c(has_evidence)
    expr = None
    for (lv, no_ev), text in ADVICE.items():
        cond = (level == lv) & (ev == F.lit(not no_ev))
        expr = F.when(cond, text) if expr is None else expr.when(cond, text)
    return expr


def truncate_label(text, width: int = 20) -> Column:
    t = _c(text)
    return F.when(F.length(t) > width, F.concat(F.substring(t, 1, width), F.lit("…"))).otherwise(t)


def thousands(x) -> Column:
    return F.format_number(_c(x).cast("double"), 0)


def bar_width(prr, scale: float = 20.0) -> Column:
    return F.least(F.lit(100.0), _c(prr) / scale * 100)


def rank_label(rank) -> Column:
    return F.lpad(_c(rank).cast("string"), 2, "0")


def explanation(event, a, prr, ror, drug_a, drug_b) -> Column:
    """Sentence about the top event of a pair."""
    return F.format_string(
        "%s was reported %d times when %s and %s were taken together; PRR %.2f, ROR %.2f.",
        _c(event), _c(a), _c(drug_a), _c(drug_b), _c(prr), _c(ror))


def feature_drivers(freq_ratio, combined, difference) -> Column:
    """Three driver records: name, value rounded to 2, value normalised to at most 1."""
    def drv(name, v, scale):
        v = _c(v).cast("double")
        return F.struct(F.lit(name).alias("name"), F.round(v, 2).alias("value"),
                        F.least(F.lit(1.0), v / scale).alias("normalized"))
    return F.array(drv("Freq Ratio", freq_ratio, 1.0), drv("Comb Risk", combined, 100.0),
                   drv("Risk Diff", difference, 50.0))
