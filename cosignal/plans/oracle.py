"""DuckDB SQL for every oracle-checked query; same column names and types as Spark.

All strings share one chain of views over the test tables (the stand-in of
``cosignal.sources.proxy`` followed by the reference semantics written out in SQL).
Doubles are rounded to 6 digits, counts cast to BIGINT.
"""

from __future__ import annotations

from cosignal.plans.catalog import TREES
from cosignal.sources.proxy import PROXY_SQL, REQUESTS_SQL
from cosignal.sources.tables import EXAMPLE_PAIRS

CLEAN = "trim(regexp_replace(regexp_replace(upper({x}), '[[:punct:]]', '', 'g'), '\\s+', ' ', 'g'))"

BASE_CHAIN = PROXY_SQL + """,
drugs AS (
  SELECT DISTINCT quarter, PRIMARYID, """ + CLEAN.format(x="DRUGNAME") + """ AS drug
  FROM drug WHERE PRIMARYID IS NOT NULL
),
drugs_ne AS (SELECT * FROM drugs WHERE drug <> ''),
multi AS (SELECT quarter, PRIMARYID FROM drugs_ne GROUP BY quarter, PRIMARYID HAVING count(*) >= 2),
dd AS (SELECT d.* FROM drugs_ne d JOIN multi m ON d.quarter = m.quarter AND d.PRIMARYID = m.PRIMARYID),
pairs AS (
  SELECT x.quarter, x.PRIMARYID, x.drug AS drug_a, y.drug AS drug_b
  FROM dd x JOIN dd y ON x.quarter = y.quarter AND x.PRIMARYID = y.PRIMARYID AND x.drug < y.drug
),
pair_events AS (
  SELECT p.drug_a, p.drug_b, r.PT AS event, d.AGE AS age, d.SEX AS gender, p.quarter
  FROM pairs p
  JOIN reac r ON r.quarter = p.quarter AND r.PRIMARYID = p.PRIMARYID
  JOIN demo d ON d.quarter = p.quarter AND d.PRIMARYID = p.PRIMARYID
),
pec_all AS (SELECT drug_a, drug_b, event, CAST(count(*) AS BIGINT) AS a FROM pair_events GROUP BY drug_a, drug_b, event),
pc AS (SELECT drug_a, drug_b, CAST(sum(a) AS BIGINT) AS pair_total FROM pec_all GROUP BY drug_a, drug_b),
ec AS (SELECT event, CAST(sum(a) AS BIGINT) AS event_total FROM pec_all GROUP BY event),
tot AS (SELECT CAST(sum(a) AS BIGINT) AS n FROM pec_all),
cells AS (
  SELECT pec.drug_a, pec.drug_b, pec.event, pec.a, pc.pair_total, ec.event_total,
         pec.a + 0.5::DOUBLE AS ca,
         (pc.pair_total - pec.a) + 0.5::DOUBLE AS cb,
         (ec.event_total - pec.a) + 0.5::DOUBLE AS cc,
         ((SELECT n FROM tot) - pc.pair_total - ec.event_total + pec.a) + 0.5::DOUBLE AS cd
  FROM pec_all pec
  JOIN pc ON pec.drug_a = pc.drug_a AND pec.drug_b = pc.drug_b
  JOIN ec ON pec.event = ec.event
  WHERE pec.a >= 3
),
signals AS (
  SELECT drug_a, drug_b, event, a, pair_total, event_total,
         (ca / (ca + cb)) / (cc / (cc + cd)) AS PRR,
         (ca * cd) / (cb * cc) AS ROR,
         ln(1 + a) * ln(1 + (ca / (ca + cb)) / (cc / (cc + cd))) AS risk_score
  FROM cells
)"""


LEARN_CHAIN = """,
pmr AS (
  SELECT drug_a, drug_b, max(risk_score) AS max_risk, CAST(max(pair_total) AS BIGINT) AS total_reports,
         ln(1 + greatest(max(risk_score), 0.0)) AS log_max_risk
  FROM signals GROUP BY drug_a, drug_b
),
dfreq AS (
  SELECT drug, CAST(count(*) AS BIGINT) AS freq
  FROM (SELECT drug_a AS drug FROM signals UNION ALL SELECT drug_b AS drug FROM signals) GROUP BY drug
),
dmean AS (
  SELECT drug, avg(m) AS mean_risk FROM (
    SELECT drug_a AS drug, avg(max_risk) AS m FROM pmr GROUP BY drug_a
    UNION ALL SELECT drug_b AS drug, avg(max_risk) AS m FROM pmr GROUP BY drug_b) GROUP BY drug
),
feat0 AS (
  SELECT p.drug_a, p.drug_b, p.max_risk, p.total_reports, p.log_max_risk,
         CAST(coalesce(fa.freq, 0) AS BIGINT) AS drug_a_freq, CAST(coalesce(fb.freq, 0) AS BIGINT) AS drug_b_freq,
         CAST(coalesce(ma.mean_risk, 0) AS DOUBLE) AS drug_a_mean_risk,
         CAST(coalesce(mb.mean_risk, 0) AS DOUBLE) AS drug_b_mean_risk
  FROM pmr p
  LEFT JOIN dfreq fa ON fa.drug = p.drug_a LEFT JOIN dfreq fb ON fb.drug = p.drug_b
  LEFT JOIN dmean ma ON ma.drug = p.drug_a LEFT JOIN dmean mb ON mb.drug = p.drug_b
),
feat AS (
  SELECT *, drug_a_mean_risk * drug_b_mean_risk AS combined_risk_interaction,
         abs(drug_a_mean_risk - drug_b_mean_risk) AS risk_difference,
         least(drug_a_freq, drug_b_freq)::DOUBLE / (greatest(drug_a_freq, drug_b_freq)::DOUBLE + 1e-6::DOUBLE) AS freq_ratio,
         ln(1 + drug_a_freq::DOUBLE) AS drug_a_log_freq, ln(1 + drug_b_freq::DOUBLE) AS drug_b_log_freq,
         ln(1 + greatest(drug_a_mean_risk * drug_b_mean_risk, 0.0)) AS log_combined_risk,
         ln(1 + greatest(abs(drug_a_mean_risk - drug_b_mean_risk), 0.0)) AS log_risk_difference,
         (CAST(('0x' || substr(md5(concat_ws('#', drug_a, drug_b)), 1, 8)) AS BIGINT) % 100) AS bucket
  FROM feat0
),
scored AS (
  SELECT *, ln(1 + greatest((drug_a_mean_risk + drug_b_mean_risk) / 2, 0.0)) AS baseline
  FROM feat WHERE bucket >= 80
),
conf AS (
  SELECT CAST(count(*) FILTER (WHERE exp(log_max_risk) - 1 > 3.0 AND exp(baseline) - 1 > 3.0) AS BIGINT) AS tp,
         CAST(count(*) FILTER (WHERE NOT exp(log_max_risk) - 1 > 3.0 AND exp(baseline) - 1 > 3.0) AS BIGINT) AS fp,
         CAST(count(*) FILTER (WHERE exp(log_max_risk) - 1 > 3.0 AND NOT exp(baseline) - 1 > 3.0) AS BIGINT) AS fn,
         CAST(count(*) FILTER (WHERE NOT exp(log_max_risk) - 1 > 3.0 AND NOT exp(baseline) - 1 > 3.0) AS BIGINT) AS tn
  FROM scored
),
cat AS (SELECT drug_a AS drug FROM feat UNION SELECT drug_b AS drug FROM feat),
node_a AS (SELECT drug_a AS drug, max(drug_a_freq) AS fa, max(drug_a_mean_risk) AS ma FROM feat GROUP BY drug_a),
node_b AS (SELECT drug_b AS drug, max(drug_b_freq) AS fb, max(drug_b_mean_risk) AS mb FROM feat GROUP BY drug_b),
nf AS (
  SELECT c.drug,
         CAST(CASE WHEN coalesce(fa, 0) = 0 THEN coalesce(fb, 0) ELSE fa END AS DOUBLE) AS freq,
         CAST(CASE WHEN coalesce(fa, 0) = 0 THEN coalesce(mb, 0) ELSE ma END AS DOUBLE) AS mean_risk
  FROM cat c LEFT JOIN node_a a ON a.drug = c.drug LEFT JOIN node_b b ON b.drug = c.drug
),
nodes AS (
  SELECT CAST(row_number() OVER (ORDER BY drug) - 1 AS BIGINT) AS idx, drug, freq, mean_risk,
         (freq - avg(freq) OVER ()) / (stddev_samp(freq) OVER () + 1e-6::DOUBLE) AS freq_z,
         (mean_risk - avg(mean_risk) OVER ()) / (stddev_samp(mean_risk) OVER () + 1e-6::DOUBLE) AS risk_z
  FROM nf
),
edges0 AS (
  SELECT na.idx AS src, nb.idx AS dst, f.log_max_risk AS w
  FROM feat f JOIN nodes na ON na.drug = f.drug_a JOIN nodes nb ON nb.drug = f.drug_b
),
edges AS (SELECT src, dst, w FROM edges0 UNION ALL SELECT dst AS src, src AS dst, w FROM edges0),
hop1 AS (
  SELECT n.idx, coalesce(avg(m.freq_z), 0.0) AS freq_z, coalesce(avg(m.risk_z), 0.0) AS risk_z
  FROM nodes n LEFT JOIN edges e ON e.dst = n.idx LEFT JOIN nodes m ON m.idx = e.src GROUP BY n.idx
),
hop2 AS (
  SELECT n.idx, coalesce(avg(h.freq_z), 0.0) AS freq_z, coalesce(avg(h.risk_z), 0.0) AS risk_z
  FROM nodes n LEFT JOIN edges e ON e.dst = n.idx LEFT JOIN hop1 h ON h.idx = e.src GROUP BY n.idx
),
hop3 AS (
  SELECT n.idx, coalesce(avg(h.freq_z), 0.0) AS freq_z, coalesce(avg(h.risk_z), 0.0) AS risk_z
  FROM nodes n LEFT JOIN edges e ON e.dst = n.idx LEFT JOIN hop2 h ON h.idx = e.src GROUP BY n.idx
)"""

FEATURE_COLS = ["drug_a_freq", "drug_b_freq", "drug_a_mean_risk", "drug_b_mean_risk",
                "combined_risk_interaction", "risk_difference", "freq_ratio",
                "drug_a_log_freq", "drug_b_log_freq", "log_combined_risk", "log_risk_difference"]


def with_learn(select: str) -> str:
    return "WITH " + BASE_CHAIN + LEARN_CHAIN + "\n" + select


def _r2_sql(mse: str, var: str) -> str:
    return f"CASE WHEN {var} > 0 THEN 1 - {mse} / {var} WHEN {mse} = 0 THEN 1.0 ELSE 0.0 END"


def _ratio_sql(num: str, den: str) -> str:
    return f"coalesce(CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0), 0.0)"


def with_chain(select: str) -> str:
    return "WITH " + BASE_CHAIN + "\n" + select


def r6(x: str, alias: str | None = None) -> str:
    return f"round({x}, 6) AS {alias or x}"


SIGNAL_SELECT = ("SELECT drug_a, drug_b, event, a, pair_total, event_total, "
                 + ", ".join(r6(c) for c in ["PRR", "ROR", "risk_score"]) + " FROM signals")

N_TREES = TREES.trees

# One split with L1 = 1 and L2 = 5 at the feature's 256-quantiles; gradients in fixed point, as
# features that order the pairs alike tie exactly (the first one wins).
_STUMP = """, pts AS (
  SELECT *, round(((SELECT avg(log_max_risk) FROM feat WHERE bucket < 80) - log_max_risk) * 268435456)::BIGINT AS g
  FROM feat WHERE bucket < 80),
long AS (""" + " UNION ALL ".join(
    f"SELECT {i} AS no, '{c}' AS feature, {c}::DOUBLE AS x, g FROM pts" for i, c in enumerate(FEATURE_COLS)) + """),
cuts AS (
  SELECT no, unnest(list_distinct(quantile_disc(x, [i / 256.0 FOR i IN range(1, 256)]))) AS cut FROM long GROUP BY no),
total AS (SELECT sum(g)::DOUBLE AS g, count(*) AS n FROM pts),
sides AS (
  SELECT long.no, feature, cut, sum(long.g)::DOUBLE / 268435456 AS gl, count(*) AS nl,
         (max(total.g) - sum(long.g)::DOUBLE) / 268435456 AS gr, max(total.n) - count(*) AS nr, max(total.g) / 268435456 AS ga
  FROM long JOIN cuts ON long.no = cuts.no AND x <= cut, total GROUP BY long.no, feature, cut),
judged AS (
  SELECT *, greatest(abs(gl) - 1, 0) ^ 2 / (nl + 5) + greatest(abs(gr) - 1, 0) ^ 2 / (nr + 5)
         - greatest(abs(ga) - 1, 0) ^ 2 / (nl + nr + 5) AS gain FROM sides WHERE nr > 0)
SELECT feature, round(cut, 6) AS threshold, round(gain, 4) AS gain, nl + nr AS cover,
       round(-sign(gl) * greatest(abs(gl) - 1, 0) / (nl + 5), 6) AS left_value, nl AS left_rows,
       round(-sign(gr) * greatest(abs(gr) - 1, 0) / (nr + 5), 6) AS right_value, nr AS right_rows,
       (SELECT round(avg(log_max_risk), 6) FROM pts) AS base
FROM judged ORDER BY round(gain, 9) DESC, no, cut LIMIT 1"""

ORACLE: dict[str, str] = {
    "clean_names": """SELECT p_partkey, """ + CLEAN.format(x="p_name") + """ AS name_clean, """
    + CLEAN.format(x="p_brand") + """ AS brand_clean FROM part""",
    "pair_events": with_chain("SELECT drug_a, drug_b, event, age, gender, quarter FROM pair_events"),
    "pair_event_counts": with_chain("SELECT drug_a, drug_b, event, a FROM pec_all WHERE a >= 3"),
    "pair_counts": with_chain("SELECT drug_a, drug_b, pair_total FROM pc"),
    "event_counts": with_chain("SELECT event, event_total FROM ec"),
    "total_rows": with_chain("SELECT n FROM tot"),
    "signals": with_chain(SIGNAL_SELECT),
    "top_signals": with_chain(
        "SELECT drug_a, drug_b, event, a, pair_total, event_total, "
        + ", ".join(r6(c) for c in ["PRR", "ROR", "risk_score"])
        + " FROM signals ORDER BY round(risk_score, 9) DESC, a DESC, drug_a, drug_b, event LIMIT 20"),
    "quarterly_counts_merged": with_chain(
        "SELECT drug_a, drug_b, event, CAST(sum(a) AS BIGINT) AS a FROM ("
        "SELECT quarter, drug_a, drug_b, event, count(*) AS a FROM pair_events "
        "GROUP BY quarter, drug_a, drug_b, event) GROUP BY drug_a, drug_b, event HAVING sum(a) >= 3"),
    "batch_totals": with_chain(
        "SELECT quarter, CAST(count(*) AS BIGINT) AS n FROM pair_events GROUP BY quarter"),
}

_REG = """SELECT CAST(n AS BIGINT) AS n, round(log_mse, 6) AS log_mse, round(""" + _r2_sql("log_mse", "vl") + """, 6) AS log_r2,
  round(orig_mse, 6) AS orig_mse, round(""" + _r2_sql("orig_mse", "vo") + """, 6) AS orig_r2
FROM (SELECT count(*) AS n, avg((log_max_risk - baseline) * (log_max_risk - baseline)) AS log_mse,
  var_pop(log_max_risk) AS vl,
  avg(((exp(log_max_risk) - 1) - (exp(baseline) - 1)) * ((exp(log_max_risk) - 1) - (exp(baseline) - 1))) AS orig_mse,
  var_pop(exp(log_max_risk) - 1) AS vo FROM scored)"""

_BIN = ("SELECT round(" + _ratio_sql("tp + tn", "tp + fp + fn + tn") + ", 6) AS acc, round("
        + _ratio_sql("tp", "tp + fp") + ", 6) AS prec, round(" + _ratio_sql("tp", "tp + fn")
        + ", 6) AS rec, round(" + _ratio_sql("2 * tp", "2 * tp + fp + fn") + ", 6) AS f1 FROM conf")


def _class_rows() -> str:
    p0, r0, f0 = _ratio_sql("tn", "tn + fn"), _ratio_sql("tn", "tn + fp"), _ratio_sql("2 * tn", "2 * tn + fn + fp")
    p1, r1, f1 = _ratio_sql("tp", "tp + fp"), _ratio_sql("tp", "tp + fn"), _ratio_sql("2 * tp", "2 * tp + fp + fn")
    n = "(tp + fp + fn + tn)"
    s0, s1 = "(tn + fp)", "(tp + fn)"
    w0, w1 = _ratio_sql(s0, n), _ratio_sql(s1, n)
    acc = _ratio_sql("tp + tn", n)
    rows = [
        ("'LOW RISK'", p0, r0, f0, s0),
        ("'SIGNIFICANT RISK'", p1, r1, f1, s1),
        ("'accuracy'", "NULL", "NULL", acc, n),
        ("'macro avg'", f"({p0} + {p1}) / 2", f"({r0} + {r1}) / 2", f"({f0} + {f1}) / 2", n),
        ("'weighted avg'", f"{p0} * {w0} + {p1} * {w1}", f"{r0} * {w0} + {r1} * {w1}",
         f"{f0} * {w0} + {f1} * {w1}", n),
    ]
    parts = [f"SELECT {c} AS class, round(CAST({p} AS DOUBLE), 6) AS precision, round(CAST({r} AS DOUBLE), 6) AS recall, "
             f"round(CAST({f} AS DOUBLE), 6) AS f1, CAST({s} AS BIGINT) AS support FROM conf"
             for c, p, r, f, s in rows]
    return " UNION ALL ".join(parts)


_FEAT_SELECT = ("SELECT drug_a, drug_b, " + r6("max_risk") + ", total_reports, " + r6("log_max_risk") + ", "
                + ", ".join(c if c.endswith("_freq") and "log" not in c else r6(c) for c in FEATURE_COLS)
                + " FROM feat")

ORACLE.update({
    "pair_max_risk": with_learn("SELECT drug_a, drug_b, " + r6("max_risk") + ", total_reports, "
                                + r6("log_max_risk") + " FROM pmr"),
    "drug_freq": with_learn("SELECT drug, freq FROM dfreq"),
    "drug_mean_risk": with_learn("SELECT drug, " + r6("mean_risk") + " FROM dmean"),
    "pair_features": with_learn(_FEAT_SELECT),
    "hash_split": with_learn("SELECT drug_a, drug_b, CAST(bucket AS BIGINT) AS bucket, "
                             "CASE WHEN bucket < 80 THEN 'train' ELSE 'test' END AS split FROM feat"),
    "regression_metrics": with_learn(_REG),
    "binary_metrics": with_learn(_BIN),
    "class_report": with_learn(_class_rows()),
    "graph_nodes": with_learn("SELECT idx, drug, " + ", ".join(r6(c) for c in ["freq", "mean_risk", "freq_z", "risk_z"])
                              + " FROM nodes"),
    "graph_edges": with_learn("SELECT src, dst, " + r6("w") + " FROM edges"),
    "neighbor_mean_1hop": with_learn("SELECT n.idx, n.drug, round(h.freq_z, 6) AS h1_freq_z, round(h.risk_z, 6) AS h1_risk_z "
                                     "FROM nodes n JOIN hop1 h ON h.idx = n.idx"),
    "neighbor_mean_2hop": with_learn("SELECT n.idx, n.drug, round(h1.freq_z, 6) AS h1_freq_z, round(h1.risk_z, 6) AS h1_risk_z, "
                                     "round(h2.freq_z, 6) AS h2_freq_z, round(h2.risk_z, 6) AS h2_risk_z "
                                     "FROM nodes n JOIN hop1 h1 ON h1.idx = n.idx JOIN hop2 h2 ON h2.idx = n.idx"),
})


def _label(x: str, hi: float = 10.0, mid: float = 5.0) -> str:
    return (f"CASE WHEN {x} > {hi} THEN 'HIGH RISK' WHEN {x} > {mid} THEN 'MEDIUM RISK' "
            "ELSE 'LOW RISK' END")


def _map100(x: str) -> str:
    return (f"CASE WHEN {x} >= 20 THEN least(100.0, 90 + ({x} - 20)) "
            f"WHEN {x} >= 10 THEN 75 + (({x} - 10) / 10) * 15 "
            f"WHEN {x} >= 5 THEN 40 + (({x} - 5) / 5) * 35 ELSE ({x} / 5) * 40 END")


def _band(x: str) -> str:
    return f"CASE WHEN {x} > 10.0 THEN 'HIGH' WHEN {x} > 2.0 THEN 'MOD' ELSE 'LOW' END"


REPORT_CHAIN = """,
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY drug_a, drug_b ORDER BY round(risk_score, 9) DESC, event) AS BIGINT) AS rank
  FROM signals
),
ev AS (
  SELECT drug_a, drug_b, rank, lpad(CAST(rank AS VARCHAR), 2, '0') AS rank_label, event,
         a AS co_occurrences, PRR, ROR, risk_score FROM ranked
),
summ AS (
  SELECT drug_a, drug_b, CAST(max(pair_total) AS BIGINT) AS total_reports, CAST(count(*) AS BIGINT) AS unique_events,
         max(risk_score) AS max_risk, """ + _label("max(risk_score)") + """ AS risk_label
  FROM signals GROUP BY drug_a, drug_b
),
two AS (
  SELECT f.drug_a, f.drug_b, f.max_risk AS observed,
         greatest((f.drug_a_mean_risk + f.drug_b_mean_risk) / 2, 0.0) AS baseline,
         coalesce(s.unique_events, 0) AS evidence_count
  FROM feat f LEFT JOIN summ s ON s.drug_a = f.drug_a AND s.drug_b = f.drug_b
),
comp AS (
  SELECT drug_a, drug_b, evidence_count > 0 AS has_evidence,
         CAST(floor((""" + _map100("observed") + " + " + _map100("baseline") + """) / 2 + 0.5) AS BIGINT) AS composite
  FROM two
),
""" + REQUESTS_SQL + """,
req AS (
  SELECT request_id, least(x, y) AS drug_a, greatest(x, y) AS drug_b FROM (
    SELECT request_id, coalesce(""" + CLEAN.format(x="drug_a") + ", '') AS x, coalesce(" + CLEAN.format(x="drug_b") + """, '') AS y
    FROM requests)
),
req_trim AS (
  SELECT request_id, least(x, y) AS drug_a, greatest(x, y) AS drug_b FROM (
    SELECT request_id, coalesce(trim(upper(drug_a)), '') AS x, coalesce(trim(upper(drug_b)), '') AS y FROM requests)
)"""


def with_report(select: str) -> str:
    return "WITH " + BASE_CHAIN + LEARN_CHAIN + REPORT_CHAIN + "\n" + select


_ADVICE = {
    ("HIGH", True): "Significant interaction risk detected. Clinical review strongly recommended before co-prescribing. Consider therapeutic alternatives or enhanced monitoring.",
    ("HIGH", False): "Theoretical risk inferred via ML based on individual drug profiles. No historical FAERS co-occurrences exist. Clinical review recommended.",
    ("MODERATE", True): "Moderate interaction signal. Prescriber awareness advised. Monitor for adverse effects and consider dose adjustments where applicable.",
    ("MODERATE", False): "Theoretical moderate signal inferred via ML. No historical FAERS data exists.",
    ("LOW", True): "Low interaction signal from current FAERS data. Standard clinical monitoring applies. See Statistical Analysis tab for the full PRR breakdown.",
    ("LOW", False): "Low theoretical interaction signal from ML. No historical FAERS data exists.",
}


def _advice_sql() -> str:
    lvl = "CASE WHEN composite > 75 THEN 'HIGH' WHEN composite > 40 THEN 'MODERATE' ELSE 'LOW' END"
    parts = [f"WHEN {lvl} = '{k[0]}' AND has_evidence = {str(k[1]).upper()} THEN '{v}'"
             for k, v in _ADVICE.items()]
    return "CASE " + " ".join(parts) + " END"


_EV_COLS = "drug_a, drug_b, rank, rank_label, event, co_occurrences, " + ", ".join(r6(c) for c in ["PRR", "ROR", "risk_score"])

ORACLE.update({
    "topk_events_per_pair": with_report(f"SELECT {_EV_COLS} FROM ev WHERE rank <= 10"),
    "top3_events_per_pair": with_report(f"SELECT {_EV_COLS} FROM ev WHERE rank <= 3"),
    "pair_summary": with_report("SELECT drug_a, drug_b, total_reports, unique_events, " + r6("max_risk")
                                + ", risk_label FROM summ"),
    "prr_bands": with_report("SELECT drug_a, drug_b, " + _band("PRR") + " AS band, CAST(count(*) AS BIGINT) AS n "
                             "FROM ev WHERE rank <= 10 GROUP BY ALL HAVING count(*) > 0"),
    "band_histogram": with_report(
        "SELECT drug_a, drug_b, CAST(count(*) FILTER (WHERE PRR > 10.0) AS BIGINT) AS high_prr, "
        "CAST(count(*) FILTER (WHERE PRR > 2.0 AND PRR <= 10.0) AS BIGINT) AS mod_prr, "
        "CAST(count(*) FILTER (WHERE PRR <= 2.0) AS BIGINT) AS low_prr FROM ev WHERE rank <= 10 GROUP BY drug_a, drug_b"),
    "peak_signal": with_report(
        "SELECT drug_a, drug_b, arg_min(event, rank) AS top_event, round(arg_min(PRR, rank), 6) AS peak_prr, "
        "CAST(count(*) AS BIGINT) AS evidence_count, CAST(greatest(count(*) - 3, 0) AS BIGINT) AS more "
        "FROM ev WHERE rank <= 10 GROUP BY drug_a, drug_b"),
    "explanations": with_report(
        "SELECT drug_a, drug_b, event AS top_event, printf('%s was reported %d times when %s and %s were taken "
        "together; PRR %.2f, ROR %.2f.', event, co_occurrences, drug_a, drug_b, PRR, ROR) AS explanation "
        "FROM ev WHERE rank = 1"),
    "evidence_display": with_report(
        "SELECT drug_a, drug_b, rank, rank_label, CASE WHEN length(event) > 20 THEN substr(event, 1, 20) || '…' "
        "ELSE event END AS event_label, format('{:,}', co_occurrences) AS co_occurrences_text, "
        + _band("PRR") + " AS band, round(least(100.0, PRR / 20.0 * 100), 6) AS bar_width, "
        "CAST(risk_score > 5.0 AS INTEGER) AS is_signal FROM ev WHERE rank <= 8"),
    "risk_labels": with_report(
        "SELECT drug_a, drug_b, " + r6("max_risk") + ", " + _label("max_risk") + " AS risk_label, "
        "CASE WHEN max_risk > 10.0 THEN '#ef4444' WHEN max_risk > 5.0 THEN '#f59e0b' ELSE '#10b981' END AS risk_colour, "
        "CAST(max_risk > 5.0 AS INTEGER) AS is_signal FROM feat"),
    "composite_score": with_report(
        "SELECT drug_a, drug_b, composite, CASE WHEN composite > 75 THEN 'HIGH RISK' WHEN composite > 40 "
        "THEN 'MODERATE RISK' ELSE 'LOW RISK' END AS composite_label, CASE WHEN composite > 75 THEN '#ef4444' "
        "WHEN composite > 40 THEN '#f59e0b' ELSE '#3b82f6' END AS composite_colour, " + _advice_sql()
        + " AS advice FROM comp"),
    "model_agreement": with_report(
        "SELECT label_a, label_b, CAST(count(*) AS BIGINT) AS n, CAST(label_a = label_b AS INTEGER) AS agree FROM ("
        "SELECT " + _label("observed", 3.0, 2.0) + " AS label_a, " + _label("baseline", 3.0, 2.0)
        + " AS label_b FROM two) GROUP BY label_a, label_b"),
    "drug_catalog": with_report("SELECT drug FROM (SELECT drug_a AS drug FROM signals UNION SELECT drug_b FROM signals) "
                                "WHERE drug IS NOT NULL"),
    "drug_search": with_report("SELECT drug FROM (SELECT drug_a AS drug FROM signals UNION SELECT drug_b FROM signals) "
                               "WHERE drug IS NOT NULL AND contains(lower(drug), 'ring')"),
    "pair_lookup": with_report(
        "SELECT r.request_id, r.drug_a, r.drug_b, CASE WHEN r.drug_a = '' OR r.drug_b = '' THEN 'missing_drug' "
        "WHEN r.drug_a = r.drug_b THEN 'same_drug' WHEN s.total_reports IS NULL THEN 'no_evidence' ELSE 'ok' END AS status, "
        "s.total_reports, s.unique_events, round(s.max_risk, 6) AS max_risk, s.risk_label "
        "FROM req r LEFT JOIN summ s ON s.drug_a = r.drug_a AND s.drug_b = r.drug_b"),
})

ORACLE["pair_report"] = with_report(
    "SELECT r.request_id, r.drug_a, r.drug_b, CASE WHEN r.drug_a = '' OR r.drug_b = '' THEN 'missing_drug' "
    "WHEN r.drug_a = r.drug_b THEN 'same_drug' WHEN s.total_reports IS NULL THEN 'no_evidence' ELSE 'ok' END AS status, "
    "s.total_reports, s.unique_events, round(s.max_risk, 6) AS max_risk, s.risk_label, e.event AS top_event, "
    "printf('%s was reported %d times when %s and %s were taken together; PRR %.2f, ROR %.2f.', e.event, "
    "e.co_occurrences, e.drug_a, e.drug_b, e.PRR, e.ROR) AS explanation "
    "FROM req r LEFT JOIN summ s ON s.drug_a = r.drug_a AND s.drug_b = r.drug_b "
    "LEFT JOIN (SELECT * FROM ev WHERE rank = 1) e ON e.drug_a = r.drug_a AND e.drug_b = r.drug_b")

ORACLE.update({
    "signals_from_text": ORACLE["signals"],
    "signals_from_pair_event_files": ORACLE["signals"],
    "streamed_counters": ORACLE["pair_event_counts"],
    "streamed_reports": ORACLE["pair_event_counts"],
    "stored_catalog": with_chain("SELECT drug, source FROM (SELECT drug_a AS drug FROM signals UNION SELECT drug_b FROM signals), "
                                 "(VALUES ('encoders'), ('signals_by_pair')) s(source)"),
    "drug_search_batch": with_chain(
        "SELECT query, drug FROM (SELECT substr(x, 2, n) AS query FROM (SELECT DISTINCT x, unnest(range(0, 7)) AS n FROM ("
        "SELECT upper(p_name) AS x FROM part UNION SELECT p_name FROM part UNION SELECT p_brand FROM part)) "
        "UNION SELECT n_name FROM nation) q "
        "JOIN (SELECT drug_a AS drug FROM signals UNION SELECT drug_b FROM signals) d ON contains(lower(drug), lower(query))"),
    "signals_pruned": ORACLE["signals"],
    "signals_pruned_small_sketch": ORACLE["signals"],
    "signals_split_cells": ORACLE["signals"],
    "pair_events_split_cells": ORACLE["pair_events"],
    "pair_counts_factored": ORACLE["pair_counts"],
    "drug_encoders": with_learn("SELECT coalesce(f.drug, m.drug) AS drug, f.freq, round(m.mean_risk, 6) AS mean_risk "
                                "FROM dfreq f FULL OUTER JOIN dmean m ON f.drug = m.drug"),
    "neighbor_mean_3hop": with_learn(
        "SELECT n.idx, n.drug, " + ", ".join(
            f"round(h{k}.freq_z, 6) AS h{k}_freq_z, round(h{k}.risk_z, 6) AS h{k}_risk_z" for k in (1, 2, 3))
        + " FROM nodes n JOIN hop1 h1 ON h1.idx = n.idx JOIN hop2 h2 ON h2.idx = n.idx JOIN hop3 h3 ON h3.idx = n.idx"),
})

ORACLE["node_zscore"] = with_learn("SELECT idx, drug, " + ", ".join(r6(c) for c in ["freq_z", "risk_z"]) + " FROM nodes")

_STATUS = ("CASE WHEN r.drug_a = '' OR r.drug_b = '' THEN 'missing_drug' WHEN r.drug_a = r.drug_b THEN 'same_drug' "
           "{none} ELSE 'ok' END AS status")
_NO_EVIDENCE = "WHEN s.total_reports IS NULL THEN 'no_evidence'"
_LEVELS = ("CASE WHEN composite > 75 THEN 'HIGH RISK' WHEN composite > 40 THEN 'MODERATE RISK' ELSE 'LOW RISK' END AS composite_label, "
           "CASE WHEN composite > 75 THEN '#ef4444' WHEN composite > 40 THEN '#f59e0b' ELSE '#3b82f6' END AS composite_colour")


def _example_rows() -> str:
    return ", ".join(f"('{a}', '{b}', '{level}')" for a, b, level, _ in EXAMPLE_PAIRS)


ORACLE.update({
    "pair_lookup_bucketed": ORACLE["pair_lookup"],
    "pair_lookup_upper_trim": with_report(
        "SELECT r.request_id, r.drug_a, r.drug_b, " + _STATUS.format(none=_NO_EVIDENCE) + ", s.total_reports, "
        "s.unique_events, round(s.max_risk, 6) AS max_risk, s.risk_label "
        "FROM req_trim r LEFT JOIN summ s ON s.drug_a = r.drug_a AND s.drug_b = r.drug_b"),
    "display_texts": """SELECT p_partkey, CASE WHEN length(t) > 20 THEN substr(t, 1, 20) || '…' ELSE t END AS label,
        format('{:,}', q * 100) AS quantity
      FROM (SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type) AS t, CAST(sum(l_quantity) AS BIGINT) AS q
            FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL)""",
    "advice_texts": "SELECT composite_label, composite_colour, advice, count(*) AS n, CAST(sum(composite) AS BIGINT) AS composite_sum "
                    "FROM (SELECT composite, " + _LEVELS + ", " + _advice_sql() + " AS advice FROM ("
                    "SELECT CAST(floor((" + _map100("a") + " + " + _map100("b") + ") / 2 + 0.5) AS BIGINT) AS composite, has_evidence "
                    "FROM (SELECT CAST(l_quantity AS DOUBLE) / 2 AS a, CAST(l_discount AS DOUBLE) * 200 AS b, "
                    "l_linenumber % 2 = 1 AS has_evidence FROM lineitem))) GROUP BY ALL",
    "node_embeddings": with_learn(
        "SELECT n.idx, n.drug, " + ", ".join(
            f"round({t}.{c}, 6) AS z{2 * i + j}" for i, t in enumerate(("n", "h1", "h2", "h3"))
            for j, c in enumerate(("freq_z", "risk_z")))
        + " FROM nodes n JOIN hop1 h1 ON h1.idx = n.idx JOIN hop2 h2 ON h2.idx = n.idx JOIN hop3 h3 ON h3.idx = n.idx"),
    "score_facts": with_report(
        "SELECT r.request_id, r.drug_a, r.drug_b, r.status, CAST(r.status = 'ok' AS INTEGER) AS scored, "
        "CASE WHEN r.status = 'ok' THEN CAST(na.idx IS NULL OR nb.idx IS NULL AS INTEGER) END AS outside_graph, "
        "CASE WHEN r.status = 'ok' THEN round(least(coalesce(fa.freq, 0), coalesce(fb.freq, 0)) / "
        "(greatest(coalesce(fa.freq, 0), coalesce(fb.freq, 0))::DOUBLE + 1e-6::DOUBLE), 6) END AS driver_0, "
        "CASE WHEN r.status = 'ok' THEN round(least(1.0, coalesce(ma.mean_risk, 0) * coalesce(mb.mean_risk, 0) / 100.0), 6) END AS driver_1, "
        "CASE WHEN r.status = 'ok' THEN round(least(1.0, abs(coalesce(ma.mean_risk, 0) - coalesce(mb.mean_risk, 0)) / 50.0), 6) END AS driver_2, "
        "CAST(least(coalesce(s.unique_events, 0), 10) AS BIGINT) AS evidence_count, e.event AS top_event, "
        "e.co_occurrences AS top_co_occurrences, round(e.PRR, 6) AS top_prr, round(e.risk_score, 6) AS top_risk "
        "FROM (SELECT *, " + _STATUS.format(none="") + " FROM req r) r "
        "LEFT JOIN nodes na ON na.drug = r.drug_a LEFT JOIN nodes nb ON nb.drug = r.drug_b "
        "LEFT JOIN dfreq fa ON fa.drug = r.drug_a LEFT JOIN dfreq fb ON fb.drug = r.drug_b "
        "LEFT JOIN dmean ma ON ma.drug = r.drug_a LEFT JOIN dmean mb ON mb.drug = r.drug_b "
        "LEFT JOIN summ s ON s.drug_a = r.drug_a AND s.drug_b = r.drug_b AND r.status = 'ok' "
        "LEFT JOIN (SELECT * FROM ev WHERE rank = 1) e ON e.drug_a = r.drug_a AND e.drug_b = r.drug_b AND r.status = 'ok'"),
    "report_json_facts": with_report(
        "SELECT r.request_id, concat_ws(',', CASE WHEN r.drug_a IS NOT NULL THEN 'drug_a' END, "
        "CASE WHEN r.drug_b IS NOT NULL THEN 'drug_b' END, 'status', 'phase2_xgb', 'phase3_gnn', 'historical_evidence') AS keys, "
        "r.drug_a, r.drug_b, r.status, CAST(least(coalesce(s.unique_events, 0), 10) AS BIGINT) AS evidence_count, "
        "e.event AS top_event, e.co_occurrences AS top_co_occurrences, "
        "CASE WHEN r.status = 'ok' THEN 1 END AS score_rounded "
        "FROM (SELECT *, " + _STATUS.format(none="") + " FROM req r) r "
        "LEFT JOIN summ s ON s.drug_a = r.drug_a AND s.drug_b = r.drug_b AND r.status = 'ok' "
        "LEFT JOIN (SELECT * FROM ev WHERE rank = 1) e ON e.drug_a = r.drug_a AND e.drug_b = r.drug_b AND r.status = 'ok'"),
    "encoder_catalog": with_learn("SELECT DISTINCT drug FROM dfreq"),
    "model_facts": with_learn(
        "SELECT 'boosted_trees' AS model, count(*) AS n, count(*) AS pairs, round(sum(log_max_risk), 6) AS target_sum, "
        "count(*) AS finite FROM feat WHERE bucket >= 80 "
        "UNION ALL SELECT 'edge_regressor', 2 * count(*), 2 * count(*), round(2 * sum(log_max_risk), 6), 2 * count(*) FROM feat WHERE bucket >= 80 "
        f"UNION ALL SELECT 'importances', {len(FEATURE_COLS)}, {len(FEATURE_COLS)}, 1.0, {len(FEATURE_COLS)} "
        f"UNION ALL SELECT 'iterations', {N_TREES}, {N_TREES}, 0.0, {N_TREES}"),
    "tree_contribution_facts": with_learn("SELECT drug_a, drug_b, 1 AS sums_up, 1 AS as_predicted, 1 AS as_compiled "
                                          "FROM feat WHERE bucket >= 80"),
    "tree_node_facts": f"SELECT CAST(0 AS BIGINT) AS broken, CAST({N_TREES} AS BIGINT) AS trees, "
                       f"CAST({N_TREES} AS BIGINT) AS roots, 1 AS bounded",
    "boosted_stump": with_learn(_STUMP),
    "learned_edge_facts": with_learn("SELECT count(*) AS n, count(*) AS pairs, round(sum(log_max_risk), 6) AS target_sum, "
                                     "count(*) AS finite, 1 AS below_plain_means FROM feat WHERE bucket >= 80"),
    "encoder_statistics": with_learn(
        " UNION ALL ".join(f"SELECT '{name}' AS input, round(avg({c}), 6) + 0.0 AS mean, round(sqrt(var_pop({c}) + 1e-5::DOUBLE), 6) AS std "
                           f"FROM {t}" for name, c, t in (("freq_z", "freq_z", "nodes"), ("risk_z", "risk_z", "nodes"),
                                                          ("n_freq_z", "freq_z", "hop1"), ("n_risk_z", "risk_z", "hop1")))),
    "stored_features": with_learn("SELECT drug_a, drug_b, " + r6("max_risk") + ", total_reports, " + r6("log_max_risk")
                                  + ", 1 AS in_order FROM feat"),
    "stored_signals": with_chain(
        "SELECT layout, count(*) AS n, CAST(sum(a) AS BIGINT) AS a, round(sum(risk_score), 4) AS risk_sum, "
        "CAST(0 AS BIGINT) AS out_of_order FROM signals, (VALUES ('score'), ('pair')) l(layout) GROUP BY layout"),
    "stored_graph": with_learn(
        "SELECT 'nodes' AS stored, count(*) AS n, CAST(sum(idx) AS BIGINT) AS keys, round(sum(mean_risk), 4) AS total FROM nodes "
        "UNION ALL SELECT 'edges', count(*), CAST(sum(src * 3 + dst) AS BIGINT), round(sum(w), 4) FROM edges "
        "UNION ALL SELECT 'embeddings', count(*), CAST(sum(h1.idx) AS BIGINT), round(sum(h1.freq_z + h3.risk_z), 4) "
        "FROM hop1 h1 JOIN hop3 h3 ON h3.idx = h1.idx"),
    "stored_metrics": with_learn("SELECT 'baseline' AS model, CAST(2 AS BIGINT) AS runs, * FROM (" + _BIN + ")"),
    "example_pair_lookup": with_report(
        "SELECT r.drug_a, r.drug_b, r.level, " + _STATUS.format(none=_NO_EVIDENCE) + ", s.total_reports FROM ("
        "SELECT least(x, y) AS drug_a, greatest(x, y) AS drug_b, level FROM (VALUES " + _example_rows() + ") v(x, y, level)) r "
        "LEFT JOIN summ s ON s.drug_a = r.drug_a AND s.drug_b = r.drug_b"),
})
