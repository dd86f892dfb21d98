"""Batch scorer: a whole table of requested pairs in, one nested record per pair out.

Per pair: canonical names and status, the boosted-tree score with label and feature
drivers, the edge-model score from both drugs' embeddings (or "not found in graph"),
and the top-k evidence rows of the signal table. Every step is a join or a window;
the evidence list per pair is bounded by k before it is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosignal.functions import presentation as X
from cosignal.operators.features import with_encodings
from cosignal.operators.learn import Model, load_model, predict, with_edge_vectors
from cosignal.operators.report import model_agreement, rank_events, request_status
from cosignal.session import cut_lineage

PAIR = ["drug_a", "drug_b"]


def tree_scores(pairs: DataFrame, encoders: DataFrame, model: Model) -> DataFrame:
    """drug_a, drug_b, tree struct<score, label, feature_drivers>; unknown drugs encode to 0."""
    f = with_encodings(pairs.select(*PAIR).distinct(), encoders)
    scored = predict(model, f).withColumn("score", F.expm1("prediction"))
    return scored.select(*PAIR, F.struct(
        F.col("score"), X.risk_label("score").alias("label"),
        X.feature_drivers("freq_ratio", "combined_risk_interaction", "risk_difference")
        .alias("feature_drivers")).alias("tree"))


def graph_scores(pairs: DataFrame, emb: DataFrame, model: Model) -> DataFrame:
    """drug_a, drug_b, graph struct<score, label>; pairs with a drug outside the graph
    get score 0 and the not-found label."""
    p = pairs.select(*PAIR).distinct()
    za = emb.select(F.col("drug").alias("drug_a"), F.col("z").alias("z_a"))
    zb = emb.select(F.col("drug").alias("drug_b"), F.col("z").alias("z_b"))
    j = p.join(za, "drug_a", "left").join(zb, "drug_b", "left")
    found = j.filter(F.col("z_a").isNotNull() & F.col("z_b").isNotNull())
    missing = j.filter(F.col("z_a").isNull() | F.col("z_b").isNull())
    s = predict(model, with_edge_vectors(found)).withColumn("score", F.expm1("prediction"))
    hit = s.select(*PAIR, F.struct(F.col("score"), X.risk_label("score").alias("label")).alias("graph"))
    miss = missing.select(*PAIR, F.struct(F.lit(0.0).alias("score"),
                                          F.lit(X.NOT_IN_GRAPH).alias("label")).alias("graph"))
    return hit.unionByName(miss)


def evidence_lists(pairs: DataFrame, signals: DataFrame, k: int = 10) -> DataFrame:
    """drug_a, drug_b, evidence array<struct<event, co_occurrences, PRR, risk_score>>,
    ordered by rank; only signal rows of requested pairs are ranked."""
    wanted = signals.join(pairs.select(*PAIR).distinct(), PAIR, "left_semi")
    top = rank_events(wanted, k)
    rec = F.struct(F.col("rank"), F.col("event"), F.col("a").alias("co_occurrences"),
                   F.col("PRR"), F.col("risk_score"))
    lists = top.groupBy(*PAIR).agg(F.array_sort(F.collect_list(rec)).alias("_ev"))
    return lists.select(*PAIR, F.transform("_ev", lambda r: F.struct(
        r["event"].alias("event"), r["co_occurrences"].alias("co_occurrences"),
        r["PRR"].alias("PRR"), r["risk_score"].alias("risk_score"))).alias("evidence"))


EVIDENCE = "array<struct<event:string,co_occurrences:bigint,PRR:double,risk_score:double>>"


def pair_records(requests: DataFrame, encoders: DataFrame, tree_model: Model, emb: DataFrame, edge_model: Model,
                 signals: DataFrame, k: int = 10, mode: str = "clean") -> tuple[DataFrame, DataFrame]:
    """(canonical requests with their status, one score record per requested pair), both stored."""
    # The canonical requests feed the distinct pairs and the final join, the pairs three
    # branches (tree, graph, evidence); both are stored once. The record of a pair is made
    # once and stored too: the requests, many a pair, meet the records in one join that
    # broadcasts them when their stored size allows.
    req = cut_lineage(request_status(requests, mode=mode), "requests")
    ok = cut_lineage(req.filter(F.col("status") == "ok").select(*PAIR).distinct(), "requested-pairs")
    tree = tree_scores(ok, encoders, tree_model)
    graph = graph_scores(ok, emb, edge_model)
    ev = evidence_lists(ok, signals, k)
    records = tree.join(graph, PAIR, "left").join(ev, PAIR, "left")
    return req, cut_lineage(records, "pair-records")


def with_evidence(records: DataFrame) -> DataFrame:
    """Records with an empty evidence list in place of none."""
    return records.withColumn("evidence", F.coalesce("evidence", F.array().cast(EVIDENCE)))


def score_pairs(requests: DataFrame, encoders: DataFrame, tree_model: Model,
                emb: DataFrame, edge_model: Model, signals: DataFrame,
                k: int = 10, mode: str = "clean") -> DataFrame:
    """Nested score record per requested pair (raw names in ``drug_a``, ``drug_b``).

    ``mode='upper_trim'`` normalises names with upper case and trim only, as the
    reference's service did; the default uses the full name cleaner.
    """
    req, records = pair_records(requests, encoders, tree_model, emb, edge_model, signals, k, mode)
    return with_evidence(req.join(records, PAIR, "left"))


def stored(spark: SparkSession, paths: dict[str, str]) -> tuple:
    """What a build stored (``plans.build`` returns the paths), as the scorer takes it: models,
    encoders, embeddings and the signal table in pair layout are loaded, nothing is fitted."""
    return (spark.read.parquet(paths["encoders"]), load_model(paths["models/tree"]),
            spark.read.parquet(paths["embeddings"]), load_model(paths["models/edge"]),
            spark.read.parquet(paths["signals_by_pair"]))


def score_stored(requests: DataFrame, paths: dict[str, str], k: int = 10, mode: str = "clean") -> DataFrame:
    """Score a request table from what a build stored."""
    return score_pairs(requests, *stored(requests.sparkSession, paths), k, mode)


def report_stored(requests: DataFrame, paths: dict[str, str], k: int = 10, mode: str = "clean") -> DataFrame:
    """``score_report`` of ``score_stored``: the report is made once per pair, from its record, and
    stored; the requests, many a pair, meet its few plain columns and not the evidence lists."""
    req, records = pair_records(requests, *stored(requests.sparkSession, paths), k, mode)
    # Only pairs of requests with status ok have a record; the others keep nulls.
    report = cut_lineage(score_report(with_evidence(records).withColumn("status", F.lit("ok"))).drop("status"), "pair-reports")
    keep = [c for c in ("request_id",) if c in req.columns]
    return req.select(*keep, *PAIR, "status").join(report, PAIR, "left").select(*keep, *PAIR, "status", *report.columns[2:])


def documents_stored(requests: DataFrame, paths: dict[str, str], k: int = 10, mode: str = "clean") -> tuple[DataFrame, DataFrame]:
    """(canonical requests with their status, stored; ``score_json`` of each pair they ask for). A document
    says its pair, the status, which follows from the pair, and the pair's record: it is the same for all
    requests of a pair. So what is read from documents can be read once a pair and meet the requests last."""
    req, records = pair_records(requests, *stored(requests.sparkSession, paths), k, mode)
    return req, score_json(with_evidence(req.select(*PAIR, "status").distinct().join(records, PAIR, "left")))


def score_report(scored: DataFrame, k: int = 10) -> DataFrame:
    """The report on the two model scores of every scored pair: composite score with label,
    colour and advice, whether both models give the same label, the top event and the
    number of evidence rows. Pairs that could not be scored have nulls there; a pair
    outside the graph has graph score 0 and so never agrees (its label is not a risk)."""
    ok = F.col("status") == "ok"
    count = F.size("evidence")
    composite = F.when(ok, X.composite_score("tree.score", "graph.score"))
    return (scored.withColumn("composite", composite)
            .select(*[c for c in ("request_id",) if c in scored.columns], *PAIR, "status",
                    F.col("tree.score").alias("tree_score"), F.col("tree.label").alias("tree_label"),
                    F.col("graph.score").alias("graph_score"), F.col("graph.label").alias("graph_label"),
                    "composite",
                    F.when(ok, X.composite_label("composite")).alias("composite_label"),
                    F.when(ok, X.composite_colour("composite")).alias("composite_colour"),
                    F.when(ok, X.advice_text("composite", count > 0)).alias("advice"),
                    F.when(ok, F.col("tree.label") == F.col("graph.label")).alias("models_agree"),
                    F.get("evidence", F.lit(0))["event"].alias("top_event"),
                    F.when(ok, count).alias("evidence_count")))


def score_agreement(report: DataFrame) -> DataFrame:
    """Scored pairs per (tree label, graph label), and whether they agree."""
    return model_agreement(report.filter(F.col("status") == "ok"), "tree_label", "graph_label")


def score_json(scored: DataFrame) -> DataFrame:
    """One JSON document per scored pair, scores rounded to 2 decimals for display.

    Fixed values: the document keys of the reference's response (phase2_xgb for the
    tree model, phase3_gnn for the graph model, historical_evidence).
    """
    tree = F.struct(F.round("tree.score", 2).alias("score"), F.col("tree.label").alias("label"),
                    F.col("tree.feature_drivers").alias("feature_drivers"))
    graph = F.struct(F.round("graph.score", 2).alias("score"), F.col("graph.label").alias("label"))
    doc = F.struct(F.col("drug_a"), F.col("drug_b"), F.col("status"), tree.alias("phase2_xgb"),
                   graph.alias("phase3_gnn"), F.col("evidence").alias("historical_evidence"))
    keep = [c for c in ("request_id",) if c in scored.columns]
    return scored.select(*keep, *PAIR, F.to_json(doc).alias("json"))


# What ``document_facts`` reads of a document.
DOCUMENT = ("drug_a string, drug_b string, status string, phase2_xgb struct<score:double>, "
            "historical_evidence array<struct<event:string,co_occurrences:bigint>>")


def document_facts(documents: DataFrame) -> DataFrame:
    """What documents (drug_a, drug_b, json) say besides the learned numbers, by the pair they were made
    for (``of_a``, ``of_b``). The text is parsed once, and once more for its keys."""
    score, evidence = F.col("said.phase2_xgb.score"), F.col("said.historical_evidence")
    first = F.get(evidence, F.lit(0))
    return documents.withColumn("said", F.from_json("json", DOCUMENT)).select(
        F.col("drug_a").alias("of_a"), F.col("drug_b").alias("of_b"),
        F.array_join(F.json_object_keys("json"), ",").alias("keys"), "said.drug_a", "said.drug_b", "said.status",
        F.size(evidence).cast("bigint").alias("evidence_count"), first["event"].alias("top_event"),
        first["co_occurrences"].alias("top_co_occurrences"), (score == F.round(score, 2)).cast("int").alias("score_rounded"))
