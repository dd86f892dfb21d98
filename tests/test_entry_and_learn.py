import sys
import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as E
from cosignal.operators import features as FE
from cosignal.operators import learn as L
from cosignal.operators import score as SC
from cosignal.plans import catalog as K
from cosignal.sources.proxy import pair_requests


def test_entry_contract(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["drug_a", "drug_b", "event", "a", "pair_total", "event_total", "PRR", "ROR", "risk_score"]
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    for name in ("gbt_regression", "edge_regression", "score_pairs", "batch_report_json"):
        assert name in q and name not in o


def test_learn_and_score(spark, sf_dir):
    sig = K.stage_signals(spark, sf_dir)
    f = K.build_features(spark, sf_dir)
    params = L.TreeParams(max_iter=3, max_depth=3)
    tree, train, test = L.fit_tree_model(f, params)
    assert train.count() + test.count() == f.count()
    path = tempfile.mkdtemp(prefix="cosignal-model-") + "/tree"
    L.save_model(tree, path)
    again = L.load_model(path)
    a = L.predict(tree, test).select("prediction").collect()
    b = L.predict(again, test).select("prediction").collect()
    assert a == b
    assert L.per_iteration_errors(tree, test).count() == 3
    _, _, emb = L.graph_embeddings(f, hops=2)
    assert len(emb.first().z) == 6
    edge, _, etest = L.fit_edge_model(f, emb, params)
    m = L.evaluate(edge, etest, 3.0, "edge").first()
    assert m.model == "edge" and 0.0 <= m.acc <= 1.0
    scored = SC.score_pairs(pair_requests(spark, sf_dir), FE.drug_encoders(sig), tree, emb, edge, sig)
    row = scored.filter("status = 'ok'").first()
    assert row.tree.label in ("HIGH RISK", "MEDIUM RISK", "LOW RISK")
    assert len(row.tree.feature_drivers) == 3 and len(row.evidence) <= 10
    assert scored.filter("status = 'same_drug'").filter(F.col("tree").isNotNull()).count() == 0
    js = SC.score_json(scored).first().json
    assert '"phase2_xgb"' in js and '"historical_evidence"' in js


def test_batch_build_end_to_end(spark):
    import os
    from cosignal.plans.build import build
    from cosignal.sources import tables as T
    from tests.test_worked_example import make_reports
    out = tempfile.mkdtemp(prefix="cosignal-build-")
    paths = build(spark, make_reports(spark), out, min_support=1,
                  tree_params=L.TreeParams(max_iter=2, max_depth=2), hops=1, write_rows=True)
    sig = spark.read.parquet(paths["signals"])
    assert sig.count() == 8
    first = sig.first()
    assert (first.drug_a, first.drug_b, first.event) == ("ASPIRIN", "WARFARIN", "Bleeding")
    assert T.read_pair_events(spark, paths["pair_events"], ["2025q1"]).count() == 11
    assert spark.read.parquet(paths["features"]).count() == 3
    nodes, edges = T.read_graph(spark, paths["graph"])
    assert nodes.count() == 3 and edges.count() == 6
    assert spark.read.json(paths["metrics"]).count() == 2
    assert T.first_existing(spark, [out + "/missing", paths["signals"]]) == paths["signals"]
    # Scoring loads what the build stored and fits nothing.
    req = spark.createDataFrame([(1, "Aspirin", "warfarin."), (2, "aspirin", "nobody"), (3, None, "x"), (4, "x", "X ")],
                                "request_id long, drug_a string, drug_b string")
    scored = SC.score_stored(req, paths).cache()
    rep = {r.request_id: r for r in SC.score_report(scored).collect()}
    assert [rep[i].status for i in (1, 2, 3, 4)] == ["ok", "ok", "missing_drug", "same_drug"]
    assert rep[1].top_event == "Bleeding" and rep[1].evidence_count > 0 and rep[1].advice is not None
    assert rep[2].graph_label.startswith("Not") or rep[2].graph_score == 0.0
    assert rep[2].evidence_count == 0 and rep[2].models_agree is False
    assert rep[3].composite is None and rep[3].advice is None
    assert sum(r.n for r in SC.score_agreement(SC.score_report(scored)).collect()) == 2
    upper = {r.request_id: r.status for r in SC.score_stored(req, paths, mode="upper_trim").collect()}
    assert upper == {1: "ok", 2: "ok", 3: "missing_drug", 4: "same_drug"}
    imp = L.feature_importances(L.load_model(paths["models/tree"]))
    assert imp.count() == 11
    assert T.example_pairs(spark).count() == 6
    assert T.drop_table(spark, paths["counters"]) and not T.path_exists(spark, paths["counters"])
    assert not T.drop_table(spark, paths["counters"])
