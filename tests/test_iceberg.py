"""Dictionary ids, cells and support-pruned counting."""
import random

import pytest
from pyspark.sql import functions as F

from cosignal.operators import cells as CE
from cosignal.operators import counts as C
from cosignal.operators import iceberg as I
from cosignal.operators import signals as S
from cosignal.operators.dictionary import build_dictionary
from cosignal.sources.proxy import proxy_reports
from cosignal.sources.reports import Reports

KEYS = ["drug_a", "drug_b", "event"]


def small_reports(spark, drug, reac, demo):
    return Reports(demo=spark.createDataFrame(demo, "quarter string, PRIMARYID long, AGE double, SEX string"),
                   drug=spark.createDataFrame(drug, "quarter string, PRIMARYID long, DRUGNAME string"),
                   reac=spark.createDataFrame(reac, "quarter string, PRIMARYID long, PT string"))


def test_dictionary_ids_are_dense_and_ordered(spark):
    rep = small_reports(spark, [("q", 1, "beta"), ("q", 1, "Be-ta "), ("q", 2, "alpha"), ("q", 2, None), ("q", 2, "--")],
                        [("q", 1, "Pain"), ("q", 1, None), ("q", 2, "ache")], [("q", 1, None, None)])
    d = build_dictionary(rep)
    assert sorted(map(tuple, d.drugs.collect())) == [("ALPHA", 0), ("BETA", 1)]
    assert sorted(map(tuple, d.events.collect())) == [("Pain", 2), ("ache", 3)]
    assert sorted((r.raw, r.id) for r in d.raw.filter("kind = 0").collect()) == [("Be-ta ", 1), ("alpha", 0), ("beta", 1)]


def test_awkward_reports(spark):
    """Null ids, names and events, repeated rows, reports that lack a table, the same number
    in two quarters; empty tables give no counters and a total of 0."""
    drug = [("q", 1, "a"), ("q", 1, "b"), ("q", 1, "A "), ("q", 1, None), ("q", 2, "a"), ("q", 2, "c"), ("q", None, "a"),
            ("q", None, "b"), ("r", 1, "b"), ("r", 1, "c"), ("q", 3, "a"), ("q", 3, "b"), ("q", 4, "a")]
    reac = [("q", 1, "x"), ("q", 1, "x"), ("q", 1, None), ("q", 2, "x"), ("r", 1, "y"), ("q", None, "x"), ("q", 4, "x")]
    demo = [("q", 1, 1.0, "F"), ("q", 1, 2.0, "F"), ("r", 1, None, None), ("q", 3, None, None), ("q", 4, None, None)]
    c = C.count_pair_events(small_reports(spark, drug, reac, demo))
    assert sorted(map(tuple, c.pair_event.collect()), key=str) == [
        ("A", "B", "x", 4), ("A", "B", None, 2), ("B", "C", "y", 1)]
    assert sorted(map(tuple, c.pair.collect())) == [("A", "B", 6), ("B", "C", 1)]
    assert {r.event: r.event_total for r in c.event.collect()} == {"x": 4, None: 2, "y": 1}
    assert spark.range(1).select(c.n).first()[0] == 7
    none = small_reports(spark, [], [], [])
    c = C.count_pair_events(none)
    assert c.pair_event.count() == c.pair.count() == 0 and spark.range(1).select(c.n).first()[0] == 0
    assert S.signals(C.count_frequent(none, 3)).count() == 0


def test_cells_cover_every_pair_and_fact_once(spark):
    rng = random.Random(6)
    drug = [("q", p, f"d{rng.randrange(30):02d}") for p in range(12) for _ in range(rng.randrange(25))]
    reac = [("q", p, f"e{rng.randrange(40)}") for p in range(12) for _ in range(rng.randrange(60))]
    rep = small_reports(spark, drug, reac, [("q", p, None, "F") for p in range(12)])
    want = {}
    for p in range(12):
        ds = sorted({n.upper() for _, q, n in drug if q == p})
        for _, q, e in reac:
            if q == p:
                for i, x in enumerate(ds):
                    for y in ds[i + 1:]:
                        want[x, y, e] = want.get((x, y, e), 0) + 1
    for size, rows in ((64, 1_000_000), (2, 4), (3, 1), (5, 100)):
        c = C.count_pair_events(rep, cell_drugs=size, cell_rows=rows)
        assert {tuple(r)[:3]: r.a for r in c.pair_event.collect()} == want
        names = build_dictionary(rep)
        cells = CE.store_cells(rep, names, size, rows)
        for r in cells.table.collect():
            assert len(r.da) <= size and len(r.db) <= size and len(r.fs) <= max(1, 2 * rows // size ** 2)
        assert cells.rows == cells.table.agg(F.sum("rows")).first()[0] == CE.triples(cells).count()


@pytest.mark.parametrize("size", [I.SketchSize(16, 1), I.SketchSize(16, 3), I.SketchSize(20, 2), None])
def test_pruning_never_changes_the_result(spark, sf_dir, size):
    rep = proxy_reports(spark, sf_dir)
    plain = C.count_pair_events(rep)
    pruned = C.count_frequent(rep, 3, size)
    want = plain.pair_event.filter("a >= 3")
    assert want.exceptAll(pruned.pair_event).count() == 0 and pruned.pair_event.exceptAll(want).count() == 0
    assert plain.pair.exceptAll(pruned.pair).count() == 0 and plain.event.exceptAll(pruned.event).count() == 0
    assert spark.range(1).select(pruned.n).first()[0] == 64079
    assert S.signals(pruned).count() == 5232


def test_sketch_is_never_too_low_and_drops_rare_groups(spark, sf_dir):
    rep = proxy_reports(spark, sf_dir)
    rows = CE.triples(CE.store_cells(rep, build_dictionary(rep)))
    exact = rows.groupBy(*KEYS).agg(F.sum("w").alias("a"))
    size = I.SketchSize(20, 2)
    sketched = I.sketch(rows, KEYS, "w", size)
    for j in range(size.rows):
        at = exact.withColumn("bucket", I.bucket(KEYS, j, size)).join(sketched.filter(F.col("row") == j), "bucket")
        assert at.count() == exact.count() and at.filter("total < a").count() == 0
    kept = I.keep_heavy(rows, KEYS, I.heavy_buckets(sketched, 3, size), size)
    left = kept.groupBy(*KEYS).agg(F.sum("w").alias("a"))
    groups, rare = left.count(), left.filter("a < 3").count()
    assert groups - rare == 5232
    assert rare < 0.05 * exact.filter("a < 3").count()      # nearly all rare groups are gone before the shuffle


def test_sketch_sizes_are_checked():
    for bits, rows in ((15, 1), (28, 1), (20, 0), (20, 5)):
        with pytest.raises(ValueError):
            I.SketchSize(bits, rows)
