import numpy as np

from cosignal.llm import ann_tree as A
from cosignal.llm.queries import op5_ann_tree

from .helpers import SF

SCHEMA = "vec_id long, embedding array<double>, leaf string, score string"


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        score = (x * x[ids == q][0]).sum(axis=1)
        ok = ids != q
        order = np.lexsort((ids[ok], -score[ok]))[:k]
        out[q] = (ids[ok][order].tolist(), score[ok][order])
    return out


def compare(got, want, least):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(want)
    found = total = 0
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        assert rows == sorted(rows, key=lambda r: (-r.score, r.vec_id))
        ids, score = want[q]
        assert len(rows) == len(ids)
        true = dict(zip(ids, score))
        assert all(abs(true[r.vec_id] - r.score) < 1e-12 for r in rows if r.vec_id in true)
        found += sum(r.vec_id in true for r in rows)
        total += len(ids)
    assert found >= least * total, found / total


def test_query_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    compare(op5_ann_tree(spark, SF).collect(), brute(ids, x, ids[ids % 20 == 0], 20), 0.9)


def test_clusters_ties_and_shards(spark, monkeypatch):
    """Clustered vectors, one vector on a third of all ids, tiny shards and copies."""
    monkeypatch.setattr(A, "SHARD_ROWS", 50)
    monkeypatch.setattr(A, "QUERIES_PER_SHARD", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 3
    x = centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8))
    x[::3] = x[0]
    ids = np.arange(900)
    df = spark.createDataFrame([(int(i), v.tolist(), "x", "y") for i, v in zip(ids, x)], SCHEMA)
    got = A.search(df, lambda i: i % 20 == 0, k=7).collect()
    want = brute(ids, x, ids[ids % 20 == 0], 7)
    compare(got, want, 0.9)


def test_thousands_of_hot_shards(spark, monkeypatch):
    """Every shard holds one vector and is wanted by more queries than one copy may serve."""
    monkeypatch.setattr(A, "SHARD_ROWS", 1)
    monkeypatch.setattr(A, "QUERIES_PER_SHARD", 2)
    rng = np.random.default_rng(6)
    x, ids = rng.normal(size=(2000, 4)), np.arange(2000)
    df = spark.createDataFrame([(int(i), v.tolist(), "x", "y") for i, v in zip(ids, x)], SCHEMA)
    got = A.search(df, lambda i: i % 50 == 0, k=3).collect()
    compare(got, brute(ids, x, ids[ids % 50 == 0], 3), 0.9)


def test_vectors_that_take_no_part(spark):
    good = [(i, [float(i % 5 + 1), 1.0]) for i in range(10)]
    bad = [(20, None), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [float("nan"), 1.0]),
           (100, [float("inf"), 1.0]), (None, [1.0, 1.0]), (120, []), (140, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, "x", "y") for r in good + bad + good], SCHEMA)
    got = A.search(df, lambda i: i % 20 == 0).collect()
    ids, x = np.arange(10), np.array([v for _, v in good])
    compare(got, brute(ids, x, np.array([0]), 20), 1.0)     # fewer candidates than 20: all
    assert A.search(df.limit(0), lambda i: i % 20 == 0).count() == 0
    assert A.search(df.filter("vec_id = 20"), lambda i: i % 20 == 0).count() == 0


def test_traversal_is_complete():
    rng = np.random.default_rng(2)
    tree = A.fit(rng.normal(size=(500, 4)), 20, 4)
    order = tree.visit(rng.normal(size=4), tree.leaves)
    assert sorted(order) == list(range(tree.leaves))
    x = rng.normal(size=(50, 4))
    assert ((0 <= tree.assign(x)) & (tree.assign(x) < tree.leaves)).all()


def test_queries_in_tiny_leaves_find_k(spark, monkeypatch):
    """Copies of one vector fill the calibration, so one leaf is enough for them; queries
    that land in tiny leaves still get k rows."""
    monkeypatch.setattr(A, "LEAF_SAMPLE", 8)
    monkeypatch.setattr(A, "LEAF_ROWS", 8)
    rng = np.random.default_rng(4)
    outliers = rng.normal(size=(600, 8))
    outliers[:, 0] = -1
    x = np.vstack([np.tile([10.0, *[0.0] * 7], (1200, 1)), outliers])
    visits = []
    calibrate = A.calibrate
    monkeypatch.setattr(A, "calibrate", lambda *a: visits.append(calibrate(*a)) or visits[-1])
    df = spark.createDataFrame([(i, v.tolist(), "x", "y") for i, v in enumerate(x)], SCHEMA)
    got = A.search(df, lambda i: (i < 300) | (i >= 1792)).groupBy("query_id").count().collect()
    assert visits == [1]
    assert {r.query_id: r["count"] for r in got} == {i: A.K for i in [*range(300), *range(1792, 1800)]}


def test_traversal_goes_on_until_the_leaves_hold_enough():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4))
    tree = A.fit(x, 20, 4)
    size = np.bincount(tree.assign(x), minlength=tree.leaves)
    for q in rng.normal(size=(20, 4)):
        some = tree.visit(q, 1, size, 60)
        assert size[some].sum() >= 60 > size[some[:-1]].sum()
        assert some == tree.visit(q, len(some))
    assert len(tree.visit(q, 3, size, 0)) == 3 and len(tree.visit(q, 1, size, 10**6)) == tree.leaves
