"""Regularised boosting against a plain version, and the model as rows."""
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cosignal.operators import boosting as B

FEATURES = ["a", "b", "c"]


def data(n=300, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    return x, np.round(np.where(x[:, 0] > 0, 2.0, -1.0) + x[:, 1] * x[:, 2] + rng.normal(size=n) * 0.1, 3)


def frame(spark, x, y):
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double").repartition(5)


def plain_tree(x, g, rows, p, depth):
    """(feature, threshold, left, right) or a leaf value, by trying every value as a cut."""
    worth = lambda s, n: np.sign(s) ** 2 * max(abs(s) - p.l1, 0) ** 2 / (n + p.l2)
    best = (B.LEAST_GAIN, None)
    if depth:
        for f in range(x.shape[1]):
            for cut in sorted(set(x[:, f]))[:-1]:
                left = rows[x[rows, f] <= cut]
                right = rows[x[rows, f] > cut]
                if len(left) and len(right):
                    gain = (worth(g[left].sum(), len(left)) + worth(g[right].sum(), len(right))
                            - worth(g[rows].sum(), len(rows)))
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, cut, left, right))
    if best[1] is None:
        s = g[rows].sum()
        return -p.rate * np.sign(s) * max(abs(s) - p.l1, 0) / (len(rows) + p.l2)
    f, cut, left, right = best[1]
    return f, cut, plain_tree(x, g, left, p, depth - 1), plain_tree(x, g, right, p, depth - 1)


def plain_predict(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("small", [65_536, 40, 1])
def test_trees_match_the_plain_version(spark, small):
    """With all rows and columns, and every value its own bin; nodes grown by histogram
    jobs, by subtree jobs and by both give the same trees."""
    x, y = data()
    p = B.BoostParams(trees=3, depth=3, rate=0.5, row_share=1.0, column_share=1.0, small_node=small, trees_per_write=2)
    model = B.fit(frame(spark, x, y), FEATURES, "y", ["id"], p)
    margin = np.full(len(y), y.mean())
    for _ in range(p.trees):
        tree = plain_tree(x, margin - y, np.arange(len(y)), p, p.depth)
        margin += [plain_predict(tree, r) for r in x]
    got = {r.id: r.prediction for r in B.predict(model, frame(spark, x, y)).collect()}
    assert np.allclose([got[i] for i in range(len(y))], margin, atol=1e-6)


def test_model_does_not_depend_on_partitions_or_jobs(spark):
    x, y = data(500, 2)
    p = dict(trees=4, depth=5, rate=0.3, trees_per_write=3)
    df = frame(spark, x, y)
    one = B.fit(df.coalesce(1), FEATURES, "y", ["id"], B.BoostParams(**p))
    many = B.fit(df.repartition(9), FEATURES, "y", ["id"], B.BoostParams(**p, small_node=60))
    key = lambda m: sorted((t, f, thr, round(v, 9), c) for t, _, _, f, thr, _, _, v, _, c in m.nodes if f)
    assert key(one) == key(many)
    sampled = {n[9] for n in one.nodes if n[2] == -1}
    assert all(0.75 * 500 < c < 0.95 * 500 for c in sampled) and len(sampled) > 1
    used = {t: {n[3] for n in one.nodes if n[0] == t and n[3]} for t in range(4)}
    assert all(len(u) <= 2 for u in used.values())          # 85 % of three columns


def test_regularisation_shrinks(spark):
    x, y = data()
    df = frame(spark, x, y)
    size = lambda **k: max(abs(n[7]) for n in B.fit(df, FEATURES, "y", ["id"], B.BoostParams(trees=1, depth=4, **k)).nodes)
    assert size(l1=0, l2=0) > size(l1=0, l2=50) > 0 and size(l1=0, l2=0) > size(l1=20, l2=0)
    flat = B.fit(df, FEATURES, "y", ["id"], B.BoostParams(trees=2, l1=1e9))
    assert all(n[3] is None and n[7] == 0 for n in flat.nodes)


def test_contributions_errors_importances_and_storage(spark):
    x, y = data()
    df = frame(spark, x, y)
    m = B.fit(df, FEATURES, "y", ["id"], B.BoostParams(trees=6, depth=4, rate=0.3))
    for r in B.contributions(m, df).collect():
        assert abs(r.bias + sum(r.contributions.values()) - r.prediction) < 1e-9
    assert B.predict(m, df).withColumn("e", B.as_column(m)).filter(F.abs(F.col("e") - F.col("prediction")) > 1e-9).count() == 0
    errors = {r.iteration: r.squared_error for r in B.per_tree_errors(m, df, "y").collect()}
    mse = B.predict(m, df).agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0]
    assert len(errors) == 6 and abs(errors[6] - mse) < 1e-9 and errors[6] < errors[1]
    shares = {r.name: r.importance for r in B.importances(m, spark).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9 and shares["a"] == max(shares.values())
    path = tempfile.mkdtemp(prefix="cosignal-boost-") + "/m"
    m.save(spark, path)
    again = B.BoostedModel.load(spark, path)
    assert again == m


def test_awkward_rows(spark):
    """Null features go left everywhere, rows without target do not train, constant features and
    targets give no split, an empty table predicts 0, a column named like an internal one stays."""
    x, y = data(120)
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    rows += [(200, None, 1.0, 2.0, 1.0), (201, None, None, None, None), (202, 1.0, float("nan"), 0.0, None), (3, *rows[3][1:])]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double").withColumn("margin", F.lit("m"))
    p = B.BoostParams(trees=2, depth=3)
    m = B.fit(df, FEATURES, "y", ["id"], p)
    out = B.predict(m, df)
    assert out.columns == [*df.columns, "prediction"] and out.filter("prediction IS NULL OR isnan(prediction)").count() == 0
    assert out.withColumn("e", B.as_column(m)).filter(F.abs(F.col("e") - F.col("prediction")) > 1e-9).count() == 0
    const = B.fit(df.withColumn("y", F.lit(2.0)), FEATURES, "y", ["id"], p)
    assert const.base == 2.0 and all(n[3] is None for n in const.nodes)
    none = B.fit(df.limit(0), FEATURES, "y", ["id"], p)
    assert B.predict(none, df).select("prediction").distinct().collect() == [(0.0,)]
    assert B.contributions(m, df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        B.fit(df, FEATURES, "y", ["id"], B.BoostParams(bins=300))
