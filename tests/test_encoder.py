"""Closed-form encoder and decoder against numpy."""
import numpy as np
from pyspark.sql import functions as F

from cosignal.operators import encoder as EN


def toy(spark, n=40, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.3]
    w = [1.0 + x[i, 0] * x[j, 0] + abs(x[i, 1] - x[j, 1]) for i, j in pairs]
    nodes = spark.createDataFrame([(i, f"d{i:02d}", *map(float, v)) for i, v in enumerate(x)], "idx long, drug string, p double, q double")
    both = [(i, j, float(v)) for (i, j), v in zip(pairs, w)] + [(j, i, float(v)) for (i, j), v in zip(pairs, w)]
    edges = spark.createDataFrame(both, "src long, dst long, w double").repartition(3)
    table = spark.createDataFrame([(f"d{i:02d}", f"d{j:02d}", float(v)) for (i, j), v in zip(pairs, w)],
                                  "drug_a string, drug_b string, y double")
    return x, pairs, np.array(w), nodes, edges, table


def plain_encode(x, pairs, w, hops, l2):
    n = len(x)
    a = np.zeros((n, n))
    for i, j in pairs:
        a[i, j] = a[j, i] = 1
    deg = a.sum(1, keepdims=True)
    src = np.array([i for i, j in pairs] + [j for i, j in pairs])
    y = np.concatenate([w, w])
    h, z = x, [x]
    for _ in range(hops):
        u = np.hstack([h, np.where(deg > 0, a @ h / np.maximum(deg, 1), 0)])
        u = (u - u.mean(0)) / np.sqrt(u.var(0) + EN.EPS)
        rows = np.hstack([np.ones((len(src), 1)), u[src]])
        penalty = np.diag([0.0] + [l2 * len(src)] * u.shape[1]) + 1e-9 * np.eye(u.shape[1] + 1)
        weights = np.linalg.solve(rows.T @ rows + penalty, rows.T @ np.stack([y, y * y], 1))
        h = np.hstack([np.ones((n, 1)), u]) @ weights
        z.append(h)
    return np.hstack(z)


def test_layers_and_decoder_match_numpy(spark):
    x, pairs, w, nodes, edges, table = toy(spark)
    emb, model = EN.encode(nodes, edges, ["p", "q"], 2, edges, l2=1e-3)
    want = plain_encode(x, pairs, w, 2, 1e-3)
    got = np.array([r.z for r in emb.orderBy("idx").collect()])
    assert got.shape == (40, 6) and np.allclose(got, want, atol=1e-7)
    again, _ = EN.encode(nodes, edges, ["p", "q"], 2, model=model)
    assert np.allclose(got, np.array([r.z for r in again.orderBy("idx").collect()]))
    dec = EN.fit_decoder(table, emb, 6, "y", hidden=8, l2=0.01)
    za, zb = want[[i for i, _ in pairs]], want[[j for _, j in pairs]]
    v = np.stack([za, zb, za * zb, np.abs(za - zb)], 2).reshape(len(pairs), -1)
    v = (v - v.mean(0)) / np.sqrt(v.var(0) + EN.EPS)
    v = np.hstack([np.ones((len(v), 1)), v, np.maximum(v @ np.array(dec.hidden), 0)])
    penalty = np.diag([0.0] + [0.01 * len(v)] * (v.shape[1] - 1)) + 1e-9 * np.eye(v.shape[1])
    beta = np.linalg.solve(v.T @ v + penalty, v.T @ w)
    made = {(r.drug_a, r.drug_b): r.prediction for r in EN.decode(dec, table, emb).collect()}
    got = np.array([made[f"d{i:02d}", f"d{j:02d}"] for i, j in pairs])
    assert np.allclose(got, v @ beta, atol=1e-6)
    assert ((got - w) ** 2).mean() < 0.5 * w.var()            # the structure of the toy weights is learned


def test_awkward_tables(spark):
    """Nodes without edges, no training edge, pairs with unknown drugs or null targets, empty tables,
    a column that is already called prediction."""
    _, _, _, nodes, edges, table = toy(spark)
    lonely = nodes.unionByName(spark.createDataFrame([(40, "zz", 1.0, 2.0)], nodes.schema))
    emb, _ = EN.encode(lonely, edges, ["p", "q"], 1, edges)
    assert emb.count() == 41 and emb.filter(F.exists("z", lambda v: v.isNull() | F.isnan(v))).count() == 0
    none, _ = EN.encode(nodes, edges, ["p", "q"], 2, edges.limit(0))
    assert all(r.z[2:] == [0.0] * 4 for r in none.collect())
    more = table.unionByName(spark.createDataFrame([("zz", "unknown", 1.0), ("d00", "d01", None)], table.schema))
    dec = EN.fit_decoder(more, emb, 4, "y", hidden=4)
    out = EN.decode(dec, more.withColumn("prediction", F.lit("x")), emb)
    assert out.columns == ["drug_a", "drug_b", "y", "prediction"] and out.count() == more.count() - 1
    flat = EN.fit_decoder(table.limit(0), emb, 4, "y", hidden=4)
    assert {r.prediction for r in EN.decode(flat, table, emb).collect()} == {0.0}
    assert EN.decode(dec, table.limit(0), emb).count() == 0
