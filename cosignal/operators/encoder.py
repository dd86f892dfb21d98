"""Learned neighbourhood encoder and edge decoder, fitted layer by layer in closed form.

Encoder layer: a node's values and the mean of its in-neighbours' values are batch-normalised
(mean and variance over all nodes), then mapped linearly to what its training edges weigh: the
weights minimise, summed over training edges, the squared distance of the source's mapped values
to (weight, weight^2). The next layer starts from the mapped values. So every layer is one
propagation, one aggregation and one small system of normal equations.

Decoder: both ends' embeddings, their products and absolute differences, batch-normalised, and
``hidden`` ReLU units with fixed random weights over them; output weights by ridge regression on
the training edges.

Normal equations are summed by Spark as (row, column, value) entries, so the driver sees matrices
of a few dozen rows whatever the number of edges, and nothing is iterated over epochs.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cosignal.operators import graph as G
from cosignal.session import cut_lineage

# Functions that run inside tasks travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EPS = 1e-5
SEED = 42


@dataclass
class Layer:
    mean: list[float]
    std: list[float]
    weights: list[list[float]]       # [inputs + 1 (constant)] x outputs


@dataclass
class EncoderModel:
    inputs: list[str]
    layers: list[Layer] = field(default_factory=list)


@dataclass
class DecoderModel:
    mean: list[float]
    std: list[float]
    hidden: list[list[float]]        # fixed projection of the normalised pair values
    weights: list[float]             # constant, pair values, hidden units


def moments(df: DataFrame, cols: list[str]) -> list[tuple[float, float]]:
    """(mean, population variance) of each column; (0, 0) without rows."""
    r = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    return [(r[f"m{i}"] or 0.0, r[f"v{i}"] or 0.0) for i in range(len(cols))]


def normal_equations(df: DataFrame, cols: list[str], targets: list[str],
                     expand: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(X'X, X'Y) over the rows of ``df``, X being a constant and the columns ``cols`` (after
    ``expand``, a function of the row matrix). Each task adds up its rows; entries are summed
    by Spark."""
    given = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)],
                      *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(targets)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            a = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)], 1)
            x, y = a[:, :len(cols)], a[:, len(cols):]
            x = np.hstack([np.ones((len(x), 1)), expand(x) if expand else x])
            part = x.T @ np.hstack([x, y])
            total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()),
                                              pa.array(total.ravel())], names=["i", "j", "v"])

    rows = given.mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    n = 1 + max((r.i for r in rows), default=-1)
    both = np.zeros((n, n + len(targets)))
    for r in rows:
        both[r.i, r.j] = r.v
    return both[:, :n], both[:, n:]


def ridge(xx: np.ndarray, xy: np.ndarray, l2: float) -> np.ndarray:
    """Weights for ``l2`` on all but the constant, relative to the number of rows (xx[0, 0])."""
    if not len(xx):
        return np.zeros_like(xy)
    penalty = np.full(len(xx), l2 * xx[0, 0])
    penalty[0] = 0.0
    return np.linalg.solve(xx + np.diag(penalty + 1e-9), xy)


def _layer_inputs(state: DataFrame, edges, cols: list[str]) -> DataFrame:
    """idx, the columns and their neighbour means (``n_<col>``)."""
    means = G.neighbour_mean(edges, state.select("idx", *cols), cols)
    return state.join(means.select("idx", *[F.col(c).alias(f"n_{c}") for c in cols]), "idx")


def _apply(layer: Layer, cols: list[str], out: int) -> Column:
    total = F.lit(layer.weights[0][out])
    for c, m, s, w in zip(cols, layer.mean, layer.std, layer.weights[1:]):
        total = total + (F.col(c) - F.lit(m)) / F.lit(s) * F.lit(w[out])
    return total


def encode(nodes: DataFrame, edges: DataFrame, cols: list[str], hops: int = 3, train: DataFrame | None = None,
           model: EncoderModel | None = None, l2: float = 1e-3) -> tuple[DataFrame, EncoderModel]:
    """(idx, drug, z; model): own values followed by the mapped values of every layer.

    Fits the layers on ``train`` (src, dst, w: training edges, both directions), or applies a
    fitted ``model``. A node without neighbours has neighbour means of 0; without training edges
    all mapped values are 0.
    """
    fitted = EncoderModel(list(cols)) if model is None else model
    by_source = G.bucketed_edges(edges) if hops > 1 else edges
    state = cut_lineage(nodes.select("idx", "drug", *cols), "layer-0")
    now, z = list(cols), list(cols)
    for k in range(1, hops + 1):
        inputs = now + [f"n_{c}" for c in now]
        wide = cut_lineage(_layer_inputs(state, by_source, now), f"layer-{k}-inputs")
        if model is None:
            stats = moments(wide, inputs)
            mean, std = [m for m, _ in stats], [float(np.sqrt(v + EPS)) for _, v in stats]
            normal = wide.select(F.col("idx").alias("src"), *[((F.col(c) - m) / s).alias(c) for c, m, s in zip(inputs, mean, std)])
            rows = train.withColumn("w2", F.col("w") * F.col("w")).join(normal, "src")
            xx, xy = normal_equations(rows, inputs, ["w", "w2"])
            weights = ridge(xx, xy, l2) if len(xx) else np.zeros((len(inputs) + 1, 2))
            fitted.layers.append(Layer(mean, std, weights.tolist()))
        layer = fitted.layers[k - 1]
        made = [f"z{k}_{i}" for i in range(len(layer.weights[0]))]
        state = cut_lineage(wide.select("idx", "drug", *z, *[_apply(layer, inputs, i).alias(c) for i, c in enumerate(made)]),
                            f"layer-{k}")
        now, z = made, z + made
    return state.select("idx", "drug", F.array(*[F.col(c).cast("double") for c in z]).alias("z")), fitted


def pair_values(pairs: DataFrame, emb: DataFrame, width: int) -> tuple[DataFrame, list[str]]:
    """The pairs whose two drugs have embeddings, with columns for both ends, their products and
    absolute differences."""
    za = emb.select(F.col("drug").alias("drug_a"), F.col("z").alias("_za"))
    zb = emb.select(F.col("drug").alias("drug_b"), F.col("z").alias("_zb"))
    both = pairs.join(za, "drug_a").join(zb, "drug_b")
    made = {}
    for i in range(width):
        a, b = F.col("_za")[i], F.col("_zb")[i]
        made |= {f"_a{i}": a, f"_b{i}": b, f"_p{i}": a * b, f"_d{i}": F.abs(a - b)}
    return both.select(*pairs.columns, *[v.alias(k) for k, v in made.items()]), list(made)


def _expand(mean: list[float], std: list[float], hidden: list[list[float]]) -> Callable[[np.ndarray], np.ndarray]:
    m, s, p = np.array(mean), np.array(std), np.array(hidden)

    def run(x: np.ndarray) -> np.ndarray:
        x = (x - m) / s
        return np.hstack([x, np.maximum(x @ p, 0.0)])

    return run


def fit_decoder(train: DataFrame, emb: DataFrame, width: int, label: str, hidden: int = 32, l2: float = 0.1) -> DecoderModel:
    """Decoder from pairs with a target (drug_a, drug_b, ``label``) and embeddings of ``width``."""
    values, cols = pair_values(train.filter(F.col(label).isNotNull()).select("drug_a", "drug_b", label), emb, width)
    values = cut_lineage(values, "pair-values")
    stats = moments(values, cols)
    mean, std = [m for m, _ in stats], [float(np.sqrt(v + EPS)) for _, v in stats]
    project = (np.random.default_rng(SEED).normal(size=(len(cols), hidden)) / np.sqrt(len(cols))).tolist()
    xx, xy = normal_equations(values, cols, [label], _expand(mean, std, project))
    weights = ridge(xx, xy, l2)[:, 0] if len(xx) else np.zeros(1 + len(cols) + hidden)
    return DecoderModel(mean, std, project, weights.tolist())


def decode(model: DecoderModel, pairs: DataFrame, emb: DataFrame) -> DataFrame:
    """The pairs whose drugs have embeddings, with ``prediction``. A column of that name in
    ``pairs`` is replaced."""
    pairs = pairs.drop("prediction")
    values, cols = pair_values(pairs, emb, len(model.mean) // 4)
    expand, weights = _expand(model.mean, model.std, model.hidden), np.array(model.weights)
    names = pairs.columns
    schema = T.StructType([*pairs.schema.fields, T.StructField("prediction", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in cols], 1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(expand(x) @ weights[1:] + weights[0])],
                                             names=[f.name for f in schema])

    return values.mapInArrow(run, schema)
