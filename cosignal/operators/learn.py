"""Model jobs: the regularised boosted trees on pair features (``boosting``) and the edge
regressor on propagated node embeddings (MLlib). Training, prediction and evaluation all run
as Spark jobs; the driver sees models, not rows. ``fit_tree_model`` given ``TreeParams`` fits
MLlib's trees instead; the functions on a fitted model take either kind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosignal.operators import boosting as B
from cosignal.operators import graph as G
from cosignal.operators.features import FEATURES, TARGET
from cosignal.operators.metrics import evaluation_report
from cosignal.operators.split import hash_split
from cosignal.session import cut_lineage
from cosignal.sources.tables import path_exists

Model = PipelineModel | B.BoostedModel


@dataclass
class TreeParams:
    """Settings of MLlib's trees (edge regressor): no L1/L2 leaf penalties, columns drawn per
    split (``feature_subset``)."""
    max_iter: int = 20
    max_depth: int = 5
    step_size: float = 0.1
    subsampling: float = 0.85
    feature_subset: str = "0.85"
    max_bins: int = 32
    seed: int = 42


def _gbt(p: TreeParams, features_col: str, label: str) -> GBTRegressor:
    return GBTRegressor(featuresCol=features_col, labelCol=label, predictionCol="prediction",
                        maxIter=p.max_iter, maxDepth=p.max_depth, stepSize=p.step_size,
                        subsamplingRate=p.subsampling, featureSubsetStrategy=p.feature_subset,
                        maxBins=p.max_bins, seed=p.seed, lossType="squared")


def tree_pipeline(params: TreeParams | None = None, features=FEATURES, label: str = TARGET) -> Pipeline:
    """Feature vector in fixed order, then the boosted-tree regressor on the log target."""
    p = params or TreeParams()
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features",
                                            handleInvalid="keep"),
                            _gbt(p, "features", label)])


def fit_tree_model(features: DataFrame, params: B.BoostParams | TreeParams | None = None,
                   train_pct: int = 80) -> tuple[Model, DataFrame, DataFrame]:
    """Split by undirected pair, fit on the train part; returns (model, train, test)."""
    train, test = hash_split(features, train_pct)
    if isinstance(params, TreeParams):
        return tree_pipeline(params).fit(train), train, test
    return B.fit(train, FEATURES, TARGET, ["drug_a", "drug_b"], params or B.BoostParams()), train, test


def predict(model: Model, df: DataFrame) -> DataFrame:
    """``df`` with ``prediction``; a pipeline's assembled vectors are dropped."""
    if isinstance(model, B.BoostedModel):
        return B.predict(model, df)
    return model.transform(df).drop("features", "edge_features", "z_a_vec", "z_b_vec")


def per_iteration_errors(model: Model, test: DataFrame) -> DataFrame:
    """Held-out squared error after each tree (the training log of the reference)."""
    if isinstance(model, B.BoostedModel):
        return B.per_tree_errors(model, test, TARGET)
    gbt = [s for s in model.stages if isinstance(s, GBTRegressionModel)][0]
    assembled = test
    for stage in model.stages:
        if stage is not gbt:
            assembled = stage.transform(assembled)
    errs = gbt.evaluateEachIteration(assembled, "squared")  # one float per tree
    spark = test.sparkSession
    return spark.createDataFrame([(i + 1, float(e)) for i, e in enumerate(errs)],
                                 "iteration int, squared_error double")


def feature_importances(model: Model, names=FEATURES) -> DataFrame:
    """name, importance of each input feature (one number per feature, from the model)."""
    spark = SparkSession.getActiveSession()
    if isinstance(model, B.BoostedModel):
        return B.importances(model, spark)
    gbt = [s for s in model.stages if isinstance(s, GBTRegressionModel)][0]
    imp = gbt.featureImportances.toArray().tolist()
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, imp)],
                                 "name string, importance double")


def evaluate(model: Model, test: DataFrame, threshold: float = 5.0,
             name: str = "model", label: str = TARGET) -> DataFrame:
    """One metrics row for held-out rows (log and original scale, thresholded)."""
    return evaluation_report(predict(model, test), label, "prediction", threshold, name)


def node_embeddings(nodes: DataFrame, edges: DataFrame, hops: int = 3,
                    cols=("freq_z", "risk_z")) -> DataFrame:
    """idx, drug, z: own standardised features followed by the neighbour means of each
    hop, as one array per node."""
    prop = G.propagate(nodes, edges, list(cols), hops)
    parts = list(cols) + [f"h{k}_{c}" for k in range(1, hops + 1) for c in cols]
    return prop.select("idx", "drug", F.array(*[F.col(c).cast("double") for c in parts]).alias("z"))


def edge_dataset(features: DataFrame, emb: DataFrame, both_directions: bool = True) -> DataFrame:
    """drug_a, drug_b, z_a, z_b, log_max_risk for each pair (and its reverse)."""
    za = emb.select(F.col("drug").alias("drug_a"), F.col("z").alias("z_a"))
    zb = emb.select(F.col("drug").alias("drug_b"), F.col("z").alias("z_b"))
    e = features.select("drug_a", "drug_b", TARGET).join(za, "drug_a").join(zb, "drug_b")
    if both_directions:
        rev = e.select(F.col("drug_b").alias("drug_a"), F.col("drug_a").alias("drug_b"), TARGET,
                       F.col("z_b").alias("z_a"), F.col("z_a").alias("z_b"))
        e = e.unionByName(rev)
    return e.select("drug_a", "drug_b", TARGET, "z_a", "z_b")


def with_edge_vectors(df: DataFrame) -> DataFrame:
    return (df.withColumn("z_a_vec", array_to_vector("z_a"))
            .withColumn("z_b_vec", array_to_vector("z_b")))


def edge_pipeline(dim: int, params: TreeParams | None = None, label: str = TARGET) -> Pipeline:
    """Concatenate both ends' embeddings (in the given order) and regress the edge weight.
    ``dim`` is the embedding width, declared so the pipeline also applies to empty input."""
    p = params or TreeParams()
    return Pipeline(stages=[VectorSizeHint(inputCol="z_a_vec", size=dim),
                            VectorSizeHint(inputCol="z_b_vec", size=dim),
                            VectorAssembler(inputCols=["z_a_vec", "z_b_vec"], outputCol="edge_features"),
                            _gbt(p, "edge_features", label)])


def embedding_width(emb: DataFrame) -> int:
    """Width of the embedding arrays (all rows have the same width); reads one row."""
    return int(emb.select(F.size("z")).first()[0])


def fit_edge_model(features: DataFrame, emb: DataFrame, params: TreeParams | None = None,
                   train_pct: int = 80) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Both directions of a pair fall on the same side of the split (undirected hash)."""
    data = with_edge_vectors(edge_dataset(features, emb))
    train, test = hash_split(data, train_pct)
    return edge_pipeline(embedding_width(emb), params).fit(train), train, test


def graph_embeddings(features: DataFrame, hops: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, embeddings) from the pair feature table, each materialised."""
    nodes = cut_lineage(G.graph_nodes(features), "nodes")
    edges = cut_lineage(G.graph_edges(features, nodes), "edges")
    emb = cut_lineage(node_embeddings(nodes, edges, hops), "embeddings")
    return nodes, edges, emb


def write_graph_tables(features: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """Write nodes, then the edges over the stored nodes, each once; returns both as read
    back from ``base``."""
    spark = features.sparkSession
    G.graph_nodes(features).write.mode("overwrite").parquet(f"{base}/nodes")
    nodes = spark.read.parquet(f"{base}/nodes")
    G.graph_edges(features, nodes).write.mode("overwrite").parquet(f"{base}/edges")
    return nodes, spark.read.parquet(f"{base}/edges")


def save_model(model: Model, path: str) -> None:
    """Boosted trees as node rows (see ``boosting.BoostedModel``), pipelines in MLlib's format."""
    if isinstance(model, B.BoostedModel):
        model.save(SparkSession.getActiveSession(), path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str) -> Model:
    spark = SparkSession.getActiveSession()
    if path_exists(spark, f"{path}/nodes"):
        return B.BoostedModel.load(spark, path)
    return PipelineModel.load(path)
