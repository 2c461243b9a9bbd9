"""Fitted models on ``pyspark.ml``.

* anomaly model: PCA with ``k`` components fitted on normal rows — the linear
  autoencoder.  ``x̂ = μ + P Pᵀ (x − μ)``; the score is mean((x − x̂)²).  Scoring
  is a fixed linear map, so it is written as column expressions (JVM, codegen).
* failure classifier: ``MultilayerPerceptronClassifier`` (no ``weightCol``) on
  rows replicated for class balance, or ``LogisticRegression``/``GBTClassifier`` with weights.
* days regressor: ``LinearRegression(loss="huber")`` or ``GBTRegressor`` on near-failure rows.
* any dense network's weights: an iterator ``pandas_udf`` with broadcast numpy
  matrices (Arrow batches).
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import networks
from .features import assembler
from .impute import zero_fill


# ------------------------------------------------------------------ E1 / E2: PCA reconstruction
@dataclass
class PcaDetector:
    cols: list          # input columns (already standardised)
    mean: list          # μ over the fitting rows
    components: list    # d × k
    threshold: float | None = None

    def reconstruction_error(self) -> Column:
        P = np.asarray(self.components)
        d, k = P.shape
        centred = [F.col(c) - F.lit(float(m)) for c, m in zip(self.cols, self.mean)]
        proj = [reduce(lambda a, b: a + b, [centred[i] * F.lit(float(P[i, j])) for i in range(d)]) for j in range(k)]
        terms = []
        for i in range(d):
            xhat_c = reduce(lambda a, b: a + b, [proj[j] * F.lit(float(P[i, j])) for j in range(k)])
            terms.append((centred[i] - xhat_c) ** 2)
        return reduce(lambda a, b: a + b, terms) / F.lit(float(d))

    def save(self, path: str, spark: SparkSession) -> None:
        """One-row JSON document (components, mean, threshold)."""
        save_document({"cols": self.cols, "mean": self.mean, "components": self.components,
                       "threshold": self.threshold}, path, spark)

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> "PcaDetector":
        doc = load_document(path, spark)
        return cls(doc["cols"], doc["mean"], doc["components"], doc["threshold"])


def fit_pca_detector(normal: DataFrame, cols, k: int) -> PcaDetector:
    """Distributed covariance (``ml.feature.PCA``) on the normal rows; μ from one aggregate."""
    from pyspark.ml.feature import PCA

    cols = list(cols)
    normal = normal.na.drop(subset=cols)
    mean_row = normal.agg(*[F.avg(c).alias(c) for c in cols]).first()
    mean = [float(mean_row[c]) for c in cols]
    vec = assembler(cols, "_x").transform(normal.select(*cols))
    model = PCA(k=k, inputCol="_x", outputCol="_pc").fit(vec)
    return PcaDetector(cols, mean, model.pc.toArray().tolist())


# ------------------------------------------------------------------ E5 / E6: failure classifier
FIT_ROWS = 200_000     # labelled rows that the network is fitted on at most (a sample by hash beyond that)


def class_counts(df: DataFrame, label: str) -> dict:
    return {r[0]: r[1] for r in df.groupBy(label).count().collect() if r[0] is not None}


def balanced_replicas(df: DataFrame, label: str, counts: dict | None = None, share: Column | None = None) -> DataFrame:
    """Class balance without ``weightCol``: each minority row comes n_major / n_minor times, the fraction by a
    share of the rows (``explode(sequence)``, no shuffle); the counts come from one tiny aggregate.
    ``share``: a number in [0, 1) for each row, by default a hash of the whole row."""
    counts = counts or class_counts(df, label)
    if len(counts) < 2:
        return df
    if share is None:
        share = F.pmod(F.xxhash64(*df.columns), F.lit(1 << 30)) / F.lit(float(1 << 30))
    major = max(counts.values())
    ratio = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(major / n))])[F.col(label)]
    times = F.floor(ratio).cast("int") + (share < ratio - F.floor(ratio)).cast("int")
    return df.withColumn("_r", F.explode(F.sequence(F.lit(1), times))).drop("_r")


def fit_classifier(train: DataFrame, cols, label: str, kind: str = "mlp", hidden=(128, 64, 32),
                   max_iter: int = 60, seed: int = 42, max_rows: int | None = FIT_ROWS):
    """E5: returns a fitted ``PipelineModel`` producing ``probability``. Rows with a missing feature or label are left
    out of the fit.  ``max_rows`` bounds the rows that the network (``mlp``) is fitted on, which repeats and
    iterates over them (None: all rows); the other kinds take all rows with class weights."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier

    cols = list(cols)
    data = train.withColumn("_y", F.col(label).cast("double")).na.drop(subset=[*cols, "_y"])
    counts = class_counts(data, "_y")
    if kind == "mlp":
        share = F.pmod(F.xxhash64("_y", *cols), F.lit(1 << 30)) / F.lit(float(1 << 30))
        part = 1.0 if max_rows is None else min(1.0, max_rows / max(1, sum(counts.values())))
        if part < 1.0:
            # row by row: by a hash of their values, equal rows would all be kept or all be lost;
            # the share of a kept row is uniform again once divided by the kept part
            data = data.withColumn("_share", F.rand(seed)).filter(F.col("_share") < F.lit(part))
            share = F.col("_share") / F.lit(part)
        data = balanced_replicas(data, "_y", counts, share)
        est = MultilayerPerceptronClassifier(featuresCol="_x", labelCol="_y", layers=[len(cols), *hidden, 2],
                                             maxIter=max_iter, seed=seed, blockSize=256)
    else:
        tot, k = sum(counts.values()), len(counts)
        wmap = F.create_map(*[x for c, v in counts.items() for x in (F.lit(c), F.lit(tot / (k * v)))])
        data = data.withColumn("_w", wmap[F.col("_y")])
        est = (LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=max_iter)
               if kind == "logistic" else
               GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=max_iter, seed=seed))
    return Pipeline(stages=[assembler(cols, "_x"), est]).fit(data)


def failure_probability(model, df: DataFrame, out: str = "confidence_score") -> DataFrame:
    """Probability of class 1; missing features count as 0."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(zero_fill(df, model.stages[0].getInputCols()))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability",
                                                                            "prediction")


# ------------------------------------------------------------------ E7: days regressor
def fit_regressor(near: DataFrame, cols, target: str, max_iter: int = 100, kind: str = "huber", seed: int = 42):
    """``huber`` is linear with Spark's Huber loss (the scale is fitted, errors beyond 1.35 scales count linearly;
    the original loss has a fixed delta of 1); ``gbt`` are boosted trees, ``max_iter`` of them."""
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    cols = list(cols)
    est = (LinearRegression(featuresCol="_x", labelCol=target, loss="huber", maxIter=max_iter, regParam=0.0)
           if kind == "huber" else GBTRegressor(featuresCol="_x", labelCol=target, maxIter=max_iter, seed=seed))
    return Pipeline(stages=[assembler(cols, "_x"), est]).fit(near.na.drop(subset=[*cols, target]))


def predict_days(model, df: DataFrame, out: str = "days_raw") -> DataFrame:
    """Missing features count as 0."""
    return model.transform(zero_fill(df, model.stages[0].getInputCols())).withColumnRenamed("prediction", out).drop("_x")


# ------------------------------------------------------------------ E12: any dense network
def mlp_layers(mlp_model) -> list:
    """(W, b) per layer from a fitted ``MultilayerPerceptronClassificationModel``."""
    sizes = list(mlp_model.getLayers())
    flat = mlp_model.weights.toArray()
    out, pos = [], 0
    for n_in, n_out in zip(sizes[:-1], sizes[1:]):
        W = flat[pos:pos + n_in * n_out].reshape((n_out, n_in), order="F").T
        pos += n_in * n_out
        b = flat[pos:pos + n_out]
        pos += n_out
        out.append((W, b))
    return out


def dense_forward(df: DataFrame, cols, layers, activations, out: str = "nn_out", output_index: int = -1) -> DataFrame:
    """Score ``df`` with weights ``layers`` = [(W (in×out), b)], ``activations`` per layer in
    {relu, tanh, sigmoid, softmax, identity}; Arrow batches, weights broadcast once per executor.
    Missing inputs count as 0 (B5)."""
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast([(np.asarray(W, float), np.asarray(b, float)) for W, b in layers])
    acts = list(activations)

    @F.pandas_udf("double")
    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        weights = bc.value
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            for (W, b), act in zip(weights, acts):
                x = x @ W + b
                if act == "relu":
                    x = np.maximum(x, 0.0)
                elif act == "tanh":
                    x = np.tanh(x)
                elif act == "sigmoid":
                    x = 1.0 / (1.0 + np.exp(-x))
                elif act == "softmax":
                    e = np.exp(x - x.max(axis=1, keepdims=True))
                    x = e / e.sum(axis=1, keepdims=True)
            yield pd.Series(x[:, output_index])

    inputs = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(cols)]
    return df.withColumn(out, forward(F.struct(*inputs)))


# ------------------------------------------------------------------ E1 / E5 / E7 as networks
def fit_bottleneck(normal: DataFrame, cols, hidden=(64, 32, 8, 32, 64), epochs: int = 40, **options) -> networks.Fitted:
    """The non-linear autoencoder, fitted on normal rows."""
    shape = networks.Shape((len(cols), *hidden, len(cols)), "reconstruction")
    return networks.fit(networks.to_blocks(normal, cols, cols), shape, epochs, **options)


def fit_network_classifier(train: DataFrame, cols, label: str, hidden=(128, 64, 32), epochs: int = 40,
                           **options) -> networks.Fitted:
    """E5: cross entropy, every class with the same sum of weights."""
    data = train.na.drop(subset=[*cols, label])
    counts = class_counts(data, label)
    weights = F.create_map(*[F.lit(v) for c, n in counts.items() for v in (c, sum(counts.values()) / (len(counts) * n))])
    blocks = networks.to_blocks(data, cols, [label], weights[F.col(label)])
    return networks.fit(blocks, networks.Shape((len(cols), *hidden, 1), "binary"), epochs, **options)


def fit_network_regressor(near: DataFrame, cols, target: str, hidden=(64, 32), epochs: int = 40, **options) -> networks.Fitted:
    """The loss with a fixed delta of 1."""
    return networks.fit(networks.to_blocks(near, cols, [target]), networks.Shape((len(cols), *hidden, 1), "huber"), epochs, **options)


def network_probability(df: DataFrame, cols, fitted: networks.Fitted, out: str) -> DataFrame:
    """The network's output of every row: probability or days. Missing features count as 0."""
    return dense_forward(df, cols, fitted.layers, fitted.activations, out)


def network_error(df: DataFrame, cols, fitted: networks.Fitted, out: str) -> DataFrame:
    """Mean squared difference of the inputs and their reconstruction (Arrow batches)."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(fitted.layers)
    shape = fitted.shape

    @F.pandas_udf("double")
    def error(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        flat = np.concatenate([v.ravel() for layer in shared.value for v in layer])
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            yield pd.Series(networks.row_losses(shape, flat, x, x))

    inputs = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(cols)]
    return df.withColumn(out, error(F.struct(*inputs)))


# ------------------------------------------------------------------ A15 / E13: persistence, staged runs
def save_document(doc: dict, path: str, spark: SparkSession) -> None:
    spark.createDataFrame([(json.dumps(doc),)], "doc string").coalesce(1).write.mode("overwrite").text(path)


def load_document(path: str, spark: SparkSession) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def input_state(spark: SparkSession, path: str) -> str:
    """Number, size and a hash of the names, sizes and times of the files below ``path``. Spark lists them as a table of
    files, whose content is not read, so any number of files comes back as one row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    row = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
                    F.coalesce(F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.lit(0)).alias("hash")).first()
    return f"{row['n']} files, {row['bytes']} bytes, {row['hash'] & (1 << 64) - 1:016x}"


def stage_manifest(spark: SparkSession, inputs=(), settings=None) -> dict:
    """What a stage's result depends on: the state of its input files, and its settings (models among them) as text."""
    return {"inputs": {p: input_state(spark, p) for p in inputs}, "settings": json.dumps(settings, sort_keys=True, default=repr)}


def stage_is_current(spark: SparkSession, path: str, manifest: dict) -> bool:
    """Whether the stage at ``path`` is complete and was built from what ``manifest`` says."""
    from ..sources.sinks import path_exists

    kept = f"{path}/_manifest"
    return (path_exists(spark, f"{path}/_SUCCESS") and path_exists(spark, f"{kept}/_SUCCESS")
            and load_document(kept, spark) == manifest)


def stage(path: str, build, mode: str = "reuse", spark: SparkSession | None = None, inputs=(), settings=None):
    """Materialise a stage's DataFrame as Parquet once, with a manifest beside it. It is built again when an input file,
    a setting or the list of either has changed since, when a run broke off before the manifest was written,
    and always with ``mode='overwrite'``."""
    spark = spark or SparkSession.getActiveSession()
    manifest = stage_manifest(spark, inputs, settings)
    if mode != "reuse" or not stage_is_current(spark, path, manifest):
        build().write.mode("overwrite").parquet(path)
        save_document(manifest, f"{path}/_manifest", spark)
    return spark.read.parquet(path)


def pca_k(d: int) -> int:
    """Bottleneck size: 8 like the original network, fewer for narrow inputs."""
    return max(1, min(8, d - 1))
