"""Score a feature table: scaler → model outputs → threshold → decisions (E10), any model.

``FormulaModel`` is a fixed, transparent model (probability and raw days as column formulas, anomaly
score = mean squared z-score, i.e. reconstruction by the mean) so the whole decision chain can be
checked against SQL; the fitted ``pyspark.ml`` models in ``operators/models.py`` plug into the same chain.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SensorSpec
from ..operators import models
from ..operators.cache import keep
from ..operators.features import engineer_features, feature_columns
from ..operators.fleet import window_filter
from ..operators.impute import zero_fill
from ..operators.prepare import apply_scaler, fit_scaler, near_failure_rows, normal_rows, with_split
from ..operators.score import anomaly_threshold, decisions, reconstruction_error


@dataclass(frozen=True)
class FormulaModel:
    prob_sql: str      # same text is valid Spark SQL and DuckDB SQL
    days_sql: str


# the test fleet's fixed model
EVENTS_FORMULA = FormulaModel(prob_sql="value / (value + 40.0)",
                              days_sql="(200.0 - hours_since_last_maintenance) / 24.0")


@dataclass
class Scored:
    """A scored frame, and what scores further rows by the formula."""

    frame: DataFrame
    threshold: float
    stats: dict
    features: list
    model: FormulaModel = EVENTS_FORMULA

    def outputs(self, z: DataFrame) -> DataFrame:
        """``anomaly_score``, ``confidence_score`` and ``days_raw`` of standardised rows."""
        return _formula_outputs(z, self.features, self.model)


def _formula_outputs(z: DataFrame, feats, model: FormulaModel) -> DataFrame:
    return z.withColumns({
        "anomaly_score": reconstruction_error([c + "_z" for c in feats], [F.lit(0.0)] * len(feats)),
        "confidence_score": F.expr(model.prob_sql),
        "days_raw": F.expr(model.days_sql),
    })


def score_formula(features: DataFrame, spec: SensorSpec, model: FormulaModel = EVENTS_FORMULA,
                  fit_on: str = "train", q: float = 0.95) -> Scored:
    f = keep(with_split(features, spec))
    feats = feature_columns(f, spec)
    stats = fit_scaler(f.filter(F.col("split") == "train") if fit_on == "train" else f, feats)
    z = _formula_outputs(apply_scaler(f, stats, suffix="_z"), feats, model)
    thr = anomaly_threshold(normal_rows(z.filter(F.col("split") == "train"), spec), q=q)
    out = decisions(z, spec, thr).withColumn("threshold", F.lit(thr))
    return Scored(out, thr, stats, feats, model)


@dataclass
class FittedModels:
    """The scaler and the three fitted models of a run (A15): all that scoring needs."""

    detector: models.PcaDetector      # with its threshold
    classifier: object                # PipelineModel → probability
    regressor: object                 # PipelineModel → days
    stats: dict
    features: list

    @property
    def threshold(self) -> float:
        return self.detector.threshold

    def outputs(self, z: DataFrame) -> DataFrame:
        x = z.withColumn("anomaly_score", self.detector.reconstruction_error())
        return models.predict_days(self.regressor, models.failure_probability(self.classifier, x))

    def save(self, root: str, spark: SparkSession) -> None:
        self.detector.save(f"{root}/detector", spark)
        models.save_model(self.classifier, f"{root}/classifier")
        models.save_model(self.regressor, f"{root}/regressor")
        # last: a run that breaks off leaves no complete set
        models.save_document({"features": self.features, "stats": {c: list(v) for c, v in self.stats.items()}},
                             f"{root}/scaler", spark)

    @classmethod
    def load(cls, root: str, spark: SparkSession) -> FittedModels:
        doc = models.load_document(f"{root}/scaler", spark)
        return cls(models.PcaDetector.load(f"{root}/detector", spark), models.load_pipeline(f"{root}/classifier"),
                   models.load_pipeline(f"{root}/regressor"), {c: tuple(v) for c, v in doc["stats"].items()}, doc["features"])


def standardised(features: DataFrame, spec: SensorSpec) -> tuple[DataFrame, dict, list]:
    """Split, scaler fitted on the training rows, and the standardised columns ``<feature>_z``."""
    f = keep(with_split(features, spec))
    feats = feature_columns(f, spec)
    stats = fit_scaler(f.filter(F.col("split") == "train"), feats)
    return apply_scaler(f, stats, suffix="_z"), stats, feats


def fit_models(z: DataFrame, spec: SensorSpec, stats: dict, feats: list, classifier: str = "logistic",
               max_iter: int = 50, regressor: str = "huber") -> FittedModels:
    """E1 + E5 + E7 on the standardised training rows.  The three fits are independent jobs and are
    submitted from parallel threads, so Spark runs them concurrently."""
    zcols = [c + "_z" for c in feats]
    train = z.filter(F.col("split") == "train")
    normal = normal_rows(train, spec)

    def anomaly_model():
        det = models.fit_pca_detector(normal, zcols, models.pca_k(len(zcols)))
        det.threshold = anomaly_threshold(normal.withColumn("_pca", det.reconstruction_error()), "_pca")
        return det

    with ThreadPoolExecutor(max_workers=3) as pool:
        det = pool.submit(anomaly_model)
        clf = pool.submit(models.fit_classifier, train, zcols, spec.label, kind=classifier, max_iter=max_iter)
        reg = pool.submit(models.fit_regressor, near_failure_rows(train, spec), zcols, spec.days, kind=regressor)
        return FittedModels(det.result(), clf.result(), reg.result(), stats, feats)


def apply_models(z: DataFrame, fitted: FittedModels, spec: SensorSpec) -> DataFrame:
    """One lazy chain from standardised features to the decision columns."""
    return decisions(fitted.outputs(z), spec, fitted.threshold)


def score_new(features: DataFrame, fitted: Scored | FittedModels, spec: SensorSpec) -> DataFrame:
    """E10 on rows that no fit has seen: missing features as 0 (B5), the fitted scaler, the models, the decisions."""
    z = apply_scaler(zero_fill(features, fitted.features), fitted.stats, suffix="_z")
    return decisions(fitted.outputs(z), spec, fitted.threshold)


def score_window(clean: DataFrame, spec: SensorSpec, fitted: Scored | FittedModels, start: str, end: str, wells=None,
                 warmup: bool = False, inclusive_end: bool = False) -> DataFrame:
    """E11 + B5: score the readings of ``wells`` between two dates with what has been fitted before: anomaly score and
    flag, probability, decision and clipped days.  ``warmup=False`` computes the window features from the window's
    rows only (the first rows lose their history, as in the original's single-well scoring); ``warmup=True``
    computes them on the full history first and then filters.  Remaining feature nulls become 0."""
    if warmup:
        f = window_filter(engineer_features(clean, spec), spec, start, end, wells, inclusive_end)
    else:
        f = engineer_features(window_filter(clean, spec, start, end, wells, inclusive_end), spec)
    return score_new(f, fitted, spec)
