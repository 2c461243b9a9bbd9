"""End-to-end run: readings → features → models → scores → predictions, alerts, metrics.

Readings come from a stored ``sensor_readings`` table (``plans/ingest.py`` writes it) or from the test tables. Each
stage is materialised once under ``out_root`` (``mode='reuse'`` skips stages of the same run whose input files and options
are those of their manifest, ``'overwrite'`` rebuilds them). Scaler, threshold and models are saved under ``out_root/models``; a run that skips training loads
them and fits nothing, whatever rows it scores. Predictions and alerts are written per ``run_id``, so a re-run
replaces its own rows instead of appending duplicates.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EVENTS_SPEC, WELL_SPEC, SensorSpec
from ..operators import alerts as alerts_op
from ..operators import evaluate, prepare
from ..operators.features import engineer_features
from ..operators.impute import WINDOW_ROWS, rolling_median_fill
from ..operators.models import stage
from ..operators.prepare import with_split
from ..operators.score import prediction_rows
from ..operators.sequence import lay_out, strip
from ..sources import sinks
from ..sources.readers import with_epoch
from .frames import events_features
from .scoring import FittedModels, apply_models, fit_models, score_formula, score_new, standardised


def stored_features(spark: SparkSession, table: str, spec: SensorSpec = WELL_SPEC) -> DataFrame:
    """Features of a stored readings table: its own labels and counters, sensors and counters imputed."""
    readings = with_epoch(spark.read.parquet(table), spec)
    laid = lay_out(readings, spec, 2 * (WINDOW_ROWS - 1))
    return strip(engineer_features(rolling_median_fill(laid, spec), spec))


def metrics_document(scored: DataFrame, spec: SensorSpec, features: list, threshold: float) -> dict:
    """G1-G9 of the test split in one document: both AUCs in one pass, the rest in two aggregates."""
    test = scored.filter(F.col("split") == "test")
    areas = evaluate.aucs(test, spec.label, ["anomaly_score", "confidence_score"])
    cm = evaluate.confusion(test, spec.label, "predicted_failure").first()
    mae = evaluate.mae(prepare.near_failure_rows(test, spec), spec.days, "days_to_failure_pred").first()["mae"]
    out = {
        "autoencoder_auc": round(areas["anomaly_score"], 4),
        "classifier_auc_roc": round(areas["confidence_score"], 4),
        "classifier_f1": round(2 * cm["tp"] / max(1, 2 * cm["tp"] + cm["fp"] + cm["fn"]), 4),
        "confusion_matrix": [[cm["tn"], cm["fp"]], [cm["fn"], cm["tp"]]],
        "regressor_mae_days": round(mae, 4) if mae is not None else None,
        "feature_cols": features,
        "input_dim": len(features),
        "anomaly_threshold": threshold,
    }
    if "next_failure_us" in scored.columns:
        down = evaluate.downtime_summary(evaluate.lead_times(scored, spec)).first()
        out |= {"maintenance_lead_time_days": down["mean_lead_days"], "downtime_reduction_pct": down["downtime_reduction_pct"]}
    return out


def run(spark: SparkSession, source: str, out_root: str, run_id: str, mode: str = "reuse", model: str = "fitted",
        stored: bool = False, skip_training: bool = False, classifier: str = "mlp", max_iter: int = 50) -> dict:
    """``source``: the folder of the test tables, or with ``stored`` the path of a ``sensor_readings`` table.
    ``model='fitted'`` trains the anomaly model, classifier and regressor (like the original run) or, with
    ``skip_training``, loads the ones saved before; ``'formula'`` uses the transparent formula model."""
    spec = WELL_SPEC if stored else EVENTS_SPEC
    build = (lambda: stored_features(spark, source, spec)) if stored else (lambda: events_features(spark, source))
    read = [source] if stored else [f"{source}/events.parquet"]
    feats = stage(f"{out_root}/features/{run_id}", build, mode, spark, inputs=read, settings={"spec": spec, "stored": stored})
    saved = f"{out_root}/models"
    # what the models and decisions depend on; saved models are files and count as inputs
    options = {"spec": spec, "model": model, "skip_training": skip_training, "classifier": classifier, "max_iter": max_iter}
    read_by_scores = [f"{out_root}/features/{run_id}", *([saved] if skip_training else [])]
    if model == "formula":
        s = score_formula(feats, spec)
        frame, threshold, names = s.frame, s.threshold, s.features
    elif skip_training:
        fitted = FittedModels.load(saved, spark)
        frame, threshold, names = score_new(with_split(feats, spec), fitted, spec), fitted.threshold, fitted.features
    else:
        z, stats, names = standardised(feats, spec)
        fitted = fit_models(z, spec, stats, names, classifier=classifier, max_iter=max_iter)
        fitted.save(saved, spark)
        frame, threshold = apply_models(z, fitted, spec), fitted.threshold
    scored = stage(f"{out_root}/scored/{run_id}", lambda: frame, mode, spark, inputs=read_by_scores, settings=options)

    sinks.write_run(sinks.with_defaults(prediction_rows(scored, spec), "model_predictions"),
                    f"{out_root}/model_predictions", run_id)
    sinks.write_run(alerts_op.alert_rows(scored, spec), f"{out_root}/alerts", run_id)
    metrics = metrics_document(scored, spec, names, threshold)
    sinks.write_metrics(spark, metrics, f"{out_root}/metrics")
    summary = alerts_op.run_summary(scored, spec).first().asDict()
    return {"metrics": metrics, "summary": summary}


def main(argv=None) -> None:
    """``python -m rigscope.plans.runner (--sf-dir D | --readings TABLE) --out O --run-id R [--skip-training] [--formula]``"""
    from ..session import build_session

    ap = argparse.ArgumentParser(description=__doc__)
    source = ap.add_mutually_exclusive_group(required=True)
    source.add_argument("--sf-dir", help="folder of the test tables")
    source.add_argument("--readings", help="stored sensor_readings table")
    ap.add_argument("--out", required=True)
    ap.add_argument("--run-id", required=True)
    ap.add_argument("--classifier", default="mlp", choices=["mlp", "logistic", "gbt"])
    ap.add_argument("--skip-training", action="store_true", help="load the saved scaler and models; fit nothing")
    ap.add_argument("--reuse", action="store_true", help="keep finished stages of this run")
    ap.add_argument("--formula", action="store_true", help="use the formula model instead of fitted models")
    a = ap.parse_args(argv)
    out = run(build_session(), a.readings or a.sf_dir, a.out, a.run_id, mode="reuse" if a.reuse else "overwrite",
              model="formula" if a.formula else "fitted", stored=bool(a.readings), skip_training=a.skip_training,
              classifier=a.classifier)
    print(json.dumps(out, default=str))


if __name__ == "__main__":
    main()
