"""Staged end-to-end runs, saved models, and the streaming ingestion."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from rigscope.operators import models
from rigscope.plans import runner, scoring
from rigscope.plans.ingest import ingest
from rigscope.plans.runner import run
from rigscope.sources.adapters import events_readings
from rigscope.streaming.ingest import start_ingest
from test_reference_shape import _write_reference_csv


def test_staged_run_twice_replaces_run(spark, scratch):
    first = run(spark, SF001, scratch, "r1", classifier="logistic")
    second = run(spark, SF001, scratch, "r1", classifier="logistic")          # reuses stages, replaces run r1
    preds = spark.read.parquet(f"{scratch}/model_predictions")
    n = spark.read.parquet(f"{SF001}/events.parquet").count()
    assert preds.count() == n and preds.select("run_id").distinct().count() == 1
    assert first["summary"] == second["summary"] and first["summary"]["records"] == n
    assert 0.0 <= first["metrics"]["classifier_auc_roc"] <= 1.0
    assert first["metrics"].keys() >= {"maintenance_lead_time_days", "downtime_reduction_pct", "confusion_matrix", "feature_cols"}
    alerts = spark.read.parquet(f"{scratch}/alerts")
    assert alerts.count() == first["summary"]["wells_with_alerts"]


def test_stored_readings_run_then_skip_training(spark, scratch, monkeypatch):
    """Ingested nine-sensor readings; the second run loads scaler, threshold and models, and fits nothing."""
    n = _write_reference_csv(spark, f"{scratch}/csv")
    ingest(spark, f"{scratch}/csv", f"{scratch}/tables")
    table, out = f"{scratch}/tables/sensor_readings", f"{scratch}/run"
    first = run(spark, table, out, "a", stored=True, max_iter=5)
    assert first["summary"]["records"] == n and first["metrics"]["input_dim"] == 19

    def no_fit(*args, **kw):
        raise AssertionError("a run that skips training must not fit")

    for module, name in ((models, "fit_classifier"), (models, "fit_regressor"), (models, "fit_pca_detector"),
                         (scoring, "fit_scaler"), (scoring, "anomaly_threshold"), (runner, "fit_models"), (runner, "standardised")):
        monkeypatch.setattr(module, name, no_fit)
    second = run(spark, table, out, "b", stored=True, skip_training=True)
    assert second["summary"] == first["summary"] and second["metrics"] == first["metrics"]
    preds = spark.read.parquet(f"{out}/model_predictions")
    rows = {run_id: {r.record_id: r for r in preds.filter(F.col("run_id") == run_id).collect()} for run_id in ("a", "b")}
    assert rows["a"].keys() == rows["b"].keys() and len(rows["a"]) == n
    for k, r in rows["a"].items():
        for c in ("confidence_score", "days_to_failure_pred", "anomaly_score"):
            assert rows["b"][k][c] == pytest.approx(r[c], rel=1e-12)


def test_window_of_wells_scored_by_fitted_models(spark):
    """E11 with the fitted models: all five columns for a list of wells."""
    from rigscope.config import EVENTS_SPEC
    from rigscope.plans.catalog import clean
    from rigscope.plans.frames import events_features

    z, stats, feats = scoring.standardised(events_features(spark, SF001), EVENTS_SPEC)
    fitted = scoring.fit_models(z, EVENTS_SPEC, stats, feats, max_iter=10)
    c = clean(spark, SF001)
    wells = [r[0] for r in c.select("well_id").distinct().orderBy("well_id").limit(3).collect()]
    w = scoring.score_window(c, EVENTS_SPEC, fitted, "2024-01-05", "2024-01-20", wells=wells, warmup=True)
    got = {r.record_id: r for r in w.collect()}
    full = {r.record_id: r for r in scoring.apply_models(z, fitted, EVENTS_SPEC).collect()}
    assert got and {r.well_id for r in got.values()} <= set(wells)
    for k, r in got.items():
        assert r.predicted_failure == full[k].predicted_failure and r.is_anomaly == full[k].is_anomaly
        for name in ("anomaly_score", "confidence_score", "days_to_failure_pred"):
            assert r[name] == pytest.approx(full[k][name], rel=1e-9)


def test_streaming_ingest_is_idempotent(spark, scratch):
    r = events_readings(spark, SF001).select("record_id", "well_id", "t_us", "value", "signal",
                                             F.to_date("timestamp").alias("reading_date"))
    src = f"{scratch}/incoming"
    r.write.parquet(f"{src}/b1")
    r.filter(F.col("signal") >= 50).write.mode("append").parquet(f"{src}/b1")   # redelivered rows
    q = start_ingest(spark, f"{src}/b1", f"{scratch}/table", f"{scratch}/ckpt", r.schema, partition_by="reading_date")
    q.awaitTermination(120)
    out = spark.read.parquet(f"{scratch}/table")
    assert out.count() == r.count() == out.select("record_id").distinct().count()


def test_formula_run(spark, scratch):
    out = run(spark, SF001, scratch, "f1", model="formula")
    assert out["summary"]["records"] == spark.read.parquet(f"{SF001}/events.parquet").count()
