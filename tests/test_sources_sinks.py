"""A1, A2, A4, A10/A11, A13, A14, A15 and E13."""

import pytest
from pyspark.sql import functions as F

from rigscope.config import REQUIRED_COLS
from rigscope.operators import models
from rigscope.sources import readers, sinks
from rigscope.sources.schemas import READINGS_SCHEMA


def _csv(tmp, lines):
    p = f"{tmp}/r.csv"
    with open(p, "w") as fh:
        fh.write(",".join(REQUIRED_COLS) + "\n")
        for line in lines:
            fh.write(line + "\n")
    return p


def test_csv_null_tokens_and_lowercase_none(spark, scratch):
    nine = ",".join(["1.5"] * 9)
    p = _csv(scratch, [f"1,W1,2024-01-01 00:00:00,5000,{nine},10,100,0,none,NaN",
                       f"2,W1,2024-01-01 06:00:00,5000,NA,{','.join(['NULL'] * 8)},,100,1,pump_failure,3.5"])
    df = readers.read_readings(spark, p)
    rows = {r["record_id"]: r for r in df.collect()}
    assert rows[1]["failure_type"] == "none" and rows[1]["days_to_failure"] is None
    assert rows[2]["pump_pressure_psi"] is None and rows[2]["hours_since_last_maintenance"] is None
    assert rows[2]["days_to_failure"] == 3.5 and str(df.schema["timestamp"].dataType) == "TimestampNTZType()"


def test_missing_columns_listed(spark):
    df = spark.createDataFrame([(1, "W")], "record_id long, well_id string")
    with pytest.raises(readers.MissingColumnsError, match="timestamp"):
        readers.validate_columns(df)


def test_declare_tables_idempotent(spark, scratch):
    first = sinks.declare_tables(spark, scratch)
    second = sinks.declare_tables(spark, scratch)
    assert first == second and len(first) == 5
    assert "well_id" in spark.table("alerts").columns


def test_run_overwrite_replaces_only_that_run(spark, scratch):
    path = f"{scratch}/preds"
    a = spark.createDataFrame([(1, 0.1)], "record_id long, confidence_score double")
    sinks.write_run(a, path, "r1")
    sinks.write_run(a, path, "r2")
    sinks.write_run(a.union(a), path, "r1")
    counts = {r["run_id"]: r["count"] for r in spark.read.parquet(path).groupBy("run_id").count().collect()}
    assert counts == {"r1": 2, "r2": 1}


def test_parametrised_sql(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 50.0)], "id long, v double")
    out = sinks.run_sql(spark, "SELECT id FROM t WHERE v >= :lo", views={"t": df}, args={"lo": 10.0})
    assert [r["id"] for r in out.collect()] == [2]


def test_metrics_document(spark, scratch):
    assert sinks.read_metrics(spark, f"{scratch}/absent") == {}
    m = {"classifier_auc_roc": 0.9, "confusion_matrix": [[1, 2], [3, 4]]}
    sinks.write_metrics(spark, m, f"{scratch}/m")
    assert sinks.read_metrics(spark, f"{scratch}/m") == m


def test_defaults_and_visits(spark):
    sched = spark.createDataFrame([("A", "Critical", "Pump Failure", "Jan 06, 1970"), ("B", "Low", "None", "Jan 31, 1970")],
                                  "well_id string, priority string, fault_type string, schedule_by string")
    v = sinks.visit_requests(sched).collect()
    assert len(v) == 1 and v[0]["technician"] == "Unassigned" and v[0]["notes"] == "" and v[0]["status"] == "scheduled"
    assert v[0]["failure_type_addressed"] == "pump_failure"
    w = sinks.with_defaults(spark.createDataFrame([("A", None)], "well_id string, status string"), "wells").first()
    assert w["status"] == "active"


def test_pca_detector_roundtrip(spark, scratch):
    df = spark.range(200).select(F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c"))
    det = models.fit_pca_detector(df, ["a", "b", "c"], 2)
    det.threshold = 0.5
    det.save(f"{scratch}/det", spark)
    back = models.PcaDetector.load(f"{scratch}/det", spark)
    assert back.components == det.components and back.threshold == 0.5


def test_stage_reuse(spark, scratch):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert models.stage(f"{scratch}/s", build).count() == 3
    assert models.stage(f"{scratch}/s", build).count() == 3
    assert len(calls) == 1
    models.stage(f"{scratch}/s", build, mode="overwrite")
    assert len(calls) == 2


def test_schema_has_required(spark):
    assert [f.name for f in READINGS_SCHEMA.fields] == list(REQUIRED_COLS)


def test_pipeline_model_save_load(spark, scratch):
    df = spark.range(200).select((F.col("id") / 20.0).alias("x"), F.rand(4).alias("n"))
    df = df.withColumn("y", F.col("x") * 2 - 1)
    m = models.fit_regressor(df, ["x", "n"], "y")
    models.save_model(m, f"{scratch}/reg")
    back = models.load_pipeline(f"{scratch}/reg")
    a = [r["days_raw"] for r in models.predict_days(m, df).orderBy("x").collect()]
    b = [r["days_raw"] for r in models.predict_days(back, df).orderBy("x").collect()]
    assert a == b
