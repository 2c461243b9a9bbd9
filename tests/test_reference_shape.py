"""The original 18-column readings file, end to end with the default nine-sensor spec."""

from pyspark.sql import functions as F

from conftest import SF001
from rigscope.config import REQUIRED_COLS, SENSOR_COLS, WELL_SPEC
from rigscope.operators import fleet, schedule
from rigscope.operators.features import engineer_features
from rigscope.operators.impute import keep_first, rolling_median_fill
from rigscope.plans.frames import events_labeled
from rigscope.plans.scoring import FormulaModel, score_formula
from rigscope.sources.readers import read_readings, with_epoch


def _write_reference_csv(spark, path):
    lab = events_labeled(spark, SF001)
    base = [850.0, 400.0, 1.0, 170.0, 2600.0, 50.0, 40.0, 450.0, 80.0]
    cols = [(F.lit(b) + F.col("value") * (i + 1)).alias(c) for i, (c, b) in enumerate(zip(SENSOR_COLS, base))]
    out = lab.select("record_id", "well_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
                     "depth_ft", *cols, "hours_since_last_maintenance", "cumulative_operating_hours",
                     "maintenance_required", "failure_type", "days_to_failure")
    out.select(*REQUIRED_COLS).coalesce(1).write.option("header", True).mode("overwrite").csv(path)
    return lab.count()


def test_reference_schema_pipeline(spark, scratch):
    n = _write_reference_csv(spark, f"{scratch}/readings_csv")
    raw = read_readings(spark, f"{scratch}/readings_csv")
    assert raw.count() == n and raw.filter(F.col("pump_pressure_psi").isNull()).count() > 0
    spec = WELL_SPEC
    df = with_epoch(raw, spec)
    clean = keep_first(rolling_median_fill(df, spec), spec.record, spec.order_cols)
    assert clean.filter(F.col("pump_pressure_psi").isNull()).count() == 0
    feats = engineer_features(clean, spec)
    latest = fleet.latest_state(clean, spec)
    st = fleet.fleet_status(latest, spec).collect()
    assert len(st) == clean.select("well_id").distinct().count()
    sched = schedule.maintenance_schedule(latest, spec, F.lit(0)).collect()
    assert {r["priority"] for r in sched} <= {"Critical", "High", "Medium", "Low"}
    s = score_formula(feats, spec, FormulaModel("1.0 / (1.0 + exp(-(vibration_mm_s - 20.0)))",
                                                "(650.0 - hours_since_last_maintenance) / 24.0"))
    assert len(s.features) == 19 and s.frame.count() == clean.count()


def test_ingestion_run_is_idempotent(spark, scratch):
    from rigscope.plans.ingest import ingest

    n = _write_reference_csv(spark, f"{scratch}/csv")
    first = ingest(spark, f"{scratch}/csv", f"{scratch}/tables")
    second = ingest(spark, f"{scratch}/csv", f"{scratch}/tables")
    assert first["rows_in"] == n and first["rows_written"] == n and second["rows_written"] == 0
    assert first["nulls_before"] > 0 and first["nulls_after"] == 0
    assert spark.read.parquet(f"{scratch}/tables/sensor_readings").count() == n
    wells = spark.read.parquet(f"{scratch}/tables/wells")
    assert wells.count() == wells.select("well_id").distinct().count()
    assert set(first["fault_counts"]) >= {"none"}
