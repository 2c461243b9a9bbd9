"""A4: the five tables of the data model as Spark schemas (+ the raw readings file)."""

from __future__ import annotations

from pyspark.sql import types as T

from ..config import SENSOR_COLS

_S, _D, _I, _L, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()

READINGS_SCHEMA = T.StructType([
    T.StructField("record_id", _L),
    T.StructField("well_id", _S),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("depth_ft", _I),
    *[T.StructField(c, _D) for c in SENSOR_COLS],
    T.StructField("hours_since_last_maintenance", _D),
    T.StructField("cumulative_operating_hours", _D),
    T.StructField("maintenance_required", _I),
    T.StructField("failure_type", _S),
    T.StructField("days_to_failure", _D),
])

READING_DATE = "reading_date"      # partition column of the stored readings

WELLS = T.StructType([
    T.StructField("well_id", _S, False),
    T.StructField("depth_ft", _I),
    T.StructField("install_date", T.DateType()),
    T.StructField("location", _S),
    T.StructField("status", _S),
])

SENSOR_READINGS = T.StructType([
    *READINGS_SCHEMA.fields,
    T.StructField("ingested_at", T.TimestampType()),
])

MAINTENANCE_EVENTS = T.StructType([
    T.StructField("well_id", _S, False),
    T.StructField("scheduled_date", T.DateType()),
    T.StructField("completed_date", T.DateType()),
    T.StructField("maintenance_type", _S),
    T.StructField("failure_type_addressed", _S),
    T.StructField("technician", _S),
    T.StructField("notes", _S),
    T.StructField("status", _S),
    T.StructField("created_at", T.TimestampType()),
])

MODEL_PREDICTIONS = T.StructType([
    T.StructField("well_id", _S, False),
    T.StructField("record_id", _L),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("predicted_failure", _I),
    T.StructField("confidence_score", _D),
    T.StructField("days_to_failure_pred", _D),
    T.StructField("anomaly_score", _D),
    T.StructField("is_anomaly", _B),
    T.StructField("predicted_at", T.TimestampType()),
    T.StructField("run_id", _S),
])

ALERTS = T.StructType([
    T.StructField("well_id", _S, False),
    T.StructField("alert_type", _S),
    T.StructField("severity", _S),
    T.StructField("message", _S),
    T.StructField("days_to_failure", _D),
    T.StructField("confidence_score", _D),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("acknowledged_at", T.TimestampType()),
    T.StructField("is_active", _B),
    T.StructField("run_id", _S),
])

# name: (schema, key, partition column)
TABLES = {
    "wells": (WELLS, ("well_id",), None),
    "sensor_readings": (T.StructType([*SENSOR_READINGS.fields, T.StructField(READING_DATE, T.DateType())]), ("record_id",), READING_DATE),
    "maintenance_events": (MAINTENANCE_EVENTS, ("well_id", "scheduled_date", "maintenance_type"), "scheduled_date"),
    "model_predictions": (MODEL_PREDICTIONS, ("run_id", "record_id"), "run_id"),
    "alerts": (ALERTS, ("run_id", "well_id"), "run_id"),
}
