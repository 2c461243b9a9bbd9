"""At-risk rows, one alert per machine, severity, message, run summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ALERT_MESSAGE, ALERT_TYPE, SensorSpec
from ..functions.scalars import fixed, template


def at_risk(pred: DataFrame, spec: SensorSpec) -> DataFrame:
    """predicted failure and predicted days within the alert horizon."""
    return pred.filter((F.col("predicted_failure") == 1)
                       & (F.col("days_to_failure_pred") <= F.lit(spec.thresholds.alert_days)))


def one_per_machine(rows: DataFrame, spec: SensorSpec) -> DataFrame:
    """the row with the fewest predicted days (ties: earliest time, then record).
    ``min_by`` is an aggregate with map-side partials, so a hot machine is not one task."""
    key = F.struct("days_to_failure_pred", *[F.col(c) for c in spec.order_cols])
    picked = rows.groupBy(spec.entity).agg(
        F.min_by(F.struct("days_to_failure_pred", "confidence_score", spec.record, spec.time_us), key).alias("_a"))
    return picked.select(spec.entity, "_a.*")


def alert_rows(pred: DataFrame, spec: SensorSpec, created_at=None) -> DataFrame:
    """F3 + F4 + A7 defaults: the ``alerts`` table rows."""
    a = one_per_machine(at_risk(pred, spec), spec)
    pct = F.col("confidence_score") * F.lit(100.0)
    msg = template(ALERT_MESSAGE, well=F.col(spec.entity), days=fixed("days_to_failure_pred", 1), pct=fixed(pct, 0))
    return a.select(
        F.col(spec.entity).alias("well_id"),
        F.lit(ALERT_TYPE).alias("alert_type"),
        F.when(F.col("days_to_failure_pred") <= F.lit(spec.thresholds.critical_days), F.lit("critical"))
        .otherwise(F.lit("high")).alias("severity"),
        msg.alias("message"),
        F.col("days_to_failure_pred").alias("days_to_failure"),
        "confidence_score",
        (created_at if created_at is not None else F.current_timestamp()).alias("created_at"),
        F.lit(None).cast("timestamp").alias("acknowledged_at"),
        F.lit(True).alias("is_active"),
    )


def run_summary(pred: DataFrame, spec: SensorSpec) -> DataFrame:
    """records, predicted failures, anomalies, machines with an alert."""
    risky = (F.col("predicted_failure") == 1) & (F.col("days_to_failure_pred") <= F.lit(spec.thresholds.alert_days))
    return pred.agg(
        F.count(F.lit(1)).alias("records"),
        F.sum("predicted_failure").cast("long").alias("predicted_failures"),
        F.sum(F.col("is_anomaly").cast("long")).alias("anomalies"),
        F.count_distinct(F.when(risky, F.col(spec.entity))).alias("wells_with_alerts"),
    )
