"""Fleet dashboard questions as aggregates and column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import (ANOMALY_BAND_ELSE, ANOMALY_BANDS, DAYS_BAND_ELSE, DAYS_BANDS, NO_FAULT, RISK_BAND_ELSE,
                      RISK_BANDS, STATUS_ISSUE_CRITICAL, STATUS_ISSUE_MAINT, STATUS_ISSUE_OK, STATUS_ISSUE_OVERDUE,
                      SensorSpec)
from ..functions.scalars import first_match, half_even, template, thousands, title_words

STATUSES = ("CRITICAL", "WARNING", "OK")


def latest_state(df: DataFrame, spec: SensorSpec, cols=None) -> DataFrame:
    """H1: per machine, the last non-null value of every column in (time, record) order.
    ``max_by`` with a null ordering key for null values = pandas ``groupby.last``; partial
    aggregation keeps a hot machine from landing in one task."""
    cols = [c for c in (cols or df.columns) if c != spec.entity]
    order = F.struct(*[F.col(c) for c in spec.order_cols])
    return df.groupBy(spec.entity).agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols
    ])


def status_columns(spec: SensorSpec) -> dict:
    """H2/H3: status cascade, urgency and issue text."""
    maint = F.col(spec.label) == 1
    fault = F.col(spec.fault)
    hours = F.col(spec.counters[0])
    overdue = hours > F.lit(spec.thresholds.overdue_hours)
    critical = maint & (fault != F.lit(NO_FAULT))
    return {
        "status": first_match([(critical, "CRITICAL"), (maint, "WARNING"), (overdue, "WARNING")], "OK"),
        "urgency": first_match([(critical, 0), (maint, 1), (overdue, 1)], 2),
        "issue": first_match([
            (critical, template(STATUS_ISSUE_CRITICAL, fault=title_words(fault))),
            (maint, F.lit(STATUS_ISSUE_MAINT)),
            (overdue, template(STATUS_ISSUE_OVERDUE, hours=thousands(hours))),
        ], F.lit(STATUS_ISSUE_OK)),
    }


def fleet_status(latest: DataFrame, spec: SensorSpec) -> DataFrame:
    """H4: one row per machine, ordered by urgency then machine."""
    s = status_columns(spec)
    return latest.select(
        F.col(spec.entity).alias("well_id"),
        s["status"].alias("status"),
        s["urgency"].alias("urgency"),
        s["issue"].alias("issue"),
        title_words(spec.fault).alias("fault_type"),
        half_even(spec.pressure, 1).alias("pump_psi"),
        half_even(spec.vibration, 2).alias("vibration"),
        half_even(spec.temperature, 1).alias("temperature"),
        F.col(spec.counters[0]).cast("int").alias("hrs_since_maint"),
    ).orderBy("urgency", "well_id")


def status_counts(status: DataFrame) -> DataFrame:
    """H5/H6: counts per status, % critical, banner level."""
    n = F.count(F.lit(1))
    crit = F.sum((F.col("status") == "CRITICAL").cast("long"))
    warn = F.sum((F.col("status") == "WARNING").cast("long"))
    ok = F.sum((F.col("status") == "OK").cast("long"))
    out = status.agg(n.alias("n_wells"), crit.alias("n_critical"), warn.alias("n_warning"), ok.alias("n_ok"))
    return out.select(
        "*",
        half_even(F.col("n_critical") / F.col("n_wells") * F.lit(100.0), 1).alias("pct_critical"),
        first_match([(F.col("n_critical") > 0, "critical"), (F.col("n_warning") > 0, "warning")], "ok").alias("banner"),
    )


def filter_in(df: DataFrame, column: str, values) -> DataFrame:
    """H7 / I4: keep rows whose ``column`` is one of ``values``."""
    return df.filter(F.col(column).isin(list(values)))


def fault_distribution(df: DataFrame, spec: SensorSpec) -> DataFrame:
    """H8."""
    return (df.filter(F.col(spec.fault) != F.lit(NO_FAULT))
            .groupBy(spec.fault).agg(F.count(F.lit(1)).alias("occurrences"))
            .select(title_words(spec.fault).alias("fault_type"), "occurrences")
            .orderBy(F.desc("occurrences"), "fault_type"))


def monthly_maintenance(df: DataFrame, spec: SensorSpec) -> DataFrame:
    """H9: maintenance rows per calendar month, labelled by month end, gap months filled with 0."""
    month = F.last_day(F.col(spec.time).cast("date"))
    per_month = (df.filter(F.col(spec.label) == 1).groupBy(month.alias("month"))
                 .agg(F.sum(spec.label).cast("long").alias("events")))
    span = per_month.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    months = span.select(F.explode(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"),
                                              F.expr("interval 1 month"))).alias("m")) \
        .select(F.last_day("m").alias("month"))
    return (months.join(per_month, "month", "left")
            .select(F.date_format("month", "yyyy-MM-dd").alias("month"),
                    F.coalesce("events", F.lit(0)).cast("long").alias("events"))
            .orderBy("month"))


def well_ids(df: DataFrame, spec: SensorSpec) -> DataFrame:
    """Distinct machine ids, sorted."""
    return df.select(spec.entity).distinct().orderBy(spec.entity)


def date_span(df: DataFrame, spec: SensorSpec, default_days: int = 90) -> DataFrame:
    """H10 + H12: first/last date and the default range start (last ``default_days`` days)."""
    d = df.agg(F.min(F.col(spec.time).cast("date")).alias("min_date"),
               F.max(F.col(spec.time).cast("date")).alias("max_date"))
    return d.select(
        F.date_format("min_date", "yyyy-MM-dd").alias("min_date"),
        F.date_format("max_date", "yyyy-MM-dd").alias("max_date"),
        F.date_format(F.date_sub("max_date", default_days), "yyyy-MM-dd").alias("default_start"),
    )


def window_filter(df: DataFrame, spec: SensorSpec, start, end, wells=None, inclusive_end: bool = False) -> DataFrame:
    """Readings of ``wells`` between two dates; both ends are midnight, so the last day keeps only
    00:00 unless ``inclusive_end`` (then the whole end day)."""
    ts = F.col(spec.time)
    kind = df.schema[spec.time].dataType.simpleString()   # compare in the column's own type (no zone shift)
    lo = F.lit(start).cast("date").cast(kind) if isinstance(start, str) else start
    hi = F.lit(end).cast("date").cast(kind) if isinstance(end, str) else end
    cond = (ts >= lo) & ((ts < F.date_add(hi.cast("date"), 1).cast(kind)) if inclusive_end else (ts <= hi))
    if wells is not None:
        cond = cond & F.col(spec.entity).isin(list(wells))
    return df.filter(cond)


def well_kpis(df: DataFrame, spec: SensorSpec) -> DataFrame:
    """Per machine depth (first reading), maintenance sum, mean pressure/vibration, count, flag."""
    order = F.struct(*[F.col(c) for c in spec.order_cols])
    k = df.groupBy(spec.entity).agg(
        F.min_by(spec.depth, order).alias("depth_ft"),
        F.sum(spec.label).cast("long").alias("maintenance_events"),
        F.avg(spec.pressure).alias("avg_pressure"),
        F.avg(spec.vibration).alias("avg_vibration"),
        F.count(F.lit(1)).alias("readings"),
    )
    return k.withColumn("vibration_high", F.col("avg_vibration") > F.lit(spec.thresholds.vibration_limit))


def ranges_frame(spark: SparkSession, spec: SensorSpec) -> DataFrame:
    """The configured normal bands (size bounded by the number of sensors)."""
    return spark.createDataFrame([(s, float(lo), float(hi), lab) for s, lo, hi, lab in spec.ranges],
                                 "sensor string, lo double, hi double, label string")


def _unpivot(df: DataFrame, spec: SensorSpec, keep) -> DataFrame:
    sensors = [s for s, *_ in spec.ranges]
    return df.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(s).alias("sensor"), F.col(s).cast("double").alias("reading")) for s in sensors
    ])).alias("_u")).select(*keep, "_u.sensor", "_u.reading")


def range_check(df: DataFrame, spec: SensorSpec, spark: SparkSession) -> DataFrame:
    """Per machine and sensor, the mean reading against the normal band."""
    avgs = _unpivot(df, spec, [spec.entity]).groupBy(spec.entity, "sensor").agg(F.avg("reading").alias("avg_value"))
    r = F.broadcast(ranges_frame(spark, spec))
    j = avgs.join(r, "sensor")
    return j.select(spec.entity, "sensor", "label", "avg_value", "lo", "hi",
                    first_match([(F.col("avg_value") < F.col("lo"), "below"),
                                 (F.col("avg_value") > F.col("hi"), "above")], "within").alias("band"))


def out_of_range_counts(df: DataFrame, spec: SensorSpec, spark: SparkSession) -> DataFrame:
    """Per machine and sensor, readings below / above the band."""
    u = _unpivot(df, spec, [spec.entity]).join(F.broadcast(ranges_frame(spark, spec)), "sensor")
    return u.groupBy(spec.entity, "sensor").agg(
        F.sum((F.col("reading") < F.col("lo")).cast("long")).alias("n_below"),
        F.sum((F.col("reading") > F.col("hi")).cast("long")).alias("n_above"),
        F.count("reading").alias("n_readings"),
    )


def overlay_rows(df: DataFrame, spec: SensorSpec, flag: str, cols) -> DataFrame:
    """The rows of a series to mark (maintenance rows, anomaly rows)."""
    return df.filter(F.col(flag).cast("boolean")).select(spec.entity, spec.time_us, *cols)


def days_band(days) -> Column:
    """H19."""
    d = F.col(days) if isinstance(days, str) else days
    return first_match([(d <= F.lit(cut), band) for cut, band in DAYS_BANDS], DAYS_BAND_ELSE)


def risk_band(p) -> Column:
    c = F.col(p) if isinstance(p, str) else p
    return first_match([(c > F.lit(cut), band) for cut, band in RISK_BANDS], RISK_BAND_ELSE)


def anomaly_band(n) -> Column:
    c = F.col(n) if isinstance(n, str) else n
    return first_match([(c > F.lit(cut), band) for cut, band in ANOMALY_BANDS], ANOMALY_BAND_ELSE)


def latest_prediction(pred: DataFrame, spec: SensorSpec) -> DataFrame:
    """H18 + H19: per machine the newest prediction, anomaly count, reading count and the bands."""
    order = F.struct(*[F.col(c) for c in spec.order_cols])
    g = pred.groupBy(spec.entity).agg(
        F.max_by(F.struct("confidence_score", "days_to_failure_pred"), order).alias("_last"),
        F.sum(F.col("is_anomaly").cast("long")).alias("n_anomalies"),
        F.count(F.lit(1)).alias("n_readings"),
    )
    return g.select(
        spec.entity,
        F.col("_last.confidence_score").alias("confidence_score"),
        F.col("_last.days_to_failure_pred").alias("days_to_failure_pred"),
        "n_anomalies", "n_readings",
        days_band("_last.days_to_failure_pred").alias("days_band"),
        risk_band("_last.confidence_score").alias("risk_band"),
        anomaly_band("n_anomalies").alias("anomaly_band"),
    )
