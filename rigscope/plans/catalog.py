"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None, survey ids).

Every builder takes ``(spark, sf_dir)`` and reads the supplied tables whole.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import (ANOMALY_BAND_ELSE, ANOMALY_BANDS, DAYS_BAND_ELSE, DAYS_BANDS, EVENTS_SPEC, LINEITEM_SPEC, REQUIRED_COLS,
                      RISK_BAND_ELSE, RISK_BANDS, SENSOR_COLS)
from ..functions.scalars import r6
from ..operators import alerts as alerts_op
from ..operators import evaluate, fleet, maintained, models, networks, prepare, schedule
from ..operators.cache import keep, release
from ..operators.features import assemble, rolling_median
from ..operators.impute import keep_first, rolling_median_fill
from ..operators.score import anomaly_threshold, prediction_rows
from ..operators.sequence import HELPERS, Layout, strip
from ..sources import sinks, store
from ..sources.adapters import events_readings, lineitem_readings, read_table
from ..sources.readers import read_readings, with_epoch
from ..sources.schemas import READING_DATE, SENSOR_READINGS
from . import oracle_sql as sql
from .frames import events_features, events_labeled, featurized, labeled
from .frames import lineitem_features as _lineitem_features
from .scoring import EVENTS_FORMULA, apply_models, fit_models, score_formula, score_window, standardised

SPEC = EVENTS_SPEC
DAY_US = 86_400_000_000
AS_OF_DAYS_BACK = 5   # of ``fleet_status_as_of`` and the stored rows of ``idempotent_append``, whose feature it is

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None, str]] = {}


def register(name: str, oracle: str | None, ids: str):
    def deco(fn):
        @functools.wraps(fn)
        def build(spark, sf_dir):
            release()          # what the query before kept; a frame that is still read is computed anew
            return fn(spark, sf_dir)

        REGISTRY[name] = (build, oracle, ids)
        return fn
    return deco


# ---------------------------------------------------------------- shared frames
def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labeled readings with sensors and counters imputed (the dashboard's frame)."""
    laid = labeled(events_readings(spark, sf_dir), SPEC)
    return strip(rolling_median_fill(laid, SPEC, complete=SPEC.counters))


def newest_us(spark: SparkSession, sf_dir: str) -> int:
    """Time of the newest reading: one column of the raw scan."""
    return events_readings(spark, sf_dir).agg(F.max(SPEC.time_us)).first()[0]


def clean_as_of(spark: SparkSession, sf_dir: str, days_back: int = AS_OF_DAYS_BACK) -> DataFrame:
    """``clean`` of the readings up to ``days_back`` days before the newest one, labels by what came later. A prefix
    of each machine's rows keeps their positions, so labels and imputation share one layout."""
    cut = newest_us(spark, sf_dir) - days_back * DAY_US
    laid = labeled(events_readings(spark, sf_dir), SPEC).filter(F.col(SPEC.time_us) <= F.lit(cut))
    return strip(rolling_median_fill(laid, SPEC, complete=SPEC.counters))


def _latest(df: DataFrame) -> DataFrame:
    return fleet.latest_state(df, SPEC)


SQL_CLEAN = sql.with_ctes(sql.events_readings(), sql.labeled(), sql.imputed(SPEC.impute_cols, "labeled", "clean"))
SQL_ASOF = sql.with_ctes(
    sql.events_readings(), sql.labeled(),
    f"asof_rows AS (SELECT * FROM labeled WHERE t_us <= (SELECT max(t_us) FROM labeled) - {AS_OF_DAYS_BACK} * {DAY_US})",
    sql.imputed(SPEC.impute_cols, "asof_rows", "clean"))
LATEST_COLS = ["record_id", "t_us", "depth_ft", "value", "signal", "failure_type", "days_to_failure",
               "maintenance_required", "hours_since_last_maintenance", "cumulative_operating_hours"]


def _sql_latest(base: str) -> str:
    return base.rstrip("\n") + ",\n" + sql.latest(LATEST_COLS, "clean") + "\n"


# ---------------------------------------------------------------- A: sources
@register("readings_from_events", sql.with_ctes(sql.events_readings()) + """
SELECT record_id, well_id, t_us, depth_ft, value, signal, failure_type FROM readings""", "A1 A9")
def readings_from_events(spark, d):
    r = events_readings(spark, d)
    return r.select("record_id", "well_id", "t_us", "depth_ft", "value", "signal", "failure_type")


_CSV_SENSORS = ", ".join(f"{i + 1}.5 + value * {i + 1} AS {c}" for i, c in enumerate(SENSOR_COLS))


@register("readings_from_csv", sql.events_chain("labeled") + f"""
SELECT record_id, well_id, t_us, depth_ft, {', '.join(sql.r6(c) + f' AS {c}' for c in SENSOR_COLS)}, maintenance_required, failure_type,
       days_to_failure FROM (SELECT *, {_CSV_SENSORS} FROM labeled)""", "A1 A2")
def readings_from_csv(spark, d):
    """The nine-sensor readings file: written as CSV text from the whole table, then read, checked and cast."""
    path = sinks.scratch_path(spark, "readings-csv")
    rows = events_labeled(spark, d).selectExpr("*", *_CSV_SENSORS.split(", "))
    rows = rows.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    rows.select(*REQUIRED_COLS).write.option("header", True).csv(path)
    back = with_epoch(read_readings(spark, path), SPEC)
    return back.select("record_id", "well_id", "t_us", "depth_ft", *[r6(c).alias(c) for c in SENSOR_COLS], "maintenance_required",
                       "failure_type", "days_to_failure")


# ---------------------------------------------------------------- C11/C12: labels
@register("failure_labels", sql.events_chain("labeled") + f"""
SELECT record_id, well_id, t_us, failure_type, days_to_failure, maintenance_required,
       hours_since_last_maintenance, cumulative_operating_hours
FROM labeled""", "C11 C12 C1")
def failure_labels(spark, d):
    x = events_labeled(spark, d)
    # one IEEE division of equal integers in both engines: exact, so left unrounded
    return x.select("record_id", "well_id", "t_us", "failure_type", "days_to_failure", "maintenance_required",
                    "hours_since_last_maintenance", "cumulative_operating_hours")


# ---------------------------------------------------------------- B: cleaning
@register("rolling_median_impute", sql.with_ctes(sql.events_readings(),
                                                  sql.imputed(["value", "signal"], "readings", "imputed")) + f"""
SELECT i.record_id, i.well_id, r.value AS raw_value, {sql.r6('i.value')} AS value, {sql.r6('i.signal')} AS signal
FROM imputed i JOIN readings r USING (record_id)""", "B1 B2 B6")
def rolling_median_impute(spark, d):
    raw = events_readings(spark, d).withColumn("raw_value", F.col("value"))
    imp = rolling_median_fill(raw, SPEC, cols=["value", "signal"])
    return imp.select("record_id", "well_id", "raw_value", r6("value").alias("value"), r6("signal").alias("signal"))


# ---------------------------------------------------------------- C: window features
ENG = ["pressure_rolling_mean", "pressure_rolling_std", "vibration_rolling_max", "temp_rolling_mean",
       "pressure_change_rate", "vibration_trend", "maintenance_age_ratio"]


@register("window_features", sql.events_chain("features") + "SELECT record_id, well_id, t_us, "
          + ", ".join(f"{sql.r6(c)} AS {c}" for c in ["value", "signal", *ENG]) + " FROM features",
          "C1 C2 C3 C4 C5 C6 C7 C8 C9")
def window_features(spark, d):
    f = events_features(spark, d)
    return f.select("record_id", "well_id", "t_us", *[r6(c).alias(c) for c in ["value", "signal", *ENG]])


# ---------------------------------------------------------------- H: fleet
def _latest_out(df: DataFrame) -> DataFrame:
    return df.select("well_id", "record_id", "t_us", "depth_ft", r6("value").alias("value"),
                     r6("signal").alias("signal"), "failure_type", "days_to_failure", "maintenance_required",
                     "hours_since_last_maintenance", "cumulative_operating_hours")


SQL_LATEST_OUT = ("SELECT well_id, record_id, t_us, depth_ft, " + sql.r6("value") + " AS value, "
                  + sql.r6("signal") + " AS signal, failure_type, days_to_failure, maintenance_required, "
                  + "hours_since_last_maintenance, cumulative_operating_hours FROM latest")


@register("latest_state", _sql_latest(SQL_CLEAN) + SQL_LATEST_OUT, "H1")
def latest_state(spark, d):
    return _latest_out(_latest(clean(spark, d)))


@register("fleet_status", _sql_latest(SQL_CLEAN) + sql.status_select() + " FROM latest", "H2 H3 H4")
def fleet_status(spark, d):
    return fleet.fleet_status(_latest(clean(spark, d)), SPEC)


@register("fleet_status_as_of", _sql_latest(SQL_ASOF) + sql.status_select() + " FROM latest", "H2 H3 H4")
def fleet_status_as_of(spark, d):
    return fleet.fleet_status(_latest(clean_as_of(spark, d)), SPEC)


_SQL_COUNTS = """, s AS ({status})
SELECT count(*) AS n_wells,
  CAST(sum(CASE WHEN status = 'CRITICAL' THEN 1 ELSE 0 END) AS BIGINT) AS n_critical,
  CAST(sum(CASE WHEN status = 'WARNING' THEN 1 ELSE 0 END) AS BIGINT) AS n_warning,
  CAST(sum(CASE WHEN status = 'OK' THEN 1 ELSE 0 END) AS BIGINT) AS n_ok,
  {pct} AS pct_critical,
  CASE WHEN sum(CASE WHEN status = 'CRITICAL' THEN 1 ELSE 0 END) > 0 THEN 'critical'
       WHEN sum(CASE WHEN status = 'WARNING' THEN 1 ELSE 0 END) > 0 THEN 'warning' ELSE 'ok' END AS banner
FROM s""".format(status=sql.status_select() + " FROM latest",
                 pct=sql.half_even("CAST(sum(CASE WHEN status = 'CRITICAL' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) * 100.0", 1))


@register("status_counts", _sql_latest(SQL_CLEAN).rstrip("\n") + _SQL_COUNTS, "H5 H6")
def status_counts(spark, d):
    return fleet.status_counts(fleet_status(spark, d))


@register("status_filter", _sql_latest(SQL_CLEAN).rstrip("\n") + ", s AS (" + sql.status_select()
          + " FROM latest) SELECT * FROM s WHERE status IN ('CRITICAL', 'WARNING')", "H7")
def status_filter(spark, d):
    return fleet.filter_in(fleet_status(spark, d), "status", ["CRITICAL", "WARNING"])


@register("fault_distribution", SQL_CLEAN + f"""
SELECT {sql.title('failure_type')} AS fault_type, count(*) AS occurrences
FROM clean WHERE failure_type <> 'none' GROUP BY failure_type""", "H8 A3")
def fault_distribution(spark, d):
    return fleet.fault_distribution(events_readings(spark, d), SPEC)      # imputation touches no fault


@register("monthly_maintenance", SQL_CLEAN.rstrip("\n") + """,
per_month AS (SELECT last_day(CAST("timestamp" AS DATE)) AS month, CAST(sum(maintenance_required) AS BIGINT) AS events
              FROM clean WHERE maintenance_required = 1 GROUP BY 1),
months AS (SELECT last_day(CAST(m AS DATE)) AS month FROM (SELECT unnest(generate_series(
              date_trunc('month', min(month)), date_trunc('month', max(month)), INTERVAL 1 MONTH)) AS m FROM per_month))
SELECT strftime(months.month, '%Y-%m-%d') AS month, COALESCE(events, 0) AS events
FROM months LEFT JOIN per_month USING (month)""", "H9")
def monthly_maintenance(spark, d):
    return fleet.monthly_maintenance(events_labeled(spark, d), SPEC)


@register("well_ids", sql.events_chain("labeled") + "SELECT DISTINCT well_id FROM readings", "H10")
def well_ids(spark, d):
    return fleet.well_ids(events_readings(spark, d), SPEC)


@register("date_span", sql.events_chain("labeled") + """
SELECT strftime(min(CAST("timestamp" AS DATE)), '%Y-%m-%d') AS min_date,
       strftime(max(CAST("timestamp" AS DATE)), '%Y-%m-%d') AS max_date,
       strftime(max(CAST("timestamp" AS DATE)) - INTERVAL 90 DAY, '%Y-%m-%d') AS default_start
FROM readings""", "H10 H12")
def date_span(spark, d):
    return fleet.date_span(events_readings(spark, d), SPEC)


_WINDOW_DAYS = 90     # the default range of a date window, as ``date_span`` gives it


@register("window_filter", SQL_CLEAN + f"""
SELECT well_id, record_id, t_us, {sql.r6('value')} AS value FROM clean
WHERE "timestamp" >= CAST(CAST((SELECT max("timestamp") FROM clean) AS DATE) - INTERVAL {_WINDOW_DAYS} DAY AS TIMESTAMP)
  AND "timestamp" <= CAST(CAST((SELECT max("timestamp") FROM clean) AS DATE) AS TIMESTAMP)""", "H11")
def window_filter(spark, d):
    c = clean(spark, d)
    end = c.agg(F.max(F.col(SPEC.time).cast("date"))).first()[0]
    import datetime as _dt
    start = end - _dt.timedelta(days=_WINDOW_DAYS)
    out = fleet.window_filter(c, SPEC, start.isoformat(), end.isoformat())
    return out.select("well_id", "record_id", "t_us", r6("value").alias("value"))


@register("well_kpis", SQL_CLEAN.rstrip("\n") + f""",
n AS (SELECT *, row_number() OVER ({sql.ORDER}) AS _rn FROM clean)
SELECT well_id, arg_min(depth_ft, _rn) AS depth_ft, CAST(sum(maintenance_required) AS BIGINT) AS maintenance_events,
       {sql.r6('avg(value)')} AS avg_pressure, {sql.r6('avg(signal)')} AS avg_vibration, count(*) AS readings,
       avg(signal) > {SPEC.thresholds.vibration_limit} AS vibration_high
FROM n GROUP BY well_id""", "H13 H14")
def well_kpis(spark, d):
    k = fleet.well_kpis(clean(spark, d), SPEC)
    return k.select("well_id", "depth_ft", "maintenance_events", r6("avg_pressure").alias("avg_pressure"),
                    r6("avg_vibration").alias("avg_vibration"), "readings", "vibration_high")


def _ranges_sql() -> str:
    rows = ", ".join(f"('{s}', CAST({float(lo)} AS DOUBLE), CAST({float(hi)} AS DOUBLE), '{lab}')"
                     for s, lo, hi, lab in SPEC.ranges)
    return f"ranges AS (SELECT * FROM (VALUES {rows}) AS t(sensor, lo, hi, label))"


def _unpivot_sql(src: str) -> str:
    parts = " UNION ALL ".join(f"SELECT well_id, '{s}' AS sensor, CAST({s} AS DOUBLE) AS reading FROM {src}"
                              for s, *_ in SPEC.ranges)
    return f"u AS ({parts})"


@register("range_check", SQL_CLEAN.rstrip("\n") + ",\n" + _ranges_sql() + ",\n" + _unpivot_sql("clean") + f""",
a AS (SELECT well_id, sensor, avg(reading) AS avg_value FROM u GROUP BY well_id, sensor)
SELECT well_id, sensor, label, {sql.r6('avg_value')} AS avg_value, lo, hi,
  CASE WHEN avg_value < lo THEN 'below' WHEN avg_value > hi THEN 'above' ELSE 'within' END AS band
FROM a JOIN ranges USING (sensor)""", "H15")
def range_check(spark, d):
    r = fleet.range_check(clean(spark, d), SPEC, spark)
    return r.select("well_id", "sensor", "label", r6("avg_value").alias("avg_value"), "lo", "hi", "band")


@register("out_of_range_counts", SQL_CLEAN.rstrip("\n") + ",\n" + _ranges_sql() + ",\n" + _unpivot_sql("clean") + """
SELECT well_id, sensor, CAST(sum(CASE WHEN reading < lo THEN 1 ELSE 0 END) AS BIGINT) AS n_below,
       CAST(sum(CASE WHEN reading > hi THEN 1 ELSE 0 END) AS BIGINT) AS n_above, count(reading) AS n_readings
FROM u JOIN ranges USING (sensor) GROUP BY well_id, sensor""", "H16")
def out_of_range_counts(spark, d):
    return fleet.out_of_range_counts(clean(spark, d), SPEC, spark)


@register("maintenance_overlay", SQL_CLEAN + f"""
SELECT well_id, t_us, {sql.r6('value')} AS value FROM clean WHERE maintenance_required = 1""", "H17")
def maintenance_overlay(spark, d):
    o = fleet.overlay_rows(clean(spark, d), SPEC, "maintenance_required", ["value"])
    return o.select("well_id", "t_us", r6("value").alias("value"))


# ---------------------------------------------------------------- I: scheduler
def _schedule(spark, d):
    return schedule.maintenance_schedule(_latest(clean(spark, d)), SPEC, F.lit(newest_us(spark, d)))


_SQL_SCHED = (_sql_latest(SQL_CLEAN).rstrip("\n") + ",\nnowv AS (SELECT max(t_us) AS _now FROM labeled),\n"
              + "sched AS (" + sql.priority_select() + " FROM latest, nowv)\n")


@register("maintenance_schedule", _SQL_SCHED + "SELECT * FROM sched", "I1 I2 I3 I4")
def maintenance_schedule(spark, d):
    return _schedule(spark, d).drop("schedule_date")


@register("priority_counts", _SQL_SCHED + """, names AS (SELECT * FROM (VALUES ('Critical', 0), ('High', 1),
  ('Medium', 2), ('Low', 3)) AS t(priority, priority_order))
SELECT priority, priority_order, CAST(COALESCE(n, 0) AS BIGINT) AS n_wells
FROM names LEFT JOIN (SELECT priority, count(*) AS n FROM sched GROUP BY priority) USING (priority)""", "I5")
def priority_counts(spark, d):
    return schedule.priority_counts(_schedule(spark, d), spark)


@register("workload", _SQL_SCHED + """
SELECT strftime(strptime(schedule_by, '%b %d, %Y'), '%Y-%m-%d') AS date, count(*) AS wells_due
FROM sched WHERE days_remaining <= 30 GROUP BY 1""", "I6")
def workload(spark, d):
    return schedule.workload(_schedule(spark, d), SPEC)


# ---------------------------------------------------------------- D/E/F/G: scoring chain (formula model)

FEATS = list(SPEC.features)


def scored(spark, d):
    return score_formula(events_features(spark, d), SPEC, EVENTS_FORMULA)


def _sql_scored(*extra: str) -> str:
    base = [sql.events_readings(), sql.labeled(), sql.imputed(SPEC.impute_cols), sql.features()]
    return sql.with_ctes(*base, *sql.scoring(FEATS, EVENTS_FORMULA.prob_sql, EVENTS_FORMULA.days_sql), *extra)


TEST = "split = 'test'"


@register("standardize", _sql_scored() + "SELECT record_id, split, "
          + ", ".join(f"{sql.r6(c + '_z')} AS {c}_z" for c in FEATS) + " FROM decided", "D1 D2 D3")
def standardize(spark, d):
    s = scored(spark, d).frame
    return s.select("record_id", "split", *[r6(c + "_z").alias(c + "_z") for c in FEATS])


@register("split_report", _sql_scored() + f"""
SELECT split, count(*) AS n_rows, {sql.r6('avg(CAST(maintenance_required AS DOUBLE))')} AS positive_rate
FROM decided GROUP BY split""", "D3 D4")
def split_report(spark, d):
    r = prepare.split_report(prepare.with_split(events_labeled(spark, d), SPEC), SPEC)
    return r.select("split", "n_rows", r6("positive_rate").alias("positive_rate"))


@register("stratified_split", sql.events_chain("labeled") + """
, ranked AS (SELECT record_id, maintenance_required, row_number() OVER (PARTITION BY maintenance_required
    ORDER BY md5(record_id::VARCHAR || ':42')) AS place, count(*) OVER (PARTITION BY maintenance_required) AS n FROM labeled)
SELECT record_id, maintenance_required, CASE WHEN place <= floor(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM ranked""", "D3")
def stratified_split(spark, d):
    """A test split with the same share of either label."""
    return prepare.with_stratified_split(events_labeled(spark, d), SPEC).select("record_id", "maintenance_required", "split")


@register("class_weights", _sql_scored() + f""", c AS (SELECT maintenance_required, count(*) AS n_c FROM decided
  WHERE split = 'train' GROUP BY 1)
SELECT maintenance_required, n_c, {sql.r6('CAST(sum(n_c) OVER () AS DOUBLE) / (count(*) OVER () * n_c)')} AS weight,
  {sql.r6('CAST(sum(CASE WHEN maintenance_required = 0 THEN n_c END) OVER () AS DOUBLE) / sum(CASE WHEN maintenance_required = 1 THEN n_c END) OVER ()')} AS pos_weight
FROM c""", "D5")
def class_weights(spark, d):
    f = prepare.with_split(events_labeled(spark, d), SPEC).filter(F.col("split") == "train")
    w = prepare.class_weights(f, SPEC)
    return w.select("maintenance_required", "n_c", r6("weight").alias("weight"), r6("pos_weight").alias("pos_weight"))


@register("training_subsets", _sql_scored() + f"""
SELECT split, CAST(sum(CASE WHEN maintenance_required = 0 THEN 1 ELSE 0 END) AS BIGINT) AS normal_rows,
  CAST(sum(CASE WHEN days_to_failure IS NOT NULL AND days_to_failure < {SPEC.thresholds.regressor_horizon_days} THEN 1 ELSE 0 END) AS BIGINT) AS near_failure_rows
FROM decided GROUP BY split""", "D6 D7")
def training_subsets(spark, d):
    return prepare.subset_counts(prepare.with_split(events_labeled(spark, d), SPEC), SPEC)


@register("anomaly_scores", _sql_scored() + f"""
SELECT record_id, well_id, {sql.r6('anomaly_score')} AS anomaly_score, {sql.r6('threshold')} AS threshold, is_anomaly
FROM decided""", "E2 E3 E4")
def anomaly_scores(spark, d):
    s = scored(spark, d).frame
    return s.select("record_id", "well_id", r6("anomaly_score").alias("anomaly_score"),
                    r6("threshold").alias("threshold"), "is_anomaly")


PRED_SQL_COLS = (f"well_id, record_id, t_us, predicted_failure, {sql.r6('confidence_score')} AS confidence_score, "
                 f"{sql.r6('days_to_failure_pred')} AS days_to_failure_pred, {sql.r6('anomaly_score')} AS anomaly_score, is_anomaly")


def _pred_cols(df, *more):
    return df.select("well_id", "record_id", "t_us", "predicted_failure", r6("confidence_score").alias("confidence_score"),
                     r6("days_to_failure_pred").alias("days_to_failure_pred"),
                     r6("anomaly_score").alias("anomaly_score"), "is_anomaly", *more)


@register("predictions", _sql_scored() + f"SELECT {PRED_SQL_COLS} FROM decided", "E8 E9 E10 A10")
def predictions(spark, d):
    return _pred_cols(scored(spark, d).frame)


_ALERT_SQL = _sql_scored(f"""risky AS (SELECT * FROM decided WHERE predicted_failure = 1
  AND days_to_failure_pred <= {SPEC.thresholds.alert_days})""",
                         """pick AS (SELECT well_id, arg_min(struct_pack(d := days_to_failure_pred, c := confidence_score),
  struct_pack(d := days_to_failure_pred, t := t_us, r := record_id)) AS a FROM risky GROUP BY well_id)""")


def _fmt_sql(expr: str, digits: int) -> str:
    return f"printf('%.{digits}f', {sql.half_even(expr, digits)})"


@register("alerts", _ALERT_SQL + f"""
SELECT well_id, 'predicted_failure' AS alert_type,
  CASE WHEN a.d <= {SPEC.thresholds.critical_days} THEN 'critical' ELSE 'high' END AS severity,
  {sql.alert_message('well_id', _fmt_sql('a.d', 1), _fmt_sql('a.c * 100.0', 0))} AS message,
  {sql.r6('a.d')} AS days_to_failure, {sql.r6('a.c')} AS confidence_score, TRUE AS is_active
FROM pick""", "F1 F2 F3 F4 A11")
def alerts(spark, d):
    a = alerts_op.alert_rows(scored(spark, d).frame, SPEC)
    return a.select("well_id", "alert_type", "severity", "message", r6("days_to_failure").alias("days_to_failure"),
                    r6("confidence_score").alias("confidence_score"), "is_active")


@register("run_summary", _sql_scored() + f"""
SELECT count(*) AS records, CAST(sum(predicted_failure) AS BIGINT) AS predicted_failures,
  CAST(sum(CAST(is_anomaly AS INTEGER)) AS BIGINT) AS anomalies,
  count(DISTINCT CASE WHEN predicted_failure = 1 AND days_to_failure_pred <= {SPEC.thresholds.alert_days} THEN well_id END)
    AS wells_with_alerts
FROM decided""", "F5")
def run_summary(spark, d):
    return alerts_op.run_summary(scored(spark, d).frame, SPEC)


def _auc_sql(score: str) -> str:
    return f"""(SELECT (sum(CASE WHEN y = 1 THEN rk END) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
   / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0))
 FROM (SELECT maintenance_required AS y, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS rk
       FROM decided WHERE {TEST}))"""


_CM = f"""cm AS (SELECT CAST(sum(CASE WHEN maintenance_required = 0 AND predicted_failure = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN maintenance_required = 0 AND predicted_failure = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN maintenance_required = 1 AND predicted_failure = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN maintenance_required = 1 AND predicted_failure = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp
  FROM decided WHERE {TEST})"""
_MAE = f"""m AS (SELECT avg(abs(days_to_failure - days_to_failure_pred)) AS mae FROM decided
  WHERE {TEST} AND days_to_failure IS NOT NULL AND days_to_failure < {SPEC.thresholds.regressor_horizon_days})"""


_LEADS = f"""leads AS (SELECT well_id, next_failure_us,
  min(CASE WHEN predicted_failure = 1 AND days_to_failure_pred <= {SPEC.thresholds.alert_days} THEN t_us END) AS first_alert_us
  FROM decided WHERE next_failure_us IS NOT NULL GROUP BY well_id, next_failure_us)"""


_DOWN = f"""down AS (SELECT avg(CASE WHEN lead_days >= 1.0 THEN lead_days END) AS mean_lead,
  (count(*) * 24.0 - (count(*) FILTER (WHERE lead_days >= 1.0) * 8.0 + (count(*) - count(*) FILTER (WHERE lead_days >= 1.0)) * 24.0))
    / (count(*) * 24.0) * 100.0 AS reduction
  FROM (SELECT CAST(next_failure_us - first_alert_us AS DOUBLE) / {sql.US_PER_DAY} AS lead_days FROM leads))"""


@register("model_metrics", _sql_scored(_CM, _MAE, _LEADS, _DOWN) + f"""
SELECT {sql.half_even(_auc_sql('anomaly_score'), 4)} AS autoencoder_auc,
       {sql.half_even(_auc_sql('confidence_score'), 4)} AS classifier_auc_roc,
       {sql.half_even('CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END', 4)} AS classifier_f1,
       {sql.half_even('mae', 4)} AS regressor_mae_days,
       {sql.r6('(SELECT max(threshold) FROM decided)')} AS anomaly_threshold,
       {len(FEATS)} AS input_dim,
       {sql.grade(_auc_sql('confidence_score'))} AS grade, tn, fp, fn, tp,
       {sql.r6('mean_lead')} AS maintenance_lead_time_days, {sql.r6('reduction')} AS downtime_reduction_pct,
       '{','.join(FEATS)}' AS feature_cols
FROM cm, m, down""", "G1 G2 G3 G5 G6 G7 G9 A14")
def model_metrics(spark, d):
    from ..functions.scalars import half_even

    s = scored(spark, d)
    test = keep(s.frame.filter(F.col("split") == "test").select(
        "maintenance_required", "predicted_failure", "anomaly_score", "confidence_score", "days_to_failure",
        "days_to_failure_pred"))
    areas = evaluate.aucs(test, "maintenance_required", ["anomaly_score", "confidence_score"])
    auc_a, auc_c = areas["anomaly_score"], areas["confidence_score"]
    cm = evaluate.confusion(test, "maintenance_required", "predicted_failure")
    near = prepare.near_failure_rows(test, SPEC)
    m = evaluate.mae(near, "days_to_failure", "days_to_failure_pred").select("mae")
    from ..functions.scalars import one_row

    down = evaluate.downtime_summary(evaluate.lead_times(s.frame, SPEC)).select("mean_lead_days", "downtime_reduction_pct")
    row = one_row(cm, m, down)
    return row.select(
        half_even(F.lit(auc_a), 4).alias("autoencoder_auc"),
        half_even(F.lit(auc_c), 4).alias("classifier_auc_roc"),
        half_even(evaluate.f1_from(F.col("tp"), F.col("fp"), F.col("fn")), 4).alias("classifier_f1"),
        half_even("mae", 4).alias("regressor_mae_days"),
        r6(F.lit(s.threshold)).alias("anomaly_threshold"),
        F.lit(len(s.features)).alias("input_dim"),
        evaluate.grade(F.lit(auc_c)).alias("grade"),
        "tn", "fp", "fn", "tp",
        r6("mean_lead_days").alias("maintenance_lead_time_days"), r6("downtime_reduction_pct").alias("downtime_reduction_pct"),
        F.lit(",".join(s.features)).alias("feature_cols"),
    )


@register("stored_metrics", _sql_scored(_CM) + """
SELECT tn, fp, fn, tp, (SELECT count(*) FROM decided) AS records FROM cm""", "A14")
def stored_metrics(spark, d):
    """The metrics document written and read back."""
    frame = scored(spark, d).frame
    doc = evaluate.confusion(frame.filter(F.col("split") == "test"), "maintenance_required", "predicted_failure").first().asDict()
    path = sinks.scratch_path(spark, "metrics")
    sinks.write_metrics(spark, {k: doc[k] for k in ("tn", "fp", "fn", "tp")} | {"records": frame.count()}, path)
    back = sinks.read_metrics(spark, path)
    return spark.createDataFrame([tuple(back.values())], ", ".join(f"{k} long" for k in back))


@register("confusion_matrix", _sql_scored(_CM) + """
SELECT tn, fp, fn, tp, """ + ", ".join(f"{sql.r6(f'{k} * 100.0 / (tn + fp + fn + tp)')} AS {k}_pct" for k in ("tn", "fp", "fn", "tp"))
          + " FROM cm", "G3")
def confusion_matrix(spark, d):
    test = scored(spark, d).frame.filter(F.col("split") == "test")
    c = evaluate.confusion(test, "maintenance_required", "predicted_failure")
    return c.select("tn", "fp", "fn", "tp", *[r6(f"{k}_pct").alias(f"{k}_pct") for k in ("tn", "fp", "fn", "tp")])


def _report_sql() -> str:
    def safe(a, b):
        return f"(CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END)"
    p0, r0, p1, r1 = safe("tn", "tn + fn"), safe("tn", "tn + fp"), safe("tp", "tp + fp"), safe("tp", "tp + fn")
    f0, f1 = safe(f"2.0 * {p0} * {r0}", f"{p0} + {r0}"), safe(f"2.0 * {p1} * {r1}", f"{p1} + {r1}")
    n = "(tn + fp + fn + tp)"
    acc = safe("tn + tp", n)
    rows = [("'0'", p0, r0, f0, "tn + fp"), ("'1'", p1, r1, f1, "fn + tp"), ("'accuracy'", acc, acc, acc, n),
            ("'macro avg'", f"({p0} + {p1}) / 2", f"({r0} + {r1}) / 2", f"({f0} + {f1}) / 2", n),
            ("'weighted avg'", safe(f"{p0} * (tn + fp) + {p1} * (fn + tp)", n),
             safe(f"{r0} * (tn + fp) + {r1} * (fn + tp)", n), safe(f"{f0} * (tn + fp) + {f1} * (fn + tp)", n), n)]
    return " UNION ALL ".join(
        f"SELECT {c} AS class, {sql.r6(p)} AS precision, {sql.r6(r)} AS recall, {sql.r6(f)} AS f1, CAST({s} AS BIGINT) AS support FROM cm"
        for c, p, r, f, s in rows)


@register("classification_report", _sql_scored(_CM) + _report_sql(), "G4")
def classification_report(spark, d):
    test = scored(spark, d).frame.filter(F.col("split") == "test")
    r = evaluate.classification_report(test, "maintenance_required", "predicted_failure")
    return r.select("class", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"),
                    F.col("support").cast("long").alias("support"))


@register("roc_curve", _sql_scored(f"""per AS (SELECT CAST(floor(confidence_score / 0.01) AS INTEGER) AS bucket,
  CAST(sum(maintenance_required) AS BIGINT) AS pos, CAST(sum(1 - maintenance_required) AS BIGINT) AS neg
  FROM decided WHERE {TEST} GROUP BY 1)""") + f"""
SELECT {sql.r6('CAST(bucket AS DOUBLE) * CAST(0.01 AS DOUBLE)')} AS threshold,
  {sql.r6('CAST(sum(pos) OVER (ORDER BY bucket DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / sum(pos) OVER ()')} AS tpr,
  {sql.r6('CAST(sum(neg) OVER (ORDER BY bucket DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / sum(neg) OVER ()')} AS fpr
FROM per""", "G8")
def roc_curve(spark, d):
    test = scored(spark, d).frame.filter(F.col("split") == "test")
    r = evaluate.roc_points(test, "maintenance_required", "confidence_score")
    return r.select(r6("threshold").alias("threshold"), r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))


@register("lead_times", _sql_scored(_LEADS) + f"""
SELECT well_id, next_failure_us, CAST(first_alert_us AS DOUBLE) AS first_alert_us,
  {sql.r6('CAST(next_failure_us - first_alert_us AS DOUBLE) / ' + sql.US_PER_DAY)} AS lead_days FROM leads""", "G9")
def lead_times(spark, d):
    lt = evaluate.lead_times(scored(spark, d).frame, SPEC)
    # nullable epoch as double (exact below 2**53) so both engines hand back the same null
    return lt.select("well_id", "next_failure_us", F.col("first_alert_us").cast("double").alias("first_alert_us"),
                     r6("lead_days").alias("lead_days"))


@register("downtime_summary", _sql_scored(_LEADS, f"""l2 AS (SELECT *, CAST(next_failure_us - first_alert_us AS DOUBLE)
  / {sql.US_PER_DAY} AS lead_days FROM leads)""") + f"""
SELECT count(*) AS failures, CAST(sum(CASE WHEN lead_days >= 1.0 THEN 1 ELSE 0 END) AS BIGINT) AS warned,
  {sql.r6('avg(CASE WHEN lead_days >= 1.0 THEN lead_days END)')} AS mean_lead_days,
  {sql.r6('(count(*) * 24.0 - (sum(CASE WHEN lead_days >= 1.0 THEN 1 ELSE 0 END) * 8.0 + (count(*) - sum(CASE WHEN lead_days >= 1.0 THEN 1 ELSE 0 END)) * 24.0)) / (count(*) * 24.0) * 100.0')} AS downtime_reduction_pct
FROM l2""", "G9")
def downtime_summary(spark, d):
    s = evaluate.downtime_summary(evaluate.lead_times(scored(spark, d).frame, SPEC))
    return s.select("failures", "warned", r6("mean_lead_days").alias("mean_lead_days"),
                    r6("downtime_reduction_pct").alias("downtime_reduction_pct"))


@register("latest_prediction", _sql_scored(f"""n AS (SELECT *, row_number() OVER ({sql.ORDER}) AS _rn FROM decided)""",
                                           """lp AS (SELECT well_id, arg_max(confidence_score, _rn) AS c, arg_max(days_to_failure_pred, _rn) AS dd,
  CAST(sum(CAST(is_anomaly AS INTEGER)) AS BIGINT) AS n_anomalies, count(*) AS n_readings FROM n GROUP BY well_id)""") + f"""
SELECT well_id, {sql.r6('c')} AS confidence_score, {sql.r6('dd')} AS days_to_failure_pred, n_anomalies, n_readings,
  {sql.bands('dd', DAYS_BANDS, DAYS_BAND_ELSE, '<=')} AS days_band,
  {sql.bands('c', RISK_BANDS, RISK_BAND_ELSE, '>')} AS risk_band,
  {sql.bands('n_anomalies', ANOMALY_BANDS, ANOMALY_BAND_ELSE, '>')} AS anomaly_band
FROM lp""", "H18 H19")
def latest_prediction(spark, d):
    lp = fleet.latest_prediction(scored(spark, d).frame, SPEC)
    return lp.select("well_id", r6("confidence_score").alias("confidence_score"),
                     r6("days_to_failure_pred").alias("days_to_failure_pred"), "n_anomalies", "n_readings",
                     "days_band", "risk_band", "anomaly_band")


@register("anomaly_series", _sql_scored() + f"""
SELECT well_id, t_us, {sql.r6('anomaly_score')} AS anomaly_score, {sql.r6('threshold')} AS threshold, is_anomaly
FROM decided""", "H20")
def anomaly_series(spark, d):
    s = scored(spark, d).frame
    return s.select("well_id", "t_us", r6("anomaly_score").alias("anomaly_score"), r6("threshold").alias("threshold"),
                    "is_anomaly")


@register("anomaly_overlay", _sql_scored() + f"""
SELECT well_id, t_us, {sql.r6('value')} AS value FROM decided WHERE is_anomaly""", "H17")
def anomaly_overlay(spark, d):
    o = fleet.overlay_rows(scored(spark, d).frame, SPEC, "is_anomaly", ["value"])
    return o.select("well_id", "t_us", r6("value").alias("value"))


# ---------------------------------------------------------------- lineitem: four-sensor fleet

_LI_OUT = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", *ENG]


@register("lineitem_features", sql.with_ctes(
    sql.lineitem_readings(), sql.labeled(LINEITEM_SPEC), sql.imputed(LINEITEM_SPEC.sensors, spec=LINEITEM_SPEC),
    sql.features(LINEITEM_SPEC)) + "SELECT record_id, l_partkey, well_id, t_us, maintenance_required, "
    + ", ".join(f"{sql.r6(c)} AS {c}" for c in _LI_OUT) + " FROM features", "C1-C9 C11 C12 B1 (4 sensors, ties)")
def lineitem_features(spark, d):
    f = _lineitem_features(spark, d)
    return f.select("record_id", "l_partkey", "well_id", "t_us", "maintenance_required",
                    *[r6(c).alias(c) for c in _LI_OUT])


# ---------------------------------------------------------------- E1/E5/E7/E12/E13/G10: fitted models (rows-only)


def _pca(spark, d):
    s = scored(spark, d)
    zcols = [c + "_z" for c in s.features]
    normal_train = s.frame.filter((F.col("split") == "train") & (F.col("maintenance_required") == 0))
    det = models.fit_pca_detector(normal_train, zcols, models.pca_k(len(zcols)))
    f = s.frame.withColumn("pca_score", det.reconstruction_error())
    det.threshold = anomaly_threshold(f.filter((F.col("split") == "train") & (F.col("maintenance_required") == 0)),
                                      "pca_score")
    return f.withColumn("pca_anomaly", F.col("pca_score") > F.lit(det.threshold)), det


@register("pca_anomaly_scores", None, "E1 E2 E3 E4")
def pca_anomaly_scores(spark, d):
    f, det = _pca(spark, d)
    return f.select("record_id", "well_id", "split", r6("pca_score").alias("anomaly_score"),
                    F.col("pca_anomaly").alias("is_anomaly"), r6(F.lit(det.threshold)).alias("threshold"))


def _classifier(spark, d, kind="mlp", max_iter=40):
    s = scored(spark, d)
    zcols = [c + "_z" for c in s.features]
    train = s.frame.filter(F.col("split") == "train")
    return s, zcols, models.fit_classifier(train, zcols, "maintenance_required", kind=kind, max_iter=max_iter)


@register("mlp_failure_probability", None, "E5 E6 E9 C10")
def mlp_failure_probability(spark, d):
    """The class-weighted network of three hidden layers, 40 epochs."""
    z, _, feats = standardised(events_features(spark, d), SPEC)
    zcols = [c + "_z" for c in feats]
    fitted = models.fit_network_classifier(z.filter(F.col("split") == "train"), zcols, SPEC.label)
    p = models.network_probability(z.select("record_id", "well_id", "split", *zcols), zcols, fitted, "confidence_score")
    return p.select("record_id", "well_id", "split", r6("confidence_score").alias("confidence_score"),
                    (F.col("confidence_score") >= F.lit(SPEC.thresholds.probability)).cast("int").alias("predicted_failure"))


@register("autoencoder_scores", None, "E1 E2 E3 E4")
def autoencoder_scores(spark, d):
    """The bottleneck network fitted on normal rows, its error of every row and the threshold of the normal training rows."""
    z, _, feats = standardised(events_features(spark, d), SPEC)
    zcols = [c + "_z" for c in feats]
    normal = prepare.normal_rows(z.filter(F.col("split") == "train"), SPEC)
    fitted = models.fit_bottleneck(normal, zcols, hidden=(32, 4, 32), epochs=20)
    scored_rows = keep(models.network_error(z.select("record_id", "well_id", "split", SPEC.label, *zcols), zcols, fitted, "anomaly_score"))
    cut = anomaly_threshold(prepare.normal_rows(scored_rows.filter(F.col("split") == "train"), SPEC))
    return scored_rows.select("record_id", "well_id", "split", r6("anomaly_score").alias("anomaly_score"),
                              (F.col("anomaly_score") > F.lit(cut)).alias("is_anomaly"), r6(F.lit(cut)).alias("threshold"))


@register("network_days_prediction", None, "E7 E8 D7")
def network_days_prediction(spark, d):
    """The network with the loss of fixed delta 1, fitted on near-failure rows, clipped."""
    from ..functions.scalars import clip

    z, _, feats = standardised(events_features(spark, d), SPEC)
    zcols = [c + "_z" for c in feats]
    fitted = models.fit_network_regressor(prepare.near_failure_rows(z.filter(F.col("split") == "train"), SPEC), zcols, SPEC.days, epochs=20)
    p = models.network_probability(z.select("record_id", "well_id", "split", *zcols), zcols, fitted, "days_raw")
    return p.select("record_id", "well_id", "split", r6(clip("days_raw", *SPEC.thresholds.days_clip)).alias("days_to_failure_pred"))


# a 2-2-1 network, its weights in the order of ``networks.Shape.layers``
_GRADIENT_AT = (0.4, -0.3, 0.2, 0.5, 0.1, -0.1, 0.7, -0.6, 0.05)


def _gradient_sql() -> str:
    w11, w12, w21, w22, b1, b2, v1, v2, c = (f"CAST({x} AS DOUBLE)" for x in _GRADIENT_AT)
    sums = ["loss", "e * %s * CAST(h1 > 0 AS INT) * x1" % v1, "e * %s * CAST(h2 > 0 AS INT) * x1" % v2,
            "e * %s * CAST(h1 > 0 AS INT) * x2" % v1, "e * %s * CAST(h2 > 0 AS INT) * x2" % v2,
            "e * %s * CAST(h1 > 0 AS INT)" % v1, "e * %s * CAST(h2 > 0 AS INT)" % v2, "e * h1", "e * h2", "e"]
    out = " UNION ALL ".join(f"SELECT kind, {k} AS place, {sql.r6(f'sum(w * {x}) / sum(w)')} AS value FROM errors GROUP BY kind"
                             for k, x in enumerate(sums))
    return f"""
, rows_in AS (SELECT COALESCE(value, 0.0) / 100.0 AS x1, signal / 100.0 AS x2, CAST(failure_type <> 'none' AS INT) AS y,
    CASE WHEN failure_type <> 'none' THEN 5.0::DOUBLE ELSE 0.5::DOUBLE END AS w FROM readings WHERE signal IS NOT NULL),
hid AS (SELECT *, greatest(x1 * {w11} + x2 * {w21} + {b1}, 0) AS h1, greatest(x1 * {w12} + x2 * {w22} + {b2}, 0) AS h2 FROM rows_in),
outs AS (SELECT *, h1 * {v1} + h2 * {v2} + {c} AS o FROM hid),
errors AS (SELECT 'binary' AS kind, *, ln(1 + exp(o)) - y * o AS loss, 1 / (1 + exp(-o)) - y AS e FROM outs
  UNION ALL SELECT 'huber', *, CASE WHEN abs(o - 3 * y) <= 1 THEN 0.5 * power(o - 3 * y, 2) ELSE abs(o - 3 * y) - 0.5 END,
  greatest(least(o - 3 * y, 1), -1) FROM outs)
{out}"""


@register("network_gradient", sql.with_ctes(sql.events_readings()) + _gradient_sql(), "E5 E7")
def network_gradient(spark, d):
    """Mean loss (place 0) and its gradient at given weights, over all readings, for both weighted losses."""
    r = events_readings(spark, d).where("signal IS NOT NULL").select(
        (F.coalesce("value", F.lit(0.0)) / 100).alias("x1"), (F.col("signal") / 100).alias("x2"),
        (F.col("failure_type") != "none").cast("double").alias("y"))
    rows = []
    for kind, scale in (("binary", 1.0), ("huber", 3.0)):
        blocks = networks.to_blocks(r.withColumn("target", F.col("y") * scale), ["x1", "x2"], ["target"],
                                    F.when(F.col("y") == 1, 5.0).otherwise(0.5), held_share=0.0)
        sums, gradient = networks.summed(blocks, networks.Shape((2, 2, 1), kind), np.array(_GRADIENT_AT))
        rows += [(kind, k, float(v / sums[1])) for k, v in enumerate([sums[0], *gradient])]
    return spark.createDataFrame(rows, "kind string, place int, value double").select("kind", "place", r6("value").alias("value"))


@register("huber_days_prediction", None, "E7 E8 D7")
def huber_days_prediction(spark, d):
    s = scored(spark, d)
    zcols = [c + "_z" for c in s.features]
    near = prepare.near_failure_rows(s.frame.filter(F.col("split") == "train"), SPEC)
    m = models.fit_regressor(near, zcols, SPEC.days)
    p = models.predict_days(m, s.frame.select("record_id", "well_id", "split", SPEC.days, *zcols))
    lo, hi = SPEC.thresholds.days_clip
    from ..functions.scalars import clip
    return p.select("record_id", "well_id", "split", r6(clip("days_raw", lo, hi)).alias("days_to_failure_pred"))


@register("model_scoring", None, "E10 E11 A10")
def model_scoring(spark, d):
    """All three fitted models (fitted concurrently) in one lazy chain → the 8 prediction columns."""
    z, stats, feats = standardised(events_features(spark, d), SPEC)
    return _pred_cols(apply_models(z, fit_models(z, SPEC, stats, feats), SPEC))


@register("dense_network_scores", None, "E12")
def dense_network_scores(spark, d):
    """The fitted MLP's weights run through the generic Arrow forward pass (sigmoid hidden, softmax out)."""
    s, zcols, m = _classifier(spark, d, max_iter=20)
    mlp = m.stages[-1]
    layers = models.mlp_layers(mlp)
    acts = ["sigmoid"] * (len(layers) - 1) + ["softmax"]
    x = models.dense_forward(s.frame.select("record_id", "well_id", *zcols), zcols, layers, acts, out="p_forward")
    return x.select("record_id", "well_id", r6("p_forward").alias("p_forward"))


# ---------------------------------------------------------------- A: ingestion, keys, derived tables, sinks


@register("ingestion_report", sql.with_ctes(
    sql.events_readings(), sql.labeled(), sql.imputed(SPEC.sensors, "labeled", "cleaned")) + """
SELECT (SELECT count(*) FROM labeled) AS rows_in,
  (SELECT CAST(count(*) FILTER (WHERE value IS NULL) + count(*) FILTER (WHERE signal IS NULL) AS BIGINT) FROM labeled) AS nulls_before,
  (SELECT CAST(count(*) FILTER (WHERE value IS NULL) + count(*) FILTER (WHERE signal IS NULL) AS BIGINT) FROM cleaned) AS nulls_after,
  (SELECT CAST(count(*) FILTER (WHERE value IS NULL) + count(*) FILTER (WHERE signal IS NULL) AS BIGINT) FROM labeled)
   - (SELECT CAST(count(*) FILTER (WHERE value IS NULL) + count(*) FILTER (WHERE signal IS NULL) AS BIGINT) FROM cleaned) AS nulls_imputed,
  (SELECT count(*) - count(DISTINCT record_id) FROM cleaned) AS duplicates_dropped,
  (SELECT count(DISTINCT record_id) FROM cleaned) AS rows_out,
  (SELECT CAST(sum(maintenance_required) AS BIGINT) FROM cleaned) AS maintenance_events,
  (SELECT """ + sql.r6("avg(CAST(maintenance_required AS DOUBLE)) * 100") + """ FROM cleaned) AS maintenance_pct""",
          "A3 B3 B4 B6")
def ingestion_report(spark, d):
    laid = labeled(events_readings(spark, d), SPEC)        # one layout for labels and imputation
    raw = strip(laid)
    cleaned = strip(rolling_median_fill(laid, SPEC, cols=SPEC.sensors))
    deduped = keep_first(cleaned, SPEC.record, SPEC.order_cols)
    r = sinks.ingestion_report(raw, cleaned, deduped, SPEC.sensors, SPEC)
    return r.withColumn("maintenance_pct", r6("maintenance_pct"))


_LI_KEY = ["l_orderkey", "l_linenumber"]
_LI_ORDER = ["t_us", "l_partkey", "l_quantity", "l_extendedprice"]


@register("dedup_keep_first", sql.with_ctes(sql.lineitem_readings()) + """
SELECT record_id, l_orderkey, l_linenumber, l_partkey, well_id, t_us, l_quantity, l_extendedprice, l_discount, l_tax
FROM readings QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY t_us, l_partkey, l_quantity, l_extendedprice) = 1""", "B4")
def dedup_keep_first(spark, d):
    r = lineitem_readings(spark, d).select("record_id", "l_orderkey", "l_linenumber", "l_partkey", "well_id", "t_us",
                                           "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return keep_first(r, _LI_KEY, _LI_ORDER)


@register("key_checks", """
WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
           WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY 1, 2)
SELECT (SELECT count(*) FROM lineitem) AS rows,
  (SELECT CAST(count(*) FILTER (WHERE l_orderkey IS NULL OR l_linenumber IS NULL) AS BIGINT) FROM lineitem) AS null_keys,
  (SELECT CAST(COALESCE(sum(n - 1), 0) AS BIGINT) FROM k) AS duplicate_rows,
  (SELECT CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) FROM k) AS duplicated_keys,
  (SELECT count(*) FROM lineitem l WHERE l_suppkey IS NOT NULL
     AND NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey)) AS orphans""", "A6")
def key_checks(spark, d):
    li = read_table(spark, d, "lineitem")
    sup = read_table(spark, d, "supplier")
    return sinks.key_report(li, _LI_KEY, sup, "l_suppkey", "s_suppkey")


@register("wells_table", sql.with_ctes(sql.events_readings()) + f"""
, n AS (SELECT *, row_number() OVER ({sql.ORDER}) AS _rn FROM readings)
SELECT well_id, CAST(arg_min(depth_ft, _rn) FILTER (WHERE depth_ft IS NOT NULL) AS INTEGER) AS depth_ft,
  '2022-01-01' AS install_date, 'Field-' || right(well_id, 3) AS location, 'active' AS status
FROM n GROUP BY well_id""", "A8 A7")
def wells_table(spark, d):
    w = sinks.wells_table(events_readings(spark, d), SPEC)
    return w.withColumn("install_date", F.date_format("install_date", "yyyy-MM-dd"))


_REDELIVERY_DAYS = 2


@register("idempotent_append", sql.with_ctes(sql.events_readings()) + f"""
, lim AS (SELECT max(t_us) - {AS_OF_DAYS_BACK} * {DAY_US} AS cut FROM readings),
stored AS (SELECT r.* FROM readings r, lim WHERE t_us <= cut),
batch AS (SELECT r.* FROM readings r, lim WHERE t_us > cut - {_REDELIVERY_DAYS} * {DAY_US}
          UNION ALL SELECT r.* FROM readings r, lim WHERE t_us > cut - {_REDELIVERY_DAYS} * {DAY_US}),
fresh AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY t_us) = 1)
SELECT record_id, well_id, t_us, value, signal, failure_type FROM fresh
WHERE record_id NOT IN (SELECT record_id FROM stored)""", "A5")
def idempotent_append(spark, d):
    """Stored = readings up to five days before the end; a redelivered batch (the last seven days,
    sent twice) appends only what is new, once."""
    r = events_readings(spark, d).select("record_id", "well_id", "t_us", "value", "signal", "failure_type")
    cut = r.agg(F.max("t_us")).first()[0] - AS_OF_DAYS_BACK * DAY_US
    stored = r.filter(F.col("t_us") <= F.lit(cut))
    part = r.filter(F.col("t_us") > F.lit(cut - _REDELIVERY_DAYS * DAY_US))
    return sinks.rows_to_append(part.unionByName(part), stored, "record_id", ["t_us"])


@register("visit_requests", _SQL_SCHED + """
SELECT well_id, strftime(strptime(schedule_by, '%b %d, %Y'), '%Y-%m-%d') AS scheduled_date,
  CASE WHEN priority = 'Critical' THEN 'corrective' ELSE 'inspection' END AS maintenance_type,
  CASE WHEN fault_type <> 'None' THEN lower(replace(fault_type, ' ', '_')) END AS failure_type_addressed,
  'Unassigned' AS technician, '' AS notes, 'scheduled' AS status
FROM sched WHERE priority IN ('Critical', 'High')""", "A12 A7")
def visit_requests(spark, d):
    v = sinks.visit_requests(_schedule(spark, d))
    return v.select("well_id", F.date_format("scheduled_date", "yyyy-MM-dd").alias("scheduled_date"),
                    "maintenance_type", "failure_type_addressed", "technician", "notes", "status")


_ADHOC = "SELECT well_id, count(*) AS n, avg(value) AS avg_value FROM readings WHERE value >= :lo GROUP BY well_id"


@register("adhoc_sql", sql.with_ctes(sql.events_readings()) + f"""
SELECT well_id, count(*) AS n, {sql.r6('avg(value)')} AS avg_value FROM readings WHERE value >= 50.0 GROUP BY well_id""",
          "A13")
def adhoc_sql(spark, d):
    out = sinks.run_sql(spark, _ADHOC, views={"readings": events_readings(spark, d)}, args={"lo": 50.0})
    return out.select("well_id", "n", r6("avg_value").alias("avg_value"))


# ---------------------------------------------------------------- E11 + B5: score a date window


@register("window_scoring", _sql_scored(
    f"""win AS (SELECT * EXCLUDE (pressure_rolling_mean, pressure_rolling_std, vibration_rolling_max, temp_rolling_mean,
  pressure_change_rate, vibration_trend, maintenance_age_ratio) FROM features
  WHERE "timestamp" >= CAST(CAST((SELECT max("timestamp") FROM features) AS DATE) - INTERVAL {_WINDOW_DAYS} DAY AS TIMESTAMP)
    AND "timestamp" <= CAST(CAST((SELECT max("timestamp") FROM features) AS DATE) AS TIMESTAMP))""",
    sql.features(SPEC, src="win", name="wf"),
    "wz AS (SELECT wf.*, (" + " + ".join(
        f"power(((COALESCE({c}, 0.0) - m_{i}) / (CASE WHEN s_{i} IS NULL OR s_{i} = 0 THEN 1.0 ELSE s_{i} END)), 2)"
        for i, c in enumerate(FEATS)) + f""") / {float(len(FEATS))} AS w_score, {EVENTS_FORMULA.prob_sql} AS prob,
      {EVENTS_FORMULA.days_sql} AS days FROM wf, stats)""") + f"""
SELECT well_id, record_id, t_us, {sql.r6('w_score')} AS anomaly_score, w_score > threshold AS is_anomaly,
  {sql.r6('prob')} AS confidence_score, CASE WHEN prob >= {SPEC.thresholds.probability} THEN 1 ELSE 0 END AS predicted_failure,
  {sql.r6(f'least(greatest(days, {SPEC.thresholds.days_clip[0]}), {SPEC.thresholds.days_clip[1]})')} AS days_to_failure_pred,
  {sql.r6('pressure_rolling_mean')} AS pressure_rolling_mean, {sql.r6('vibration_trend')} AS vibration_trend
FROM wz, thr""", "E11 B5 H11")
def window_scoring(spark, d):
    """Features computed inside the window (no warm-up rows, like the original's single-well scoring),
    nulls → 0, then the full-data scaler and threshold."""
    s = scored(spark, d)
    c = clean(spark, d)
    end = c.agg(F.max(F.col(SPEC.time).cast("date"))).first()[0]
    import datetime as _dt
    z = score_window(c, SPEC, s, (end - _dt.timedelta(days=_WINDOW_DAYS)).isoformat(), end.isoformat())
    return z.select("well_id", "record_id", "t_us", r6("anomaly_score").alias("anomaly_score"), "is_anomaly",
                    r6("confidence_score").alias("confidence_score"), "predicted_failure",
                    r6("days_to_failure_pred").alias("days_to_failure_pred"),
                    r6("pressure_rolling_mean").alias("pressure_rolling_mean"),
                    r6("vibration_trend").alias("vibration_trend"))


# a fixed classifier of two features; the third one it ignores
_RISK = "value / 50.0 + hours_since_last_maintenance / 200.0"
_RISK_FEATURES = ["value", "hours_since_last_maintenance", "signal"]
_PERM_SEED = 42


def _risk(columns: dict) -> Column:
    return columns["value"] / F.lit(50.0) + columns["hours_since_last_maintenance"] / F.lit(200.0)


def _rank_auc_sql(score: str) -> str:
    return f"""(SELECT (sum(CASE WHEN y = 1 THEN rk END) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
   / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0))
 FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM (SELECT y, {score} AS s FROM perm)))"""


def _walks_sql() -> str:
    """(j, place, x): where the row at ``place`` gives its value of feature j to, walked until it is in range."""
    keys = {j: evaluate.round_keys(_PERM_SEED, j) for j in range(1, len(_RISK_FEATURES) + 1)}
    source = "SELECT j, place, n, a, b, x // b AS l, x % b AS r FROM walk WHERE x >= n OR step = 0"
    for k in range(6):
        k0, k1, k2, k3 = ("CASE j " + " ".join(f"WHEN {j} THEN {v[k][c]}" for j, v in keys.items()) + " END" for c in range(4))
        p, q = evaluate.PRIMES
        mixed = lambda half: f"((({half} * ({k0}) + ({k1})) % {p}) * ({k2}) + ({k3})) % {q}"  # noqa: E731, B023
        moved = f"l, (r + {mixed('l')}) % b AS r" if k % 2 else f"(l + {mixed('r')}) % a AS l, r"
        source = f"SELECT j, place, n, a, b, {moved} FROM ({source})"
    start = ("SELECT j, place, n, CAST(ceil(sqrt(n)) AS BIGINT) AS a, CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS b, place AS x, 0 AS step "
             f"FROM t, (SELECT count(*) AS n FROM t), (SELECT unnest(range(1, {len(_RISK_FEATURES) + 1})) AS j)")
    return (f"walk AS ({start} UNION ALL SELECT j, place, n, a, b, l * b + r AS x, 1 AS step FROM ({source})), "
            "dealt AS (SELECT j, place, x FROM walk WHERE step = 1 AND x < n)")


@register("permutation_importance", (_sql_scored(
    "t AS (SELECT record_id, maintenance_required AS y, row_number() OVER (ORDER BY record_id) - 1 AS place, "
    + ", ".join(_RISK_FEATURES) + f" FROM decided WHERE {TEST})", _walks_sql(),
    "perm AS (SELECT t.*" + "".join(f", d{j}.p{j}" for j in range(1, len(_RISK_FEATURES) + 1)) + " FROM t"
    + "".join(f" JOIN (SELECT x, {f} AS p{j} FROM dealt JOIN t USING (place) WHERE j = {j}) d{j} ON d{j}.x = t.place"
              for j, f in enumerate(_RISK_FEATURES, 1)) + ")",
    "drops AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {_rank_auc_sql(_RISK)} AS base, {_rank_auc_sql(_RISK.replace(f, f'p{j}'))} AS shuffled"
        for j, f in enumerate(_RISK_FEATURES, 1)) + ")") + f"""
SELECT feature, {sql.r6('base - shuffled')} AS auc_drop, {sql.r6('base')} AS base_auc,
  {sql.r6('coalesce(greatest(base - shuffled, 0.0) / nullif(sum(greatest(base - shuffled, 0.0)) OVER (), 0) * 100.0, 0.0)')} AS importance_pct
FROM drops""").replace("WITH", "WITH RECURSIVE", 1), "G10")
def permutation_importance(spark, d):
    """What a failure classifier's AUC on the test split loses when a feature is shuffled."""
    test = scored(spark, d).frame.filter(F.col("split") == "test").select("record_id", "maintenance_required", *_RISK_FEATURES)
    drops, base = evaluate.permutation_importance(test, _RISK_FEATURES, _risk, "maintenance_required", "record_id", _PERM_SEED)
    return _importance_rows(spark, drops, base)


def _importance_rows(spark, drops, base) -> DataFrame:
    """One row per feature, from the measured drops."""
    total = sum(max(v, 0.0) for _, v in drops) or 1.0
    rows = [(f, float(v), float(base), float(max(v, 0.0) / total * 100.0)) for f, v in drops]
    out = spark.createDataFrame(rows, "feature string, auc_drop double, base_auc double, importance_pct double")
    return out.select("feature", *[r6(c).alias(c) for c in ("auc_drop", "base_auc", "importance_pct")])


@register("classifier_importance", None, "G10 E5")
def classifier_importance(spark, d):
    """The same for the fitted logistic classifier, all features; its probability is a column of its coefficients."""
    from ..functions.scalars import sigmoid

    # two frames are persisted on the way: neither is to hold columns that no step reads
    laid = labeled(events_readings(spark, d), SPEC)
    laid = laid.select(SPEC.entity, SPEC.record, SPEC.label, SPEC.depth, *SPEC.impute_cols, *HELPERS)
    z, _, feats = standardised(featurized(laid, SPEC).drop(SPEC.entity), SPEC)
    zcols = [c + "_z" for c in feats]
    model = models.fit_classifier(z.filter(F.col("split") == "train"), zcols, SPEC.label, kind="logistic").stages[-1]
    weights = dict(zip(zcols, model.coefficients.toArray().tolist()))

    def probability(columns):
        return sigmoid(sum((columns[c] * F.lit(w) for c, w in weights.items()), F.lit(float(model.intercept))))

    test = z.filter(F.col("split") == "test").select("record_id", SPEC.label, *zcols)
    drops, base = evaluate.permutation_importance(test, zcols, probability, SPEC.label, "record_id")
    return _importance_rows(spark, [(f.removesuffix("_z"), v) for f, v in drops], base)


# ---------------------------------------------------------------- fitted models where SQL knows the answer


@register("pca_two_sensors", _sql_scored(
    """nt AS (SELECT * FROM decided WHERE split = 'train' AND maintenance_required = 0)""",
    """mom AS (SELECT avg(value_z) AS m1, avg(signal_z) AS m2, var_samp(value_z) AS a, var_samp(signal_z) AS c,
  covar_samp(value_z, signal_z) AS b FROM nt)""",
    "lam AS (SELECT *, (a + c - sqrt(power(a - c, 2) + 4 * b * b)) / 2 AS l FROM mom)",
    """pc AS (SELECT d.record_id, d.split, d.maintenance_required, power((value_z - m1) * b + (signal_z - m2) * (l - a), 2)
  / (b * b + power(l - a, 2)) / 2 AS score FROM decided d, lam)""",
    "cut AS (SELECT quantile_cont(score, 0.95) AS t FROM pc WHERE split = 'train' AND maintenance_required = 0)") + f"""
SELECT record_id, {sql.r6('score')} AS anomaly_score, score > t AS is_anomaly, {sql.r6('t')} AS threshold FROM pc, cut""",
          "E1 E2 E3 E4")
def pca_two_sensors(spark, d):
    """The fitted reconstruction of two sensors by one component; the discarded axis is known in closed form."""
    f = scored(spark, d).frame
    normal = prepare.normal_rows(f.filter(F.col("split") == "train"), SPEC)
    det = models.fit_pca_detector(normal, ["value_z", "signal_z"], 1)
    det.threshold = anomaly_threshold(normal.withColumn("_pca", det.reconstruction_error()), "_pca")
    f = f.withColumn("score", det.reconstruction_error())
    return f.select("record_id", r6("score").alias("anomaly_score"), (F.col("score") > F.lit(det.threshold)).alias("is_anomaly"),
                    r6(F.lit(det.threshold)).alias("threshold"))


_XOR = ["strong", "high"]


@register("classifier_recovers_labels", sql.with_ctes(sql.events_readings()) + """
SELECT record_id, CASE WHEN (signal >= 50) <> (COALESCE(value, 0) >= 50) THEN 1 ELSE 0 END AS mlp_class,
       CASE WHEN (signal >= 50) <> (COALESCE(value, 0) >= 50) THEN 1 ELSE 0 END AS gbt_class
FROM readings""", "E5 E6 E9 C10")
def classifier_recovers_labels(spark, d):
    """The network and the boosted trees fitted on a label that two features decide, and no linear rule does."""
    r = events_readings(spark, d).select(
        "record_id", (F.col("signal") >= 50).cast("double").alias("strong"),
        (F.coalesce("value", F.lit(0.0)) >= 50).cast("double").alias("high"))
    r = keep(r.withColumn("label", (F.col("strong") != F.col("high")).cast("int")))   # the fits read it seven times
    for kind, options in (("mlp", {"hidden": (8,), "max_iter": 200, "max_rows": None}), ("gbt", {"max_iter": 5})):
        model = models.fit_classifier(r, _XOR, "label", kind=kind, **options)
        r = models.failure_probability(model, r, out="p").withColumn(
            f"{kind}_class", (F.col("p") >= F.lit(SPEC.thresholds.probability)).cast("int")).drop("p")
    return r.select("record_id", "mlp_class", "gbt_class")


@register("regressor_recovers_days", sql.with_ctes(sql.events_readings()) + """
SELECT record_id, 1.0::DOUBLE + 0.25 * floor(COALESCE(value, 0)) + 0.5 * signal AS days FROM readings""", "E7")
def regressor_recovers_days(spark, d):
    """The Huber regressor fitted on a target that is a line of two features."""
    r = events_readings(spark, d).select("record_id", F.floor(F.coalesce("value", F.lit(0.0))).cast("double").alias("v"), "signal")
    r = r.withColumn("days", F.lit(1.0) + F.lit(0.25) * F.col("v") + F.lit(0.5) * F.col("signal"))
    model = models.fit_regressor(r, ["v", "signal"], "days", max_iter=300)
    return models.predict_days(model, r.drop("days"), out="days").select("record_id", (F.round("days", 2) + F.lit(0.0)).alias("days"))


@register("gbt_days_prediction", None, "E7 E8 D7")
def gbt_days_prediction(spark, d):
    """The non-linear days regressor (boosted trees) on near-failure rows, clipped."""
    from ..functions.scalars import clip

    z, _, feats = standardised(events_features(spark, d), SPEC)
    zcols = [c + "_z" for c in feats]
    m = models.fit_regressor(prepare.near_failure_rows(z.filter(F.col("split") == "train"), SPEC), zcols, SPEC.days,
                             kind="gbt", max_iter=20)
    p = models.predict_days(m, z.select("record_id", "well_id", "split", *zcols))
    return p.select("record_id", "well_id", "split", r6(clip("days_raw", *SPEC.thresholds.days_clip)).alias("days_to_failure_pred"))


# fixed weights of a 2-3-2-1 network
_NET = (([[0.02, -0.01, 0.03], [0.015, 0.02, -0.025]], [0.1, -0.2, 0.3], "relu"),
        ([[0.4, -0.3], [0.2, 0.5], [-0.6, 0.1]], [0.05, -0.05], "sigmoid"),
        ([[1.5], [-2.0]], [0.25], "identity"))


def _net_sql() -> str:
    inputs, ctes = ["COALESCE(value, 0.0)", "COALESCE(signal, 0.0)"], []
    source = "readings"
    for k, (weights, bias, act) in enumerate(_NET):
        outs = []
        for j, b in enumerate(bias):
            x = " + ".join(f"{v} * CAST({weights[i][j]} AS DOUBLE)" for i, v in enumerate(inputs)) + f" + CAST({b} AS DOUBLE)"
            outs.append({"relu": f"greatest({x}, 0.0)", "sigmoid": f"1.0 / (1.0 + exp(-({x})))", "identity": x}[act] + f" AS n{k}_{j}")
        ctes.append(f"l{k} AS (SELECT record_id, {', '.join(outs)} FROM {source})")
        inputs, source = [f"n{k}_{j}" for j in range(len(bias))], f"l{k}"
    return sql.with_ctes(sql.events_readings(), *ctes) + f"SELECT record_id, {sql.r6(inputs[0])} AS nn_out FROM {source}"


@register("network_forward", _net_sql(), "E12")
def network_forward(spark, d):
    """A network's given weights over every reading (Arrow batches)."""
    r = events_readings(spark, d).select("record_id", "value", "signal")
    out = models.dense_forward(r, ["value", "signal"], [(w, b) for w, b, _ in _NET], [a for *_, a in _NET])
    return out.select("record_id", r6("nn_out").alias("nn_out"))


@register("feature_vector", sql.events_chain("features") + f"""
SELECT record_id, {len(FEATS)} AS n_features, """ + ", ".join(
    (f"CAST(COALESCE({c}, 0) AS DOUBLE)" if c in SPEC.counters else sql.r6(f"CAST(COALESCE({c}, 0) AS DOUBLE)"))
    + f" AS f{i}" for i, c in enumerate(FEATS)) + " FROM features", "C10 B5")
def feature_vector(spark, d):
    """The vector that the models take, entry by entry. Counters are one exact division, so left unrounded."""
    from pyspark.ml.functions import vector_to_array

    x = assemble(events_features(spark, d), SPEC).select("record_id", vector_to_array("features").alias("v"))
    return x.select("record_id", F.size("v").alias("n_features"), *[
        (F.col("v")[i] if c in SPEC.counters else r6(F.col("v")[i])).alias(f"f{i}") for i, c in enumerate(FEATS)])


@register("activations", sql.with_ctes(sql.events_readings()) + f"""
SELECT record_id, {sql.r6('1.0 / (1.0 + exp(-((COALESCE(value, 0.0) - 50.0) / 10.0)))')} AS sigmoid,
       greatest(COALESCE(value, 0.0) - 50.0, 0.0) AS relu FROM readings""", "J")
def activations(spark, d):
    from ..functions.scalars import relu, sigmoid

    x = F.coalesce(F.col("value"), F.lit(0.0)) - F.lit(50.0)
    return events_readings(spark, d).select("record_id", r6(sigmoid(x / F.lit(10.0))).alias("sigmoid"), relu(x).alias("relu"))


# ---------------------------------------------------------------- the layout for machines of any size


@register("window_features_chunked", REGISTRY["window_features"][1], "C1-C9 on the chunked layout")
def window_features_chunked(spark, d):
    """``window_features`` with at most 40 rows of a machine in a window task, so that most machines are cut."""
    f = events_features(spark, d, layout=Layout(chunk_rows=40))
    return f.select("record_id", "well_id", "t_us", *[r6(c).alias(c) for c in ["value", "signal", *ENG]])


# ---------------------------------------------------------------- A9-A12: what the sinks store, read back


@register("stored_readings", sql.events_chain("labeled") + f"""
SELECT record_id, well_id, depth_ft, {sql.r6('value')} AS pump_pressure_psi, {sql.r6('signal')} AS vibration_mm_s, failure_type,
       maintenance_required, strftime(CAST("timestamp" AS DATE), '%Y-%m-%d') AS reading_date FROM labeled""", "A9 A5")
def stored_readings(spark, d):
    """``sensor_readings`` partitioned by date, written twice by the idempotent append."""
    path = sinks.scratch_path(spark, "sensor-readings")
    rows = events_labeled(spark, d).withColumnsRenamed({"value": "pump_pressure_psi", "signal": "vibration_mm_s"})
    rows = sinks.sensor_readings_rows(rows, SENSOR_READINGS.fields[:-1]).withColumn(READING_DATE, F.to_date(SPEC.time))
    for _ in range(2):
        sinks.append_new(sinks.with_defaults(rows, "sensor_readings"), path, "record_id", ["timestamp"], partition_by=READING_DATE)
    return spark.read.parquet(path).select(
        "record_id", "well_id", "depth_ft", r6("pump_pressure_psi").alias("pump_pressure_psi"),
        r6("vibration_mm_s").alias("vibration_mm_s"), "failure_type", "maintenance_required",
        F.date_format(READING_DATE, "yyyy-MM-dd").alias(READING_DATE))


@register("stored_predictions", _sql_scored() + f"SELECT {PRED_SQL_COLS}, run_id FROM decided, (VALUES ('r1'), ('r2')) AS r(run_id)",
          "A10")
def stored_predictions(spark, d):
    """``model_predictions`` of two runs, one of them written twice."""
    path = sinks.scratch_path(spark, "predictions")
    rows = sinks.with_defaults(prediction_rows(scored(spark, d).frame, SPEC), "model_predictions")
    for run in ("r1", "r2", "r1"):
        sinks.write_run(rows, path, run)
    return _pred_cols(spark.read.parquet(path), "run_id")


@register("stored_alerts", _ALERT_SQL + f"""
SELECT well_id, CASE WHEN a.d <= {SPEC.thresholds.critical_days} THEN 'critical' ELSE 'high' END AS severity,
  {sql.r6('a.d')} AS days_to_failure, TRUE AS is_active, 'r1' AS run_id FROM pick""", "A11")
def stored_alerts(spark, d):
    """``alerts`` of a run that was written twice."""
    path = sinks.scratch_path(spark, "alerts")
    rows = alerts_op.alert_rows(scored(spark, d).frame, SPEC)
    for _ in range(2):
        sinks.write_run(rows, path, "r1")
    return spark.read.parquet(path).select("well_id", "severity", r6("days_to_failure").alias("days_to_failure"), "is_active", "run_id")


@register("stored_visits", _SQL_SCHED + """
, planned AS (SELECT well_id, strftime(strptime(schedule_by, '%b %d, %Y'), '%Y-%m-%d') AS scheduled_date,
  CASE WHEN priority = 'Critical' THEN 'corrective' ELSE 'inspection' END AS maintenance_type, 'Unassigned' AS technician
  FROM sched WHERE priority IN ('Critical', 'High'))
SELECT *, 'scheduled' AS status FROM planned
UNION ALL SELECT well_id, scheduled_date, 'calibration', 'Crew 7', 'scheduled' FROM planned""", "A12")
def stored_visits(spark, d):
    """``maintenance_events``: the planned visits appended twice, then a calibration asked for with each of them."""
    path = sinks.scratch_path(spark, "visits")
    visits = sinks.visit_requests(_schedule(spark, d))
    for _ in range(2):
        sinks.append_visits(visits, path)
    asked = visits.select("well_id", "scheduled_date", F.lit("calibration").alias("maintenance_type"),
                          F.lit("Crew 7").alias("technician"))
    sinks.append_visits(sinks.given_visits(asked), path)
    return spark.read.parquet(path).select("well_id", F.date_format("scheduled_date", "yyyy-MM-dd").alias("scheduled_date"),
                                           "maintenance_type", "technician", "status")


@register("fault_value_counts", sql.with_ctes(sql.events_readings()) + """
SELECT failure_type, count(*) AS n FROM readings GROUP BY failure_type""", "A3")
def fault_value_counts(spark, d):
    """Every fault value including ``none``, most frequent first (the ingestion printout)."""
    r = events_readings(spark, d)
    return r.groupBy("failure_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "failure_type")


@register("null_counts", sql.with_ctes(sql.events_readings(), sql.labeled(),
                                       sql.imputed(SPEC.sensors, "labeled", "cleaned")) + """
SELECT 'before' AS stage, CAST(count(*) FILTER (WHERE value IS NULL) AS BIGINT) AS value,
       CAST(count(*) FILTER (WHERE signal IS NULL) AS BIGINT) AS signal,
       CAST(count(*) FILTER (WHERE value IS NULL) + count(*) FILTER (WHERE signal IS NULL) AS BIGINT) AS total_nulls
FROM labeled
UNION ALL
SELECT 'after', CAST(count(*) FILTER (WHERE value IS NULL) AS BIGINT), CAST(count(*) FILTER (WHERE signal IS NULL) AS BIGINT),
       CAST(count(*) FILTER (WHERE value IS NULL) + count(*) FILTER (WHERE signal IS NULL) AS BIGINT)
FROM cleaned""", "B3")
def null_counts(spark, d):
    from ..operators.impute import null_counts as _nulls

    laid = labeled(events_readings(spark, d), SPEC)
    before = _nulls(strip(laid), SPEC.sensors).withColumn("stage", F.lit("before"))
    after = _nulls(strip(rolling_median_fill(laid, SPEC, cols=SPEC.sensors)), SPEC.sensors).withColumn("stage", F.lit("after"))
    return before.unionByName(after).select("stage", *SPEC.sensors, "total_nulls")


# ---------------------------------------------------------------- E13: stages that notice changed inputs and options


@register("staged_features", sql.with_ctes(sql.events_readings()) + """
, n AS (SELECT count(*) AS all_rows, count(*) FILTER (WHERE record_id % 2 = 0) AS half, 
        count(value) FILTER (WHERE record_id % 2 = 0) AS seen_half FROM readings)
SELECT step, what, rebuilt, CASE WHEN step < 4 THEN half ELSE all_rows END AS rows,
       CASE WHEN step < 3 THEN seen_half WHEN step = 3 THEN half ELSE all_rows END AS with_value
FROM n, (VALUES (1, 'first run', TRUE), (2, 'same input and options', FALSE), (3, 'other option', TRUE), (4, 'more input', TRUE),
         (5, 'same input and options', FALSE)) AS t(step, what, rebuilt)""", "E13")
def staged_features(spark, d):
    """A stage over half of the readings run twice, with another option, and after the other half has come: which of these
    runs built it again, and what it holds then."""
    source, out = sinks.scratch_path(spark, "stage-input"), sinks.scratch_path(spark, "stage")
    r = events_readings(spark, d).select("record_id", "value")
    even = F.col("record_id") % 2 == 0
    rows = []
    for step, (what, more, fill) in enumerate([("first run", even, None), ("same input and options", None, None),
                                               ("other option", None, 0.0), ("more input", ~even, 0.0),
                                               ("same input and options", None, 0.0)], 1):
        if more is not None:
            r.where(more).write.mode("append").parquet(source)
        options = {"fill": fill}
        manifest = models.stage_manifest(spark, [source], options)
        rebuilt = not models.stage_is_current(spark, out, manifest)
        kept = models.stage(out, lambda fill=fill: spark.read.parquet(source).withColumn(
            "value", F.coalesce("value", F.lit(fill).cast("double"))), spark=spark, inputs=[source], settings=options)
        seen = kept.agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("with_value")).first()
        rows.append((step, what, rebuilt, seen["rows"], seen["with_value"]))
    return spark.createDataFrame(rows, "step int, what string, rebuilt boolean, rows long, with_value long")


# ---------------------------------------------------------------- A5/A9/H11: the store that opens few files

_STORE_FILES = 60
_STORE_BATCHES = 3


@register("store_window", sql.with_ctes(sql.events_readings()) + f"""
, busy AS (SELECT well_id FROM readings GROUP BY well_id ORDER BY count(*) DESC, well_id LIMIT 1),
span AS (SELECT max(t_us) - 15 * {DAY_US} AS lo, max(t_us) AS hi FROM readings)
SELECT 'one well' AS asked, record_id, well_id, t_us, {sql.r6('value')} AS value, {sql.r6('signal')} AS signal, failure_type
FROM readings, span WHERE well_id IN (SELECT well_id FROM busy) AND t_us BETWEEN lo AND hi
UNION ALL SELECT 'all wells', record_id, well_id, t_us, {sql.r6('value')}, {sql.r6('signal')}, failure_type FROM readings""", "A9 H11 E11")
def store_window(spark, d):
    """All readings written to the clustered store; the last 15 days of the busiest well, and everything, read from it."""
    path = sinks.scratch_path(spark, "store")
    r = events_readings(spark, d).select("record_id", "well_id", "t_us", "value", "signal", "failure_type")
    store.write_clustered(r, path, SPEC, rows_per_file=max(1, r.count() // _STORE_FILES))
    well = r.groupBy("well_id").count().orderBy(F.desc("count"), "well_id").first()[0]
    hi = r.agg(F.max("t_us")).first()[0]
    one = store.read_range(spark, path, SPEC, [well], hi - 15 * DAY_US, hi).withColumn("asked", F.lit("one well"))
    rows = one.unionByName(store.read_range(spark, path, SPEC).withColumn("asked", F.lit("all wells")))
    return rows.select("asked", "record_id", "well_id", "t_us", r6("value").alias("value"), r6("signal").alias("signal"), "failure_type")


@register("indexed_append", sql.events_chain("labeled") + f"""
SELECT record_id, well_id, {sql.r6('value')} AS value, failure_type, strftime(CAST("timestamp" AS DATE), '%Y-%m-%d') AS reading_date
FROM labeled""", "A5 A9")
def indexed_append(spark, d):
    """All readings appended in batches by id; each batch brings a tenth of the one before again, under another date."""
    path = sinks.scratch_path(spark, "indexed-readings")
    r = events_readings(spark, d).select("record_id", "well_id", "t_us", "value", "failure_type",
                                         F.to_date("timestamp").alias("reading_date"))
    lo, hi = r.agg(F.min("record_id"), F.max("record_id")).first()
    step = (hi - lo) // _STORE_BATCHES + 1
    for k in range(_STORE_BATCHES):
        batch = r.where(F.col("record_id").between(lo + k * step, lo + (k + 1) * step - 1))
        again = r.where(F.col("record_id").between(lo + (k - 1) * step, lo + k * step - 1) & (F.col("record_id") % 10 == 0))
        again = again.withColumn("reading_date", F.date_add("reading_date", 3))
        store.append_indexed(batch.unionByName(again), path, "record_id", ["t_us"], partition_by="reading_date")
    return spark.read.parquet(path).select("record_id", "well_id", r6("value").alias("value"), "failure_type",
                                           F.date_format("reading_date", "yyyy-MM-dd").alias("reading_date"))


# ---------------------------------------------------------------- C9: wide rolling medians

_MEDIAN_ROWS = 500


@register("rolling_median_wide", sql.with_ctes(sql.lineitem_readings()) + f"""
SELECT record_id, l_partkey, well_id, t_us, {sql.r6('l_extendedprice')} AS l_extendedprice,
  {sql.r6(f"median(l_extendedprice) OVER (PARTITION BY well_id ORDER BY t_us, record_id, l_partkey, l_quantity, l_extendedprice ROWS BETWEEN {_MEDIAN_ROWS - 1} PRECEDING AND CURRENT ROW)")} AS price_median
FROM readings""", "C9")
def rolling_median_wide(spark, d):
    """The median of each supplier's last 500 prices."""
    r = rolling_median(lineitem_readings(spark, d), "l_extendedprice", LINEITEM_SPEC, _MEDIAN_ROWS, "price_median")
    return r.select("record_id", "l_partkey", "well_id", "t_us", r6("l_extendedprice").alias("l_extendedprice"),
                    r6("price_median").alias("price_median"))


# ---------------------------------------------------------------- H1/H2-H6/H13: pages kept up to date by date

_PAGE_COLS = ["record_id", "t_us", "depth_ft", "value", "signal", "failure_type", "days_to_failure", "maintenance_required",
              "hours_since_last_maintenance", "cumulative_operating_hours"]


def _pages(spark, d):
    """States of all readings, appended in three batches that overlap in their dates."""
    readings, states = sinks.scratch_path(spark, "page-readings"), sinks.scratch_path(spark, "page-states")
    # read by every batch: labelled once, not once a batch
    rows = keep(events_labeled(spark, d).select("well_id", *_PAGE_COLS, F.to_date("timestamp").alias("reading_date")))
    for k in range(3):
        added = store.append_indexed(rows.where(F.col("record_id") % 3 <= k), readings, "record_id", ["t_us"], partition_by="reading_date")
        maintained.refresh(spark, readings, states, SPEC, _PAGE_COLS, "reading_date",
                           maintained.touched_dates(added.rows, "reading_date"))
    return spark.read.parquet(states)


SQL_STORED = sql.with_ctes(sql.events_readings(), sql.labeled(), "clean AS (SELECT * FROM labeled)")


@register("maintained_fleet_status", _sql_latest(SQL_STORED) + sql.status_select() + " FROM latest", "H1 H2 H3 H4")
def maintained_fleet_status(spark, d):
    """``fleet_status`` of the stored readings from states by date, after three appends."""
    return fleet.fleet_status(maintained.latest_state(_pages(spark, d), SPEC, _PAGE_COLS), SPEC)


@register("maintained_well_kpis", SQL_STORED.rstrip("\n") + f""",
n AS (SELECT *, row_number() OVER ({sql.ORDER}) AS _rn FROM clean)
SELECT well_id, arg_min(depth_ft, _rn) AS depth_ft, CAST(sum(maintenance_required) AS BIGINT) AS maintenance_events,
       {sql.r6('round(avg(value), 9)')} AS avg_pressure, {sql.r6('round(avg(signal), 9)')} AS avg_vibration, count(*) AS readings,
       avg(signal) > {SPEC.thresholds.vibration_limit} AS vibration_high
FROM n GROUP BY well_id""", "H13 H14")
def maintained_well_kpis(spark, d):
    """``well_kpis`` of the stored readings from states by date, after three appends. Means of sums by date may differ from means
    of all rows in a double's last place, so both are cut to nine places before they are rounded."""
    k = maintained.well_kpis(_pages(spark, d), SPEC)
    return k.select("well_id", "depth_ft", "maintenance_events", r6(F.round("avg_pressure", 9)).alias("avg_pressure"),
                    r6(F.round("avg_vibration", 9)).alias("avg_vibration"), "readings", "vibration_high")
