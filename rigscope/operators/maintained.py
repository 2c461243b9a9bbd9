"""Fleet pages from states by date, of which an append rebuilds only the dates it touched.

A state is one row for each machine and date: of every column the last non-null value with its place in the order
(time, record), the first depth with its place, and the sums and counts of the key figures. States of any dates merge by
the same aggregates, so a page reads (machines x dates) rows instead of all readings. States are partitions by date beside
the readings table: after an append the dates of the new rows are computed again from that table, whose other
partitions are not read, and overwritten, which a repeated or broken run may do as often as it likes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SensorSpec

_SUMS = "_sum_", "_n_"


def _place(spec: SensorSpec) -> Column:
    return F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(spec.order_cols)])


def day_states(readings: DataFrame, spec: SensorSpec, cols, date: str) -> DataFrame:
    """(machine, date, last value and place of each of ``cols``, first depth and place, sums): states of ``readings``."""
    cols = [c for c in cols if c not in (spec.entity, date)]
    place = _place(spec)
    last = {c: F.max(F.when(F.col(c).isNotNull(), F.struct(place.alias("at"), F.col(c).alias("v")))) for c in cols}
    figures = [f(F.col(c)).alias(f"{name}{c}") for c in dict.fromkeys((spec.pressure, spec.vibration)) for name, f in zip(_SUMS, (F.sum, F.count))]
    found = readings.groupBy(spec.entity, date).agg(
        *[x.alias(f"_last_{c}") for c, x in last.items()],
        F.min_by(F.col(spec.depth), place).alias("_first_depth"), F.min(place).alias("_first_at"),
        F.sum(F.col(spec.label)).cast("long").alias("_maintenance"), F.count(F.lit(1)).alias("_rows"), *figures)
    parts = [x for c in cols for x in (F.col(f"_last_{c}")["v"].alias(c), F.col(f"_last_{c}")["at"].alias(f"_at_{c}"))]
    return found.select(spec.entity, date, *parts, *[c for c in found.columns if c.startswith("_") and not c.startswith("_last_")])


def refresh(spark: SparkSession, readings_path: str, states_path: str, spec: SensorSpec, cols, date: str, dates) -> None:
    """Compute the states of ``dates`` (None among them: rows without a date) anew from the readings table."""
    known = [d for d in dates if d is not None]
    touched = F.col(date).isin(known) if known else F.lit(False)
    if len(known) < len(list(dates)):
        touched = touched | F.col(date).isNull()
    states = day_states(spark.read.parquet(readings_path).where(touched), spec, cols, date)
    (states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(states_path))


def touched_dates(rows: DataFrame, date: str) -> list:
    """Dates of an append: few, as a batch brings few."""
    return [r[0] for r in rows.select(date).distinct().collect()]


def latest_state(states: DataFrame, spec: SensorSpec, cols) -> DataFrame:
    """H1 from states."""
    cols = [c for c in cols if f"_at_{c}" in states.columns]
    return states.groupBy(spec.entity).agg(*[F.max_by(F.col(c), F.col(f"_at_{c}")).alias(c) for c in cols])


def well_kpis(states: DataFrame, spec: SensorSpec) -> DataFrame:
    """H13/H14 from states."""
    mean = lambda c: F.sum(f"_sum_{c}") / F.sum(f"_n_{c}")
    k = states.groupBy(spec.entity).agg(
        F.min_by("_first_depth", "_first_at").alias("depth_ft"), F.sum("_maintenance").alias("maintenance_events"),
        mean(spec.pressure).alias("avg_pressure"), mean(spec.vibration).alias("avg_vibration"), F.sum("_rows").alias("readings"))
    return k.withColumn("vibration_high", F.col("avg_vibration") > F.lit(spec.thresholds.vibration_limit))
