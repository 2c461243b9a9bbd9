"""Maintenance priority, days remaining, schedule-by date, workload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CRITICAL_DEFAULT_DAYS, NO_FAULT, PRIORITY_ACTIONS, PRIORITY_DAYS, SensorSpec
from ..functions.scalars import date_of_us, first_match, half_even, title_words

PRIORITIES = tuple(p for p, _ in PRIORITY_ACTIONS)


def priority_columns(spec: SensorSpec) -> dict:
    maint = F.col(spec.label) == 1
    critical = maint & (F.col(spec.fault) != F.lit(NO_FAULT))
    overdue = F.col(spec.counters[0]) > F.lit(spec.thresholds.overdue_hours)
    cases = [critical, maint, overdue]
    names = list(PRIORITIES)
    actions = dict(PRIORITY_ACTIONS)
    fixed_days = dict(PRIORITY_DAYS)
    days = first_match([
        (critical, F.coalesce(F.col(spec.days), F.lit(CRITICAL_DEFAULT_DAYS))),
        (maint, F.lit(fixed_days["High"])),
        (overdue, F.lit(fixed_days["Medium"])),
    ], F.lit(fixed_days["Low"]))
    return {
        "priority": first_match(list(zip(cases, names[:3])), names[3]),
        "priority_order": first_match(list(zip(cases, [0, 1, 2])), 3),
        "action": first_match([(c, actions[n]) for c, n in zip(cases, names[:3])], actions[names[3]]),
        "days": days,
    }


def schedule_date(now_us: Column, days: Column) -> Column:
    """The date of ``now + max(0, days)``."""
    shift = (F.greatest(days, F.lit(0.0)) * F.lit(86_400_000_000.0)).cast("long")
    return date_of_us(now_us + shift)


def schedule_by(now_us: Column, days: Column) -> Column:
    """That date as ``Mon DD, YYYY``."""
    return F.date_format(schedule_date(now_us, days), "MMM dd, yyyy")


def maintenance_schedule(latest: DataFrame, spec: SensorSpec, now_us: Column, wells=None) -> DataFrame:
    """One row per machine in scope, ordered by priority then machine."""
    src = latest if wells is None else latest.filter(F.col(spec.entity).isin(list(wells)))
    p = priority_columns(spec)
    return src.select(
        F.col(spec.entity).alias("well_id"),
        p["priority"].alias("priority"),
        p["priority_order"].alias("priority_order"),
        title_words(spec.fault).alias("fault_type"),
        p["action"].alias("action"),
        half_even(p["days"], 1).alias("days_remaining"),
        schedule_by(now_us, p["days"]).alias("schedule_by"),
        F.col(spec.counters[0]).cast("int").alias("hrs_since_service"),
        schedule_date(now_us, p["days"]).alias("schedule_date"),
    ).orderBy("priority_order", "well_id")


def priority_counts(schedule: DataFrame, spark: SparkSession) -> DataFrame:
    """Machines per priority, all four priorities present."""
    names = spark.createDataFrame([(n, i) for i, n in enumerate(PRIORITIES)], "priority string, priority_order int")
    counts = schedule.groupBy("priority").agg(F.count(F.lit(1)).alias("n_wells"))
    return (F.broadcast(names).join(counts, "priority", "left")
            .select("priority", "priority_order", F.coalesce("n_wells", F.lit(0)).cast("long").alias("n_wells"))
            .orderBy("priority_order"))


def workload(schedule: DataFrame, spec: SensorSpec) -> DataFrame:
    """Machines due per schedule date, for days remaining <= 30."""
    return (schedule.filter(F.col("days_remaining") <= F.lit(spec.thresholds.workload_days))
            .withColumnRenamed("schedule_date", "date")
            .groupBy("date").agg(F.count(F.lit(1)).alias("wells_due"))
            .select(F.date_format("date", "yyyy-MM-dd").alias("date"), "wells_due")
            .orderBy("date"))
