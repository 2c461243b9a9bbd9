"""Failure labels and usage counters derived from the event history of each machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import NO_FAULT, SensorSpec
from ..functions.scalars import days_between_us, hours_between_us
from .sequence import DEFAULT_LAYOUT, Layout, add_context, carry_scans, ensure_layout, home_rows, strip


def derive_labels(df: DataFrame, spec: SensorSpec, layout: Layout = DEFAULT_LAYOUT,
                  horizon_days: float | None = None) -> DataFrame:
    """Add ``days_to_failure`` (to the next failure at or after the row, NULL if none),
    ``maintenance_required`` (next failure within the horizon), ``next_failure_us``, ``hours_since_last_maintenance``
    (since the last failure at or before the row, else since the first reading) and
    ``cumulative_operating_hours`` (since the first reading)."""
    horizon = spec.thresholds.label_horizon_days if horizon_days is None else horizon_days
    d, created = ensure_layout(df, spec, 0, layout)
    # unbounded carries are exact on home rows only: drop context copies, derive, then copy again
    d = home_rows(d)
    failure_us = F.when(F.col(spec.fault) != F.lit(NO_FAULT), F.col(spec.time_us))
    # time leads the row order, so the first reading's time is the entity's minimum time
    d = carry_scans(d, spec, running_max=[(failure_us, "_last_fail_us")],
                    running_min_after=[(failure_us, "_next_fail_us")],
                    entity_min=[(F.col(spec.time_us), "_first_us")])
    days = days_between_us("_next_fail_us", spec.time_us)
    d = d.withColumns({
        spec.days: days,
        spec.label: F.coalesce((days <= F.lit(horizon)).cast("int"), F.lit(0)),
        spec.counters[0]: hours_between_us(spec.time_us, F.coalesce("_last_fail_us", "_first_us")),
        spec.counters[1]: hours_between_us(spec.time_us, "_first_us"),
    }).withColumnRenamed("_next_fail_us", "next_failure_us").drop("_last_fail_us", "_first_us")
    return strip(d) if created else add_context(d)
