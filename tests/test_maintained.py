"""States by date equal the full computation after every append, and an append touches its own dates only."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from rigscope.config import EVENTS_SPEC as SPEC
from rigscope.operators import fleet, maintained

COLS = ["record_id", "t_us", "depth_ft", "value", "signal", "failure_type", "maintenance_required"]
SCHEMA = ("well_id string, record_id long, t_us long, depth_ft int, value double, signal double, failure_type string, "
          "maintenance_required int, day date")


def _rows(rng, ids):
    out = []
    for k in ids:
        t = rng.randrange(12)
        out.append((rng.choice(["a", "a", "b", None]), k, t, rng.choice([None, 5, 7]), rng.choice([None, rng.random()]), rng.choice([None, 2.0]),
                    rng.choice(["none", "pump_failure", None]), rng.choice([0, 1, None]), rng.choice([dt.date(2024, 1, 1 + t // 3), None])))
    return out


def _set(df):
    return sorted(map(str, df.collect()))


def test_states_equal_full_computation_after_each_append(spark, scratch):
    rng = random.Random(2)
    readings, states = f"{scratch}/r", f"{scratch}/s"
    for n in range(3):
        batch = spark.createDataFrame(_rows(rng, range(n * 60, n * 60 + 60)), SCHEMA)
        batch.write.mode("append").partitionBy("day").parquet(readings)
        maintained.refresh(spark, readings, states, SPEC, COLS, "day", maintained.touched_dates(batch, "day"))
        whole, kept = spark.read.parquet(readings), spark.read.parquet(states)
        assert _set(maintained.latest_state(kept, SPEC, COLS)) == _set(fleet.latest_state(whole, SPEC, COLS))
        got, want = (f.select("well_id", "depth_ft", "maintenance_events", F.round("avg_pressure", 9), "avg_vibration", "readings",
                              "vibration_high") for f in (maintained.well_kpis(kept, SPEC), fleet.well_kpis(whole, SPEC)))
        assert _set(got) == _set(want)


def test_an_append_rewrites_its_dates_only(spark, scratch):
    readings, states = f"{scratch}/r", f"{scratch}/s"
    def row(k, day):
        return ("a", k, k, 1, 1.0, 1.0, "none", 0, dt.date(2024, 1, day))
    spark.createDataFrame([row(1, 1), row(2, 2)], SCHEMA).write.partitionBy("day").parquet(readings)
    maintained.refresh(spark, readings, states, SPEC, COLS, "day", [dt.date(2024, 1, 1), dt.date(2024, 1, 2)])
    first = {d: os.listdir(f"{states}/{d}") for d in os.listdir(states) if d.startswith("day=")}
    more = spark.createDataFrame([row(3, 2)], SCHEMA)
    more.write.mode("append").partitionBy("day").parquet(readings)
    maintained.refresh(spark, readings, states, SPEC, COLS, "day", maintained.touched_dates(more, "day"))
    assert os.listdir(f"{states}/day=2024-01-01") == first["day=2024-01-01"]
    assert os.listdir(f"{states}/day=2024-01-02") != first["day=2024-01-02"]
    assert [r.record_id for r in maintained.latest_state(spark.read.parquet(states), SPEC, COLS).collect()] == [3]


def test_batches_read_rows_that_are_labelled_once(spark):
    from conftest import SF001
    from rigscope.operators import cache
    from rigscope.plans import catalog

    cache.release()
    states = catalog._pages(spark, SF001)
    assert any({"well_id", "reading_date", *catalog._PAGE_COLS} == set(f.columns) for f in cache._KEPT)
    whole = catalog.events_labeled(spark, SF001)
    assert _set(maintained.latest_state(states, SPEC, catalog._PAGE_COLS)) == _set(fleet.latest_state(
        whole.select("well_id", *catalog._PAGE_COLS), SPEC))
