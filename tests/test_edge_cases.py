"""Hand-written edge rows (FIXTURES §4)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rigscope.config import SensorSpec
from rigscope.operators import alerts, evaluate, fleet, schedule
from rigscope.operators.features import engineer_features
from rigscope.operators.impute import keep_first, rolling_median_fill
from rigscope.operators.prepare import apply_scaler, fit_scaler
from rigscope.operators.score import decisions
from rigscope.sources import sinks

H = 3_600_000_000
SPEC = SensorSpec(sensors=("p", "v", "t"), counters=("hours_since_last_maintenance", "cumulative_operating_hours"),
                  pressure="p", vibration="v", temperature="t",
                  ranges=(("p", 0.0, 10.0, "P"), ("v", 0.0, 3.5, "V"), ("t", 0.0, 10.0, "T")))
SCHEMA = ("record_id long, well_id string, t_us long, p double, v double, t double, "
          "hours_since_last_maintenance double, cumulative_operating_hours double")


def readings(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df, col):
    return {r["record_id"]: r[col] for r in df.select("record_id", col).collect()}


def test_head_nulls_and_whole_null_well_use_global_median(spark):
    rows = [(1, "A", 0, None, 1.0, 1.0, 0.0, 0.0), (2, "A", H, 4.0, 1.0, 1.0, 0.0, 0.0),
            (3, "A", 2 * H, 6.0, 1.0, 1.0, 0.0, 0.0), (4, "B", 0, None, 1.0, 1.0, 0.0, 0.0),
            (5, "B", H, None, 1.0, 1.0, 0.0, 0.0), (6, "C", 0, 10.0, 1.0, 1.0, 0.0, 0.0)]
    out = by_id(rolling_median_fill(readings(spark, rows), SPEC), "p")
    # after B1 the non-null values are {4, 6, 10}; their median 6 fills the rest
    assert out[2] == 4.0 and out[3] == 6.0 and out[6] == 10.0
    assert out[1] == 6.0 and out[4] == 6.0 and out[5] == 6.0


def test_window_median_then_fallback_after_24_nulls(spark):
    rows = [(i, "A", i * H, (float(i) if i < 3 else None), 1.0, 1.0, 0.0, 0.0) for i in range(30)]
    out = by_id(rolling_median_fill(readings(spark, rows), SPEC), "p")
    assert out[3] == 1.0               # median of raw 0, 1, 2
    assert out[25] == 2.0              # window rows 2..25 hold only the raw 2
    assert out[26] == 1.0 and out[29] == 1.0  # no raw value in the window → global median after B1


def test_one_row_well_features_are_zero(spark):
    rows = [(1, "A", 0, 5.0, 2.0, 3.0, 10.0, 0.0)]
    f = engineer_features(readings(spark, rows), SPEC).first()
    assert f["pressure_rolling_std"] == 0.0 and f["pressure_change_rate"] == 0.0 and f["vibration_trend"] == 0.0
    assert f["maintenance_age_ratio"] == pytest.approx(10.0 / 720.0)


def test_duplicate_record_keeps_first(spark):
    rows = [(7, "A", 2 * H, 1.0, 1.0, 1.0, 0.0, 0.0), (7, "A", H, 9.0, 1.0, 1.0, 0.0, 0.0)]
    out = keep_first(readings(spark, rows), "record_id", ["t_us"]).collect()
    assert len(out) == 1 and out[0]["p"] == 9.0


def test_null_key_is_reported(spark):
    rows = [(1, None, 0, 1.0, 1.0, 1.0, 0.0, 0.0), (2, "A", 0, 1.0, 1.0, 1.0, 0.0, 0.0),
            (2, "A", H, 1.0, 1.0, 1.0, 0.0, 0.0)]
    r = sinks.key_report(readings(spark, rows), "well_id").first()
    assert r["null_keys"] == 1
    r2 = sinks.key_report(readings(spark, rows), "record_id").first()
    assert r2["duplicate_rows"] == 1 and r2["duplicated_keys"] == 1


STATE_SCHEMA = ("record_id long, well_id string, t_us long, p double, v double, t double, maintenance_required int, "
                "failure_type string, days_to_failure double, hours_since_last_maintenance double")


def test_latest_state_skips_null_and_cascade(spark):
    rows = [(1, "A", 0, 1.0, 1.0, 1.0, 1, "pump_failure", 5.0, 10.0),
            (2, "A", H, 1.0, 1.0, 1.0, 1, "pump_failure", None, 11.0),
            (3, "B", 0, 1.0, 1.0, 1.0, 1, "none", None, 700.0),
            (4, "C", 0, 1.0, 1.0, 1.0, 0, "none", None, 650.0),
            (5, "D", 0, 1.0, 1.0, 1.0, 0, "none", None, 650.5)]
    df = spark.createDataFrame(rows, STATE_SCHEMA)
    latest = fleet.latest_state(df, SPEC)
    a = latest.filter("well_id = 'A'").first()
    assert a["days_to_failure"] == 5.0 and a["record_id"] == 2
    st = {r["well_id"]: r for r in fleet.fleet_status(latest, SPEC).collect()}
    assert st["A"]["status"] == "CRITICAL" and st["A"]["issue"].startswith("Active Pump Failure")
    assert st["B"]["status"] == "WARNING" and st["B"]["issue"].startswith("Sensors suggest")
    assert st["C"]["status"] == "OK" and st["D"]["status"] == "WARNING"
    assert st["D"]["issue"] == "No service in 650 hrs — routine inspection recommended"  # 650.5 → half-even 650
    sch = {r["well_id"]: r for r in schedule.maintenance_schedule(latest, SPEC, F.lit(0)).collect()}
    assert sch["A"]["priority"] == "Critical" and sch["A"]["days_remaining"] == 5.0
    assert sch["A"]["schedule_by"] == "Jan 06, 1970"
    assert sch["B"]["priority"] == "High" and sch["D"]["priority"] == "Medium" and sch["C"]["priority"] == "Low"


PRED_SCHEMA = ("well_id string, record_id long, t_us long, confidence_score double, days_raw double, "
               "anomaly_score double")


def test_alert_and_decision_edges(spark):
    rows = [("A", 1, 0, 0.5, 3.0, 1.0), ("B", 2, 0, 0.9, 7.0, 2.0), ("C", 3, 0, 0.9, 7.01, 3.0),
            ("D", 4, 0, 0.49, 1.0, 0.5)]
    d = decisions(spark.createDataFrame(rows, PRED_SCHEMA), SPEC, threshold=2.0)
    got = {r["well_id"]: r for r in d.collect()}
    assert got["A"]["predicted_failure"] == 1 and got["D"]["predicted_failure"] == 0
    assert got["B"]["is_anomaly"] is False and got["C"]["is_anomaly"] is True
    al = {r["well_id"]: r for r in alerts.alert_rows(d, SPEC).collect()}
    assert al["A"]["severity"] == "critical" and al["B"]["severity"] == "high" and "C" not in al
    assert al["A"]["message"] == "Well A: Predicted failure in 3.0 days (confidence: 50%)"


def test_constant_sensor_scales_to_zero(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 4.0)], "record_id long, x double")
    z = apply_scaler(df, fit_scaler(df, ["x"]), suffix="_z")
    assert [r["x_z"] for r in z.collect()] == [0.0, 0.0]


def test_gap_month_is_zero(spark):
    rows = [(1, "A", dt.datetime(2024, 1, 5), 1), (2, "A", dt.datetime(2024, 3, 5), 1),
            (3, "A", dt.datetime(2024, 2, 5), 0)]
    df = spark.createDataFrame(rows, "record_id long, well_id string, timestamp timestamp_ntz, maintenance_required int")
    m = [(r["month"], r["events"]) for r in fleet.monthly_maintenance(df, SPEC).collect()]
    assert m == [("2024-01-31", 1), ("2024-02-29", 0), ("2024-03-31", 1)]


def test_window_end_is_midnight_unless_inclusive(spark):
    rows = [(1, "A", dt.datetime(2024, 1, 2, 0, 0)), (2, "A", dt.datetime(2024, 1, 2, 6, 0))]
    df = spark.createDataFrame(rows, "record_id long, well_id string, timestamp timestamp_ntz")
    assert fleet.window_filter(df, SPEC, "2024-01-01", "2024-01-02").count() == 1
    assert fleet.window_filter(df, SPEC, "2024-01-01", "2024-01-02", inclusive_end=True).count() == 2


def test_all_tied_scores_auc_half(spark):
    df = spark.createDataFrame([(0, 0.3), (1, 0.3), (0, 0.3), (1, 0.3)], "y int, s double")
    assert evaluate.auc(df, "y", "s") == pytest.approx(0.5)


def test_two_writes_of_same_key_keep_one_row(spark, scratch):
    path = f"{scratch}/readings"
    df = spark.createDataFrame([(1, "A"), (1, "A"), (2, "B")], "record_id long, well_id string")
    sinks.append_new(df, path, "record_id", ["well_id"])
    sinks.append_new(df, path, "record_id", ["well_id"])
    assert spark.read.parquet(path).count() == 2


def test_rolling_median_of_any_width(spark):
    """Against a plain sorted window; nulls, NaN, ties, machines without a name, and windows cut over chunks."""
    import random

    from rigscope.config import EVENTS_SPEC
    from rigscope.operators.features import rolling_median
    from rigscope.operators.sequence import Layout

    rng = random.Random(3)
    rows = []
    for k in range(900):
        x = rng.choice([None, float("nan"), float(rng.randrange(8)), rng.gauss(0, 1e6), float("inf")])
        rows.append((k, rng.choice(["a", "a", "a", "b", None]), k // 3, x))
    df = spark.createDataFrame(rows, "record_id long, well_id string, t_us long, value double").repartition(5)
    for width, least in ((1, 1), (7, 3), (200, 1)):
        expected = {}
        for w in ("a", "b", None):
            mine = [r for r in rows if r[1] == w]
            for i, r in enumerate(mine):
                seen = sorted(x[3] for x in mine[max(0, i - width + 1):i + 1] if x[3] is not None and x[3] == x[3])
                mid = None
                if len(seen) >= max(1, least):
                    low, high = seen[(len(seen) - 1) // 2], seen[len(seen) // 2]
                    mid = low if low == high else low + 0.5 * (high - low)
                expected[r[0]] = mid
        for layout in (Layout(), Layout(chunk_rows=60, range_partitions=4)):
            got = rolling_median(df, "value", EVENTS_SPEC, width, "m", least, layout).collect()
            assert {r.record_id: r.m for r in got} == expected and len(got) == len(rows)
