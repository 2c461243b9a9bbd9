"""B1/B2 and C2-C8 on random data with nulls, against their definitions computed row by row."""

import math
import random
import statistics

import pytest

from rigscope.config import SensorSpec
from rigscope.operators.features import engineer_features
from rigscope.operators.impute import rolling_median_fill

SPEC = SensorSpec(sensors=("p", "v", "t"), pressure="p", vibration="v", temperature="t")
COLS = ["p", "v", "t", "hours_since_last_maintenance", "cumulative_operating_hours"]


def by_definition(rows):
    """One pass over each machine's rows in order, looking back over explicit lists."""
    machines = {}
    for r in sorted(rows, key=lambda r: (r["t_us"], r["record_id"])):
        machines.setdefault(r["well_id"], []).append(dict(r))
    for series in machines.values():
        for c in COLS:
            raw = [r[c] for r in series]
            for k, r in enumerate(series):
                seen = [x for x in raw[max(0, k - 23):k + 1] if x is not None]
                if r[c] is None and seen:
                    r[c] = statistics.median(seen)
    for c in COLS:
        known = [r[c] for s in machines.values() for r in s if r[c] is not None]
        for r in (r for s in machines.values() for r in s if r[c] is None):
            r[c] = statistics.median(known)
    for series in machines.values():
        for k, r in enumerate(series):
            last4, last24 = series[max(0, k - 3):k + 1], series[max(0, k - 23):k + 1]
            r["pressure_rolling_mean"] = math.fsum(x["p"] for x in last4) / len(last4)
            r["pressure_rolling_std"] = statistics.stdev([x["p"] for x in last4]) if len(last4) > 1 else 0.0
            r["vibration_rolling_max"] = max(x["v"] for x in last4)
            r["temp_rolling_mean"] = math.fsum(x["t"] for x in last4) / len(last4)
            r["pressure_change_rate"] = r["p"] - series[k - 1]["p"] if k else 0.0
            n = len(last24)      # least squares over places 0..n-1: Σ (i - mid) v_i / Σ (i - mid)², the latter (n³ - n) / 12
            mid = (n - 1) / 2
            r["vibration_trend"] = (math.fsum((i - mid) * x["v"] for i, x in enumerate(last24)) * 12 / (n ** 3 - n)
                                    if n > 1 else 0.0)
            r["maintenance_age_ratio"] = r["hours_since_last_maintenance"] / 720.0
    return {r["record_id"]: r for s in machines.values() for r in s}


def test_against_definitions(spark):
    rng = random.Random(11)
    times = rng.sample(range(900), 900)
    rows = []
    for k in range(900):
        gap = lambda x, share=0.15: None if rng.random() < share else x
        rows.append({"record_id": k, "well_id": rng.choice(["W1", "W2", "W3", "W4"]), "t_us": times[k] * 21_600_000_000,
                     "p": None if k < 40 else gap(rng.gauss(1000, 50)), "v": gap(rng.gammavariate(2, 1)), "t": gap(rng.gauss(185, 5)),
                     "hours_since_last_maintenance": gap(rng.uniform(0, 700)),
                     "cumulative_operating_hours": gap(rng.uniform(0, 9000), 0)})
    schema = "record_id long, well_id string, t_us long, " + ", ".join(f"{c} double" for c in COLS)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    want = by_definition(rows)
    got = engineer_features(rolling_median_fill(df, SPEC), SPEC).collect()
    assert len(got) == len(want)
    for r in got:
        for c, x in want[r["record_id"]].items():
            assert r[c] == (x if isinstance(x, str) else pytest.approx(x, rel=1e-9, abs=1e-9)), (r["record_id"], c)
