"""Per-machine window features in time order, and the feature vector."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SensorSpec
from .sequence import CHUNK, DEFAULT_LAYOUT, SEQ, Layout, chunk_window, ensure_layout, frame, strip

SHORT = 4     # rows in the short rolling frames
TREND = 24    # rows in the slope frame


def rolling(c, fn: str, spec: SensorSpec, rows: int, min_rows: int = 1):
    """``fn`` over the last ``rows`` rows of the machine (current included), NULL below ``min_rows``."""
    w = frame(spec, -(rows - 1), 0)
    x = F.col(c)
    agg = {
        "mean": F.avg(x), "std": F.stddev_samp(x), "max": F.max(x), "min": F.min(x),
        "median": F.percentile(x, 0.5), "sum": F.sum(x),
        "slope": F.regr_slope(x, F.col(SEQ).cast("double")),
    }[fn].over(w)
    return F.when(F.count(x).over(w) >= F.lit(min_rows), agg) if min_rows > 1 else agg


def rolling_median(df: DataFrame, c: str, spec: SensorSpec, rows: int, out: str, min_rows: int = 1,
                   layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """``out`` is the median of the non-null values of ``c`` among the last ``rows`` rows of the machine (current included),
    NULL below ``min_rows`` values.

    Rows of a (machine, chunk) arrive in order, in Arrow batches. The window is kept sorted across batches: a row's value is put
    in, the one that leaves is taken out, both by binary search, so a wide window costs hardly more than a narrow
    one, and a task holds one batch and one window. NaN counts as missing."""
    d, created = ensure_layout(df, spec, rows - 1, layout)
    schema = T.StructType([*d.schema.fields, T.StructField(out, T.DoubleType())])
    keys = [d.columns.index(k) for k in (spec.entity, CHUNK)]
    place = d.columns.index(c)

    def medians(batches):
        now, recent, ordered = None, deque(), []
        for batch in batches:
            found = []
            for *key, x in zip(*(batch.column(k).to_pylist() for k in keys), batch.column(place).to_pylist()):
                if key != now:
                    now, recent, ordered = key, deque(), []
                x = None if x is None or x != x else float(x)
                recent.append(x)
                if x is not None:
                    insort(ordered, x)
                if len(recent) > rows:
                    gone = recent.popleft()
                    if gone is not None:
                        del ordered[bisect_left(ordered, gone)]
                n = len(ordered)
                low, high = (ordered[(n - 1) // 2], ordered[n // 2]) if n else (None, None)
                found.append(None if n < max(1, min_rows) else low if low == high else low + 0.5 * (high - low))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, out])

    near = d.repartition(spec.entity, CHUNK).sortWithinPartitions(spec.entity, CHUNK, SEQ)
    filled = near.mapInArrow(medians, schema)
    return strip(filled) if created else filled


def engineer_features(df: DataFrame, spec: SensorSpec, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """C2-C8, all on one ``(machine, chunk)`` partitioning ordered by position."""
    d, created = ensure_layout(df, spec, TREND - 1, layout)
    p, v, t = spec.pressure, spec.vibration, spec.temperature
    d = d.withColumns({
        "pressure_rolling_mean": rolling(p, "mean", spec, SHORT),
        "pressure_rolling_std": F.coalesce(rolling(p, "std", spec, SHORT), F.lit(0.0)),
        "vibration_rolling_max": rolling(v, "max", spec, SHORT),
        "temp_rolling_mean": rolling(t, "mean", spec, SHORT),
        "pressure_change_rate": F.coalesce(F.col(p) - F.lag(p).over(chunk_window(spec)), F.lit(0.0)),
        "vibration_trend": F.coalesce(rolling(v, "slope", spec, TREND, 2), F.lit(0.0)),
        "maintenance_age_ratio": F.col(spec.counters[0]) / F.lit(spec.thresholds.age_divisor_hours),
    })
    return strip(d) if created else d


def feature_columns(df: DataFrame, spec: SensorSpec) -> list:
    """The feature order, skipping absent columns."""
    return [c for c in spec.features if c in df.columns]


def assembler(cols, out: str = "features"):
    """The stage that puts ``cols`` into one vector. A missing value is an error: callers drop such rows (fits) or
    fill them (scores)."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error")


def assemble(df: DataFrame, spec: SensorSpec, out: str = "features") -> DataFrame:
    """The feature vector, missing features as 0."""
    cols = feature_columns(df, spec)
    return assembler(cols, out).transform(df.na.fill(0.0, subset=cols))
