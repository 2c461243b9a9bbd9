"""Score columns, anomaly threshold and flags.

The scoring chain is model-agnostic: a model contributes a probability column,
a raw days column and a reconstruction (or directly a score); the decisions
below are plain column expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SensorSpec
from ..functions.scalars import clip
from .quantiles import exact_quantiles


def reconstruction_error(x_cols, xhat_cols) -> Column:
    """Mean over features of (x - x̂)²."""
    terms = [(F.col(a) - F.col(b)) ** 2 if isinstance(b, str) else (F.col(a) - b) ** 2
             for a, b in zip(x_cols, xhat_cols)]
    return reduce(lambda a, b: a + b, terms) / F.lit(float(len(terms)))


def anomaly_threshold(scores: DataFrame, col: str = "anomaly_score", q: float = 0.95, exact: bool = True) -> float:
    """Q-quantile (linear interpolation) of the normal training scores."""
    if exact:
        return exact_quantiles(scores, [col], q)[col]
    return scores.agg(F.percentile_approx(col, q, 100_000)).first()[0]


def decisions(df: DataFrame, spec: SensorSpec, threshold: float, prob: str = "confidence_score",
              days_raw: str = "days_raw", score: str = "anomaly_score") -> DataFrame:
    """Anomaly flag (strictly above), clipped days, binary decision (>=)."""
    lo, hi = spec.thresholds.days_clip
    return df.withColumns({
        "predicted_failure": (F.col(prob) >= F.lit(spec.thresholds.probability)).cast("int"),
        "days_to_failure_pred": clip(days_raw, lo, hi),
        "is_anomaly": F.col(score) > F.lit(threshold),
    })


def prediction_rows(df: DataFrame, spec: SensorSpec) -> DataFrame:
    """The 8 prediction columns."""
    when = [spec.time] if spec.time in df.columns else []
    return df.select(spec.entity, spec.record, *when, spec.time_us, "predicted_failure", "confidence_score",
                     "days_to_failure_pred", "anomaly_score", "is_anomaly")
