"""Shared lazy frames: readings → labels → imputed sensors → features, on one skew-safe layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import EVENTS_SPEC, LINEITEM_SPEC, SensorSpec
from ..operators.features import TREND, engineer_features
from ..operators.impute import WINDOW_ROWS, rolling_median_fill
from ..operators.labels import derive_labels
from ..operators.sequence import DEFAULT_LAYOUT, Layout, lay_out, strip
from ..sources.adapters import events_readings, lineitem_readings

# imputation (24 rows) feeds features (24 rows): home rows need 23 + 23 rows of context
CHAIN_LOOKBACK = (WINDOW_ROWS - 1) + (TREND - 1)


def labeled(readings: DataFrame, spec: SensorSpec, layout: Layout = DEFAULT_LAYOUT,
            force_chunks: bool = False) -> DataFrame:
    """Laid-out readings with labels and counters (layout columns kept)."""
    return derive_labels(lay_out(readings, spec, CHAIN_LOOKBACK, layout, force_chunks), spec)


def featurized(laid: DataFrame, spec: SensorSpec, cols=None, exact: bool = True) -> DataFrame:
    """Imputed + engineered, layout stripped.  The counters come from ``derive_labels`` and are never null."""
    d = rolling_median_fill(laid, spec, cols=cols, exact=exact, complete=spec.counters)
    return strip(engineer_features(d, spec))


def events_labeled(spark: SparkSession, sf_dir: str, layout: Layout = DEFAULT_LAYOUT,
                   force_chunks: bool = False) -> DataFrame:
    return strip(labeled(events_readings(spark, sf_dir), EVENTS_SPEC, layout, force_chunks))


def events_features(spark: SparkSession, sf_dir: str, layout: Layout = DEFAULT_LAYOUT, exact: bool = True,
                    force_chunks: bool = False) -> DataFrame:
    return featurized(labeled(events_readings(spark, sf_dir), EVENTS_SPEC, layout, force_chunks), EVENTS_SPEC,
                      exact=exact)


def lineitem_features(spark: SparkSession, sf_dir: str, layout: Layout = DEFAULT_LAYOUT, exact: bool = True) -> DataFrame:
    spec = LINEITEM_SPEC
    laid = lay_out(lineitem_readings(spark, sf_dir), spec, CHAIN_LOOKBACK, layout)
    laid = derive_labels(laid, spec)
    return featurized(laid, spec, cols=spec.sensors, exact=exact)
