"""Rolling-median imputation, global-median fallback, null counts, dedup, zero fill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SensorSpec
from .cache import keep
from .quantiles import approx_quantiles, exact_quantiles
from .sequence import CHUNK, DEFAULT_LAYOUT, Layout, ensure_layout, frame, home_rows, known_complete, strip

WINDOW_ROWS = 24


def rolling_median_fill(df: DataFrame, spec: SensorSpec, cols=None, layout: Layout = DEFAULT_LAYOUT,
                        exact: bool = True, persist: bool = True, complete=()) -> DataFrame:
    """B1 + B2. A null becomes the median of the non-null raw values among the last 24 rows of its
    machine (current row included); what is still null becomes the column median after that step.
    ``complete``: columns known to hold no null (e.g. counters derived by ``derive_labels``)."""
    skip = set(complete) | set(known_complete(df))
    cols = [c for c in (cols or spec.impute_cols) if c not in skip]
    if not cols:
        return df
    if CHUNK not in df.columns:
        # B1/B2 only change nulls: one column-pruned count decides which columns need the windows at all
        have = df.agg(*[F.count(F.when(F.col(c).isNull(), F.lit(1))).alias(c) for c in cols]).first()
        cols = [c for c in cols if have[c] > 0]
        if not cols:
            return df
    d, created = ensure_layout(df, spec, WINDOW_ROWS - 1, layout)
    w = frame(spec, -(WINDOW_ROWS - 1), 0)
    def filled(c):
        # the frame's values are collected (24 at most) and sorted only for a row whose own value is missing
        values = F.when(F.col(c).isNull(), F.sort_array(F.collect_list(F.col(c)).over(w)))
        n = F.size(values)
        low, high = F.get(values, F.floor((n - 1) / 2).cast("int")), F.get(values, F.floor(n / 2).cast("int"))
        return F.coalesce(F.col(c), low + 0.5 * (high - low)).alias(c)

    d = d.select(*[filled(c) if c in cols else F.col(c) for c in d.columns])
    if persist:
        d = keep(d)
    base = home_rows(d)
    # B2 only where B1 left gaps (the null check rides on the quantile's first pass)
    medians = (exact_quantiles(base, cols, 0.5, only_with_nulls=True) if exact
               else approx_quantiles(base, cols, 0.5))
    need = [c for c in cols if medians.get(c) is not None]
    d = d.select(*[
        F.coalesce(F.col(c), F.lit(medians[c]).cast("double")).alias(c) if c in need else F.col(c)
        for c in d.columns
    ])
    return strip(d) if created else d


def null_counts(df: DataFrame, cols) -> DataFrame:
    """One row, ``<col>`` = number of nulls, plus ``total_nulls``."""
    exprs = [F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols]
    out = df.agg(*exprs)
    return out.withColumn("total_nulls", sum((F.col(c) for c in cols), F.lit(0)).cast("long"))


def keep_first(df: DataFrame, key, order_cols) -> DataFrame:
    """Keep the first row of each key by ``order_cols``. An aggregate (``min_by``), so
    copies of one key collapse map-side instead of meeting in one task."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(c) for c in order_cols])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), ordering).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def zero_fill(df: DataFrame, cols) -> DataFrame:
    """B5."""
    return df.na.fill(0.0, subset=list(cols))
