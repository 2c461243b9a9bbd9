"""Standardisation, deterministic split, split report, class weights, training subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SPLIT_SEED, TEST_FRACTION, SensorSpec
from .quantiles import smallest_share


def fit_scaler(df: DataFrame, cols):
    """Mean and population std per column (nulls ignored); a zero std divides by 1.
    One global aggregate with map-side partials; the result is 2 numbers per column."""
    row = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        s = row[f"s_{i}"]
        out[c] = (row[f"m_{i}"], 1.0 if (s is None or s == 0.0) else s)
    return out


def apply_scaler(df: DataFrame, stats: dict, suffix: str = "") -> DataFrame:
    """``(x - mean) / std`` with the fitted numbers as literals (no join)."""
    return df.withColumns({
        f"{c}{suffix}": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()
    })


def split_flag(record: str, seed: int = SPLIT_SEED, test_fraction: float = TEST_FRACTION) -> Column:
    """D3: deterministic hash split; true = test.  ``md5(id ':' seed)`` below the cut-off hex prefix."""
    cut = format(int(test_fraction * 16 ** 8), "08x")
    return F.md5(F.concat(F.col(record).cast("string"), F.lit(f":{seed}"))) < F.lit(cut)


def with_split(df: DataFrame, spec: SensorSpec) -> DataFrame:
    return df.withColumn("split", F.when(split_flag(spec.record), F.lit("test")).otherwise(F.lit("train")))


def with_stratified_split(df: DataFrame, spec: SensorSpec, seed: int = SPLIT_SEED,
                          test_fraction: float = TEST_FRACTION) -> DataFrame:
    """D3, stratified: of each label the floor(fraction * n) rows with the smallest ``md5(id ':' seed)`` are test rows. The
    cut of each label is an exact order statistic of the hash's first 52 bits (two labels, found in the same passes),
    so no label's rows meet in one task. Rows without a label are training rows."""
    digest = F.md5(F.concat(F.col(spec.record).cast("string"), F.lit(f":{seed}")))
    place = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    labels = [r[0] for r in df.select(spec.label).distinct().collect() if r[0] is not None]
    cuts = smallest_share(df, [F.when(F.col(spec.label) == y, place) for y in labels], test_fraction)
    test = F.lit(False)
    for y, cut in zip(labels, cuts):
        if cut is not None:
            test = test | ((F.col(spec.label) == y) & (place <= F.lit(cut)))
    return df.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train")))


def split_report(df: DataFrame, spec: SensorSpec) -> DataFrame:
    """Rows and positive rate per split."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                   F.avg(F.col(spec.label).cast("double")).alias("positive_rate"))


def class_weights(df: DataFrame, spec: SensorSpec) -> DataFrame:
    """Balanced weights n / (k * n_c) and the positive-class weight n0 / n1."""
    counts = df.groupBy(spec.label).agg(F.count(F.lit(1)).alias("n_c"))
    # a window over the per-class table: as many rows as label values
    everything = Window.partitionBy()
    n = F.sum("n_c").over(everything)
    k = F.count(F.lit(1)).over(everything)
    n0 = F.sum(F.when(F.col(spec.label) == 0, F.col("n_c"))).over(everything)
    n1 = F.sum(F.when(F.col(spec.label) == 1, F.col("n_c"))).over(everything)
    return counts.select(spec.label, "n_c", (n / (k * F.col("n_c"))).alias("weight"), (n0 / n1).alias("pos_weight"))


def normal_rows(df: DataFrame, spec: SensorSpec) -> DataFrame:
    """D6."""
    return df.filter(F.col(spec.label) == 0)


def near_failure_rows(df: DataFrame, spec: SensorSpec) -> DataFrame:
    """Days known and below the regressor horizon."""
    return df.filter(F.col(spec.days).isNotNull() & (F.col(spec.days) < F.lit(spec.thresholds.regressor_horizon_days)))


def subset_counts(df: DataFrame, spec: SensorSpec) -> DataFrame:
    """D6 + D7 sizes per split in one aggregate."""
    near = F.col(spec.days).isNotNull() & (F.col(spec.days) < F.lit(spec.thresholds.regressor_horizon_days))
    return df.groupBy("split").agg(F.sum((F.col(spec.label) == 0).cast("long")).alias("normal_rows"),
                                   F.sum(near.cast("long")).alias("near_failure_rows"))
