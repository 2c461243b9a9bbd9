"""The skew-safe layout must give the same answers as one window per machine; exact quantiles as numpy."""

import numpy as np
import pandas as pd
import pytest

from rigscope.operators.quantiles import exact_quantiles
from rigscope.operators.sequence import Layout
from rigscope.plans.frames import events_features, lineitem_features
from conftest import SF001


def _pdf(df, key):
    return df.toPandas().sort_values(key).reset_index(drop=True)


@pytest.mark.parametrize("chunk,parts", [(7, 3), (40, 16)])
def test_chunked_equals_single(spark, chunk, parts):
    a = _pdf(events_features(spark, SF001), "record_id")
    b = _pdf(events_features(spark, SF001, layout=Layout(chunk_rows=chunk, range_partitions=parts),
                             force_chunks=True), "record_id")
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9, atol=1e-9)


def test_lineitem_ties_chunked(spark):
    from rigscope.config import LINEITEM_SPEC
    from rigscope.operators.labels import derive_labels
    from rigscope.operators.sequence import lay_out, strip
    from rigscope.sources.adapters import lineitem_readings
    from rigscope.operators.features import engineer_features

    r = lineitem_readings(spark, SF001)
    one = strip(engineer_features(derive_labels(lay_out(r, LINEITEM_SPEC, 46), LINEITEM_SPEC), LINEITEM_SPEC))
    many = strip(engineer_features(derive_labels(
        lay_out(r, LINEITEM_SPEC, 46, Layout(chunk_rows=50, range_partitions=5), force_chunks=True),
        LINEITEM_SPEC), LINEITEM_SPEC))
    key = ["record_id", "l_partkey", "l_quantity", "l_extendedprice", "t_us"]
    pd.testing.assert_frame_equal(_pdf(one, key), _pdf(many, key), check_exact=False, rtol=1e-9, atol=1e-9)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=5000)
    x[rng.random(5000) < 0.1] = np.nan
    y = np.round(rng.exponential(size=5000), 1)          # many ties
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    for q in (0.5, 0.95, 0.0, 1.0):
        got = exact_quantiles(df, ["x", "y"], q, bins=16)   # forces several rounds
        assert got["x"] == pytest.approx(np.nanpercentile(x, q * 100), abs=1e-12)
        assert got["y"] == pytest.approx(np.percentile(y, q * 100), abs=1e-12)


def test_lineitem_features_run(spark):
    assert lineitem_features(spark, SF001).count() == spark.read.parquet(f"{SF001}/lineitem.parquet").count()


def test_hot_machine_with_tied_times_numbered_exactly(spark):
    """One machine holding every row (and many equal timestamps) is split by the range partitioning."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from rigscope.config import LINEITEM_SPEC
    from rigscope.operators.sequence import SEQ, add_sequence
    from rigscope.sources.adapters import lineitem_readings

    hot = lineitem_readings(spark, SF001).withColumn("well_id", F.lit("HOT"))
    got = add_sequence(hot, LINEITEM_SPEC, Layout(range_partitions=8))
    w = Window.partitionBy("well_id").orderBy(*LINEITEM_SPEC.order_cols)
    check = got.withColumn("_want", F.row_number().over(w) - 1)
    assert check.filter(F.col(SEQ) != F.col("_want")).count() == 0
    parts = (hot.repartitionByRange(8, "well_id", *LINEITEM_SPEC.order_cols)
             .groupBy(F.spark_partition_id()).count().count())
    assert parts > 1


def test_context_copies_carry_home_labels(spark):
    """After labels on a chunked layout, every context copy holds its home row's label values."""
    from pyspark.sql import functions as F

    from rigscope.config import EVENTS_SPEC
    from rigscope.operators.sequence import CHUNK, CTX, SEQ
    from rigscope.plans.frames import labeled
    from rigscope.sources.adapters import events_readings

    lab = labeled(events_readings(spark, SF001), EVENTS_SPEC, Layout(chunk_rows=9, range_partitions=4),
                  force_chunks=True)
    cols = ["hours_since_last_maintenance", "days_to_failure", "cumulative_operating_hours"]
    home = lab.filter(~F.col(CTX)).select("well_id", SEQ, *[F.col(c).alias("h_" + c) for c in cols])
    ctx = lab.filter(F.col(CTX)).select("well_id", SEQ, CHUNK, *cols)
    assert ctx.count() > 0
    j = ctx.join(home, ["well_id", SEQ])
    bad = j.filter(" OR ".join(f"NOT ({c} <=> h_{c})" for c in cols))
    assert j.count() == ctx.count() and bad.count() == 0


def test_hybrid_layout_with_one_hot_machine(spark):
    """Half the suppliers merged into one hot machine: only it goes through the chunked numbering,
    and the features equal the single-window answer."""
    from pyspark.sql import functions as F

    from rigscope.config import LINEITEM_SPEC
    from rigscope.operators.features import engineer_features
    from rigscope.operators.labels import derive_labels
    from rigscope.operators.sequence import lay_out, strip
    from rigscope.sources.adapters import lineitem_readings

    r = lineitem_readings(spark, SF001)
    r = r.withColumn("well_id", F.when(F.col("depth_ft") <= 1005, F.lit("HOT")).otherwise(F.col("well_id")))

    def chain(layout):
        return strip(engineer_features(derive_labels(lay_out(r, LINEITEM_SPEC, 46, layout), LINEITEM_SPEC),
                                       LINEITEM_SPEC))

    key = ["record_id", "l_partkey", "l_quantity", "l_extendedprice", "t_us"]
    hybrid = _pdf(chain(Layout(chunk_rows=1000, range_partitions=6)), key)   # HOT ≈ 3000 rows, others ≈ 600
    single = _pdf(chain(Layout(chunk_rows=10**6)), key)
    pd.testing.assert_frame_equal(hybrid, single, check_exact=False, rtol=1e-9, atol=1e-9)


HARD = {
    "decades": [10.0 ** k * (1 + j / 64) for k in range(-150, 150) for j in range(10)],
    "infinite": [float("inf"), float("-inf")] + [float(k) for k in range(500)],
    "overflowing": [1.7e308, -1.7e308, 1.6e308, -1.6e308, 0.0, -0.0, 1.0],
    "tiny": [5e-324, 1e-323, 2.2250738585072014e-308, 2.225073858507201e-308, -5e-324, 0.0, 1e-310],
    "powers": [2.0 ** k for k in range(-1074, 1024)] + [-(2.0 ** k) for k in range(-1074, 1024, 7)]
              + [float(np.nextafter(2.0 ** k, 0)) for k in range(-1000, 1000, 3)],
    "one": [3.25],
}


@pytest.mark.parametrize("name", HARD)
def test_exact_quantiles_of_any_spread(spark, monkeypatch, name):
    from pyspark.sql import DataFrame

    values = HARD[name]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
    sent, plain = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: sent.append(plain(self)) or sent[-1])
    for q in (0.0, 0.37, 0.5, 0.95, 1.0):
        sent.clear()
        got = exact_quantiles(df, ["x"], q, bins=64)["x"]
        ordered = sorted(values)
        place = (len(ordered) - 1) * q
        low, high = ordered[int(place)], ordered[min(int(place) + 1, len(ordered) - 1)]
        assert low <= got <= high
        if np.isfinite(high - low):
            assert got == pytest.approx(low + (high - low) * (place - int(place)), rel=1e-15, abs=0)
        assert len(sent) <= 11 and all(len(rows) <= 2 * 64 for rows in sent)


def test_quantiles_only_where_nulls_are(spark):
    df = spark.createDataFrame([(float(k), None if k % 3 else float(k), None) for k in range(99)],
                               "full double, gaps double, empty double")
    assert exact_quantiles(df, ["full", "gaps", "empty"], 0.5, only_with_nulls=True) == {
        "full": None, "gaps": 48.0, "empty": None}


@pytest.mark.parametrize("collect,bins,most", [(100_000, 4096, 2), (300, 4096, 3), (60, 16, 20)])
def test_passes_over_the_data(spark, collect, bins, most):
    """A sketch and one exact pass settle a quantile; three passes where the bracket holds more than is collected."""
    from pyspark.sql import functions as F
    from rigscope.operators.quantiles import _order_statistics

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=20_000) * 10.0 ** rng.integers(-150, 150, 20_000), [np.inf, -np.inf, 0.0, -0.0, 5e-324]])
    y = np.repeat([1.5, -2.0, 7.25], 6668)[:len(x)]                      # three values only
    y = np.concatenate([y, np.full(len(x) - len(y), 3.0)])
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    for share in (0.0, 0.37, 0.95, 1.0):
        rank = int(share * (len(x) - 1))
        counts, found, passes = _order_statistics(df, [F.col("x"), F.col("y")], lambda _, n: {rank}, share, bins, 100, collect)
        assert counts == [len(x), len(x)] and passes <= most
        assert found == {(0, rank): np.sort(x)[rank], (1, rank): np.sort(y)[rank]}


def test_a_bracket_that_misses_is_no_error(spark):
    from pyspark.sql import functions as F
    from rigscope.operators.quantiles import _order_statistics

    x = np.random.default_rng(6).normal(size=5_000)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    _, found, _ = _order_statistics(df, [F.col("x")], lambda _, n: {10, 4_900}, 0.5, 64, 1_000, 1_000)
    assert found == {(0, 10): np.sort(x)[10], (0, 4_900): np.sort(x)[4_900]}
