"""The clustered store opens few files; the key index finds every stored key, whatever its date."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from rigscope.config import EVENTS_SPEC as SPEC
from rigscope.sources import store
from rigscope.sources.adapters import events_readings


@pytest.fixture(scope="module")
def readings(spark):
    return events_readings(spark, SF01).cache()


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_one_well_and_one_window_open_few_files(spark, readings, scratch):
    n = readings.count()
    store.write_clustered(readings, f"{scratch}/s", SPEC, rows_per_file=n // 120, periods=3)
    stored = spark.read.parquet(f"{scratch}/s").drop("batch")
    files = spark.read.parquet(f"{scratch}/s/_zones").count()
    assert files >= 100 and _rows(stored.select(readings.columns)) == _rows(readings)
    well = readings.groupBy(SPEC.entity).count().orderBy(F.desc("count")).first()[0]
    lo, hi = readings.agg(F.min("t_us"), F.max("t_us")).first()
    start = hi - (hi - lo) // 4
    assert len(store.wanted_files(spark, f"{scratch}/s", [well], start, hi)) <= 0.05 * files
    got = store.read_range(spark, f"{scratch}/s", SPEC, [well], start, hi)
    assert len(got.inputFiles()) <= 0.05 * files
    assert _rows(got.select(readings.columns)) == _rows(readings.where((F.col("well_id") == well) & F.col("t_us").between(start, hi)))
    cut = lo + (hi - lo) // 10
    assert len(store.wanted_files(spark, f"{scratch}/s", None, lo, cut)) <= 0.4 * files
    assert _rows(store.read_range(spark, f"{scratch}/s", SPEC, None, lo, cut).select(readings.columns)) == _rows(
        readings.where(F.col("t_us") <= cut))
    assert store.read_range(spark, f"{scratch}/s", SPEC, ["no such well"]).count() == 0


def test_rows_without_machine_or_time(spark, scratch):
    rows = spark.createDataFrame([(1, None, 5), (2, "a", None), (3, "b", 7), (3, "b", 7)], "record_id long, well_id string, t_us long")
    for _ in range(2):
        store.write_clustered(rows, f"{scratch}/s", SPEC, rows_per_file=1)
    assert store.read_range(spark, f"{scratch}/s", SPEC).count() == 8
    assert [r.record_id for r in store.read_range(spark, f"{scratch}/s", SPEC, ["b"], 0, 9).collect()] == [3] * 4
    store.write_clustered(rows.limit(0), f"{scratch}/empty", SPEC)
    assert store.read_range(spark, f"{scratch}/empty", SPEC, ["b"]).count() == 0


def _batch(spark, ids, day):
    date = dt.date(2024, 1, day)
    return spark.createDataFrame([(i, f"w{i % 7}", day * 100 + i % 10, date) for i in ids],
                                 "record_id long, well_id string, t_us long, day date")


def test_batches_open_only_key_files_that_may_match(spark, scratch):
    path = f"{scratch}/t"
    for k in range(4):
        done = store.append_indexed(_batch(spark, range(k * 3000, (k + 1) * 3000), k + 1), path, "record_id", ["t_us"], partition_by="day")
        assert done.opened == [] and done.rows.count() == 3000            # new keys: no file is read
    key_files = spark.read.parquet(f"{path}/_filters").select("file").distinct().count()
    # ids between stored ones never came: spans overlap, filters tell them apart
    late = _batch(spark, [10_000_000, *range(100, 130)], 9)               # a known record under another date
    done = store.append_indexed(late, path, "record_id", ["t_us"], partition_by="day")
    assert [r.record_id for r in done.rows.collect()] == [10_000_000]
    assert 0 < len(done.opened) <= 40 < key_files
    again = store.append_indexed(late, path, "record_id", ["t_us"], partition_by="day")
    assert again.rows.count() == 0
    stored = spark.read.parquet(path)
    assert stored.count() == stored.select("record_id").distinct().count() == 12_001


def test_filters_pass_every_stored_key_and_few_others(spark, scratch):
    path = f"{scratch}/t"
    even = _batch(spark, range(0, 40_000, 2), 1)
    store.append_indexed(even, path, "record_id", ["t_us"])
    assert store.append_indexed(even, path, "record_id", ["t_us"]).rows.count() == 0
    odd = store.append_indexed(_batch(spark, [2001, 30_003], 1), path, "record_id", ["t_us"])
    assert len(odd.opened) <= 1 and odd.rows.count() == 2


def test_copies_and_null_keys_in_a_batch(spark, scratch):
    rows = [(1, "a", 5), (1, "a", 4), (None, "n", 1), (None, "n", 1), (2, "b", 1)]
    batch = spark.createDataFrame(rows, "record_id long, well_id string, t_us long")
    done = store.append_indexed(batch, f"{scratch}/t", "record_id", ["t_us"])
    assert sorted(((r.record_id or 0), r.t_us) for r in done.rows.collect()) == [(0, 1), (0, 1), (1, 4), (2, 1)]
    assert store.append_indexed(batch.limit(0), f"{scratch}/t", "record_id", ["t_us"]).rows.count() == 0
    two = store.append_indexed(batch, f"{scratch}/t2", ["well_id", "t_us"], ["record_id"])
    assert two.rows.count() == 4 and store.append_indexed(batch, f"{scratch}/t2", ["well_id", "t_us"], ["record_id"]).rows.count() == 0


def test_a_broken_append_is_indexed_anew(spark, scratch):
    path = f"{scratch}/t"
    _batch(spark, range(50), 1).write.parquet(path)                       # a table without an index
    assert store.append_indexed(_batch(spark, range(40, 60), 2), path, "record_id", ["t_us"]).rows.count() == 10
    _batch(spark, range(60, 70), 3).write.mode("append").parquet(path)    # rows written, then the run broke off
    fs, marker = store._fs(spark, f"{path}/_appending")
    fs.create(marker, True).close()
    assert store.append_indexed(_batch(spark, range(55, 75), 4), path, "record_id", ["t_us"]).rows.count() == 5
    assert spark.read.parquet(path).count() == 75 and not fs.exists(marker)


def test_store_and_index_together(spark, readings, scratch):
    path = f"{scratch}/both"

    def write(rows, to):
        store.write_clustered(rows, to, SPEC, rows_per_file=500)

    half = readings.agg(F.percentile_approx("t_us", 0.5)).first()[0]
    for part in (readings.where(F.col("t_us") <= half), readings, readings):
        store.append_indexed(part, path, "record_id", ["t_us"], write=write)
    assert _rows(store.read_range(spark, path, SPEC).select(readings.columns)) == _rows(readings)
