"""What a cluster needs: the session keeps its settings, hot machines and rows without a machine are cut, writes are safe."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from rigscope.config import EVENTS_SPEC
from rigscope.operators.sequence import CHUNK, CTX, SEQ, Layout, add_sequence, lay_out
from rigscope.sources import sinks
from rigscope.sources.adapters import events_readings


def test_build_session_keeps_master_and_partitions(spark):
    from rigscope.session import build_session

    before = {k: spark.conf.get(k) for k in ("spark.master", "spark.sql.shuffle.partitions")}
    again = build_session(app="other")
    assert {k: again.conf.get(k) for k in before} == before
    assert again.sparkContext.master == spark.sparkContext.master


def test_ranges_grow_with_the_rows(spark):
    hot = events_readings(spark, SF001).withColumn("well_id", F.lit("HOT"))
    n = hot.count()
    got = add_sequence(hot, EVENTS_SPEC, Layout(chunk_rows=50), rows=n)
    assert sorted(r[0] for r in got.select(SEQ).collect()) == list(range(n))
    laid = lay_out(hot, EVENTS_SPEC, 0, Layout(chunk_rows=50))
    assert laid.groupBy(CHUNK).count().agg(F.max("count")).first()[0] <= 50


def test_small_chunks_need_no_more_ranges(spark):
    """Chunks of two rows of 1,000,000 are no 500,000 tasks: ranges follow the rows, chunks are windows in them."""
    from rigscope.operators import cache

    rows = events_readings(spark, SF001)
    add_sequence(rows, EVENTS_SPEC, Layout(chunk_rows=2), rows=1_000_000)
    assert cache._KEPT[-1].rdd.getNumPartitions() <= 16
    add_sequence(rows, EVENTS_SPEC, Layout(chunk_rows=1 << 18), rows=1 << 22)
    assert cache._KEPT[-1].rdd.getNumPartitions() == 16


def test_rows_without_a_machine_are_numbered_and_cut(spark):
    r = events_readings(spark, SF001)
    null = r.withColumn("well_id", F.when(F.col("record_id") % 3 > 0, F.col("well_id")))
    n = null.filter("well_id IS NULL").count()
    laid = lay_out(null, EVENTS_SPEC, 5, Layout(chunk_rows=100)).filter(~F.col(CTX))
    assert laid.count() == r.count()
    lost = laid.filter("well_id IS NULL")
    assert sorted(x[0] for x in lost.select(SEQ).collect()) == list(range(n))
    assert lost.groupBy(CHUNK).count().agg(F.max("count")).first()[0] <= 100


def test_a_table_that_cannot_be_read_is_not_overwritten(spark, scratch):
    batch = spark.createDataFrame([(1, 5), (2, 6)], "record_id long, t_us long")
    sinks.append_new(batch, f"{scratch}/t", "record_id", ["t_us"])
    with open(f"{scratch}/t/part-broken.parquet", "w") as f:
        f.write("this is no table")
    with pytest.raises(Exception):  # noqa: B017 — whatever Spark says of the broken file
        sinks.append_new(batch, f"{scratch}/t", "record_id", ["t_us"])
    assert sinks.read_metrics(spark, f"{scratch}/none") == {}


def test_append_looks_only_through_the_dates_of_the_batch(spark, scratch):
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, None)], "record_id long, d string")
    rows = rows.withColumn("d", F.to_date("d"))
    assert sinks.append_new(rows, f"{scratch}/t", "record_id", ["record_id"], partition_by="d").count() == 3
    more = rows.unionByName(spark.createDataFrame([(4, None)], "record_id long, d date"))
    assert [r.record_id for r in sinks.append_new(more, f"{scratch}/t", "record_id", ["record_id"], partition_by="d").collect()] == [4]
    assert spark.read.parquet(f"{scratch}/t").count() == 4


def test_a_key_redelivered_with_another_date_is_not_stored_again(spark, scratch):
    first = spark.sql("SELECT * FROM VALUES (1, DATE'2024-01-01'), (2, NULL), (3, DATE'2024-01-02') AS t(record_id, d)")
    again = spark.sql("SELECT * FROM VALUES (1, DATE'2024-01-05'), (2, DATE'2024-01-01'), (3, NULL), (4, NULL) AS t(record_id, d)")
    for batch, new in ((first, [1, 2, 3]), (again, [4]), (again, [])):
        got = sinks.append_new(batch, f"{scratch}/t", "record_id", ["d"], partition_by="d")
        assert sorted(r.record_id for r in got.collect()) == new
    assert spark.read.parquet(f"{scratch}/t").where("record_id = 1 AND d = DATE'2024-01-01'").count() == 1


def test_a_date_that_is_part_of_the_key_makes_another_row(spark, scratch):
    rows = spark.sql("SELECT * FROM VALUES ('a', DATE'2024-01-01'), ('a', DATE'2024-01-02') AS t(w, d)")
    for batch, new in ((rows.limit(1), 1), (rows, 1), (rows, 0)):
        assert sinks.append_new(batch, f"{scratch}/t", ["w", "d"], ["w"], partition_by="d").count() == new


def test_write_run_leaves_the_session_alone(spark, scratch):
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    sinks.write_run(spark.range(2), f"{scratch}/r", "a")
    sinks.write_run(spark.range(3), f"{scratch}/r", "b")
    assert spark.conf.get(key) == before and spark.read.parquet(f"{scratch}/r").count() == 5


def test_queries_release_what_the_one_before_kept(spark):
    import __spark_entry__ as E
    from rigscope.operators import cache

    for name in ("window_features", "latest_state", "latest_state"):
        E.queries()[name](spark, SF001).count()
    held = len(cache._KEPT)
    E.queries()["window_features"](spark, SF001).count()
    assert len(cache._KEPT) <= held + 1
    cache.release()
