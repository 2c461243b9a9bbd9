"""The supplied test tables seen as sensor readings.

``events`` → one machine per user (``WELL_<user_id:04d>``):

* ``value``  – the sensor reading; lost (NULL) when the event's signal quality
  ``props.k`` is below 10, so imputation has gaps to fill;
* ``signal`` – ``props.k`` itself, a second always-present sensor;
* a failure is an ``error`` event with ``value >= 50``; its fault type is the
  ``k // 20``-th entry of the five fault types;
* ``depth_ft`` = 5000 + user_id.

``lineitem`` → one machine per supplier, four sensors, time = ``l_shipdate``.
Both adapters keep every row of their table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FAULT_TYPES, NO_FAULT
from ..functions.scalars import epoch_us_of

# Fixed adapter parameters (mirrored in the DuckDB oracle).
SIGNAL_FLOOR = 10.0
FAILURE_VALUE = 50.0
FAULT_BUCKET = 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    fault = F.when(
        (F.col("event_type") == "error") & (F.col("value") >= F.lit(FAILURE_VALUE)),
        F.element_at(F.array(*[F.lit(f) for f in FAULT_TYPES]),
                     (F.floor(k / F.lit(FAULT_BUCKET)) + 1).cast("int")),
    ).otherwise(F.lit(NO_FAULT))
    return e.select(
        F.col("event_id").alias("record_id"),
        F.format_string("WELL_%04d", F.col("user_id")).alias("well_id"),
        F.col("ts").alias("timestamp"),
        epoch_us_of(e, "ts").alias("t_us"),
        (F.lit(5000) + F.col("user_id")).cast("int").alias("depth_ft"),
        F.when(k >= F.lit(SIGNAL_FLOOR), F.col("value")).alias("value"),
        k.alias("signal"),
        fault.alias("failure_type"),
    )


def lineitem_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("record_id"),
        F.format_string("SUPP_%06d", F.col("l_suppkey")).alias("well_id"),
        F.col("l_shipdate").alias("timestamp"),
        epoch_us_of(li, "l_shipdate").alias("t_us"),
        (F.lit(1000) + F.col("l_suppkey")).cast("int").alias("depth_ft"),
        "l_orderkey", "l_linenumber", "l_partkey",
        (F.col("l_quantity") + F.lit(0.0)).alias("l_quantity"),
        (F.col("l_extendedprice") + F.lit(0.0)).alias("l_extendedprice"),
        (F.col("l_discount") + F.lit(0.0)).alias("l_discount"),
        (F.col("l_tax") + F.lit(0.0)).alias("l_tax"),
        F.when(F.col("l_returnflag") == "R", F.lit(FAULT_TYPES[0])).otherwise(F.lit(NO_FAULT)).alias("failure_type"),
    )
