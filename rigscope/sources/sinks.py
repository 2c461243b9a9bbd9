"""Table declarations, idempotent appends, key checks, defaults, the derived tables, SQL, metrics."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_TECHNICIAN, WELL_INSTALL_DATE, WELL_LOCATION_PREFIX, SensorSpec
from ..functions.scalars import nan_to_null, one_row
from ..operators.impute import keep_first
from ..session import ensure_checkpoint_dir
from .schemas import TABLES


# ---------------------------------------------------------------- A4
def declare_tables(spark: SparkSession, root: str) -> list:
    """Create the five tables if they do not exist (idempotent), Parquet under ``root``."""
    made = []
    for name, (schema, _key, part) in TABLES.items():
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        part_sql = f" PARTITIONED BY ({part})" if part else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet{part_sql} LOCATION '{root}/{name}'")
        made.append(name)
    return made


# ---------------------------------------------------------------- A5 / A6
def rows_to_append(batch: DataFrame, existing: DataFrame | None, key, order_cols) -> DataFrame:
    """A5: ``ON CONFLICT DO NOTHING`` — collapse duplicates inside the batch (first by ``order_cols``),
    then drop keys already stored (left anti join on the key)."""
    keys = [key] if isinstance(key, str) else list(key)
    fresh = keep_first(batch, keys, order_cols)
    if existing is None:
        return fresh
    return fresh.join(existing.select(*keys), keys, "left_anti")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is there, in any file system that Spark reaches; every failure to look is an error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def append_new(batch: DataFrame, path: str, key, order_cols, fmt: str = "parquet",
               partition_by: str | None = None) -> DataFrame:
    """Append only new keys to the table at ``path`` and return what was written.

    A table that is there but can't be read is an error, not an empty table.  ``partition_by``: a date column
    that the table is partitioned by.  A key that is stored under any date is not stored again; the key columns of
    the whole table are read for that, unless the date is part of the key: then only the batch's dates can match."""
    spark = batch.sparkSession
    ensure_checkpoint_dir(spark)
    existing = spark.read.format(fmt).load(path) if path_exists(spark, path) else None
    if existing is not None and partition_by in ([key] if isinstance(key, str) else list(key)):
        days = [r[0] for r in batch.select(partition_by).distinct().collect()]    # a batch has few dates
        known = [d for d in days if d is not None]
        existing = existing.filter(F.col(partition_by).isin(known) | (F.col(partition_by).isNull()
                                                                      if None in days else F.lit(False)))
    new = rows_to_append(batch, existing, key, order_cols)
    ckpt = new.checkpoint()  # cut lineage: the anti join must not re-read the table it appends to
    writer = ckpt.write.mode("append").format(fmt)
    (writer.partitionBy(partition_by) if partition_by else writer).save(path)
    return ckpt


def key_report(child: DataFrame, key, parent: DataFrame | None = None, fk: str | None = None,
               parent_key: str | None = None) -> DataFrame:
    """Rows, null keys, duplicated keys (rows beyond the first), orphans (FK not in parent)."""
    keys = [key] if isinstance(key, str) else list(key)
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    base = child.agg(F.count(F.lit(1)).alias("rows"), F.sum(null_key.cast("long")).alias("null_keys"))
    dups = (child.filter(~null_key).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
            .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
                 F.coalesce(F.sum((F.col("_n") > 1).cast("long")), F.lit(0)).alias("duplicated_keys")))
    parts = [base, dups]
    if parent is not None and fk is not None:
        # one row per foreign key before the anti join, so a hot key is one row, not one task
        per_fk = child.filter(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("_n"))
        parts.append(per_fk.join(parent.select(F.col(parent_key or fk).alias(fk)), fk, "left_anti")
                     .agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("orphans")))
    return one_row(*parts)


# ---------------------------------------------------------------- A7
def with_defaults(df: DataFrame, table: str, now: Column | None = None) -> DataFrame:
    """Column defaults applied at insert: status, creation/ingestion time, is_active."""
    now = now if now is not None else F.current_timestamp()
    defaults = {
        "wells": {"status": F.lit("active")},
        "sensor_readings": {"ingested_at": now},
        "maintenance_events": {"status": F.lit("scheduled"), "created_at": now},
        "model_predictions": {"predicted_at": now},
        "alerts": {"created_at": now, "is_active": F.lit(True)},
    }[table]
    return df.withColumns({c: (F.coalesce(F.col(c), v) if c in df.columns else v) for c, v in defaults.items()})


# ---------------------------------------------------------------- A8 / A9
def wells_table(readings: DataFrame, spec: SensorSpec) -> DataFrame:
    """One row per machine: first non-null depth in time order, fixed install date, location
    ``Field-`` + last three characters of the id, default status."""
    order = F.struct(*[F.col(c) for c in spec.order_cols])
    w = readings.groupBy(spec.entity).agg(
        F.min_by(F.col(spec.depth), F.when(F.col(spec.depth).isNotNull(), order)).cast("int").alias("depth_ft"))
    w = w.select(
        F.col(spec.entity).alias("well_id"), "depth_ft",
        F.to_date(F.lit(WELL_INSTALL_DATE)).alias("install_date"),
        F.concat(F.lit(WELL_LOCATION_PREFIX), F.substring(F.col(spec.entity), -3, 3)).alias("location"),
        F.lit(None).cast("string").alias("status"),
    )
    return with_defaults(w, "wells")


def sensor_readings_rows(readings: DataFrame, schema_fields) -> DataFrame:
    """Project to the stored columns with their types (NaN → NULL for doubles)."""
    out = []
    for f in schema_fields:
        c = F.col(f.name).cast(f.dataType) if f.name in readings.columns else F.lit(None).cast(f.dataType)
        if f.dataType.simpleString() == "double":
            c = nan_to_null(c)
        out.append(c.alias(f.name))
    return readings.select(*out)


# ---------------------------------------------------------------- A10 / A11: run-scoped sinks
def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """Write one run's rows; re-running the same ``run_id`` replaces only that run (dynamic overwrite)."""
    (df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id").parquet(path))


# ---------------------------------------------------------------- A12
def visit_requests(schedule: DataFrame, technician: Column | None = None, notes: Column | None = None,
                   priorities=("Critical", "High")) -> DataFrame:
    """Scheduled visits for the urgent machines: technician defaults to ``Unassigned``, notes to "",
    status ``scheduled``; type by priority."""
    s = schedule.filter(F.col("priority").isin(list(priorities)))
    due = F.col("schedule_date") if "schedule_date" in schedule.columns else F.to_date("schedule_by", "MMM dd, yyyy")
    tech = technician if technician is not None else F.lit(None).cast("string")
    note = notes if notes is not None else F.lit(None).cast("string")
    return s.select(
        "well_id",
        due.alias("scheduled_date"),
        F.lit(None).cast("date").alias("completed_date"),
        F.when(F.col("priority") == "Critical", F.lit("corrective")).otherwise(F.lit("inspection")).alias("maintenance_type"),
        F.when(F.col("fault_type") != "None", F.lower(F.replace("fault_type", F.lit(" "), F.lit("_"))))
        .alias("failure_type_addressed"),
        F.coalesce(tech, F.lit(DEFAULT_TECHNICIAN)).alias("technician"),
        F.coalesce(note, F.lit("")).alias("notes"),
        F.lit("scheduled").alias("status"),
    )


def given_visits(requests: DataFrame) -> DataFrame:
    """Visits as a planner asks for them (``well_id``, ``scheduled_date``, ``maintenance_type``, and any of
    ``failure_type_addressed``, ``technician``, ``notes``), with the defaults of scheduled ones."""
    text = lambda c: F.col(c) if c in requests.columns else F.lit(None).cast("string")
    return requests.select(
        "well_id", F.col("scheduled_date").cast("date").alias("scheduled_date"),
        F.lit(None).cast("date").alias("completed_date"), "maintenance_type",
        text("failure_type_addressed").alias("failure_type_addressed"),
        F.coalesce(text("technician"), F.lit(DEFAULT_TECHNICIAN)).alias("technician"),
        F.coalesce(text("notes"), F.lit("")).alias("notes"), F.lit("scheduled").alias("status"))


def append_visits(visits: DataFrame, path: str, now: Column | None = None) -> DataFrame:
    """Append visits to ``maintenance_events``; one that is already planned (same well, date and type) stays as it is."""
    key = list(TABLES["maintenance_events"][1])
    return append_new(with_defaults(visits, "maintenance_events", now), path, key, ["created_at", "technician", "notes"],
                      partition_by="scheduled_date")


# ---------------------------------------------------------------- A13
def run_sql(spark: SparkSession, text: str, views: dict | None = None, args: dict | None = None) -> DataFrame:
    """Parametrised SQL over named DataFrames (``:name`` markers bound from ``args``)."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=args or {})


# ---------------------------------------------------------------- A14
def write_metrics(spark: SparkSession, metrics: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(metrics),)], "doc string").coalesce(1).write.mode("overwrite").text(path)


def read_metrics(spark: SparkSession, path: str) -> dict:
    row = spark.read.text(path).first() if path_exists(spark, path) else None
    return json.loads(row[0]) if row else {}


def batch_counts(df: DataFrame, cols) -> DataFrame:
    """A3 + B3 of a batch in one scan: rows, and nulls over ``cols``."""
    return df.agg(F.count(F.lit(1)).alias("rows_in"), _nulls(cols).alias("nulls_before"))


def _nulls(cols) -> Column:
    return sum((F.sum(F.col(c).isNull().cast("long")) for c in cols), F.lit(0))


def _kept(deduped: DataFrame, cols, spec: SensorSpec) -> DataFrame:
    return deduped.agg(F.count(F.lit(1)).alias("rows_out"), F.sum(spec.label).cast("long").alias("maintenance_events"),
                       (F.avg(F.col(spec.label).cast("double")) * 100).alias("maintenance_pct"))


def batch_report(counts: dict, deduped: DataFrame, cols, spec: SensorSpec) -> dict:
    """The ingestion report of a stored, deduplicated batch and the ``batch_counts`` of the raw one. Nulls after imputation
    are those of the kept rows; imputation leaves some only in a column without a single value."""
    kept = _kept(deduped, cols, spec).first().asDict()
    after = deduped.agg(_nulls(cols).alias("n")).first()["n"] or 0
    return counts | {"nulls_after": after, "nulls_imputed": counts["nulls_before"] - after,
                     "duplicates_dropped": counts["rows_in"] - kept["rows_out"]} | kept


def ingestion_report(raw: DataFrame, cleaned: DataFrame, deduped: DataFrame, cols, spec: SensorSpec) -> DataFrame:
    """A3 + B3: rows, nulls before/after imputation, duplicates dropped, maintenance sum and %."""
    after = cleaned.agg(_nulls(cols).alias("nulls_after"))
    r = one_row(batch_counts(raw, cols), after, _kept(deduped, cols, spec))
    return r.select("rows_in", "nulls_before", "nulls_after",
                    (F.col("nulls_before") - F.col("nulls_after")).alias("nulls_imputed"),
                    (F.col("rows_in") - F.col("rows_out")).alias("duplicates_dropped"),
                    "rows_out", "maintenance_events", "maintenance_pct")
