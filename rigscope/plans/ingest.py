"""Ingestion run: readings file → impute → dedup → ``wells`` and ``sensor_readings`` (idempotent) → report.

``python -m rigscope.plans.ingest --csv data/raw/well_sensor_data.csv --tables /shared/tables``
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import WELL_SPEC, SensorSpec
from ..operators.impute import keep_first, rolling_median_fill
from ..session import ensure_checkpoint_dir
from ..sources import sinks
from ..sources.readers import read_readings, with_epoch
from ..sources.schemas import READING_DATE, SENSOR_READINGS
from ..sources.store import append_indexed


def ingest(spark: SparkSession, path: str, tables: str, spec: SensorSpec = WELL_SPEC, fmt: str = "csv") -> dict:
    """Impute and deduplicate once, into a table of this run; report, ``wells``, ``sensor_readings`` (partitioned by date)
    and fault counts are all derived from it."""
    raw = with_epoch(read_readings(spark, path, fmt), spec)
    cleaned = rolling_median_fill(raw, spec, cols=spec.sensors)            # the ingestion path imputes sensors
    ensure_checkpoint_dir(spark)
    deduped = keep_first(cleaned, spec.record, spec.order_cols).checkpoint()
    counts = sinks.batch_counts(raw, spec.sensors).first().asDict()
    report = sinks.batch_report(counts, deduped, spec.sensors, spec)
    sinks.append_new(sinks.wells_table(deduped, spec), f"{tables}/wells", "well_id", ["well_id"])
    rows = sinks.with_defaults(sinks.sensor_readings_rows(deduped, SENSOR_READINGS.fields[:-1]), "sensor_readings")
    rows = rows.withColumn(READING_DATE, F.to_date(spec.time))
    written = append_indexed(rows, f"{tables}/sensor_readings", spec.record, [spec.time], partition_by=READING_DATE)
    report["rows_written"] = written.rows.count()
    report["fault_counts"] = {r[spec.fault]: r["n"] for r in deduped.groupBy(spec.fault)
                              .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).collect()}
    return report


def main(argv=None) -> None:
    from ..session import build_session

    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--csv", required=True)
    ap.add_argument("--tables", required=True)
    ap.add_argument("--format", default="csv")
    a = ap.parse_args(argv)
    print(json.dumps(ingest(build_session(), a.csv, a.tables, fmt=a.format), default=str))


if __name__ == "__main__":
    main()
