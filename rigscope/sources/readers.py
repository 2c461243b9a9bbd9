"""A1/A2: reading raw readings (CSV or Parquet) with an explicit schema, and the column check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import REQUIRED_COLS
from .schemas import READINGS_SCHEMA

# Text that pandas' CSV reader treats as missing (fixed values); lower-case "none" is NOT among them.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
               "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


class MissingColumnsError(ValueError):
    pass


def validate_columns(df: DataFrame, required=REQUIRED_COLS) -> DataFrame:
    """A2: raise listing the missing names (schema only, no job)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"Missing columns: {missing}")
    return df


def read_readings(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType = READINGS_SCHEMA) -> DataFrame:
    """A1: CSV with a header (every field read as text, pandas null tokens → NULL, then cast to the
    schema, NaN → NULL), or Parquet/ORC/JSON with the same casts."""
    if fmt == "csv":
        raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
        validate_columns(raw, [f.name for f in schema.fields])
        cols = []
        for f in schema.fields:
            c = F.col(f.name)
            c = F.when(c.isin(list(NULL_TOKENS)), F.lit(None)).otherwise(c)
            c = c.cast(f.dataType)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                c = F.when(F.isnan(c), F.lit(None)).otherwise(c)
            cols.append(c.alias(f.name))
        return raw.select(*cols)
    df = spark.read.format(fmt).load(path)
    validate_columns(df, [f.name for f in schema.fields])
    out = []
    for f in schema.fields:
        c = F.col(f.name).cast(f.dataType)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c), F.lit(None)).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def with_epoch(df: DataFrame, spec) -> DataFrame:
    """Add ``spec.time_us`` (epoch microseconds of ``spec.time``) used for ordering and arithmetic."""
    from ..functions.scalars import epoch_us_of

    return df.withColumn(spec.time_us, epoch_us_of(df, spec.time))
