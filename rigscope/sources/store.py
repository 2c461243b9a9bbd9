"""Stored readings that open only the files a question or a batch needs.

**Clustered files.** ``write_clustered`` cuts the rows into a few periods of equal size and orders each by machine and time,
over as many range partitions as there are files to be (Spark samples the composite key, so a machine of any size is spread). A
file then holds few machines of one period. Its extent (least and greatest machine and time) goes into ``_zones`` beside the
files; ``read_range`` asks that small table first, and hands only the files that may hold wanted rows to the Parquet
scan, whose row groups are ordered by machine and time, too. This serves one machine (some files of every period)
and one date window (the files of its periods).

**Key index.** ``append_indexed`` is the idempotent append without a look at all stored keys. The keys of each append are
stored once more, in ``SLOTS`` slots by hash, and every key file has a row or more in ``_filters``: its least and greatest
key and a Bloom filter in pages of 32,768 bits. A batch first leaves out the files whose span of keys it
doesn't meet, then those whose filter holds none of its keys, and reads just the others for the exact anti join. The
key alone counts: a record that is sent again under another date finds its key as well. One writer at a time, as the
``foreachBatch`` of a stream is; a marker lies beside the table while an append is under way, and an append that finds
one left by a broken run indexes all stored keys anew before it goes on.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SensorSpec
from ..operators.impute import keep_first
from ..session import ensure_checkpoint_dir
from .sinks import path_exists

ROWS_PER_FILE = 1 << 20
SLOTS = 64
PAGE_BITS = 32_768          # of Spark's bitmap functions
BITS_PER_KEY = 10           # with four bits set a key: about 1 % of absent keys pass
_PROBES = 4
_SHARES = 64                # quantiles of time that periods are made of


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


# ---------------------------------------------------------------- clustered files
def write_clustered(rows: DataFrame, path: str, spec: SensorSpec, rows_per_file: int = ROWS_PER_FILE,
                    periods: int | None = None) -> int:
    """Append ``rows`` to the store at ``path``; returns the number of range partitions.

    ``periods``: how many cuts of time (default: half the square root of the number of files, so that a
    machine and a period are found in a similar share of the files)."""
    spark = rows.sparkSession
    shares = [k / _SHARES for k in range(1, _SHARES)]
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(spec.time_us, shares, 1_000).alias("q")).first()
    files = max(1, -(-seen["n"] // rows_per_file))
    periods = min(_SHARES, periods or max(1, int(files ** 0.5 / 2)))
    bounds = sorted({seen["q"][k * _SHARES // periods - 1] for k in range(1, periods)}) if seen["q"] else []
    period = reduce(lambda a, b: a + b, [(F.col(spec.time_us) >= F.lit(b)).cast("int") for b in bounds], F.lit(0))
    batch = f"b{uuid.uuid4().hex}"
    order = ["_period", spec.entity, spec.time_us]
    (rows.withColumn("_period", F.coalesce(period, F.lit(0))).repartitionByRange(files, *order).sortWithinPartitions(*order)
     .drop("_period").write.option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/batch={batch}"))
    added = spark.read.parquet(f"{path}/batch={batch}")
    zones = added.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(spec.entity).alias("entity_lo"), F.max(spec.entity).alias("entity_hi"),
        F.min(spec.time_us).alias("us_lo"), F.max(spec.time_us).alias("us_hi"))
    zones.coalesce(1).write.mode("append").parquet(f"{path}/_zones")
    return files


def wanted_files(spark: SparkSession, path: str, entities=None, start_us: int | None = None,
                 end_us: int | None = None) -> list[str]:
    """Files that may hold readings of ``entities`` (all if None) from ``start_us`` to ``end_us``, both included."""
    may = F.lit(True)
    if entities is not None:
        may = reduce(lambda a, b: a | b, [(F.col("entity_lo") <= F.lit(e)) & (F.col("entity_hi") >= F.lit(e)) for e in entities],
                     F.lit(False))
    if start_us is not None:
        may = may & (F.col("us_hi") >= F.lit(start_us))
    if end_us is not None:
        may = may & (F.col("us_lo") <= F.lit(end_us))
    return [r["file"] for r in spark.read.parquet(f"{path}/_zones").where(may).select("file").collect()]


def read_range(spark: SparkSession, path: str, spec: SensorSpec, entities=None, start_us: int | None = None,
               end_us: int | None = None) -> DataFrame:
    """H11 on the store: readings of ``entities`` between two times, from the files that may hold them."""
    files = wanted_files(spark, path, entities, start_us, end_us)
    if not files:
        return spark.read.parquet(path).drop("batch").limit(0)
    rows = spark.read.parquet(*files)
    if entities is not None:
        rows = rows.where(F.col(spec.entity).isin(list(entities)))
    if start_us is not None:
        rows = rows.where(F.col(spec.time_us) >= F.lit(start_us))
    if end_us is not None:
        rows = rows.where(F.col(spec.time_us) <= F.lit(end_us))
    return rows


# ---------------------------------------------------------------- key index
def _hashed(keys: list[str]) -> dict[str, Column]:
    """Slot, number that picks the page, and the bits of a key."""
    out = {"slot": F.pmod(F.xxhash64(*keys), F.lit(SLOTS)), "spread": F.xxhash64(*keys, F.lit(1))}
    return out | {f"bit{i}": F.pmod(F.xxhash64(*keys, F.lit(2 + i)), F.lit(PAGE_BITS)) for i in range(_PROBES)}


def add_keys(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Store the keys of ``rows`` (each once, as ``append_indexed`` makes sure) with their filters."""
    spark = rows.sparkSession
    folder = f"{path}/_keys/{uuid.uuid4().hex}"
    (rows.select(*keys, _hashed(keys)["slot"].alias("slot")).repartition(SLOTS, "slot").sortWithinPartitions("slot", *keys)
     .write.partitionBy("slot").parquet(folder))
    stored = spark.read.schema(rows.select(*keys).schema).parquet(folder).select(*keys, F.col("_metadata.file_path").alias("file"))
    known = stored.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min(keys[0]).alias("lo"), F.max(keys[0]).alias("hi"))
    need = F.ceil(F.col("n") * BITS_PER_KEY / PAGE_BITS)
    known = known.withColumn("pages", F.pow(F.lit(2), F.ceil(F.log2(need))).cast("long"))
    marked = stored.withColumns(_hashed(keys)).join(known, "file")
    bits = marked.select("file", "slot", "n", "lo", "hi", "pages", F.pmod("spread", "pages").alias("page"),
                         F.explode(F.array(*[f"bit{i}" for i in range(_PROBES)])).alias("bit"))
    filters = bits.groupBy("file", "slot", "n", "lo", "hi", "pages", "page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    filters.write.mode("append").parquet(f"{path}/_filters")


def _set(bit: str) -> Column:
    return F.expr(f"shiftright(CAST(conv(hex(substring(bits, CAST({bit} div 8 + 1 AS INT), 1)), 16, 10) AS INT), "
                  f"CAST({bit} % 8 AS INT)) & 1") == 1


def key_files(batch: DataFrame, path: str, keys: list[str]) -> list[str]:
    """Key files that may hold a key of ``batch``."""
    spark = batch.sparkSession
    span = batch.agg(F.min(keys[0]).alias("lo"), F.max(keys[0]).alias("hi")).first()
    may = F.lit(False) if span["lo"] is None else (F.col("hi") >= F.lit(span["lo"])) & (F.col("lo") <= F.lit(span["hi"]))
    filters = spark.read.parquet(f"{path}/_filters").where(may)
    widths = [r["pages"] for r in filters.select("pages").distinct().collect()]        # powers of two: few
    if not widths:
        return []
    hashed = batch.select(*keys).distinct().withColumns(_hashed(keys)).withColumn("_key", F.col(keys[0])).drop(*keys)
    hashed = hashed.withColumn("pages", F.explode(F.array(*[F.lit(w) for w in widths])))
    hashed = hashed.withColumn("page", F.pmod("spread", "pages"))
    met = filters.join(hashed, ["slot", "pages", "page"]).where((F.col("_key") >= F.col("lo")) & (F.col("_key") <= F.col("hi")))
    held = reduce(lambda a, b: a & b, [_set(f"bit{i}") for i in range(_PROBES)])
    return [r["file"] for r in met.where(held).select("file").distinct().collect()]


@dataclass
class Appended:
    rows: DataFrame           # what was written
    opened: list[str]         # key files that were read


def append_indexed(batch: DataFrame, path: str, key, order_cols, write=None, partition_by: str | None = None) -> Appended:
    """A5: ``ON CONFLICT DO NOTHING`` by the key index. Null keys are not equal to any key, so such rows are all stored.

    ``write(rows, path)`` stores the new rows, by default as Parquet files, partitioned by ``partition_by`` if given. A table
    without an index (written by other means) is indexed first."""
    spark = batch.sparkSession
    ensure_checkpoint_dir(spark)
    keys = [key] if isinstance(key, str) else list(key)
    marker = f"{path}/_appending"
    if path_exists(spark, path) and (path_exists(spark, marker) or not path_exists(spark, f"{path}/_filters")):
        _index_anew(spark, path, keys, marker)
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    fresh = keep_first(batch.where(~null_key), keys, order_cols).unionByName(batch.where(null_key)).checkpoint()
    opened = key_files(fresh, path, keys) if path_exists(spark, f"{path}/_filters") else []
    # read twice below: from the checkpoint and from key files that no one changes, never from the rows of the table
    new = fresh.join(spark.read.parquet(*opened).select(*keys), keys, "left_anti") if opened else fresh
    fs, p = _fs(spark, marker)
    fs.create(p, True).close()
    if write:
        write(new, path)
    else:
        writer = new.write.mode("append")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    add_keys(new.where(~null_key), path, keys)
    fs.delete(p, False)
    return Appended(new, opened)


def _index_anew(spark: SparkSession, path: str, keys: list[str], marker: str) -> None:
    """Build the key index of a table from its rows; a run that breaks off leaves the marker, so the next one does it again."""
    for name in ("_keys", "_filters"):
        fs, p = _fs(spark, f"{path}/{name}")
        fs.delete(p, True)
    fs, p = _fs(spark, marker)
    fs.create(p, True).close()
    held = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    stored = [s.getPath().getName() for s in fs.listStatus(_fs(spark, path)[1])]
    if any(not name.startswith(("_", ".")) for name in stored):
        add_keys(spark.read.parquet(path).where(held), path, keys)
    fs.delete(p, False)
