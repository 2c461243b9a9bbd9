"""Skew-safe per-entity ordering for row-based windows.

A plain ``Window.partitionBy(entity)`` sends a whole entity to one task; one
machine can hold a third of all rows.  One profiling aggregate counts rows per
entity: entities within ``chunk_rows`` keep a plain per-entity window (a proven
bound); when some are larger, all rows get

* ``_seq``   – their 0-based position inside the entity in (time, record, tiebreak)
  order, computed from counts per (range partition, entity) and a ``row_number``
  inside each, so no task sees more than one range partition of one entity;
* ``_chunk`` – ``_seq // chunk_rows``; windows run over
  ``partitionBy(entity, _chunk).orderBy(_seq)``;
* ``_ctx``   – true on copies of the last ``lookback`` rows of the previous
  chunk, added so bounded frames (``rowsBetween(-lookback, 0)``) stay exact.

Unbounded frames (running max before, next event after) combine an in-chunk
window with a carry computed over the small per-chunk table.
"""

from __future__ import annotations

from dataclasses import dataclass


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SensorSpec
from .cache import keep

SEQ = "_seq"
CHUNK = "_chunk"
CTX = "_ctx"
HELPERS = (SEQ, CHUNK, CTX)
RANGE_ROWS = 1 << 17    # rows that a range partition is to hold at least, however few rows a chunk has


@dataclass(frozen=True)
class Layout:
    chunk_rows: int = 1 << 20              # at most this many home rows per window task
    range_partitions: int | None = None    # range partitions used to number rows (default: shuffle partitions)


DEFAULT_LAYOUT = Layout()


def add_sequence(df: DataFrame, spec: SensorSpec, layout: Layout = DEFAULT_LAYOUT, rows: int = 0) -> DataFrame:
    """Add ``_seq`` (position within the entity) without a per-entity task.

    Rows are range-partitioned on (entity, time, record, tiebreak): Spark samples that composite key,
    so a hot entity — even one with tied timestamps — spreads over many partitions.  Counts per
    (range partition, entity) give each partition's offset inside its entity (a window over that small
    table); a ``row_number`` inside each (partition, entity) adds the local position.

    ``rows`` (an upper bound, as profiled) makes the number of ranges grow with the data: none is to hold
    much more than ``chunk_rows`` rows, or ``RANGE_ROWS`` where chunks are smaller, as every range is a task
    whose rows are sorted, not a window.  Rows without an entity form an entity of their own."""
    spark = df.sparkSession
    parts = layout.range_partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                                           -(-rows // max(layout.chunk_rows, RANGE_ROWS)))
    # persisted so the count branch and the row branch read ONE range exchange: the partitioner's
    # sample is seeded per RDD, two planned exchanges could cut at different bounds.  A lost block
    # is recomputed through the same shuffle dependency, i.e. with the same bounds.
    r = keep(df.repartitionByRange(parts, F.col(spec.entity), *[F.col(c) for c in spec.order_cols])
             .withColumn("_pid", F.spark_partition_id()))
    counts = r.groupBy(spec.entity, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(spec.entity).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(spec.entity).alias("_o_entity"),
        F.col("_pid").alias("_o_pid"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
    )
    d = r.join(offsets, r[spec.entity].eqNullSafe(offsets["_o_entity"]) & (r["_pid"] == offsets["_o_pid"]))
    d = d.drop("_o_entity", "_o_pid")
    local = Window.partitionBy("_pid", spec.entity).orderBy(*spec.order_cols)
    return d.withColumn(SEQ, F.col("_off") + F.row_number().over(local) - 1).drop("_off", "_pid")


SINGLE = "single_chunk"
LOOKBACK = "lookback"
ROWS = "chunk_rows"


COMPLETE = "null_free"


def profile(df: DataFrame, spec: SensorSpec):
    """One scan: rows of the biggest entity, the double columns without any null, and all rows.
    Per-entity partial counts, then one row to the driver."""
    dbl = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    per = df.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("_n"),
                                      *[F.count(F.when(F.col(c).isNull(), F.lit(1))).alias(c) for c in dbl])
    row = per.agg(F.max("_n").alias("_n"), F.sum("_n").alias("_total"), *[F.sum(c).alias(c) for c in dbl]).first()
    return (row["_n"] or 0), [c for c in dbl if not row[c]], (row["_total"] or 0)


def known_complete(df: DataFrame) -> list:
    """Columns the layout's profile found without nulls (empty when unknown)."""
    if CHUNK not in df.columns:
        return []
    return list(df.schema[CHUNK].metadata.get(COMPLETE, []))


def lay_out(df: DataFrame, spec: SensorSpec, lookback: int, layout: Layout = DEFAULT_LAYOUT,
            force_chunks: bool = False) -> DataFrame:
    """Add ``_seq``, ``_chunk`` and ``_ctx`` (context copies for a ``lookback``-row frame).

    One profiling aggregate decides.  When every entity holds at most ``chunk_rows`` rows, each entity
    is a single chunk: one window task per entity, bounded by ``chunk_rows``, no carries.  Otherwise
    all rows are numbered in one pass over one range exchange, and entities above ``chunk_rows`` are cut into chunks."""
    w_entity = Window.partitionBy(spec.entity).orderBy(*spec.order_cols)
    if force_chunks:
        complete, d = [], add_sequence(df, spec, layout)
    else:
        biggest, complete, total = profile(df, spec)
        if biggest <= layout.chunk_rows:
            meta = {SINGLE: True, COMPLETE: complete}
            return (df.withColumn(SEQ, F.row_number().over(w_entity) - 1)
                    .withColumn(CHUNK, F.lit(0).alias(CHUNK, metadata=meta))
                    .withColumn(CTX, F.lit(False)))
        d = add_sequence(df, spec, layout, total)
    meta = {COMPLETE: complete, LOOKBACK: lookback, ROWS: layout.chunk_rows}
    d = (d.withColumn(CHUNK, F.floor(F.col(SEQ) / F.lit(layout.chunk_rows)).alias(CHUNK, metadata=meta))
         .withColumn(CTX, F.lit(False)))
    return add_context(d)


def add_context(df: DataFrame) -> DataFrame:
    """Copy each row into every later chunk whose first row lies within ``lookback`` rows after it
    (flagged ``_ctx``), so bounded frames of the next chunk see their predecessors."""
    meta = dict(df.schema[CHUNK].metadata)
    lookback, rows = meta.get(LOOKBACK, 0), meta.get(ROWS)
    if meta.get(SINGLE) or not lookback:
        return df
    home = F.col(CHUNK)
    targets = F.array(F.struct(home.alias("c"), F.lit(False).alias("x")))
    last = F.floor((F.col(SEQ) + F.lit(lookback)) / F.lit(rows))
    copies = F.transform(F.sequence(home + 1, last), lambda c: F.struct(c.alias("c"), F.lit(True).alias("x")))
    targets = F.when(last > home, F.concat(targets, copies)).otherwise(targets)
    return (
        df.filter(~F.col(CTX))
        .withColumn("_t", F.explode(targets))
        .withColumn(CHUNK, F.col("_t.c").alias(CHUNK, metadata=meta))
        .withColumn(CTX, F.col("_t.x"))
        .drop("_t")
    )


def single_chunk(df: DataFrame) -> bool:
    return bool(df.schema[CHUNK].metadata.get(SINGLE, False))


def chunk_window(spec: SensorSpec) -> Window:
    return Window.partitionBy(spec.entity, CHUNK).orderBy(SEQ)


def frame(spec: SensorSpec, lo: int, hi: int = 0):
    return chunk_window(spec).rowsBetween(lo, hi)


def home_rows(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(CTX))


def strip(df: DataFrame) -> DataFrame:
    return home_rows(df).drop(*HELPERS)


def ensure_layout(df: DataFrame, spec: SensorSpec, lookback: int, layout: Layout = DEFAULT_LAYOUT):
    """Return (laid-out frame, created?) — reuse an existing layout when present."""
    if CHUNK in df.columns:
        return df, False
    return lay_out(df, spec, lookback, layout), True


def carry_scans(df: DataFrame, spec: SensorSpec, running_max=(), running_min_after=(), entity_min=()) -> DataFrame:
    """Unbounded frames in one pass over the per-chunk table.

    * ``running_max``       [(value, out)]: max of ``value`` over the entity's rows up to and including this one;
    * ``running_min_after`` [(value, out)]: min of ``value`` over this row and all later rows;
    * ``entity_min``        [(value, out)]: min of ``value`` over the whole entity.

    Each is an in-chunk window combined with a carry from the other chunks, computed by one aggregate
    per (entity, chunk) and windows over that small table, joined back once on (entity, chunk)."""
    upto = frame(spec, Window.unboundedPreceding, 0)
    after = frame(spec, 0, Window.unboundedFollowing)
    if single_chunk(df):
        whole_entity = Window.partitionBy(spec.entity, CHUNK)
        return df.withColumns({
            **{out: F.max(v).over(upto) for v, out in running_max},
            **{out: F.min(v).over(after) for v, out in running_min_after},
            **{out: F.min(v).over(whole_entity) for v, out in entity_min},
        })
    home = home_rows(df)
    aggs, carries, finals = [], [], []
    earlier = Window.partitionBy("_c_entity").orderBy("_c_chunk").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("_c_entity").orderBy("_c_chunk").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy("_c_entity")
    locals_ = {}
    for i, (value, out) in enumerate(running_max):
        aggs.append(F.max(value).alias(f"_a{i}"))
        carries.append(F.max(f"_a{i}").over(earlier).alias(f"_k{i}"))
        locals_[f"_l{i}"] = F.max(value).over(upto)
        finals.append((out, F.greatest(f"_l{i}", f"_k{i}")))
    for j, (value, out) in enumerate(running_min_after):
        i = len(running_max) + j
        aggs.append(F.min(value).alias(f"_a{i}"))
        carries.append(F.min(f"_a{i}").over(later).alias(f"_k{i}"))
        locals_[f"_l{i}"] = F.min(value).over(after)
        finals.append((out, F.least(f"_l{i}", f"_k{i}")))
    for j, (value, out) in enumerate(entity_min):
        i = len(running_max) + len(running_min_after) + j
        aggs.append(F.min(value).alias(f"_a{i}"))
        carries.append(F.min(f"_a{i}").over(whole).alias(f"_k{i}"))
        finals.append((out, F.col(f"_k{i}")))
    per_chunk = home.groupBy(F.col(spec.entity).alias("_c_entity"), F.col(CHUNK).alias("_c_chunk")).agg(*aggs)
    carry = per_chunk.select("_c_entity", "_c_chunk", *carries)
    d = df.withColumns(locals_) if locals_ else df
    d = d.join(carry, d[spec.entity].eqNullSafe(carry["_c_entity"]) & (d[CHUNK] == carry["_c_chunk"]), "left")
    d = d.withColumns({out: expr for out, expr in finals})
    return d.drop("_c_entity", "_c_chunk", *locals_.keys(), *[f"_k{i}" for i in range(len(finals))])
