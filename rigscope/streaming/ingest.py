"""Incremental ingestion: new reading files → the stored readings table, ``ON CONFLICT DO NOTHING``.

The batch ingestion (dedup inside the batch, skip stored keys, append) driven by Structured
Streaming: every micro-batch goes through the same A5 operator inside ``foreachBatch``; the
checkpoint makes a restarted query resume after its last committed batch, and the key index makes a
replayed batch append nothing. A batch reads the key files that may hold its keys, not the keys of the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.store import append_indexed


def start_ingest(spark: SparkSession, source_dir: str, table_path: str, checkpoint: str, schema: T.StructType,
                 key="record_id", order_cols=("t_us",), available_now: bool = True, max_files: int = 100,
                 partition_by: str | None = None):
    """``partition_by``: a date column of the rows that the table is partitioned by; a key that is stored under another
    date is there already."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source_dir))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        append_indexed(batch, table_path, key, list(order_cols), partition_by=partition_by)

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
