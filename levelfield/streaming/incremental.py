"""Landed batches → keyed table, safe to replay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from levelfield.sources.sinks import SnapshotTable


def incremental_upsert(
    spark: SparkSession,
    landed: str,
    schema: StructType,
    table: SnapshotTable,
    checkpoint: str,
    order: Sequence[str] = (),
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Merge every landed Parquet file not seen before, then stop.

    The checkpoint remembers the files, and the table's ledger the batches: the entry that
    makes new files current also names the batch, so one replayed after a failure, at
    whatever moment it struck, is in the table exactly once.
    """

    def merge(batch: DataFrame, number: int) -> None:
        table.upsert(batch, order, source=checkpoint, number=number)

    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        reader.parquet(landed)
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
