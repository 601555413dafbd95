"""Incremental collection: new files of normalized conversations are merged into a store as they come."""

from __future__ import annotations

import hashlib
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators import ingest


def batch_receipt(stream: str, batch: int) -> str:
    """The receipt of a stream's micro-batch, the same when it is run again."""
    digest = hashlib.sha256(f"{stream}:{batch}".encode()).digest()
    return str(uuid.UUID(bytes=digest[:16], version=4))


def collect(spark: SparkSession, source: str, schema: T.StructType, store: str, checkpoint: str, files_per_batch: int = 1000) -> DataFrame:
    """Merges all files below source that the checkpoint hasn't seen, and returns the store's counters by provider.

    The checkpoint remembers the files; a micro-batch that was merged but not yet noted there is told by its receipt and changes nothing
    when it runs again. The merge takes the richest copy of a conversation, so the order of files and how they
    fall into micro-batches make no difference to the table. `_malformed`, where the schema has it, counts a file's malformed records by provider.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).parquet(source)
    known = "_malformed" in schema.names

    def step(batch: DataFrame, number: int) -> None:
        data = batch.where("conversation_id IS NOT NULL").drop("_malformed") if known else batch
        malformed = batch.where("_malformed > 0").selectExpr("provider", "_malformed AS malformed") if known else None
        ingest.ingest(data, store, time.time_ns() // 1_000_000, batch_receipt(checkpoint, number), malformed)

    rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return ingest.summary(spark, store)
