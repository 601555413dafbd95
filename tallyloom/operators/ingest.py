"""Idempotent ingest: batches of conversations merged into a stored table, with an audit row for each and receipts against replays.

A store is a folder that all executors share: `data/<version>` holds the merged table after each batch, and `commits/<version>` one
small table with the batch's run rows (one per provider) and its receipt. Commits are written last and whole, and readers
follow the newest one, so a batch that was broken off has changed nothing and can be sent again.
There is one writer at a time. A batch whose receipt is known returns its former run rows and writes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import merge

COMMIT = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("receipt", T.StringType()), T.StructField("version", T.LongType()), T.StructField("provider", T.StringType()), T.StructField("ingested_ms", T.LongType()),
    *[T.StructField(c, T.LongType()) for c in ("received", "written", "skipped", "malformed", "duplicates")],
])


def canonical_receipt(value: str) -> str:
    """value, if it is a UUID of version 4 in its canonical form."""
    try:
        parsed = uuid.UUID(value)
    except (AttributeError, ValueError, TypeError):
        raise ValueError("a receipt must be a canonical UUID of version 4") from None
    if parsed.version != 4 or str(parsed) != value:
        raise ValueError("a receipt must be a canonical UUID of version 4")
    return value


def commits(spark: SparkSession, store: str) -> DataFrame:
    """All run rows of a store, with their batches' receipts."""
    spark.createDataFrame([], COMMIT).write.mode("ignore").parquet(f"{store}/commits/none")
    return spark.read.schema(COMMIT).option("recursiveFileLookup", True).parquet(f"{store}/commits")


def runs(spark: SparkSession, store: str) -> DataFrame:
    return commits(spark, store).drop("receipt", "version")


def receipts(spark: SparkSession, store: str) -> DataFrame:
    return commits(spark, store).where("receipt IS NOT NULL").select("receipt", "run_id").distinct()


def replayed(spark: SparkSession, store: str, receipt: str) -> DataFrame:
    """The run rows of the batch that a receipt was given for; none if it is new."""
    return receipts(spark, store).where(F.col("receipt") == receipt).join(runs(spark, store), "run_id")


def current(spark: SparkSession, store: str, schema: T.StructType) -> DataFrame:
    """The stored table after the newest batch; empty before the first."""
    version = commits(spark, store).agg(F.max("version")).first()[0]
    return spark.createDataFrame([], schema) if version is None else spark.read.schema(schema).parquet(f"{store}/data/{version}")


def ingest(batch: DataFrame, store: str, now_ms: int, receipt: str | None = None, malformed: DataFrame | None = None, key: str = "conversation_id") -> DataFrame:
    """Merges a batch of conversations (key, provider, event_count, content_hash and more) and returns its run rows.

    Of several copies of a conversation in the batch the richest counts, the others are duplicates. malformed: provider, malformed. Each provider
    of the batch or of malformed gets a run row; received counts conversations, which are written or skipped. An empty batch leaves the table as it is.
    """
    spark = batch.sparkSession
    if receipt is not None:
        former = replayed(spark, store, canonical_receipt(receipt))
        if not former.isEmpty():
            return former.drop("receipt")
    now = current(spark, store, batch.schema)
    version = 1 + (commits(spark, store).agg(F.max("version")).first()[0] or 0)
    best = merge.best_copy(batch, key)
    did = merge.outcome(now, best.drop("duplicates"), key).where("outcome != 'kept'")
    new = F.count_if(F.col("outcome").isin("inserted", "replaced"))
    counts = did.join(best.select(key, "provider", "duplicates"), key).groupBy("provider").agg(F.count("*").alias("received"), new.alias("written"), F.sum("duplicates").alias("duplicates"))
    bad = (spark.createDataFrame([], "provider string, malformed bigint") if malformed is None else malformed).groupBy("provider").agg(F.sum("malformed").alias("malformed"))
    rows = counts.join(bad, "provider", "full").fillna(0, ["received", "written", "duplicates", "malformed"])
    rows = rows.withColumns({"run_id": F.lit(str(uuid.uuid4())), "receipt": F.lit(receipt), "version": F.lit(version), "ingested_ms": F.lit(now_ms), "skipped": F.col("received") - F.col("written")})
    merge.merge(now, best.drop("duplicates").select(now.columns), key).write.mode("overwrite").parquet(f"{store}/data/{version}")
    rows.select([F.col(f.name).cast(f.dataType) for f in COMMIT]).coalesce(1).write.mode("overwrite").parquet(f"{store}/commits/{version}")
    return commits(spark, store).where(F.col("version") == version).drop("receipt", "version")


def summary(spark: SparkSession, store: str) -> DataFrame:
    """Counters of all batches by provider."""
    sums = [F.sum(c).alias(c) for c in ("received", "written", "skipped", "malformed", "duplicates")]
    return commits(spark, store).groupBy("provider").agg(F.count("*").alias("batches"), *sums)


def upgraded(rows: DataFrame, column: str, kind: str, version: str = "schema_version", since: int = 2) -> tuple[DataFrame, DataFrame]:
    """(rows in the current schema, rows that are refused): older rows have no value in a column that came with version `since`; one that has is refused. A missing column is null."""
    full = rows if column in rows.columns else rows.withColumn(column, F.lit(None).cast(kind))
    refused = (F.col(version) < since) & F.col(column).isNotNull()
    return full.where(~refused).withColumn(version, F.greatest(F.col(version), F.lit(since))), full.where(refused)
