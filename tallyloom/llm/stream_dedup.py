"""Exact deduplication as a stateful stream.

A file stream of documents feeds a keyed aggregate whose state (RocksDB on the executors' disks,
with changelogs in the shared checkpoint) never expires: for each digest it retains the largest
id, how many rows it saw, and the locator of the row that stays, which is its file, id and text
hash. Rows of one digest meet in partial aggregates before the shuffle, so a hot digest costs a
few rows. Each micro-batch appends the digests it changed to a ledger; the newest row
of a digest counts. A hit, a row whose digest has other rows, is checked by its full bytes
against the row at the locator; rows whose bytes differ in spite of their digests are grouped
by their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_written, shared_dir, written

#: Each partition's store would else reserve some MB of disk for its manifest alone.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
#: Input of a micro-batch, whatever the size of the table: later batches meet the state of earlier ones.
BYTES_PER_TRIGGER = 1 << 30


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _row(text_col: str, id_col: str, digest) -> list[Column]:
    return [F.col(id_col).alias("id"), digest(F.coalesce(text_col, F.lit(""))).alias("digest"), F.col("_metadata.file_path").alias("file")]


def _pattern(path: str) -> str:
    """A pattern for just this path: a stream takes a plain path for a folder, but a table may be one file."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def run_stream(spark: SparkSession, path: str, out: str, check: str, text_col: str = "text", id_col: str = "doc_id", digest=sha256, bytes_per_trigger: int = BYTES_PER_TRIGGER) -> None:
    """Reads all files at path that the checkpoint hasn't seen, and appends the changed digests (digest, size, kept, batch) to the ledger at out.

    Run again with the same checkpoint after more files have come, it goes on from its state.
    """
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", str(bytes_per_trigger)).parquet(_pattern(path))
    best = F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", "file"))
    state = stream.select(*_row(text_col, id_col, digest)).groupBy("digest").agg(F.count("*").alias("size"), best.alias("kept"))

    def append(changed: DataFrame, batch: int) -> None:
        # a batch that is run again after a failure replaces its own rows
        changed.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{out}/changes-{batch}")

    before = {key: spark.conf.get(key, None) for key in STORE}
    for key, value in STORE.items():
        spark.conf.set(key, value)
    try:
        query = state.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", check).trigger(availableNow=True).start()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    query.awaitTermination()


def newest(spark: SparkSession, out: str, id_type: T.DataType) -> DataFrame:
    """The newest state of each digest in a ledger: digest, size, kept."""
    kept = T.StructType([T.StructField("known", T.BooleanType()), T.StructField("id", id_type), T.StructField("file", T.StringType())])
    schema = T.StructType([T.StructField("digest", T.StringType()), T.StructField("size", T.LongType()), T.StructField("kept", kept), T.StructField("batch", T.LongType())])
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/changes-none")
    ledger = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
    return ledger.groupBy("digest").agg(F.max(F.struct("batch", "size", "kept")).alias("x")).select("digest", "x.size", "x.kept")


def dedup(spark: SparkSession, path: str, text_col: str = "text", id_col: str = "doc_id", digest=sha256, bytes_per_trigger: int = BYTES_PER_TRIGGER) -> DataFrame:
    """One row per document of the Parquet table at path: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the
    largest id stays; rows without an id come after all others, and of several rows with the
    largest id all are marked kept, since nothing tells them apart. digest maps a text column to a
    string. An empty table gives no rows; further columns are ignored.
    """
    docs = spark.read.parquet(path)
    out, check = shared_dir(spark, "dedup-ledger"), shared_dir(spark, "dedup-stream")
    run_stream(spark, path, out, check, text_col, id_col, digest, bytes_per_trigger)
    state = written(newest(spark, out, docs.schema[id_col].dataType), "dedup-state")
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(*_row(text_col, id_col, digest), text.alias("text"))
    # the full bytes of hits against the row at the locator; these joins only feed a write, so Spark may split a hot digest
    hits = written(rows.join(state.where("size > 1"), "digest"), "dedup-hits")
    located = hits.where(F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("file") == F.col("kept.file"))).groupBy("digest").agg(F.min("text").alias("kept_text"))
    differ = written(hits.join(located, "digest").where("text != kept_text").select("digest"), "dedup-collisions")
    light = docs.select(*_row(text_col, id_col, digest), sha256(text).alias("sha"))
    if differ.isEmpty():
        drop_written(spark, hits)
        equal = light.join(state, "digest").select("id", F.col("kept.id").alias("keep_id"), F.col("size").alias("group_size"), "sha")
    else:
        equal = light.join(state, "digest").join(differ, "digest", "left_anti").select("id", F.col("kept.id").alias("keep_id"), F.col("size").alias("group_size"), "sha")
        clash = hits.join(differ.distinct(), "digest", "left_semi").select("id", sha256(F.col("text")).alias("sha"), F.xxhash64("text").alias("x"), "text")
        groups = clash.groupBy("sha", "x", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        equal = equal.union(clash.join(groups, ["sha", "x", "text"]).select("id", "keep_id", "group_size", "sha"))
    return equal.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
