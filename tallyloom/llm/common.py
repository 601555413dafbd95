"""Shared helpers: reading tables, and the shared folder for what must outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Temporary folders of applications that run in one process without the setting.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset and all runs in one process, under a temporary folder that the application keeps to."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="tallyloom-")
        base = _LOCAL[app]
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table that written() returned, once nothing reads it any more."""
    path = None
    for f in df.inputFiles()[:1]:
        path = f.rsplit("/", 1)[0]
    if path:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def held_out(id_col: str, modulus: int, rest: int):
    """True where crc32 of the id as text leaves this remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == rest
