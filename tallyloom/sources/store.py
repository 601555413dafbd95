"""Tables written once to the shared folder and read from there."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths by application, source and name of the table.
_STORED: dict[tuple[str, str, str], str] = {}

#: Names in the catalog of those of them that are dealt to buckets.
_BUCKETED: dict[tuple[str, str, str], str] = {}


#: Lets Spark read a bucketed table by files of a size where no operator needs its buckets.
_BY_SIZE = "spark.sql.sources.bucketing.autoBucketedScan.enabled"

#: Temporary folders of applications that run in one process without the setting.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and all runs in one process, a temporary folder that the application keeps to."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="tallyloom-")
        base = _LOCAL[app]
    return base.rstrip("/")


def cut(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder, which ends its lineage; for what a loop reads several times."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark(spark: SparkSession, folder: str) -> str:
    """A hash of the names, sizes and times of all files below a folder, from its listing: another one as soon as a file is added or changed."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files below a folder, from the file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def stored(df: DataFrame, source: str, name: str, by: str | None = None, ranged: bool = False, key: str | None = None, buckets: int = 0) -> DataFrame:
    """df as it was written on the first call of this application for (source, name).

    With `by`, each partition is sorted by that column, so that the statistics of row groups let scans with a filter on it skip
    most of them; ranged also deals the rows by ranges of it, so that such scans read few files, for a shuffle and a
    second reading of df that finds the ranges. With `key`, the rows are dealt to buckets by it instead, so that tables with the same
    key and number of buckets are joined and grouped by it without a shuffle. The written table stands until forget(); a source's name
    should hold its mark(), so that changed files are another source.
    """
    spark = df.sparkSession
    at = (spark.sparkContext.applicationId, source, name)
    if at not in _STORED:
        table = f"{name}_{uuid.uuid4().hex}"
        path = f"{shared_dir(spark)}/{table}"
        if key is not None:
            writer = df.repartition(buckets, key).write.bucketBy(buckets, key)
            # rows of a source with the same buckets aren't shuffled; read by bucket, not by size, each bucket is one task and one file
            before = spark.conf.get(_BY_SIZE)
            spark.conf.set(_BY_SIZE, "false")
            try:
                (writer if by is None else writer.sortBy(by)).option("path", path).saveAsTable(table)
            finally:
                spark.conf.set(_BY_SIZE, before)
            _BUCKETED[at] = table
        else:
            dealt = df.repartitionByRange(by) if ranged else df
            (df if by is None else dealt.sortWithinPartitions(by)).write.parquet(path)
        _STORED[at] = path
    return spark.table(_BUCKETED[at]) if at in _BUCKETED else spark.read.schema(df.schema).parquet(_STORED[at])


def forget(spark: SparkSession, source: str) -> None:
    """Makes the tables of a source, or of all sources in a folder, be written anew, and deletes what was written of them."""
    for key in [k for k in _STORED if k[0] == spark.sparkContext.applicationId and (k[1] == source or k[1].startswith(source + "@"))]:
        if key in _BUCKETED:
            spark.sql(f"DROP TABLE IF EXISTS {_BUCKETED.pop(key)}")
        p = spark._jvm.org.apache.hadoop.fs.Path(_STORED.pop(key))
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
