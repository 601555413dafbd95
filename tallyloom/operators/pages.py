"""Pages of a frozen result: membership and order are written once for a query, so pages don't shift when rows change."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import cut, shared_dir

#: Rows of a page at most, and seconds after which an unused and any frozen result is gone.
MOST_ROWS, IDLE_S, AGE_S = 200, 300, 1800


def fingerprint(query: dict, sort: str, descending: bool, size: int) -> str:
    """SHA-256 of the canonical JSON of a query and how its result is listed."""
    canonical = json.dumps({"query": query, "sort": sort, "direction": "desc" if descending else "asc", "pageSize": size}, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    return hashlib.sha256(b"reporting-list:v1\0" + canonical.encode()).hexdigest()


def numbered(df: DataFrame, order: list[Column], to: str = "position") -> DataFrame:
    """df with each row's place in an order, from 1: a range sort, and sums of its partitions before each. order must tell rows apart."""
    parts = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each partition
    before = counts.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    at = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return parts.withColumn("__at", at).join(before, "__part").withColumn(to, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


@dataclass
class _Frozen:
    path: str
    print: str
    rows: int
    size: int
    created: float
    used: float
    cursors: dict[str, int] = field(default_factory=dict)


class Pages:
    """Frozen results of a process; their rows are Parquet tables in the shared folder."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self._clock, self._frozen = clock, {}

    def first(self, result: DataFrame, order: list[Column], query: dict, sort: str, descending: bool = False, size: int = MOST_ROWS) -> tuple[DataFrame, str | None]:
        """Freezes a result and returns its first page and the cursor of the next one."""
        if not 1 <= size <= MOST_ROWS:
            raise ValueError(f"a page has 1 to {MOST_ROWS} rows")
        self._expire()
        spark = result.sparkSession
        path = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
        numbered(result, order).sortWithinPartitions("position").write.parquet(path)
        now = self._clock()
        frozen = _Frozen(path, fingerprint(query, sort, descending, size), spark.read.parquet(path).count(), size, now, now)
        self._frozen[uuid.uuid4().hex] = frozen
        return self._page(spark, frozen, 0)

    def next(self, spark: SparkSession, cursor: str, query: dict, sort: str, descending: bool = False, size: int = MOST_ROWS) -> tuple[DataFrame, str | None]:
        """The page of a cursor; the query must be the one that was frozen."""
        self._expire()
        frozen = next((f for f in self._frozen.values() if cursor in f.cursors), None)
        if frozen is None:
            raise LookupError("the result is no longer kept")
        if frozen.print != fingerprint(query, sort, descending, size):
            raise ValueError("the cursor is of another query")
        frozen.used = self._clock()
        return self._page(spark, frozen, frozen.cursors[cursor])

    def _page(self, spark: SparkSession, frozen: _Frozen, start: int) -> tuple[DataFrame, str | None]:
        page = spark.read.parquet(frozen.path).where(F.col("position").between(start + 1, start + frozen.size))  # read by the statistics of row groups
        cursor = None
        if start + frozen.size < frozen.rows:
            cursor = uuid.uuid4().hex
            frozen.cursors[cursor] = start + frozen.size
        return page, cursor

    def _expire(self) -> None:
        now = self._clock()
        self._frozen = {k: f for k, f in self._frozen.items() if now - f.used <= IDLE_S and now - f.created <= AGE_S}
