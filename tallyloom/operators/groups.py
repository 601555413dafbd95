"""Groups of records that must be handled together, because they share an identity directly or through others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import cut


def linked(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """member and group (the least member that links reach) of all values that a or b has; a null end makes no link.

    Each round gives a member the least group among its neighbours' and then that group's own group, so
    groups reach over twice as many links each time. A member of many links meets them in partial aggregates.
    """
    ends = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("x"), F.col(b).alias("y"))
    links = cut(ends.union(ends.select("y", "x")).distinct(), "links")
    members = pairs.select(F.col(a).alias("member")).union(pairs.select(F.col(b))).where("member IS NOT NULL").distinct()
    now = cut(members.withColumn("group", F.col("member")), "groups")
    while True:
        offered = links.join(now.withColumnRenamed("member", "y"), "y").groupBy(F.col("x").alias("member")).agg(F.min("group").alias("least"))
        lower = now.join(offered, "member", "left").select("member", F.least("group", F.coalesce("least", "group")).alias("group"), F.col("group").alias("was"))
        # the group that a member left goes along to the lower one, with all that are still in it
        moved = lower.where("group < was").groupBy(F.col("was").alias("from")).agg(F.min("group").alias("to"))
        new = lower.join(moved, F.col("group") == F.col("from"), "left").select("member", F.least("group", F.coalesce("to", "group")).alias("group"), "was")
        new = cut(new, "groups")
        if new.where("group != was").isEmpty():
            return new.select("member", "group")
        now = new.select("member", "group")


def planned(files: DataFrame, group: list[str], order: list[str], most: int) -> DataFrame:
    """files with a batch (stretch, own) of at most `most` files, whole groups in the order of their first file; a larger group is a batch of its own.

    A group of up to half of `most` goes to the stretch of that length in which it begins, so a batch stays within `most`; larger
    groups stand alone. The sums before a group come from sums of range partitions, so no task sees all groups.
    """
    half = max(1, most // 2)
    sizes = files.groupBy(*group).agg(F.count("*").alias("files"), F.min(F.struct(*order)).alias("first"))
    ranged = cut(sizes.repartitionByRange("first", *group).withColumn("part", F.spark_partition_id()), "sizes")
    per_part = ranged.groupBy("part").agg(F.sum("files").alias("n"))  # a row for each partition
    upto = lambda *by: W.partitionBy(*by[:-1]).orderBy(*by[-1]).rowsBetween(W.unboundedPreceding, -1)
    before = per_part.select("part", F.coalesce(F.sum("n").over(upto(["part"])), F.lit(0)).alias("before"))
    start = F.col("before") + F.coalesce(F.sum("files").over(upto("part", ["first", *group])), F.lit(0))
    batch = F.struct(F.floor(start / half).alias("stretch"), F.when(F.col("files") > half, start).alias("own"))
    return files.join(ranged.join(before, "part").select(*group, batch.alias("batch")), group)
