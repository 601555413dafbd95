"""Replay of logs whose records may take earlier ones back.

A log is a list that grows at its end: a write of a new id appends a message, a write of an id that the list
has replaces its content in place, a rewind to an id cuts the list before that message, and a rewind
to an id that the list lacks, or a clear, empties it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut


def _cuts(log: DataFrame) -> DataFrame:
    """key, at, q of every rewind and clear: all that was appended at q or later goes.

    The place of a rewind's target at that time is its earliest write that no rewind in between has taken back, which depends on
    earlier rewinds. So the places are found in rounds, each with those of the round before, until none changes; a
    round settles the rewinds that depend on settled ones only, and most logs need two.
    """
    clears = log.where("kind = 'clear'").select("key", "at", F.lit(-1).cast("bigint").alias("q"))
    rewinds = log.where("kind = 'rewind'").select("key", "at", F.col("id").alias("target"))
    writes = log.where("kind = 'write'").select("key", F.col("at").alias("w"), F.col("id").alias("target"))
    tried = cut(rewinds.join(writes.hint("merge"), ["key", "target"], "left").withColumn("w", F.when(F.col("w") < F.col("at"), F.col("w"))).distinct(), "rewinds")
    cuts = cut(clears.unionByName(rewinds.select("key", "at", F.lit(None).cast("bigint").alias("q"))), "cuts")
    while True:
        between = tried.alias("t").join(cuts.where("q IS NOT NULL").alias("c").hint("merge"), F.expr("t.key = c.key AND t.w < c.at AND c.at < t.at AND c.q <= t.w"), "left_anti")
        found = between.groupBy("key", "at").agg(F.coalesce(F.min("w"), F.lit(-1)).alias("q"))
        # a rewind all of whose writes were taken back empties the list
        placed = rewinds.select("key", "at").join(found.hint("merge"), ["key", "at"], "left").withColumn("q", F.coalesce("q", F.lit(-1).cast("bigint")))
        new = cut(clears.unionByName(placed), "cuts")
        if new.exceptAll(cuts).isEmpty():
            return new
        cuts = new


def replayed(log: DataFrame, key: list[str], at: str, kind: str, id_col: str) -> DataFrame:
    """The messages that a log ends with: key, id, position (the `at` of the write that appended it) and last (that of its newest write).

    kind is "write", "rewind" or "clear"; `at` is a whole number from 0 that tells a log's records apart. A message lives where
    no later cut goes to or before its place: the least cut that follows is a window's minimum over the rows after it.
    Records of other kinds or without an id (unless clears) change nothing; an empty log gives no rows.
    """
    rows = log.select(F.struct(*key).alias("key"), F.col(at).cast("bigint").alias("at"), F.col(kind).alias("kind"), F.col(id_col).alias("id")).where("kind = 'clear' OR kind IN ('write', 'rewind') AND id IS NOT NULL")
    cuts = _cuts(rows)
    after = Window.partitionBy("key").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    both = rows.where("kind = 'write'").select("key", "at", "id", F.lit(None).cast("bigint").alias("q")).unionByName(cuts.withColumn("id", F.lit(None).cast(rows.schema["id"].dataType)))
    lives = both.withColumn("cut", F.min("q").over(after)).where("q IS NULL").withColumn("lives", F.col("cut").isNull() | (F.col("cut") > F.col("at")))
    ends = lives.groupBy("key", "id").agg(F.min(F.when(F.col("lives"), F.col("at"))).alias("position"), F.max("at").alias("last")).where("position IS NOT NULL")
    return ends.select("key.*", F.col("id").alias(id_col), "position", "last")
