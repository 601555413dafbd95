"""Activity calendars: 52 weeks of days ending on the Saturday of a slice's last week."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import DAY_MS
from .slices import Slice, semantic_calls

DAYS = 364
TOP = 5


def days(spark: SparkSession, end_ms: int, observed_from_ms: int | None = None) -> DataFrame:
    """364 days as numbers since 1970 (1970-01-01 was a Thursday); observed from the export's start to the range's end."""
    last = end_ms // DAY_MS
    saturday = last + (2 - last) % 7
    seen = F.col("day") <= last
    if observed_from_ms is not None:
        seen &= F.col("day") >= observed_from_ms // DAY_MS
    return spark.range(saturday - DAYS + 1, saturday + 1, numPartitions=1).withColumnRenamed("id", "day").withColumn("observed", seen)


def _day(column: str):
    return F.floor(F.col(column) / DAY_MS).alias("day")


def activity(s: Slice, calendar: DataFrame) -> DataFrame:
    """Per day: conversations and turns started, their duration, and tokens; zero on observed days, null on others."""
    turns = s.turns.groupBy(_day("started_ms")).agg(F.count("*").alias("turns"), F.sum("duration_ms").alias("duration_ms"))
    conversations = s.conversations.groupBy(_day("started_ms")).agg(F.count("*").alias("conversations"))
    tokens = semantic_calls(s).groupBy(_day("timestamp_ms")).agg(F.sum("total_tokens").alias("tokens"))
    out = calendar.join(turns, "day", "left").join(conversations, "day", "left").join(tokens, "day", "left")
    return out.select("day", "observed", *[F.when(F.col("observed"), F.coalesce(c, F.lit(0))).alias(c) for c in ("conversations", "turns", "duration_ms", "tokens")])


def series(s: Slice, calendar: DataFrame, by: str) -> DataFrame:
    """Tokens per observed day in the five largest groups of all days and a remainder."""
    calls = semantic_calls(s).where("timestamp_ms IS NOT NULL").join(calendar.where("observed").select("day"), F.floor(F.col("timestamp_ms") / DAY_MS) == F.col("day"), "left_semi")
    daily = calls.groupBy(_day("timestamp_ms"), F.coalesce(by, F.lit("unknown")).alias("label")).agg(F.sum("total_tokens").alias("tokens"))
    top = daily.groupBy("label").agg(F.sum("tokens").alias("all")).orderBy(F.desc("all"), "label").limit(TOP).select("label", F.lit(True).alias("top"))
    return daily.join(F.broadcast(top), "label", "left").groupBy("day", F.when(F.col("top"), F.col("label")).otherwise("remainder").alias("bucket")).agg(F.sum("tokens").alias("tokens"))


def streaks(active: DataFrame) -> DataFrame:
    """The longest run of observed days on which a turn or a conversation began, and the run that ends at the last observed day (0 if nothing began on it). active: day, observed, turns and, if it is told, conversations of one calendar."""
    last = active.where("observed").agg(F.max("day").alias("last"))
    began = F.coalesce(F.col("turns") > 0, F.lit(False))
    if "conversations" in active.columns:
        began |= F.coalesce(F.col("conversations") > 0, F.lit(False))
    runs = active.where(F.col("observed") & began).withColumn("run", F.col("day") - F.row_number().over(Window.orderBy("day"))).groupBy("run").agg(F.count("*").alias("n"), F.max("day").alias("end"))
    return runs.crossJoin(last).agg(F.coalesce(F.max("n"), F.lit(0)).alias("longest"), F.coalesce(F.max(F.when(F.col("end") == F.col("last"), F.col("n"))), F.lit(0)).alias("current"))


def daily_peak(s: Slice, calendar: DataFrame) -> DataFrame:
    """The most tokens of one calendar day, null without timed calls."""
    return activity(s, calendar).agg(F.max(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("peak_tokens"))


def availability(s: Slice) -> DataFrame:
    """Which metrics and breakdowns the slice can show."""
    calls = semantic_calls(s).where("timestamp_ms IS NOT NULL").agg((F.count("*") > 0).alias("tokens"), F.coalesce(F.bool_and(F.col("provider") != "unknown"), F.lit(False)).alias("by_provider"), F.coalesce(F.bool_and(F.col("model") != "unknown"), F.lit(False)).alias("by_model"))
    turns = s.turns.agg((F.count("started_ms") > 0).alias("turns"), (F.count("duration_ms") > 0).alias("duration"))
    return calls.crossJoin(turns).crossJoin(s.conversations.agg((F.count("started_ms") > 0).alias("conversations")))
