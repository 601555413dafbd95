"""Metrics of a slice: each family is one aggregate over one fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DAY_MS, change, ratio
from .slices import Slice, closed, semantic_calls

HOUR_MS = 3_600_000


def percentile(x: Column | str, p: float) -> Column:
    """Exact, interpolated, null without values; rounded to 3 decimals, below which engines differ."""
    return F.round(F.percentile(x, p), 3)


def spread(x: Column | str, name: str) -> list[Column]:
    """Three percentiles of one aggregate, so that values are kept and shuffled once."""
    places = (0.5, 0.75, 0.95)
    all_of = F.percentile(x, list(places))
    return [F.round(all_of[i], 3).alias(f"{name}_p{round(100 * p)}") for i, p in enumerate(places)]


def islands(turns: DataFrame, by: str) -> DataFrame:
    """Merged active intervals of closed turns per machine: touching intervals are one. One shuffle by machine."""
    order = Window.partitionBy(by).orderBy("started_ms", "ended_ms")
    before = F.max("ended_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = turns.where(F.col("ended_ms").isNotNull() & (F.col("ended_ms") >= F.col("started_ms"))).withColumn("fresh", (before.isNull() | (F.col("started_ms") > before)).cast("int"))
    return marked.withColumn("island", F.sum("fresh").over(order)).groupBy(by, "island").agg((F.max("ended_ms") - F.min("started_ms")).alias("length_ms"))


def active_time(turns: DataFrame, by: str, share_safe: bool = False) -> DataFrame:
    """Active milliseconds per machine: merged intervals, or in shared reports the plain sum of durations."""
    if share_safe:
        return turns.groupBy(by).agg(F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("active_ms"))
    return islands(turns, by).groupBy(by).agg(F.sum("length_ms").alias("active_ms"))


def peak_concurrency(turns: DataFrame, by: str) -> DataFrame:
    """The most turns at once per machine; at one instant ends come before starts. Changes are summed per instant before the sweep."""
    ok = turns.where("ended_ms IS NOT NULL AND ended_ms >= started_ms")
    ends = ok.select(by, F.col("started_ms").alias("at"), F.lit(1).alias("delta")).union(ok.select(by, F.col("ended_ms").alias("at"), F.lit(-1).alias("delta")))
    summed = ends.groupBy(by, "at", "delta").agg(F.sum("delta").alias("step"))
    running = F.sum("step").over(Window.partitionBy(by).orderBy("at", "delta"))
    return summed.withColumn("running", running).groupBy(by).agg(F.greatest(F.max("running"), F.lit(0)).alias("peak"))


def headline(s: Slice) -> DataFrame:
    """The 24 scalars of a slice in one row."""
    calls = semantic_calls(s).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_tokens", "cached_input_tokens", "input_tokens", "reasoning_output_tokens", "output_tokens")])
    machines = s.conversations.select("conversation_id", "machine", "semantics")
    turns = s.turns.join(machines, "conversation_id", "left")
    done = closed()
    additive = F.when(done & (F.col("semantics") == "additive"), F.col("total_tokens"))
    of_turns = turns.agg(
        F.count("*").alias("turns"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "aborted").alias("aborted"),
        *spread(additive, "tokens_per_turn"), *spread(F.when(done, F.col("tool_calls")), "tools_per_turn"),
        *spread(F.when(done, F.col("duration_ms")), "duration"), *spread(F.when(done, F.col("ttft_ms")), "ttft"),
        F.count_distinct(F.floor(F.col("started_ms") / DAY_MS)).alias("active_days"),
    )
    active = active_time(turns.where(done), "machine").agg(F.coalesce(F.sum("active_ms"), F.lit(0)).alias("active_ms"))
    pressure = s.samples.where("window_tokens > 0").agg(*spread(100.0 * F.col("input_tokens") / F.col("window_tokens"), "pressure"))
    # four frames of one row each
    row = of_turns.crossJoin(calls).crossJoin(active).crossJoin(pressure)
    finished = F.col("completed") + F.col("aborted")
    return row.select(
        "turns", "completed", "aborted", F.col("total_tokens").alias("tokens"),
        *[f"{n}_p{p}" for n in ("tokens_per_turn", "tools_per_turn", "duration", "ttft") for p in (50, 75, 95)],
        F.round(ratio(F.col("cached_input_tokens"), F.col("input_tokens")), 3).alias("cache_rate"), F.round(ratio(F.col("aborted"), finished), 3).alias("abort_rate"),
        F.round(ratio(F.col("reasoning_output_tokens"), F.col("output_tokens")), 3).alias("reasoning_share"), "active_ms",
        F.round(F.when(F.col("active_ms") == 0, F.lit(0.0)).otherwise(finished * float(HOUR_MS) / F.col("active_ms")), 3).alias("throughput"), "pressure_p50", "pressure_p95", "active_days",
    )


COHORTS = ("project", "model", "effort", "mode", "delegation", "compaction")
LEAST_GROUP = 5


def cohorts(s: Slice, by: str, settings: DataFrame, share_safe: bool = False) -> DataFrame:
    """Closed turns grouped by a property of the turn or its conversation; shared reports hide groups of under five turns.

    Medians ignore token semantics here. settings spans the whole data set, not the slice.
    """
    turns = s.turns.where(closed()).join(s.conversations.select("conversation_id", "project", "models"), "conversation_id")
    if by in ("model", "effort", "mode"):
        turns = turns.join(settings.select("conversation_id", "turn_no", F.col(by).alias("set")), ["conversation_id", "turn_no"], "left")
    if by == "project":
        name = F.coalesce(F.nullif(F.col("project"), F.lit("")), F.lit("unknown"))
    elif by == "model":
        name = F.coalesce("set", F.nullif(F.array_join("models", ", "), F.lit("")), F.lit("unknown"))
    elif by in ("effort", "mode"):
        name = F.coalesce("set", F.lit("unknown"))
    elif by == "delegation":
        ids = s.subagents.select(F.col("parent_id").alias("conversation_id")).distinct().withColumn("marked", F.lit(True))
        turns = turns.join(ids, "conversation_id", "left")
        name = F.when(F.col("marked"), "delegated").otherwise("not delegated")
    elif by == "compaction":
        turns = turns.join(s.compactions.select("conversation_id").distinct().withColumn("marked", F.lit(True)), "conversation_id", "left")
        name = F.when(F.col("marked"), "compacted").otherwise("not compacted")
    else:
        raise ValueError(f"no cohort {by}")
    pressure = s.samples.where("window_tokens > 0").join(turns.select("conversation_id", "turn_no", name.alias("cohort")), ["conversation_id", "turn_no"]).groupBy("cohort").agg(percentile(100.0 * F.col("input_tokens") / F.col("window_tokens"), 0.95).alias("pressure_p95"))
    out = turns.groupBy(name.alias("cohort")).agg(
        F.count("*").alias("turns"), percentile("duration_ms", 0.5).alias("median_duration"), percentile("total_tokens", 0.5).alias("median_tokens"),
        F.round(F.avg("tool_calls"), 3).alias("mean_tools"), F.round(100.0 * F.count_if(F.col("status") == "aborted") / F.count("*"), 3).alias("abort_rate"),
    )
    out = out.join(pressure, "cohort", "left")
    return out.where(F.col("turns") >= LEAST_GROUP) if share_safe else out


def rank(df: DataFrame, name: str, value: Column, top: int = 10) -> DataFrame:
    """The groups with the largest sums, ties by name; an empty name is unknown."""
    grouped = df.groupBy(F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("unknown")).alias("label")).agg(F.sum(value).alias("value"))
    return grouped.orderBy(F.desc("value"), "label").limit(top)


def composition(s: Slice) -> DataFrame:
    """Tokens by part: what was paid as input, read from the cache, put out and reasoned."""
    calls = semantic_calls(s)
    sums = calls.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(n) for n, x in (("Input", F.col("uncached_input_tokens") + F.col("cache_write_input_tokens")), ("Cache", F.col("cached_input_tokens")), ("Output", F.col("visible_output_tokens")), ("Reasoning", F.col("reasoning_output_tokens")))])
    return sums.unpivot([], ["Input", "Cache", "Output", "Reasoning"], "part", "tokens")


def coverage(s: Slice) -> DataFrame:
    """Shares of closed turns with a duration and a time to first token, of calls without a model, of unattributed tokens, of turns with tools, and of compacted and delegating conversations."""
    turns = s.turns.where(closed()).agg(F.round(ratio(F.count("duration_ms"), F.count("*")), 3).alias("duration_share"), F.round(ratio(F.count("ttft_ms"), F.count("*")), 3).alias("ttft_share"), F.round(ratio(F.count_if(F.col("tool_calls") > 0), F.count("*")), 3).alias("tool_share"))
    calls = s.calls.agg(F.round(ratio(F.count_if(F.col("model") == "unknown"), F.count("*")), 3).alias("unknown_model_share"), F.round(ratio(F.sum("unattributed_tokens"), F.sum("total_tokens")), 3).alias("unattributed_share"))
    n = s.conversations.agg(F.count("*").alias("conversations"))
    compacted = s.compactions.agg(F.count_distinct("conversation_id").alias("compacted"))
    delegating = s.subagents.agg(F.count_distinct("parent_id").alias("delegating"))
    return turns.crossJoin(calls).crossJoin(n).crossJoin(compacted).crossJoin(delegating).select("duration_share", "ttft_share", "tool_share", "unknown_model_share", "unattributed_share", F.round(ratio(F.col("compacted"), F.col("conversations")), 3).alias("compacted_share"), F.round(ratio(F.col("delegating"), F.col("conversations")), 3).alias("delegating_share"))


def lower_rank_p95(df: DataFrame, by: str, value: str) -> DataFrame:
    """The value at place floor(0.95 (n - 1)) of each group, not interpolated: a running number and a count, without gathering values."""
    w = Window.partitionBy(by)
    placed = df.where(F.col(value).isNotNull()).withColumns({"at": F.row_number().over(w.orderBy(value)) - 1, "n": F.count("*").over(w)})
    return placed.where(F.col("at") == F.floor((F.col("n") - 1) * 0.95)).select(by, F.col(value).alias("p95"))


def compared(now: DataFrame, before: DataFrame, columns: list[str]) -> DataFrame:
    """Two rows of metrics as one row per metric with the change in percent."""
    a = now.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "metric", "current")
    b = before.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "metric", "previous")
    return a.join(b, "metric").withColumn("change", F.round(change(F.col("current"), F.col("previous")), 3))
