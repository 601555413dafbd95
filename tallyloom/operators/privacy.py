"""Share-safe data sets: aliases for names, days for times, categories for tools, dense keys for ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DAY_MS, neutralized, tool_category
from ..sources.store import cut


def aliases(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Numbered aliases of the distinct values in order: value, alias."""
    names = df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    return with_local_keys(names, "value", "__n").select("value", F.concat(F.lit(prefix + "-"), (F.col("__n") + 1).cast("string")).alias("alias"))


def model_names(conversations: DataFrame, calls: DataFrame, settings: DataFrame) -> DataFrame:
    """model: the distinct names that summaries, calls and settings tell."""
    return conversations.select(F.explode("models").alias("model")).union(calls.select("model")).union(settings.select("model")).where("model IS NOT NULL").distinct()


def with_alias(df: DataFrame, column: str, names: DataFrame, prefix: str) -> DataFrame:
    """df with a column's values replaced by their aliases; values without one are prefix-unmapped."""
    return df.join(names.withColumnRenamed("value", column), column, "left").withColumn(column, F.coalesce("alias", F.lit(prefix + "-unmapped"))).drop("alias")


def to_day(ms):
    return (F.floor(ms / DAY_MS) * DAY_MS).cast("bigint")


def share_safe(conversations: DataFrame) -> DataFrame:
    """Conversations with aliased projects, machines and models and with times at midnight; the provider stays."""
    models = conversations.select(F.explode("models").alias("model"))
    out = with_alias(with_alias(conversations, "project", aliases(conversations, "project", "project"), "project"), "machine", aliases(conversations, "machine", "machine"), "machine")
    named = aliases(models, "model", "model")
    renamed = out.select("conversation_id", F.explode("models").alias("model")).join(named, F.col("model") == F.col("value")).groupBy("conversation_id").agg(F.array_sort(F.collect_set("alias")).alias("aliased"))
    out = out.join(renamed, "conversation_id", "left").withColumn("models", F.coalesce("aliased", F.array().cast("array<string>"))).drop("aliased")
    return out.withColumns({"started_ms": to_day(F.col("started_ms")), "ended_ms": to_day(F.col("ended_ms"))})


#: What a share-safe table may tell: its keys within a conversation, its times (as days) and its other columns.
SHAPES = {
    "turns": (["turn_no"], ["started_ms", "ended_ms"], ["status", "duration_ms", "ttft_ms", "model_calls", "tool_calls", "total_tokens"]),
    "calls": (["turn_no", "sequence"], ["timestamp_ms"], ["model", "input_tokens", "output_tokens", "total_tokens"]),
    "tools": (["turn_no", "sequence"], ["timestamp_ms"], ["tool"]),
    "work": (["turn_no"], ["started_ms"], ["kind", "duration_ms"]),
    "samples": (["turn_no", "sequence"], ["timestamp_ms"], ["input_tokens", "window_tokens"]),
    "settings": (["turn_no"], [], ["model", "effort", "mode"]),
    "compactions": ([], ["timestamp_ms"], []),
}


def share_safe_graph(conversations: DataFrame, children: dict[str, DataFrame], subagents: DataFrame, runs: DataFrame) -> dict[str, DataFrame]:
    """The ten tables of a share-safe data set of the given conversations.

    Conversations and their rows have dense keys for ids; edges have the keys of their ends, null for one that isn't in the set. Names of projects, machines
    and models are aliases, the models' over summaries, calls and settings; tools are categories, times are days; all else that isn't in SHAPES is left out.
    """
    keys = with_local_keys(conversations, "conversation_id", "conversation_key").select("conversation_id", "conversation_key")
    mine = {name: df.join(keys, "conversation_id") for name, df in children.items()}
    names = aliases(model_names(conversations, mine["calls"], mine["settings"]), "model", "model")
    out = with_alias(with_alias(conversations, "project", aliases(conversations, "project", "project"), "project"), "machine", aliases(conversations, "machine", "machine"), "machine")
    renamed = out.select("conversation_id", F.explode("models").alias("model")).join(names, F.col("model") == F.col("value")).groupBy("conversation_id").agg(F.array_sort(F.collect_set("alias")).alias("aliased"))
    out = out.drop("models").join(renamed, "conversation_id", "left").join(keys, "conversation_id")
    safe = {"conversations": out.select("conversation_key", "provider", "project", "machine", F.coalesce("aliased", F.array().cast("array<string>")).alias("models"), to_day(F.col("started_ms")).alias("started_ms"), to_day(F.col("ended_ms")).alias("ended_ms"))}
    for name, (own, times, told) in SHAPES.items():
        df = mine[name]
        if "model" in told:
            df = with_alias(df, "model", names, "model")
        if "tool" in told:
            df = share_safe_tools(df)
        safe[name] = df.select("conversation_key", *own, *[to_day(F.col(t)).alias(t) for t in times], *told)
    ends = {end: keys.select(F.col("conversation_id").alias(f"{end}_id"), F.col("conversation_key").alias(f"{end}_key")) for end in ("parent", "child")}
    safe["subagents"] = subagents.join(ends["parent"], "parent_id", "left").join(ends["child"], "child_id", "left").select("parent_key", "child_key", to_day(F.col("created_ms")).alias("created_ms"))
    safe["runs"] = runs.select("provider", to_day(F.col("ingested_ms")).alias("ingested_ms"), "received", "malformed")
    return safe


def share_safe_tools(tools: DataFrame) -> DataFrame:
    return tools.withColumn("tool", tool_category(F.col("tool")))


def with_local_keys(df: DataFrame, key: str, to: str) -> DataFrame:
    """df with dense numbers from 0 in the order of the key. The numbers are offsets of range-sorted partitions, so no task holds all rows."""
    ordered = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("__at", F.monotonically_increasing_id())
    ordered = cut(ordered.withColumn("__part", F.shiftright("__at", 33)), "keyed")  # read twice, with the same ranges
    sizes = ordered.groupBy("__part").count()
    before = sizes.withColumn("__before", F.sum("count").over(Window.orderBy("__part")) - F.col("count")).drop("count")
    return ordered.join(F.broadcast(before), "__part").withColumn(to, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__part", "__before")


def exported(df: DataFrame) -> DataFrame:
    """Rows as a spreadsheet may open them: text that begins like a formula is neutralized, null is empty."""
    return df.select(*[F.coalesce(neutralized(F.col(c)), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
