"""Connectors: local stores of coding assistants as facts. Contents of messages are never read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scan
from .assemble import FACTS, Bundle, assemble, one_copy

NOTHING = {"touches": "boolean", "effort": "string", "turn_key": "string", "ends": "string", "model": "string", "tool": "string", "sample_in": "bigint", "sample_window": "bigint"}


def _facts(df: DataFrame, **columns) -> DataFrame:
    """FACTS with the given columns; others are missing."""
    made = {c: F.lit(None).cast(t) for c, t in NOTHING.items()} | {"starts": F.lit(False), "compaction": F.lit(False), "aside": F.lit(False), "tok": F.lit(None).cast("struct<" + ",".join(f"{f}:bigint" for f in scan.TOKEN_FIELDS) + ">")} | columns
    made = {c: F.coalesce(x, F.lit(False)) if c in ("starts", "compaction") else x for c, x in made.items()}
    return df.withColumns(made).select(FACTS)


def _per_file(events: DataFrame) -> DataFrame:
    """events with each file's number of events and a hash of their contents."""
    sums = events.groupBy("path").agg(F.count("*").alias("n_events"), F.sha2(F.sum(F.xxhash64("digest").cast("decimal(38,0)")).cast("string"), 256).alias("hash"))
    return events.join(sums, "path")


def kimi(spark: SparkSession, home: str, machine: str = "local") -> tuple[Bundle, DataFrame]:
    """Wire logs: sessions/*/<id>/wire.jsonl. Returns the graph and one row of counters (malformed, duplicates)."""
    lines = scan.json_lines(spark, f"{home}/sessions/*/*/wire.jsonl")
    v = F.col("value")
    event = F.coalesce(scan.name(v, "$.message.type", 64).isNotNull() & scan.has(v, "$.message.payload", "OBJECT"), F.lit(False))
    header = F.coalesce((scan.text(v, "$.type") == "metadata") & scan.text(v, "$.protocol_version").isNotNull(), F.lit(False))
    lines = lines.withColumns({"is_event": event, "bad": ~event & ~header, "external_id": F.element_at(F.split("path", "/"), -2)})
    events, others = one_copy(_per_file(lines.where("is_event")), ["external_id"], ["n_events", "hash"])
    events = events.withColumns({"seq": F.row_number().over(Window.partitionBy("external_id").orderBy("at")), "kind": scan.text(v, "$.message.type"), "provider": F.lit("kimi"), "machine": F.lit(machine), "at_ms": scan.time_ms(v, "$.timestamp")})
    kind, p = F.col("kind"), "$.message.payload"
    usage = scan.tokens(scan.count(v, f"{p}.token_usage.input_other"), scan.count(v, f"{p}.token_usage.input_cache_read"), scan.count(v, f"{p}.token_usage.input_cache_creation"), scan.count(v, f"{p}.token_usage.output"), None, scan.count(v, f"{p}.token_usage.total"))
    status = kind == "StatusUpdate"
    whole = lambda path: F.when(status & scan.has(v, path, "BIGINT"), F.try_variant_get(v, path, "bigint"))
    facts = _facts(
        events, starts=kind == "TurnBegin", turn_key=F.concat(F.lit("turn-"), F.col("seq")), ends=F.when(kind == "TurnEnd", "completed").when(kind == "StepInterrupted", "aborted"),
        tok=F.when(status & scan.has(v, f"{p}.token_usage", "OBJECT<"), usage), model=F.lit("unknown"),
        tool=F.when(kind.isin("ToolCall", "ToolCallRequest"), F.coalesce(scan.name(v, f"{p}.function.name"), scan.name(v, f"{p}.name"))), compaction=kind == "CompactionEnd",
        sample_in=whole(f"{p}.context_tokens"), sample_window=F.when(whole(f"{p}.context_tokens").isNotNull(), whole(f"{p}.max_context_tokens")),
    )
    return assemble(facts), lines.agg(F.count_if("bad").alias("malformed")).crossJoin(others.agg(F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates")))


def plandex(spark: SparkSession, home: str, machine: str = "local") -> tuple[Bundle, DataFrame]:
    """Server files: orgs/*/plans/<id>/conversation/*.json, a message each; only total tokens are reported."""
    docs = scan.json_documents(spark, f"{home}/orgs/*/plans/*/conversation/*.json")
    v = F.col("value")
    role = scan.name(v, "$.role", 32)
    docs = docs.withColumns({"folder": F.regexp_replace("path", "/[^/]*$", ""), "ok": F.coalesce(scan.name(v, "$.id").isNotNull() & role.isin("user", "assistant"), F.lit(False)), "at_ms": scan.time_ms(v, "$.createdAt")})
    number = F.coalesce(F.when(scan.has(v, "$.num", "BIGINT"), F.try_variant_get(v, "$.num", "bigint")), F.lit(0))
    order = Window.partitionBy("folder").orderBy(F.coalesce("at_ms", F.lit(0)), number, "path")
    good = docs.where("ok").withColumn("seq", F.row_number().over(order))
    plans = good.groupBy("folder").agg(F.coalesce(F.min_by(scan.name(v, "$.planId"), "seq"), F.element_at(F.split("folder", "/"), -2)).alias("external_id"), F.count("*").alias("n_events"), F.sha2(F.sum(F.xxhash64("digest").cast("decimal(38,0)")).cast("string"), 256).alias("hash"))
    messages = good.drop("path").join(plans, "folder").withColumnRenamed("folder", "path")
    messages, others = one_copy(messages, ["external_id"], ["n_events", "hash"])
    said = role == "assistant"
    stopped = F.coalesce(F.try_variant_get(v, "$.stopped", "boolean"), F.lit(False))
    facts = _facts(
        messages.withColumns({"provider": F.lit("plandex"), "machine": F.lit(machine)}), starts=role == "user", turn_key=scan.text(v, "$.id"), ends=F.when(said, F.when(stopped, "aborted").otherwise("completed")),
        tok=F.when(said, scan.tokens(total=scan.count(v, "$.tokens"))), model=F.lit("unknown"),
    )
    return assemble(facts), docs.agg(F.count_if(~F.col("ok")).alias("malformed")).crossJoin(others.agg(F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates")))


#: Connectors by provider: (spark, folder, machine) -> (graph, counters).
CONNECTORS = {"kimi": kimi, "plandex": plandex}
