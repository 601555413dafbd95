"""Connectors of stores that keep usage in a ledger beside the messages. Contents of messages are never read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import interval_ms, label, qualified_model
from ..operators.folds import as_of
from . import scan
from .assemble import Bundle, one_copy
from .sqlite import read_sqlite
from .store import cut
from .transcripts import _bundle, _call, _counters, _items, _named, _one_if, _spread

_NO_NAMES = "CAST(array() AS array<string>)"


def _time(x: Column) -> Column:
    """Epoch milliseconds of a text that is a number (of seconds, or of milliseconds from 1e10 on) or a zoned ISO time."""
    n = F.when(x.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), x.cast("double"))
    return F.coalesce(F.when(F.abs(n) >= 1e10, n).otherwise(n * 1000).cast("bigint"), scan.zoned_ms(x))


def goose(spark: SparkSession, home: str, machine: str = "local") -> tuple[Bundle, DataFrame]:
    """sessions.db: sessions, messages, and a ledger of usage whose rows belong to the turn that had begun at their time."""
    path = f"{home}/sessions.db"
    sessions = read_sqlite(spark, path, "sessions", "_file string, id string, created_at string, updated_at string, provider_name string, model_config_json string", loose=("created_at", "updated_at"))
    messages = read_sqlite(spark, path, "messages", "_file string, id string, message_id string, session_id string, role string, content_json string, created_timestamp string, metadata_json string", loose=("id", "created_timestamp"))
    ledger = read_sqlite(
        spark, path, "usage_ledger", "_file string, id string, session_id string, created_timestamp string, model string, input_tokens bigint, output_tokens bigint, total_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint, is_compaction bigint",
        loose=("id", "created_timestamp"),
    )
    config = F.try_parse_json("model_config_json")
    heads = cut(sessions.select(
        "_file", F.col("id").alias("session_id"), label(F.col("id"), 500).alias("external_id"), _time(F.col("created_at")).alias("created_ms"), _time(F.col("updated_at")).alias("updated_ms"), label(F.col("provider_name"), 127).alias("model_provider"),
        scan.name(config, "$.model_name", 255).alias("configured"), (F.col("model_config_json").isNotNull() & (~F.coalesce(F.schema_of_variant(config).startswith("OBJECT"), F.lit(False)) | F.try_variant_get(config, "$.model_name", "string").isNotNull() & scan.name(config, "$.model_name", 255).isNull())).alias("bad_config"),
    ), "goose")
    content, meta = F.try_parse_json("content_json"), F.try_parse_json(F.when(F.coalesce("metadata_json", F.lit("")) == "", "{}").otherwise(F.col("metadata_json")))
    kinds = F.transform(_items(content, "$"), lambda b: scan.text(b, "$.type"))
    is_list, is_object = F.coalesce(F.schema_of_variant(content).startswith("ARRAY"), F.lit(False)), F.coalesce(F.schema_of_variant(meta).startswith("OBJECT"), F.lit(False))
    requests = F.filter(_items(content, "$"), lambda b: F.coalesce(scan.text(b, "$.type").isin("toolRequest", "frontendToolRequest"), F.lit(False)))
    blocks = F.filter(_items(content, "$"), lambda b: ~F.coalesce(F.schema_of_variant(b).startswith("OBJECT"), F.lit(False)))
    said = messages.withColumn("external_message", F.coalesce(label(F.col("message_id")), label(F.col("id")))).select(
        "_file", "session_id", "id", F.col("external_message"), label(F.col("role"), 32).alias("role"), _time(F.col("created_timestamp")).alias("at_ms"), F.col("created_timestamp").cast("double").alias("by"), F.col("id").cast("bigint").alias("by_id"),
        F.coalesce(F.array_contains(kinds, "text") | F.array_contains(kinds, "image"), F.lit(False)).alias("prompt"), F.coalesce(F.array_contains(kinds, "error"), F.lit(False)).alias("error"), F.coalesce(F.try_variant_get(meta, "$.userVisible", "boolean"), F.lit(True)).alias("visible"),
        F.transform(requests, lambda b: scan.name(b, "$.toolCall.value.name")).alias("tools"), (F.size(blocks) + F.size(F.filter(requests, lambda b: scan.name(b, "$.toolCall.value.name").isNull()))).alias("bad_blocks"),
        F.coalesce(F.col("external_message").isNotNull() & label(F.col("role"), 32).isin("user", "assistant") & is_list & is_object, F.lit(False)).alias("ok"), F.xxhash64("id", "role", "content_json", "created_timestamp").alias("digest"),
    )
    said, spent = cut(said, "messages"), cut(ledger.withColumn("usage_id", label(F.col("id"))).withColumn("digest", F.xxhash64("id", "created_timestamp", "model", "total_tokens")), "ledger")
    both = said.where("ok").select("_file", "session_id", "digest").union(spent.where("usage_id IS NOT NULL").select("_file", "session_id", "digest"))
    sizes = both.groupBy("_file", "session_id").agg(F.count("*").alias("n_events"), F.sha2(F.sum(F.col("digest").cast("decimal(38,0)")).cast("string"), 256).alias("hash"))
    copies = heads.join(sizes, ["_file", "session_id"], "left").fillna(0, ["n_events"]).fillna("", ["hash"]).withColumn("rank_ms", F.coalesce("updated_ms", F.lit(-(1 << 62)))).withColumn("path", F.concat_ws("\u0000", "_file", "session_id"))
    kept, others = one_copy(copies.where("external_id IS NOT NULL"), ["external_id"], ["n_events", "rank_ms", "hash"])
    kept = cut(kept, "kept")
    mine = kept.select("_file", "session_id", "external_id")
    order = Window.partitionBy("external_id").orderBy("by", "by_id")
    rows = said.where("ok").join(mine, ["_file", "session_id"]).withColumn("n", F.row_number().over(order).cast("bigint")).withColumn("starts", (F.col("role") == "user") & F.col("visible") & F.col("prompt"))
    rows = rows.withColumn("turn_no", F.count_if("starts").over(Window.partitionBy("external_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    answers = F.col("role") == "assistant"
    failed = F.coalesce(F.max(answers & F.col("error")).over(Window.partitionBy("external_id", "turn_no")), F.lit(False))
    rows = cut(rows.withColumn("failed", failed), "rows")
    facts = _spread(
        _named(rows, "goose", machine), None, F.col("tools"), starts=F.col("starts"), turn_key=F.col("external_message"), touches=answers, ends=F.when(answers, F.when(F.col("failed"), "aborted").otherwise("completed")),
    )
    marks = rows.where("starts AND at_ms IS NOT NULL").groupBy("external_id", "at_ms").agg(F.max("turn_no").alias("turn_no"))
    number = Window.partitionBy("external_id").orderBy("by", "by_id")
    used = spent.where("usage_id IS NOT NULL").join(mine, ["_file", "session_id"]).select("external_id", _time(F.col("created_timestamp")).alias("at_ms"), F.col("created_timestamp").cast("double").alias("by"), F.col("id").cast("bigint").alias("by_id"), "model", *[F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens", "cache_read_tokens", "cache_write_tokens")], "is_compaction")
    used = used.withColumn("n", F.row_number().over(number).cast("bigint")).join(kept.select("external_id", "model_provider", "configured"), "external_id")
    placed = as_of(used, marks, ["external_id"], "at_ms", "turn_no").withColumn("turn_no", F.coalesce("turn_no", F.lit(0)))
    cached = F.least("input_tokens", "cache_read_tokens")
    write = F.least(F.col("input_tokens") - cached, F.col("cache_write_tokens"))
    tok = scan.tokens(F.col("input_tokens") - cached - write, cached, write, F.col("output_tokens"), None, F.col("total_tokens"))
    model = qualified_model(F.col("model_provider"), F.coalesce(label(F.col("model"), 255), "configured"))
    facts = facts.unionByName(_spread(_named(placed, "goose", machine), F.array(_call(tok, model)), None, compaction=F.coalesce(F.col("is_compaction") == 1, F.lit(False))))
    made = _bundle(facts, kept.select("external_id", F.col("n_events").alias("event_count")))
    times = kept.select("external_id", "created_ms", "updated_ms")
    conversations = made.conversations.join(times, "external_id").withColumns({"started_ms": F.coalesce("created_ms", "started_ms"), "ended_ms": F.coalesce("updated_ms", "ended_ms")}).drop("created_ms", "updated_ms").withColumn("duration_ms", interval_ms(F.col("started_ms"), F.col("ended_ms")))
    # the last turn, if nothing answered it, ends with the session
    answered = rows.groupBy("external_id", "turn_no").agg(F.max(answers & F.col("at_ms").isNotNull()).alias("answered"), F.max("turn_no").over(Window.partitionBy("external_id")).alias("last_turn"))
    waits = ~F.col("answered") & (F.col("turn_no") == F.col("last_turn"))
    turns = made.turns.join(answered, ["external_id", "turn_no"]).join(times, "external_id").withColumn("ended_ms", F.when(waits, F.col("updated_ms")).otherwise(F.col("ended_ms"))).withColumn("duration_ms", interval_ms(F.col("started_ms"), F.col("ended_ms"))).drop("answered", "last_turn", "created_ms", "updated_ms")
    bad = heads.agg((F.count_if(F.col("external_id").isNull()) + F.count_if("bad_config")).alias("a")).crossJoin(said.agg((F.count_if(~F.col("ok")) + F.coalesce(F.sum(F.when(F.col("ok"), F.col("bad_blocks"))), F.lit(0))).alias("b"))).crossJoin(spent.agg(F.count_if(F.col("usage_id").isNull()).alias("c")))
    return Bundle(**(made.__dict__ | {"conversations": conversations, "turns": turns})), _counters(bad.select((F.col("a") + F.col("b") + F.col("c")).alias("malformed")), others)


def amp(spark: SparkSession, home: str, machine: str = "local") -> tuple[Bundle, DataFrame]:
    """Threads threads/T-*.json, one document each. Usage comes from the ledger, joined to its messages' cache counters and turns; without a ledger, from the messages."""
    v = F.col("value")
    docs = scan.json_documents(spark, f"{home}/threads/T-*.json").withColumn("external_id", F.coalesce(scan.name(v, "$.id"), label(F.regexp_extract("path", r"([^/]*)\.json$", 1))))
    usable = F.coalesce(F.col("external_id").isNotNull() & scan.has(v, "$.messages", "ARRAY"), F.lit(False))
    events = _items(v, "$.usageLedger.events")
    odd_ledger = F.coalesce(F.try_variant_get(v, "$.usageLedger.events", "variant").isNotNull() & ~F.is_variant_null(F.try_variant_get(v, "$.usageLedger.events", "variant")) & ~scan.has(v, "$.usageLedger.events", "ARRAY"), F.lit(False))
    is_object = lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))
    not_objects = lambda xs: F.size(F.filter(xs, lambda x: ~is_object(x)))
    files = docs.withColumns({
        "ok": usable, "n_events": (F.size(_items(v, "$.messages")) + F.size(events)).cast("bigint"), "hash": F.col("digest"),
        "wrong": F.when(usable, not_objects(_items(v, "$.messages")) + not_objects(events) + odd_ledger.cast("int")).otherwise(1),
    })
    kept, others = one_copy(files.where("ok").drop("value", "wrong"), ["external_id"], ["n_events", "hash"])
    kept = kept.join(docs.select("path", "value"), "path").select("external_id", "n_events", scan.time_ms(v, "$.created", True).alias("created_ms"), F.transform(_items(v, "$.messages"), lambda x: F.to_json(x)).alias("messages"), F.transform(events, lambda x: F.to_json(x)).alias("ledger"), F.array_max(F.transform(_items(v, "$.meta.traces"), lambda t: scan.time_ms(t, "$.endTime", True))).alias("traced_ms"))
    kept = cut(kept, "amp")
    identifier = lambda x, path: F.coalesce(scan.name(x, path), F.when(scan.has(x, path, "BIGINT"), F.try_variant_get(x, path, "string")))
    parsed = kept.select("external_id", "created_ms", F.posexplode("messages").alias("n", "json")).withColumn("value", F.parse_json("json")).where(is_object(v))
    blocks = _items(v, "$.content")
    shown = F.when(scan.text(v, "$.content").isNotNull(), scan.text(v, "$.content") != "").otherwise(F.exists(blocks, lambda b: is_object(b) & ~F.coalesce(scan.text(b, "$.type") == "tool_result", F.lit(False))))
    told = F.array(*[F.try_variant_get(v, f"$.usage.{c}", "variant").isNotNull() for c in ("inputTokens", "outputTokens", "cacheCreationInputTokens", "cacheReadInputTokens", "totalTokens")])
    has_usage = F.array_contains(told, True)
    model = F.coalesce(scan.name(v, "$.usage.model", 255), scan.name(v, "$.model", 255), F.lit("unknown"))
    counted = lambda c: scan.count(v, f"$.usage.{c}")

    def tokens(uncached: Column, write: Column, read: Column, output: Column, total: Column, model: Column) -> Column:
        folded = model.startswith("gpt-")  # these count writes to the cache as plain input
        whole = F.least(uncached.cast("decimal(38,0)") + F.when(folded, write).otherwise(0), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("bigint")
        return scan.tokens(whole, read, F.when(folded, 0).otherwise(write), output, None, total)

    rows = parsed.select(
        "external_id", F.col("n").cast("bigint").alias("n"), F.coalesce(scan.time_ms(v, "$.usage.timestamp", True), scan.time_ms(v, "$.timestamp", True)).alias("at_ms"), "created_ms", identifier(v, "$.messageId").alias("message_id"), scan.name(v, "$.id").alias("own_id"),
        F.coalesce((scan.text(v, "$.role") == "user") & shown, F.lit(False)).alias("starts"), F.coalesce(scan.text(v, "$.role") == "assistant", F.lit(False)).alias("answers"), F.coalesce(scan.text(v, "$.stop_reason"), scan.text(v, "$.stopReason")).alias("stop"), has_usage.alias("has_usage"), model.alias("model"),
        tokens(counted("inputTokens"), counted("cacheCreationInputTokens"), counted("cacheReadInputTokens"), counted("outputTokens"), counted("totalTokens"), model).alias("tok"), scan.count(v, "$.usage.maxInputTokens").alias("window"),
        counted("cacheCreationInputTokens").alias("cache_write"), counted("cacheReadInputTokens").alias("cache_read"), F.transform(F.filter(blocks, lambda b: scan.text(b, "$.type") == "tool_use"), lambda b: scan.name(b, "$.name")).alias("tools"),
    )
    rows = rows.withColumn("turn_no", F.count_if("starts").over(Window.partitionBy("external_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    rows = cut(rows, "rows")
    entries = kept.select("external_id", F.posexplode("ledger").alias("n", "json")).withColumn("value", F.parse_json("json")).where(scan.name(v, "$.model", 255).isNotNull() & scan.has(v, "$.tokens", "OBJECT<"))
    entries = entries.select("external_id", F.col("n").cast("bigint").alias("n"), scan.time_ms(v, "$.timestamp", True).alias("at_ms"), scan.name(v, "$.model", 255).alias("model"), identifier(v, "$.toMessageId").alias("message_id"), *[scan.count(v, f"$.tokens.{c}").alias(c) for c in ("input", "output", "total")])
    # a message's newest record tells its turn, and its newest answer its cache counters
    named = rows.where("message_id IS NOT NULL").groupBy("external_id", "message_id").agg(F.max_by("turn_no", "n").alias("turn_no"), F.max_by(F.struct("cache_write", "cache_read"), F.when(F.col("answers"), F.col("n"))).alias("c"))
    joined = entries.join(named, ["external_id", "message_id"], "left").withColumn("turn_no", F.coalesce("turn_no", F.lit(0)))
    spent = joined.withColumn("tok", tokens(F.col("input"), F.coalesce("c.cache_write", F.lit(0)), F.coalesce("c.cache_read", F.lit(0)), F.col("output"), F.col("total"), F.col("model")))
    spent = cut(spent.where(sum((F.col(f"tok.{c}") for c in scan.TOKEN_FIELDS[1:]), F.col(f"tok.{scan.TOKEN_FIELDS[0]}")) > 0), "ledger")
    ledgers = spent.select("external_id").distinct().withColumn("ledger", F.lit(True))
    rows = rows.join(ledgers, "external_id", "left").withColumn("at_ms", F.coalesce("at_ms", F.when(F.col("starts") & (F.col("turn_no") == 1), F.col("created_ms"))))
    of_message = F.col("answers") & F.col("has_usage") & F.col("ledger").isNull()
    used = F.col("tok.uncached_input_tokens") + F.col("tok.cached_input_tokens") + F.col("tok.cache_write_input_tokens")
    calls = _one_if(of_message, _call(F.col("tok"), F.col("model"), False, F.when(F.col("window") > 0, used), F.when(F.col("window") > 0, F.col("window"))))
    ends = F.when(F.col("answers"), F.when(F.col("stop").isin("error", "aborted", "cancelled"), "aborted").when(F.col("stop").isin("end_turn", "stop", "length", "max_tokens"), "completed"))
    facts = _spread(_named(rows, "amp", machine), calls, F.when(F.col("answers"), F.col("tools")).otherwise(F.expr(_NO_NAMES)), starts=F.col("starts"), turn_key=F.coalesce("message_id", "own_id", F.concat(F.lit("turn-"), "turn_no")), touches=F.col("answers"), ends=ends)
    facts = facts.unionByName(_spread(_named(spent.drop("at_ms"), "amp", machine).withColumn("at_ms", F.lit(None).cast("bigint")), F.array(_call(F.col("tok"), F.col("model"))), None))
    own = _named(kept.select("external_id", F.explode(F.array("created_ms", "traced_ms")).alias("at_ms"), F.lit(-1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("turn_no")), "amp", machine)
    made = _bundle(facts.unionByName(_spread(own, None, None)), kept.select("external_id", F.col("n_events").alias("event_count")))
    # the ledger's own times are those of its calls; they don't move the thread's ends
    numbered = spent.withColumn("sequence", F.row_number().over(Window.partitionBy("external_id").orderBy("n"))).select("external_id", "sequence", F.col("at_ms").alias("told_ms"))
    timed = made.calls.join(numbered, ["external_id", "sequence"], "left").withColumn("timestamp_ms", F.coalesce("timestamp_ms", "told_ms")).drop("told_ms")
    return Bundle(**(made.__dict__ | {"calls": timed})), _counters(files.agg(F.coalesce(F.sum("wrong"), F.lit(0)).alias("malformed")), others)
