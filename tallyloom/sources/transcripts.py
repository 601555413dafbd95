"""Connectors of branched, patched and forked transcripts, and of rollouts. Contents of messages are never read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import MAX_LONG, agent_role, called_tools, edge_status, label, work_status
from ..operators import branches, folds, replay, rollouts
from . import scan
from .assemble import FACTS, KEY, Bundle, assemble, one_copy
from .connectors import NOTHING
from .sqlite import read_sqlite
from .store import cut

# Kinds of work items by the type that a log tells; levels of effort; roles of agents by their type.
WORK_KINDS = {
    "AgentMessage": "message", "CollabAgentToolCall": "agent-coordination", "CommandExecution": "command", "ContextCompaction": "compaction", "DynamicToolCall": "dynamic-tool", "Extension": "extension",
    "FileChange": "file-change", "ImageView": "media", "McpToolCall": "mcp-tool", "Reasoning": "reasoning", "SubAgentActivity": "subagent-activity", "UserMessage": "user-message",
}
LEVELS = ["off", "minimal", "low", "medium", "high", "xhigh", "max"]
AGENT_TYPES = {"explore": "research", "general-purpose": "worker", "plan": "planning"}

_TOK = "struct<" + ",".join(f"{f}:bigint" for f in scan.TOKEN_FIELDS) + ">"


def _numbered(lines: DataFrame) -> DataFrame:
    """JSON objects of each file with their number in it, and the file's number of objects and hash."""
    good = lines.where("value IS NOT NULL").withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("at")).cast("bigint"))
    sums = good.groupBy("path").agg(F.count("*").alias("n_events"), F.sha2(F.sum(F.xxhash64("digest", "n").cast("decimal(38,0)")).cast("string"), 256).alias("hash"))
    return good.join(sums, "path")


def _first(df: DataFrame, value: Column, to: str, order: str = "n") -> DataFrame:
    """path and the first value in each file that isn't null."""
    return df.withColumn("__v", value).groupBy("path").agg(F.min_by("__v", F.when(F.col("__v").isNotNull(), F.col(order))).alias(to))


def _items(v: Column, path: str) -> Column:
    """The elements of a list as variants; none if it is no list."""
    return F.coalesce(F.when(scan.has(v, path, "ARRAY"), F.try_variant_get(v, path, "array<variant>")), F.expr("CAST(array() AS array<variant>)"))


def _spread(events: DataFrame, calls: Column | None, tools: Column | None, **base: Column) -> DataFrame:
    """Facts: one for each event with the base columns, then one for each of its calls (tok, model, aside, sample_in, sample_window) and tools (name)."""
    own = {c: F.lit(None).cast(t) for c, t in NOTHING.items()} | {"starts": F.lit(False), "compaction": F.lit(False), "aside": F.lit(False), "tok": F.lit(None).cast(_TOK)}
    more = ["starts", "turn_key", "ends", "tok", "model", "tool", "compaction", "sample_in", "sample_window", "touches", "effort", "aside"]
    no = lambda **c: F.struct(*[(c.get(x, own[x])).alias(x) for x in more])
    rows = [F.array(no(**base))]
    if calls is not None:
        rows.append(F.transform(calls, lambda x: no(tok=x["tok"], model=x["model"], aside=x["aside"], sample_in=x["sample_in"], sample_window=x["sample_window"])))
    if tools is not None:
        rows.append(F.transform(F.filter(tools, lambda x: x.isNotNull()), lambda x: no(tool=x)))
    rows = [rows[0], *(F.coalesce(r, F.filter(rows[0], lambda x: F.lit(False))) for r in rows[1:])]  # none where there is no list
    made = events.select("*", F.posexplode(F.concat(*rows)).alias("__i", "__f"))
    taken = [c for c in ("provider", "machine", "external_id", "at_ms") if c in events.columns]
    keep = ["turn_no"] if "turn_no" in events.columns else []
    return made.select(*taken, *keep, F.struct(F.col("n").alias("n"), F.col("__i").alias("i")).alias("seq"), "__f.*")


def _call(tok: Column, model: Column, aside: bool = False, sample_in: Column | None = None, sample_window: Column | None = None) -> Column:
    none = F.lit(None).cast("bigint")
    return F.struct(tok.alias("tok"), F.coalesce(model, F.lit("unknown")).alias("model"), F.lit(aside).alias("aside"), (none if sample_in is None else sample_in).alias("sample_in"), (none if sample_window is None else sample_window).alias("sample_window"))


def _one_if(condition: Column, x: Column) -> Column:
    return F.filter(F.array(F.when(condition, x)), lambda e: e.isNotNull())


def _bundle(facts: DataFrame, sizes: DataFrame, **how) -> Bundle:
    """The graph of facts, with the events of each conversation as its file has them."""
    made = assemble(facts, first_end=False, next_closes=False, by_time=True, **how)
    made = Bundle(**(made.__dict__ | {"conversations": made.conversations.drop("event_count").join(sizes, "external_id")}))
    return made


def _counters(malformed: Column | DataFrame, duplicates: DataFrame) -> DataFrame:
    """One row of the two counters, of frames of one row each."""
    return malformed.crossJoin(duplicates.agg(F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates")))


def _named(df: DataFrame, provider: str, machine: str) -> DataFrame:
    return df.withColumns({"provider": F.lit(provider), "machine": F.lit(machine)})


def _input_total(v: Column, whole: str, cached: str, visible: str, reasoning: str, total: str) -> Column:
    """Tokens where the cached input is a part of the input that is told."""
    n, c = scan.count(v, whole), F.least(scan.count(v, whole), scan.count(v, cached))
    return scan.tokens(n - c, c, None, scan.count(v, visible), scan.count(v, reasoning), scan.count(v, total))


def _output_total(v: Column, prefix: str, uncached: str, cached: str, write: str, output: str, reasoning: str, total: str | None) -> Column:
    """Tokens where reasoning is a part of the output that is told."""
    of = lambda name: scan.count(v, f"{prefix}{name}")
    thought = F.least(of(output), of(reasoning))
    return scan.tokens(of(uncached), of(cached), of(write), of(output) - thought, thought, None if total is None else of(total))


def gemini(spark: SparkSession, home: str, machine: str = "local") -> tuple[Bundle, DataFrame]:
    """Chats: tmp/*/chats/session-*.json (one document) and .jsonl (a log with rewinds and checkpoints)."""
    v = F.col("value")
    lines = scan.json_lines(spark, f"{home}/tmp", below="session-*.jsonl")
    docs = scan.json_documents(spark, f"{home}/tmp", below="session-*.json").withColumn("at", F.struct(F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("row")))
    all_lines = lines.select("path", "at", "value", "digest").union(docs.select("path", F.col("at"), "value", "digest")).where(F.col("path").rlike("/tmp/[^/]*/chats/[^/]*$"))
    events = cut(_numbered(all_lines).select("path", "n", "n_events", "hash", F.to_json("value").alias("json")), "gemini").withColumn("value", F.parse_json("json"))
    rewind, own = scan.name(v, "$['$rewindTo']"), scan.name(v, "$.id")
    is_set = scan.has(v, "$['$set']", "OBJECT")
    kind = F.when(rewind.isNotNull(), "rewind").when(is_set, "set").when(own.isNotNull(), "write").when(scan.text(v, "$.sessionId").isNotNull(), "meta")
    listed = F.when(kind == "set", _items(v, "$['$set'].messages")).when(kind == "meta", _items(v, "$.messages")).otherwise(F.expr("CAST(array() AS array<variant>)"))
    clears = (kind == "set") & scan.has(v, "$['$set'].messages", "ARRAY")
    op = lambda k, i, v: F.struct(k.alias("kind"), i.alias("id"), v.alias("message"))
    none, text = F.lit(None).cast("string"), lambda m: F.to_json(m)
    ops = F.concat(
        _one_if(kind == "rewind", op(F.lit("rewind"), rewind, none)), _one_if(clears, op(F.lit("clear"), none, none)), _one_if(kind == "write", op(F.lit("write"), own, F.col("json"))),
        F.transform(F.filter(listed, lambda m: scan.name(m, "$.id").isNotNull()), lambda m: op(F.lit("write"), scan.name(m, "$.id"), text(m))),
    )
    steps = events.select("path", "n", F.posexplode(ops).alias("i", "op")).select("path", F.row_number().over(Window.partitionBy("path").orderBy("n", "i")).cast("bigint").alias("step"), "op.*")
    steps = cut(steps, "steps")
    ends = replay.replayed(steps.drop("message"), ["path"], "step", "kind", "id")
    messages = ends.join(steps.where("kind = 'write'").select("path", F.col("step").alias("last"), "message"), ["path", "last"]).select("path", F.col("position").alias("n"), "id", F.parse_json("message").alias("value"))
    told = lambda name: F.when(is_set & (kind == "set"), F.try_variant_get(v, f"$['$set'].{name}", "string")).when(kind == "meta", F.try_variant_get(v, f"$.{name}", "string"))
    last = lambda name: F.max_by(told(name), F.when(told(name).isNotNull(), F.col("n")))
    meta = events.groupBy("path", "n_events", "hash").agg(label(last("sessionId")).alias("external_id"), last("startTime").alias("t0"), last("lastUpdated").alias("t1"))
    named = meta.where("external_id IS NOT NULL")
    kept, others = one_copy(named, ["external_id"], ["n_events", "hash"])
    kept = cut(kept, "sessions")
    kind_of, model = scan.text(v, "$.type"), scan.name(v, "$.model", 255)
    said = kind_of == "gemini"
    rows = _named(messages.join(kept.select("path", "external_id"), "path"), "gemini", machine).withColumn("at_ms", scan.time_ms(v, "$.timestamp"))
    tok = _input_total(v, "$.tokens.input", "$.tokens.cached", "$.tokens.output", "$.tokens.thoughts", "$.tokens.total")
    facts = _spread(
        rows, _one_if(said, _call(tok, model)), F.when(said, F.transform(_items(v, "$.toolCalls"), lambda t: scan.name(t, "$.name"))).otherwise(F.expr("CAST(array() AS array<string>)")),
        starts=kind_of == "user", turn_key=F.col("id"), ends=F.when(said, "completed").when(kind_of.isin("error", "warning"), "aborted"),
    )
    # times of the file itself count for the conversation, before its first turn
    own_times = _named(kept.select("external_id", F.explode(F.array(scan.zoned_ms(F.col("t0")), scan.zoned_ms(F.col("t1")))).alias("at_ms"), F.lit(0).cast("bigint").alias("n")), "gemini", machine)
    facts = facts.select(FACTS).unionByName(_spread(own_times, None, None).select(FACTS))
    bad = all_lines.agg(F.count_if(F.col("value").isNull()).alias("bad")).crossJoin(meta.agg(F.count_if(F.col("external_id").isNull()).alias("nameless")))
    return _bundle(facts, kept.select("external_id", F.col("n_events").alias("event_count"))), _counters(bad.select((F.col("bad") + F.col("nameless")).alias("malformed")), others)


def pi(spark: SparkSession, home: str, machine: str = "local") -> tuple[Bundle, DataFrame]:
    """Sessions of branches: sessions/**/*.jsonl. A call's turn and model are those of the nearest records above it."""
    v = F.col("value")
    lines = scan.json_lines(spark, f"{home}/sessions", below="*.jsonl")
    events = _numbered(lines)
    head = _first(events.where(scan.text(v, "$.type") == "session"), F.struct(scan.name(v, "$.id").alias("id")), "head").select("path", F.col("head.id").alias("external_id"))
    files = events.select("path", "n_events", "hash").distinct().join(head, "path", "left")
    kept, others = one_copy(files.where("external_id IS NOT NULL"), ["external_id"], ["n_events", "hash"])
    kind, role = scan.text(v, "$.type"), F.when(scan.text(v, "$.type") == "message", scan.text(v, "$.message.role"))
    both = lambda provider, name: F.when(provider.isNotNull() & name.isNotNull(), F.concat(provider, F.lit("/"), name)).otherwise(name)
    model = both(scan.name(v, "$.message.provider", 127), scan.name(v, "$.message.model", 127))
    changed = both(scan.name(v, "$.provider", 127), scan.name(v, "$.modelId", 127))
    level = scan.text(v, "$.thinkingLevel")
    rows = events.join(kept.select("path", "external_id"), "path").select(
        "external_id", "n", scan.name(v, "$.id").alias("id"), scan.name(v, "$.parentId").alias("parent"), kind.alias("kind"), role.alias("role"), scan.time_ms(v, "$.timestamp", True).alias("at_ms"),
        model.alias("model"), F.when(kind == "model_change", F.struct(changed.alias("v"))).when((role == "assistant") & model.isNotNull(), F.struct(model.alias("v"))).alias("m_model"),
        F.when(kind == "thinking_level_change", F.struct(F.when(level.isin(*LEVELS), level).alias("v"))).alias("m_level"), F.when(role == "user", F.struct(F.col("n").alias("v"))).alias("m_turn"),
        scan.text(v, "$.message.stopReason").alias("stop"), F.transform(F.filter(_items(v, "$.message.content"), lambda b: scan.text(b, "$.type") == "toolCall"), lambda b: scan.name(b, "$.name")).alias("tools"),
        _output_total(v, "$.message.usage.", "input", "cacheRead", "cacheWrite", "output", "reasoning", "totalTokens").alias("tok"),
        F.when(scan.has(v, "$.usage", "OBJECT"), _output_total(v, "$.usage.", "input", "cacheRead", "cacheWrite", "output", "reasoning", "totalTokens")).alias("own_tok"),
    )
    rows = cut(rows.withColumn("node", F.coalesce("id", F.concat(F.lit("\u0000"), "n"))), "pi")
    newest = Window.partitionBy("external_id", "node").orderBy(F.desc("n"))
    tree = rows.withColumn("__r", F.row_number().over(newest)).where("__r = 1").drop("__r")
    above = branches.inherited(tree.select("external_id", "node", "parent", "m_model", "m_level", "m_turn"), ["external_id"], "node", "parent", {"m_model": "up_model", "m_level": "up_level", "m_turn": "up_turn"})
    rows = rows.join(above.select("external_id", "node", "up_model", "up_level", "up_turn"), ["external_id", "node"])
    order = Window.partitionBy("external_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("running", F.count_if(F.col("role") == "user").over(order))
    numbers = rows.where("role = 'user'").select("external_id", F.col("n").alias("__turn_n"), F.col("running").alias("__turn_no"))
    rows = rows.withColumn("__turn_n", F.when(F.coalesce(F.col("role") != "user", F.lit(True)), F.col("up_turn.v"))).join(numbers, ["external_id", "__turn_n"], "left").withColumn("turn_no", F.coalesce("__turn_no", "running"))
    said = F.coalesce(F.col("role") == "assistant", F.lit(False))
    summed = F.coalesce(F.col("kind").isin("compaction", "branch_summary"), F.lit(False)) & F.col("own_tok").isNotNull()
    calls = F.concat(_one_if(said, _call(F.col("tok"), F.coalesce("model", "up_model.v"))), _one_if(summed, _call(F.col("own_tok"), F.col("up_model.v"))))
    facts = _spread(
        _named(rows, "pi", machine), calls, F.when(said, F.col("tools")).otherwise(F.expr("CAST(array() AS array<string>)")), starts=F.coalesce(F.col("role") == "user", F.lit(False)),
        turn_key=F.coalesce("id", F.concat(F.lit("turn-"), "running")), effort=F.col("up_level.v"), touches=said, compaction=F.coalesce(F.col("kind") == "compaction", F.lit(False)),
        ends=F.when(said, F.when(F.col("stop").isin("error", "aborted"), "aborted").when(F.col("stop").isin("stop", "length"), "completed")),
    )
    bad = lines.agg(F.count_if(F.col("value").isNull()).alias("bad")).crossJoin(files.agg(F.count_if(F.col("external_id").isNull()).alias("headless")))
    return _bundle(facts, kept.select("external_id", F.col("n_events").alias("event_count"))), _counters(bad.select((F.col("bad") + F.col("headless")).alias("malformed")), others)


def qwen(spark: SparkSession, home: str, machine: str = "local") -> tuple[Bundle, DataFrame]:
    """Chats of branches: projects/*/chats/*.jsonl. Only the branch of the last record counts; fragments of a record are merged."""
    v = F.col("value")
    lines = scan.json_lines(spark, f"{home}/projects/*/chats/*.jsonl")
    events = _numbered(lines)
    files = events.select("path", "n_events", "hash").distinct().join(_first(events, scan.name(v, "$.sessionId"), "external_id"), "path", "left")
    kept, others = one_copy(files.where("external_id IS NOT NULL"), ["external_id"], ["n_events", "hash"])
    kind, subtype = scan.text(v, "$.type"), scan.text(v, "$.subtype")
    told_parent = F.try_variant_get(v, "$.parentUuid", "string").isNotNull()
    rows = events.join(kept.select("path", "external_id"), "path").select(
        "external_id", "n", scan.name(v, "$.uuid").alias("node"), scan.name(v, "$.parentUuid").alias("parent"), kind.alias("kind"), subtype.alias("subtype"), F.coalesce(F.try_variant_get(v, "$.isSidechain", "boolean"), F.lit(False)).alias("side"),
        F.coalesce(scan.name(v, "$.uuid").isNotNull() & (~told_parent | scan.name(v, "$.parentUuid").isNotNull()) & (scan.name(v, "$.sessionId") == F.col("external_id")) & kind.isin("user", "assistant", "tool_result", "system"), F.lit(False)).alias("ok"),
        scan.time_ms(v, "$.timestamp").alias("at_ms"), scan.name(v, "$.model", 255).alias("model"), F.when(scan.has(v, "$.usageMetadata", "OBJECT"), _input_total(v, *[f"$.usageMetadata.{x}TokenCount" for x in ("prompt", "cachedContent", "candidates", "thoughts", "total")])).alias("tok"),
        F.transform(_items(v, "$.message.parts"), lambda p: scan.name(p, "$.functionCall.name")).alias("tools"), scan.count(v, "$.contextWindowSize").alias("window"),
    )
    rows = cut(rows, "qwen")
    good = rows.where("ok")
    leaves = good.where("NOT coalesce(kind = 'system' AND subtype IN ('session_artifact_event', 'session_artifact_snapshot'), false)").groupBy("external_id").agg(F.max_by("node", "n").alias("node"))
    first = lambda c: F.min_by(F.struct(c), "n")[c].alias(c)
    merged = cut(good.groupBy("external_id", "node").agg(
        *[first(c) for c in ("parent", "kind", "subtype", "side", "window")], F.max("at_ms").alias("at_ms"), F.min_by("model", F.when(F.col("model").isNotNull(), F.col("n"))).alias("model"),
        F.max_by("tok", F.when(F.col("tok").isNotNull(), F.col("n"))).alias("tok"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "tools"))), lambda x: x["tools"])).alias("tools"),
    ), "fragments")
    path = branches.path_to_root(merged, leaves, ["external_id"], "node", "parent").join(merged, ["external_id", "node"]).withColumn("n", -F.col("distance"))
    path = cut(path, "branches")
    said = (F.col("kind") == "assistant") & ~F.col("side") & F.coalesce(F.col("subtype") != "realtime_message", F.lit(True))
    user = (F.col("kind") == "user") & F.col("subtype").isNull() & ~F.col("side")
    tok = F.coalesce("tok", scan.tokens())
    used = F.col("tok.uncached_input_tokens") + F.col("tok.cached_input_tokens") + F.col("tok.cache_write_input_tokens")
    facts = _spread(
        _named(path, "qwen", machine), _one_if(said, _call(tok, F.col("model"), False, F.when(F.col("window") > 0, F.coalesce(used, F.lit(0))), F.when(F.col("window") > 0, F.col("window")))),
        F.when(said, F.col("tools")).otherwise(F.expr("CAST(array() AS array<string>)")), starts=user, turn_key=F.col("node"), ends=F.when(said, "completed"), compaction=(F.col("kind") == "system") & F.coalesce(F.col("subtype") == "chat_compression", F.lit(False)),
    )
    cut_off = path.groupBy("external_id").agg(F.max_by("parent", "distance").alias("missing")).agg(F.count("missing").alias("cut_off"))
    bad = lines.agg(F.count_if(F.col("value").isNull()).alias("bad")).crossJoin(files.agg(F.count_if(F.col("external_id").isNull()).alias("nameless"))).crossJoin(rows.agg(F.count_if(~F.col("ok")).alias("wrong"))).crossJoin(cut_off)
    return _bundle(facts, kept.select("external_id", F.col("n_events").alias("event_count"))), _counters(bad.select((F.col("bad") + F.col("nameless") + F.col("wrong") + F.col("cut_off")).alias("malformed")), others)


def claude_files(lines: DataFrame) -> DataFrame:
    """path, key, parent, agent, role_path, n_events, hash of session and agent transcripts; a null key marks one that can't be named.

    Files that share a key, and agents with their parents' keys, must be read together: `groups.linked(files, "key", "parent")`.
    """
    v = F.col("value")
    parts = F.split(F.regexp_extract("path", "/projects/(.*)$", 1), "/")
    name = F.element_at(parts, -1)
    nested = (F.size(parts) >= 4) & (F.get(parts, F.lit(2)) == "subagents")
    stem = F.regexp_replace(name, r"\.jsonl$", "")
    sums = lines.groupBy("path").agg(F.max("n_events").alias("n_events"), F.max("hash").alias("hash"))
    named = sums.join(_first(lines, scan.name(v, "$.sessionId"), "session"), "path").join(_first(lines, scan.name(v, "$.agentId", 255), "agent_label"), "path")
    agent = nested | name.startswith("agent-")
    parent = F.when(agent, F.coalesce(F.when(nested, label(F.get(parts, F.lit(1)))), F.col("session")))
    agent_id = F.coalesce("agent_label", F.when(name.startswith("agent-"), label(F.regexp_replace(stem, "^agent-", ""), 255)))
    own = F.coalesce("session", label(stem), F.concat(F.lit("session-"), F.substring("hash", 1, 24)))
    key = F.when(agent, label(F.concat(parent, F.lit(":agent:"), agent_id))).otherwise(own)
    return named.select("path", key.alias("key"), F.when(key.isNotNull(), parent).alias("parent"), agent.alias("agent"), F.regexp_replace("path", r"\.jsonl$", ".meta.json").alias("role_path"), "n_events", "hash")


def claude(spark: SparkSession, home: str, machine: str = "local") -> tuple[Bundle, DataFrame]:
    """Sessions projects/*/*.jsonl and their agents' transcripts projects/*/<session>/subagents/**/agent-*.jsonl.

    Of a response's fragments the best counts; responses that an agent's transcript repeats from its parent are left out; sub-calls of advisors are calls of their own.
    """
    v = F.col("value")
    every = scan.json_lines(spark, f"{home}/projects", below="*.jsonl").where(F.col("path").rlike(r"/projects/[^/]+/[^/]+\.jsonl$") | F.col("path").rlike(r"/projects/[^/]+/[^/]+/subagents/.*agent-[^/]*\.jsonl$"))
    lines = _numbered(every)
    files = cut(claude_files(lines), "transcripts")
    kept, others = one_copy(files.where("key IS NOT NULL"), ["key"], ["n_events", "hash"])
    kept = cut(kept, "kept")
    message_id = scan.name(v, "$.message.id")
    kind = scan.text(v, "$.type")
    replies = F.coalesce(kind == "assistant", F.lit(False)) & scan.has(v, "$.message", "OBJECT")
    events = lines.drop("n_events", "hash").join(kept.select("path", F.col("key").alias("external_id"), "parent", "agent"), "path").withColumn("reply_id", F.when(replies, message_id))
    of_sessions = events.where("NOT agent AND reply_id IS NOT NULL").select(F.col("external_id").alias("parent"), "reply_id")
    events = events.where("NOT agent").unionByName(folds.without_replays(events.where("agent"), of_sessions, ["parent", "reply_id"]).select(events.columns))
    usage = scan.has(v, "$.message.usage", "OBJECT") & replies
    tok = lambda v, at: _output_total(v, at, "input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "output_tokens", "output_tokens_details.thinking_tokens", None)
    advisors = F.transform(F.filter(_items(v, "$.message.usage.iterations"), lambda x: scan.text(x, "$.type") == "advisor_message"), lambda x: _call(tok(x, "$."), scan.name(x, "$.model", 255), True))
    content = _items(v, "$.message.content")
    kinds = F.array_distinct(F.filter(F.transform(content, lambda b: F.when(F.schema_of_variant(b).startswith("OBJECT"), F.coalesce(scan.text(b, "$.type"), F.lit("")))), lambda t: t.isNotNull()))
    speaks = scan.text(v, "$.message.content").isNotNull() | (F.size(F.array_except(kinds, F.array(F.lit("tool_result")))) > 0)
    flag = lambda path: F.coalesce(F.try_variant_get(v, path, "boolean"), F.lit(False))
    starts = (kind == "user") & ~flag("$.isMeta") & (~flag("$.isSidechain") | F.col("agent")) & F.try_variant_get(v, "$.toolUseResult", "variant").isNull() & scan.has(v, "$.message", "OBJECT") & speaks
    call_key = F.coalesce(scan.name(v, "$.requestId"), message_id, scan.name(v, "$.uuid"), F.concat(F.lit("event-"), F.col("n")))
    events = events.select(
        "external_id", "agent", "n", scan.time_ms(v, "$.timestamp").alias("at_ms"), F.coalesce(starts, F.lit(False)).alias("starts"), scan.name(v, "$.uuid").alias("uuid"), replies.alias("replies"), call_key.alias("call_key"), usage.alias("has_usage"),
        F.when(usage, F.concat(F.array(_call(tok(v, "$.message.usage."), scan.name(v, "$.message.model", 255))), advisors)).alias("calls"), F.try_variant_get(v, "$.message.stop_reason", "string").isNotNull().alias("stopped"),
        F.when(replies, F.filter(F.transform(content, lambda b, i: F.when(scan.text(b, "$.type") == "tool_use", F.struct(scan.name(b, "$.name").alias("name"), F.coalesce(scan.name(b, "$.id"), F.concat(call_key, F.lit(":"), i + 1, F.lit(":"), scan.name(b, "$.name"))).alias("key"), i.alias("i")))), lambda t: t["name"].isNotNull())).alias("tools"),
        flag("$.isApiErrorMessage").alias("failed"), ((kind == "system") & scan.text(v, "$.subtype").isin("compact", "compact_boundary")).alias("compaction"),
    )
    events = cut(events, "claude")
    total = F.aggregate("calls", F.lit(0).cast("decimal(38,0)"), lambda acc, c: (acc + sum((c["tok"][f].cast("decimal(38,0)") for f in scan.TOKEN_FIELDS[1:]), c["tok"][scan.TOKEN_FIELDS[0]].cast("decimal(38,0)"))).cast("decimal(38,0)"))
    rank = F.when(F.col("has_usage"), F.struct("stopped", total.alias("total"), "n"))
    best = F.max(rank).over(Window.partitionBy("external_id", "call_key"))["n"] == F.col("n")
    events = events.withColumn("calls", F.when(F.col("has_usage") & best, F.col("calls")))
    tools = events.select("external_id", "n", F.explode("tools").alias("t")).withColumn("__r", F.row_number().over(Window.partitionBy("external_id", "t.key").orderBy("n", "t.i"))).where("__r = 1")
    firsts = tools.groupBy("external_id", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("t.i", "t.name"))), lambda x: x["name"]).alias("names"))
    events = events.drop("tools").join(firsts, ["external_id", "n"], "left")
    facts = _spread(
        _named(events, "claude", machine), F.col("calls"), F.col("names"), starts=F.col("starts"), turn_key=F.col("uuid"), touches=F.col("replies"),
        ends=F.when(F.col("replies"), F.when(F.col("failed"), "aborted").otherwise("completed")), compaction=F.coalesce("compaction", F.lit(False)),
    )
    made = _bundle(facts, kept.select(F.col("key").alias("external_id"), F.col("n_events").alias("event_count")))
    ends = made.turns.groupBy("external_id").agg(F.max_by("status", "turn_no").alias("last_status"))
    meta = scan.json_documents(spark, f"{home}/projects", below="*.meta.json")
    role = F.lower(F.trim(scan.text(v, "$.agentType")))
    known = F.lit("other")
    for name, means in AGENT_TYPES.items():
        known = F.when(role == name, means).otherwise(known)
    roles = meta.select(F.regexp_replace("path", "^file:/+", "/").alias("role_path"), F.when(F.coalesce(role, F.lit("")) == "", "unspecified").otherwise(known).alias("role"))
    agents = kept.where("agent").select(F.col("key").alias("external_id"), "parent", F.regexp_replace("role_path", "^file:/+", "/").alias("role_path"))
    edges = agents.join(roles, "role_path", "left").join(made.conversations.select("external_id", "provider", "machine", "started_ms", "ended_ms", "total_tokens"), "external_id").join(ends, "external_id", "left")
    edges = edges.select(
        "provider", "machine", F.col("parent").alias("parent_id"), F.col("external_id").alias("child_id"), F.coalesce("last_status", F.lit("unknown")).alias("status"), F.col("started_ms").alias("created_ms"), F.col("ended_ms").alias("updated_ms"),
        F.coalesce("role", F.lit("unspecified")).alias("role"), F.col("total_tokens").alias("tokens_used"),
    )
    bad = every.agg(F.count_if(F.col("value").isNull()).alias("bad")).crossJoin(files.agg(F.count_if(F.col("key").isNull()).alias("nameless")))
    return Bundle(**(made.__dict__ | {"edges": edges})), _counters(bad.select((F.col("bad") + F.col("nameless")).alias("malformed")), others)


def codex(spark: SparkSession, home: str, machine: str = "local") -> tuple[Bundle, DataFrame]:
    """Rollouts sessions/**/*.jsonl, and the edges between threads in state_5.sqlite."""
    v = F.col("value")
    every = scan.json_lines(spark, f"{home}/sessions", below="*.jsonl")
    lines = _numbered(every)
    p = "$.payload"
    kind, sub = scan.text(v, "$.type"), scan.text(v, f"{p}.type")
    header = F.coalesce(kind == "session_meta", F.lit(False))
    whole = lambda path: F.when(scan.number(v, path) == F.floor(scan.number(v, path)), F.try_variant_get(v, path, "bigint"))
    files = lines.select("path", "n_events", "hash").distinct().join(_first(lines.where(header), scan.name(v, f"{p}.id"), "id"), "path", "left").withColumn("external_id", F.coalesce("id", F.concat(F.lit("content-"), "hash")))
    kept, others = one_copy(files, ["external_id"], ["n_events", "hash"])
    message = F.coalesce(kind == "event_msg", F.lit(False)) & scan.has(v, p, "OBJECT")
    is_ = lambda *names: message & F.coalesce(sub.isin(*names), F.lit(False))
    usage = f"{p}.info.last_token_usage"
    kinds = (
        F.when(kind == "compacted", "compacted").when(is_("thread_settings_applied") & scan.has(v, f"{p}.thread_settings", "OBJECT"), "settings").when(kind == "turn_context", "context").when(is_("task_started"), "start")
        .when(is_("task_complete"), "complete").when(is_("turn_aborted"), "abort").when(is_("item_completed") & scan.has(v, f"{p}.item", "OBJECT"), "item").when(is_("token_count") & scan.has(v, usage, "OBJECT"), "usage")
        .when((kind == "response_item") & sub.isin("custom_tool_call", "function_call"), "tool").otherwise("other")
    )
    mode = lambda at: F.coalesce(scan.name(v, f"{at}.collaboration_mode.mode", 64), scan.name(v, f"{at}.collaboration_mode", 64))
    count = lambda name: F.greatest(F.lit(0), F.coalesce(whole(f"{usage}.{name}"), F.lit(0)))
    cached = count("cached_input_tokens")
    write = F.least(count("cache_write_input_tokens"), F.lit(MAX_LONG) - cached)
    tok = scan.tokens(F.greatest(count("input_tokens"), cached + write) - cached - write, cached, write, F.greatest(F.lit(0), count("output_tokens") - count("reasoning_output_tokens")), count("reasoning_output_tokens"), count("total_tokens"))
    window = F.coalesce(whole(f"{p}.info.model_context_window"), whole(f"{p}.model_context_window"))
    item, text = f"{p}.item", lambda path: F.try_variant_get(v, path, "string")
    work_kind = F.lit("other")
    for name, means in WORK_KINDS.items():
        work_kind = F.when(scan.text(v, f"{item}.type") == name, means).otherwise(work_kind)
    error = F.when(scan.has(v, f"{item}.error", "BOOLEAN"), F.when(F.try_variant_get(v, f"{item}.error", "boolean"), "true").otherwise("")).when(scan.has(v, f"{item}.error", "OBJECT") | scan.has(v, f"{item}.error", "ARRAY"), "true").otherwise(text(f"{item}.error"))
    status = work_status(whole(f"{item}.exit_code"), F.when(scan.has(v, f"{item}.success", "BOOLEAN"), F.try_variant_get(v, f"{item}.success", "boolean")), F.coalesce(error, F.lit("")), F.coalesce(scan.text(v, f"{item}.status"), F.lit("")))
    outer = F.coalesce(scan.name(v, f"{p}.name"), F.lit("unknown"))
    of_settings = kinds == "settings"
    settings = f"{p}.thread_settings"
    events = lines.join(kept.select("path", "external_id"), "path").select(
        "external_id", F.col("n").alias("seq"), scan.time_ms(v, "$.timestamp").alias("at_ms"), kinds.alias("kind"), scan.name(v, f"{p}.turn_id").alias("turn_id"), (F.coalesce(text(f"{p}.turn_id"), F.lit("")) != "").alias("names_turn"),
        F.when(of_settings, scan.name(v, f"{settings}.model", 255)).otherwise(scan.name(v, f"{p}.model", 255)).alias("model"), F.when(of_settings, scan.name(v, f"{settings}.reasoning_effort", 64)).otherwise(scan.name(v, f"{p}.effort", 64)).alias("effort"),
        F.when(of_settings, mode(settings)).otherwise(mode(p)).alias("mode"), F.when(of_settings, scan.name(v, f"{settings}.service_tier", 64)).alias("tier"), F.when(window > 0, window).alias("window"),
        F.when(kinds == "usage", tok).alias("tok"), F.when(kinds == "tool", F.transform(called_tools(outer, text(f"{p}.input")), lambda t: F.struct(outer.alias("outer_tool"), t.alias("tool")))).alias("tools"),
        whole(f"{p}.duration_ms").alias("duration_ms"), whole(f"{p}.time_to_first_token_ms").alias("ttft_ms"),
        F.struct(work_kind.alias("work_kind"), scan.name(v, f"{item}.tool").alias("tool"), whole(f"{p}.started_at_ms").alias("started_at_ms"), whole(f"{p}.completed_at_ms").alias("completed_at_ms"), status.alias("status")).alias("item"),
    )
    key = KEY
    rows = cut(rollouts.placed(_named(events, "codex", machine), ["provider", "external_id"]), "rollouts")
    conversations = _named(rollouts.conversations(rows, key), "codex", machine)
    edges = read_sqlite(spark, f"{home}/state_5.sqlite", "thread_spawn_edges", "parent_thread_id string, child_thread_id string, status string")
    threads = read_sqlite(spark, f"{home}/state_5.sqlite", "threads", "id string, created_at_ms bigint, updated_at_ms bigint, agent_role string, tokens_used bigint")
    told = edges.join(threads.withColumnRenamed("id", "child_thread_id"), "child_thread_id", "left").select(
        F.lit("codex").alias("provider"), F.lit(machine).alias("machine"), F.col("parent_thread_id").alias("parent_id"), F.col("child_thread_id").alias("child_id"), F.coalesce(edge_status(F.col("status")), F.lit("unknown")).alias("status"),
        F.col("created_at_ms").alias("created_ms"), F.col("updated_at_ms").alias("updated_ms"), agent_role(F.col("agent_role")).alias("role"), "tokens_used",
    )
    bad = every.agg(F.count_if(F.col("value").isNull()).alias("bad")).crossJoin(lines.agg(F.count_if(header & ~scan.has(v, p, "OBJECT")).alias("headless")))
    bundle = Bundle(conversations, rollouts.turns(rows, key), rollouts.calls(rows, key), rollouts.tools(rows, key), rollouts.samples(rows, key), rollouts.compactions(rows, key), rollouts.settings(rows, key), rollouts.items(rows, key), told)
    return bundle, _counters(bad.select((F.col("bad") + F.col("headless")).alias("malformed")), others)


def copilot(spark: SparkSession, home: str, machine: str = "local") -> tuple[Bundle, DataFrame]:
    """Event logs session-state/*/events.jsonl. Usage comes once, by model, in the last shutdown event; events of other agents than the root don't count."""
    v = F.col("value")
    every = scan.json_lines(spark, f"{home}/session-state/*/events.jsonl")
    lines = _numbered(every)
    kind = scan.text(v, "$.type")
    start = F.coalesce(kind == "session.start", F.lit(False))
    files = lines.select("path", "n_events", "hash").distinct().join(_first(lines.where(start), scan.name(v, "$.data.sessionId"), "external_id"), "path", "left")
    kept, others = one_copy(files.where("external_id IS NOT NULL"), ["external_id"], ["n_events", "hash"])
    agent = F.try_variant_get(v, "$.agentId", "variant")
    ok = F.coalesce(kind.isNotNull() & scan.has(v, "$.data", "OBJECT"), F.lit(False))
    root = ok & (agent.isNull() | F.is_variant_null(agent))
    is_ = lambda name: root & (kind == name)
    shutdown = is_("session.shutdown") & scan.has(v, "$.data.modelMetrics", "OBJECT")
    tool = F.when(is_("tool.execution_start"), scan.name(v, "$.data.toolName"))
    rows = lines.join(kept.select("path", "external_id"), "path").select(
        "external_id", "n", scan.time_ms(v, "$.timestamp").alias("at_ms"), scan.name(v, "$.id").alias("id"), is_("user.message").alias("user"), is_("assistant.message").alias("said"), is_("assistant.turn_end").alias("done"),
        F.when(is_("assistant.message"), scan.name(v, "$.data.model", 255)).alias("seen_model"), F.when(is_("session.start"), scan.name(v, "$.data.selectedModel", 255)).alias("chosen"), F.when(is_("session.start"), scan.name(v, "$.data.reasoningEffort", 64)).alias("told_effort"),
        tool.alias("tool"), F.coalesce(scan.name(v, "$.data.toolCallId"), F.concat(F.lit("event-"), F.col("n"))).alias("tool_key"), (is_("session.compaction_complete") & F.coalesce(F.try_variant_get(v, "$.data.success", "boolean"), F.lit(False))).alias("compaction"),
        F.when(shutdown, F.try_variant_get(v, "$.data.modelMetrics", "map<string,variant>")).alias("metrics"), F.when(shutdown, scan.text(v, "$.data.shutdownType")).alias("shutdown"), shutdown.alias("is_shutdown"),
        (~ok | is_("tool.execution_start") & tool.isNull() | is_("session.shutdown") & ~shutdown).alias("wrong"),
    )
    log = Window.partitionBy("external_id")
    rows = rows.withColumns({
        "turn_no": F.count_if("user").over(log.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)), "is_last": F.col("is_shutdown") & (F.max(F.when(F.col("is_shutdown"), F.col("n"))).over(log) == F.col("n")),
        "tool": F.when(F.row_number().over(Window.partitionBy("external_id", "tool_key", F.col("tool").isNotNull()).orderBy("n")) == 1, F.col("tool")),
    })
    usage = lambda e: F.least(scan.count(e["value"], "$.usage.inputTokens"), F.lit(MAX_LONG))

    def tokens_of(e: Column) -> Column:
        whole, told = usage(e), lambda name: scan.count(e["value"], f"$.usage.{name}")
        cached = F.least(whole, told("cacheReadTokens"))
        write = F.least(whole - cached, told("cacheWriteTokens"))
        thought = F.least(told("outputTokens"), told("reasoningTokens"))
        return scan.tokens(whole - cached - write, cached, write, told("outputTokens") - thought, thought)

    entries = F.array_sort(F.map_entries("metrics"), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    good = F.filter(entries, lambda e: label(e["key"], 255).isNotNull() & scan.has(e["value"], "$.usage", "OBJECT"))
    rows = rows.withColumn("calls", F.when(F.col("is_last"), F.transform(good, lambda e: _call(tokens_of(e), label(e["key"], 255), True)))).withColumn("unusable", F.when(F.col("is_last"), F.size("metrics") - F.size(good)).otherwise(0))
    rows = cut(rows.drop("metrics"), "copilot")
    facts = _spread(_named(rows, "copilot", machine), F.col("calls"), F.array("tool"), starts=F.col("user"), turn_key=F.coalesce("id", F.concat(F.lit("turn-"), "turn_no")), ends=F.when(F.col("done"), "completed"), touches=F.col("said") | F.col("done"), compaction=F.col("compaction"))
    facts = facts.withColumn("turn_no", F.when(F.col("tok").isNull(), F.col("turn_no")).otherwise(0))  # usage is the session's, of no turn
    made = _bundle(facts, kept.select("external_id", F.col("n_events").alias("event_count")))
    whole = rows.groupBy("external_id").agg(
        F.array_compact(F.concat(F.collect_set("seen_model"), F.array(F.max_by("chosen", F.when(F.col("chosen").isNotNull(), F.col("n")))))).alias("more"), F.max_by("told_effort", F.when(F.col("told_effort").isNotNull(), F.col("n"))).alias("effort"),
        F.max("turn_no").alias("last_turn"), F.coalesce(F.max(F.when(F.col("is_last"), F.col("shutdown"))) == "error", F.lit(False)).alias("broken"),
    )
    conversations = made.conversations.join(whole.select("external_id", "more"), "external_id").withColumn("models", F.array_sort(F.array_union("models", "more"))).drop("more")
    open_turn = F.col("broken") & (F.col("turn_no") == F.col("last_turn")) & (F.col("status") != "completed")
    turns = made.turns.join(whole.select("external_id", "last_turn", "broken"), "external_id").withColumn("status", F.when(open_turn, "aborted").otherwise(F.col("status"))).drop("last_turn", "broken")
    seen = rows.where("turn_no > 0").groupBy("external_id", "turn_no").agg(F.collect_set("seen_model").alias("own"))
    settings = made.settings.select(*KEY, "turn_no").join(seen, ["external_id", "turn_no"]).join(whole.select("external_id", "effort"), "external_id").select(*KEY, "turn_no", F.when(F.size("own") == 1, F.col("own")[0]).alias("model"), "effort")
    bad = every.agg(F.count_if(F.col("value").isNull()).alias("bad")).crossJoin(files.agg(F.count_if(F.col("external_id").isNull()).alias("nameless"))).crossJoin(rows.agg(F.count_if("wrong").alias("wrong"), F.coalesce(F.sum("unusable"), F.lit(0)).alias("unusable")))
    return Bundle(**(made.__dict__ | {"conversations": conversations, "turns": turns, "settings": settings})), _counters(bad.select((F.col("bad") + F.col("nameless") + F.col("wrong") + F.col("unusable")).alias("malformed")), others)
