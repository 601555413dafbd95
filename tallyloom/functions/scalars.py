"""Column functions of the usage graph. Times are epoch milliseconds (UTC); null means "not reported", never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
MAX_LONG = 2**63 - 1

# Token semantics of each provider; any other is unavailable.
SEMANTICS = {
    "additive": ["aider", "amp", "claude", "cline", "codex", "continue", "gemini", "goose", "grok", "kilo", "kimi", "opencode", "openhands", "pi", "plandex", "qwen"],
    "conversation-aggregate": ["copilot", "mistral-vibe"],
    "context-snapshot": ["crush"],
    "unavailable": ["amazon-q", "cursor"],
}

# Categories of tools in shared reports, by exact name.
TOOL_CATEGORIES = {
    "Agent coordination": ["followup_task", "interrupt_agent", "list_agents", "send_message", "spawn_agent", "wait_agent"],
    "Shell and processes": ["exec_command", "wait", "write_stdin"],
    "Files and workspace": ["apply_patch", "view_image"],
    "Web": ["web__run"],
    "Planning": ["create_goal", "get_goal", "update_goal", "update_plan"],
}


def epoch_ms(ts: str) -> Column:
    """Milliseconds of a column of timestamps without zone, whatever the session's zone; microseconds are rounded, halves away from 1970."""
    days = f"datediff(CAST({ts} AS DATE), DATE'1970-01-01')"
    return F.expr(f"CAST(round(CAST({days} AS BIGINT) * {DAY_MS} + (hour({ts}) * 3600 + minute({ts}) * 60 + extract(SECOND FROM {ts})) * 1000) AS BIGINT)")


def day(ms: Column) -> Column:
    """UTC day as text, or unknown."""
    return F.coalesce(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / DAY_MS).cast("int")).cast("string"), F.lit("unknown"))


def canonical_time(text: Column) -> Column:
    """A zoned ISO-8601 text as fixed-width UTC text with microseconds; null if it has no zone or isn't a time."""
    ts = F.when(text.rlike(r"(?i)^\d{4}-\d{2}-\d{2}[T ].*(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))
    return F.concat(F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def source_time(x: Column) -> Column:
    """Epoch milliseconds of a number that counts seconds, or milliseconds if it is over 1e10; null if not finite."""
    ok = x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < 1e17)
    return F.when(ok, F.when(F.abs(x) > 1e10, x.cast("double")).otherwise(x.cast("double") * 1000).cast("bigint"))


def ratio(n: Column, d: Column) -> Column:
    """Percent, 0 where the denominator is 0."""
    return F.when(d == 0, F.lit(0.0)).otherwise(100.0 * n / d)


def semantics(provider: Column) -> Column:
    out = F.lit("unavailable")
    for kind, names in SEMANTICS.items():
        if kind != "unavailable":
            out = F.when(provider.isin(names), kind).otherwise(out)
    return out


def tool_category(tool: Column) -> Column:
    """The category that shared reports show instead of a tool's name; the first rule that fits."""
    out = F.when(tool.contains("imagegen"), "Media").when(tool.startswith("mcp__") | tool.contains("mcp_resource"), "Integrations").otherwise("Other")
    for category, names in reversed(TOOL_CATEGORIES.items()):
        out = F.when(tool.isin(names), category).otherwise(out)
    return out


def counter(x: Column) -> Column:
    """A number as a count: truncated, clamped to 0 .. 2**63 - 1; null, NaN and infinities are 0."""
    d = x.cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")) | (d <= 0), F.lit(0)).when(d >= float(MAX_LONG), F.lit(MAX_LONG)).otherwise(d.cast("bigint"))


def bounded_sum(*xs: Column) -> Column:
    """A sum of counts that stops at 2**63 - 1."""
    total = sum((x.cast("decimal(38,0)") for x in xs[1:]), xs[0].cast("decimal(38,0)"))
    return F.least(total, F.lit(MAX_LONG).cast("decimal(38,0)")).cast("bigint")


def label(x: Column, longest: int = 512, at_sign: bool = True) -> Column:
    """A trimmed name, or null if it is empty, too long or has other characters than names may have."""
    t = F.trim(x)
    return F.when(t.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.:/+@-]*$" if at_sign else r"^[A-Za-z0-9][A-Za-z0-9_.:/+-]*$") & (F.length(t) <= longest), t)


# Names of states and roles in logs, by the state or role that they mean.
STATES = {
    "aborted": ["aborted", "canceled", "cancelled", "interrupted"],
    "completed": ["complete", "completed", "done", "succeeded", "success"],
    "failed": ["error", "errored", "failed", "failure"],
    "in-progress": ["active", "in-progress", "pending", "running"],
}
ROLES = {"planning": ["planner", "planning"], "research": ["explorer", "research", "researcher"], "review": ["review", "reviewer"], "test": ["test", "tester"], "worker": ["implementer", "worker"]}
# Tools that an outer tool's input may call.
NESTED_TOOLS = ["apply_patch", "create_goal", "exec_command", "get_goal", "image_gen__imagegen", "list_mcp_resource_templates", "list_mcp_resources", "read_mcp_resource", "update_goal", "update_plan", "view_image", "wait", "web__run", "write_stdin"]


def _folded(x: Column) -> Column:
    return F.replace(F.lower(F.trim(x)), F.lit("_"), F.lit("-"))


def _named(x: Column, names: dict[str, list[str]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for name, aliases in names.items():
        out = F.when(x.isin(*aliases), name).otherwise(out)
    return out


def edge_status(x: Column) -> Column:
    """The state of a delegation, whatever a log calls it."""
    return _named(_folded(x), STATES, "unknown")


def agent_role(x: Column) -> Column:
    """The role of an agent; unspecified where a log tells none, other where it isn't known."""
    t = _folded(x)
    return F.when(F.coalesce(t, F.lit("")).isin("", "unknown", "unspecified"), "unspecified").otherwise(_named(t, ROLES, "other"))


# States and roles in stores of the former schema, by what they mean.
FORMER_STATES = {
    "completed": ["completed", "done", "finished", "success", "succeeded"], "failed": ["failed", "error", "errored"], "aborted": ["aborted", "canceled", "cancelled", "killed", "terminated"],
    "in-progress": ["active", "in-progress", "in_progress", "pending", "queued", "running", "starting"],
}
FORMER_ROLES = {"worker": ["worker", "general"], "research": ["explore", "explorer", "research", "researcher"], "review": ["review", "reviewer"], "test": ["test", "tester"], "planning": ["planner", "planning"], "other": ["other"], "unspecified": ["unspecified"]}


def former_status(x: Column) -> Column:
    """The state of a delegation that a store of the former schema tells; not trimmed, as it was stored."""
    return _named(F.lower(x), FORMER_STATES, "unknown")


def former_role(x: Column) -> Column:
    """The role that a store of the former schema tells; unspecified where it tells none."""
    return F.when(x.isNull() | (F.trim(x) == ""), "unspecified").otherwise(_named(F.lower(x), FORMER_ROLES, "other"))


def day_floor(ms: Column) -> Column:
    """The midnight of UTC at or before a time."""
    return ms - F.pmod(ms, F.lit(DAY_MS))


def day_ceiling(ms: Column) -> Column:
    """The midnight of UTC at or after a time."""
    return ms + F.pmod(-ms, F.lit(DAY_MS))


def work_status(exit_code: Column, success: Column, error: Column, status: Column) -> Column:
    """The state of a work item: a failing exit code, success = false or any error decide before its status."""
    t = F.replace(F.lower(status), F.lit("_"), F.lit("-"))
    failed = F.coalesce(exit_code != 0, F.lit(False)) | F.coalesce(~success, F.lit(False)) | F.coalesce(error != "", F.lit(False)) | t.isin("failed", "error", "errored")
    return F.when(failed, "failed").when(t.isin("completed", "success", "succeeded"), "completed").when(t.isin("in-progress", "running", "pending"), "in-progress").otherwise("unknown")


def called_tools(outer: Column, text: Column) -> Column:
    """The tools that a call stands for: those that the input of the tool `exec` calls, if it calls any that are known, else itself."""
    found = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?:tools|collaboration)\.([A-Za-z][A-Za-z0-9_]*)\s*\("), 1), lambda t: t.isin(*NESTED_TOOLS) | t.startswith("mcp__"))
    own = F.coalesce(label(outer, 512, False), F.lit("unknown"))
    return F.when((own == "exec") & (F.size(found) > 0), found).otherwise(F.array(own))


def repository_slug(url: Column) -> Column:
    """The last part of a repository's address without .git; null if it is no name."""
    last = F.regexp_extract(F.regexp_replace(url, r"[/\\]+$", ""), r"([^/\\:]*)$", 1)
    return label(F.regexp_replace(last, r"\.git$", ""), 255, False)


def qualified_model(provider: Column, model: Column) -> Column:
    """provider/model, unless the model already begins with its provider or either is missing."""
    bare = F.coalesce(provider, F.lit("")) == ""
    return F.when(F.coalesce(model, F.lit("")) == "", None).when(bare | model.startswith(F.concat(provider, F.lit("/"))), model).otherwise(F.concat(provider, F.lit("/"), model))


def change_style(change: Column, prefer: str = "neutral") -> Column:
    """How a change in percent reads: better or worse by the preference for higher or lower values, neutral without one; null without a change."""
    if prefer not in ("higher", "lower", "neutral"):
        raise ValueError(f"no preference {prefer}")
    good = {"higher": change > 0, "lower": change < 0, "neutral": F.lit(None).cast("boolean")}[prefer]
    return F.when(change.isNull(), None).when(good.isNull(), "neutral").when(good, "better").otherwise("worse")


def neutralized(x: Column) -> Column:
    """Text that a spreadsheet won't read as a formula: an apostrophe before what begins like one."""
    return F.when(x.rlike(r"^[\t\r\n]|^\s*[=+\-@]"), F.concat(F.lit("'"), x)).otherwise(x)


def script_safe(x: Column) -> Column:
    """JSON text that may stand inside an HTML script element."""
    for c in "&<>":
        x = F.replace(x, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return x


def heat_level(v: Column, most: Column) -> Column:
    """0 to 4 by share of the largest value; -1 where nothing was observed."""
    return F.when(v.isNull(), -1).when(most <= 0, 0).otherwise(F.least(F.lit(4), F.ceil(4 * v / most))).cast("int")


def change(now: Column, before: Column) -> Column:
    """Percent of change from before, null where that is null or 0."""
    return F.when(before.isNotNull() & (before != 0), 100.0 * (now - before) / F.abs(before))


def interval_ms(start: Column, end: Column) -> Column:
    """Length of an interval, not below 0; null if either end is."""
    return F.when(start.isNotNull() & end.isNotNull(), F.greatest(F.lit(0), end - start))
