"""Client-side slices: inclusive ranges in epoch milliseconds, with a missing end as still running."""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import DAY_MS


@dataclass(frozen=True)
class Range:
    start: int | None = None
    end: int | None = None


def in_range(ms: Column, r: Range) -> Column:
    """Inclusive at both ends; a missing time passes only where the range has no start."""
    ok = F.lit(True)
    if r.start is not None:
        ok &= ms >= r.start
    if r.end is not None:
        ok &= ms <= r.end
    return F.when(ms.isNull(), F.lit(r.start is None)).otherwise(ok)


def overlaps(r: Range, start: str = "started_ms", end: str = "ended_ms") -> Column:
    """A missing start is the beginning and a missing end the end of time; without both, false."""
    s, e = F.col(start), F.col(end)
    ok = s.isNotNull() | e.isNotNull()
    if r.start is not None:
        ok &= F.coalesce(e >= r.start, F.lit(True))
    if r.end is not None:
        ok &= F.coalesce(s <= r.end, F.lit(True))
    return ok


def closed() -> Column:
    return F.col("status").isin("completed", "aborted")


def observed_end(g) -> DataFrame:
    """One row: the latest time that any table of the graph tells."""
    times = [(g.conversations, "started_ms"), (g.conversations, "ended_ms"), (g.turns, "started_ms"), (g.turns, "ended_ms"), (g.calls, "timestamp_ms"), (g.tools, "timestamp_ms"), (g.samples, "timestamp_ms"), (g.compactions, "timestamp_ms"), (g.runs, "ingested_ms"), (g.work, "started_ms"), (g.subagents, "created_ms")]
    found = None
    for df, c in times:
        one = df.agg(F.max(c).alias("at"))
        found = one if found is None else found.union(one)
    return found.agg(F.max("at").alias("at"))


def ranges(latest: DataFrame, days: int | None, since: int | None = None, until: int | None = None) -> DataFrame:
    """start, end and the previous range of equal width, for the last `days` days (None: all) that the data and an export window leave.

    latest is one row; without any time there is no range. The end is the last millisecond of the latest day,
    within the window; a previous range that begins before the window is none.
    """
    end = F.col("at") - F.pmod(F.col("at"), F.lit(DAY_MS)) + (DAY_MS - 1)
    if until is not None:
        end = F.least(end, F.lit(until - 1))
    if since is not None:
        end = F.greatest(end, F.lit(since))
    start = F.lit(since).cast("bigint") if days is None else end - F.pmod(end, F.lit(DAY_MS)) - (days - 1) * DAY_MS
    if since is not None:
        start = F.greatest(start, F.lit(since))
    rows = latest.where("at IS NOT NULL").select(start.alias("start_ms"), end.alias("end_ms")).withColumn("previous_end_ms", F.col("start_ms") - 1).withColumn("previous_start_ms", F.col("start_ms") - (F.col("end_ms") - F.col("start_ms")) - 1)
    if since is not None:
        inside = F.col("previous_start_ms") >= since
        rows = rows.withColumns({c: F.when(inside, F.col(c)) for c in ("previous_start_ms", "previous_end_ms")})
    return rows


def custom_range(latest: DataFrame, first: str | None, last: str | None, since: int | None = None, until: int | None = None) -> DataFrame:
    """As ranges(), from the day `first` to the day `last` (ISO days of UTC): a missing first day is the export window's start, a missing last one the latest day that the data tell."""
    rows = ranges(latest, None, since, until).select("end_ms")
    midnight = lambda day: F.lit(calendar.timegm(date.fromisoformat(day).timetuple()) * 1000)
    start = F.lit(since).cast("bigint") if first is None else midnight(first)
    end = F.col("end_ms") if last is None else midnight(last) + (DAY_MS - 1)
    if since is not None:
        start = F.greatest(start, F.lit(since))
    if until is not None:
        end = F.least(end, F.lit(until - 1))
    rows = rows.select(start.cast("bigint").alias("start_ms"), end.cast("bigint").alias("end_ms")).withColumn("previous_end_ms", F.col("start_ms") - 1).withColumn("previous_start_ms", F.col("start_ms") - (F.col("end_ms") - F.col("start_ms")) - 1)
    if since is not None:
        inside = F.col("previous_start_ms") >= since
        rows = rows.withColumns({c: F.when(inside, F.col(c)) for c in ("previous_start_ms", "previous_end_ms")})
    return rows


def last_days(days: int, now_ms: int) -> Range:
    """The last `days` days up to the next midnight of UTC after the wall clock's now."""
    end = now_ms - now_ms % DAY_MS + DAY_MS
    return Range(end - days * DAY_MS, end)


@dataclass(frozen=True)
class Slice:
    conversations: DataFrame
    turns: DataFrame
    calls: DataFrame
    tools: DataFrame
    work: DataFrame
    samples: DataFrame
    settings: DataFrame
    compactions: DataFrame
    subagents: DataFrame


def whole(g) -> Slice:
    return Slice(g.conversations, g.turns, _with_semantics(_in_turns(g, "calls"), g.conversations), g.tools, g.work, g.samples, g.settings, g.compactions, g.subagents)


def _in_turns(g, name: str) -> DataFrame:
    """Calls or settings with their turn: in_turn if there is one, its start and its status. A graph may keep them so, as <name>_in_turns."""
    kept = getattr(g, f"{name}_in_turns", None)
    if kept is not None:
        return kept
    turns = g.turns.groupBy("conversation_id", "turn_no").agg(F.lit(True).alias("in_turn"), F.min("started_ms").alias("turn_started_ms"), F.min("status").alias("turn_status"))
    return getattr(g, name).join(turns, ["conversation_id", "turn_no"], "left")


def _with_semantics(calls: DataFrame, conversations: DataFrame) -> DataFrame:
    return calls.join(conversations.select("conversation_id", "provider", "semantics", F.col("started_ms").alias("c_start"), F.col("ended_ms").alias("c_end")), "conversation_id")


def select(g, r: Range, provider: str | None = None, machine: str | None = None, project: str | None = None, model: str | None = None) -> Slice:
    """Nine selections that depend on each other; calls carry their conversation's provider and semantics.

    Calls of aggregate and snapshot providers are placed by their conversation's times, all others
    need a time of their own. With a model, turns are those of the model's calls, and what
    belongs to a turn needs one of them.
    """
    base = g.conversations
    for value, column in ((provider, "provider"), (machine, "machine"), (project, "project")):
        if value is not None:
            base = base.where(F.col(column) == value)
    if model is not None:
        base = base.where(F.array_contains("models", model))
    ids = base.select("conversation_id")
    of_base = lambda df: df.join(ids, "conversation_id", "left_semi")
    turn = ["conversation_id", "turn_no"]
    calls = _with_semantics(_in_turns(g, "calls"), base)
    if model is not None:
        calls = calls.where(F.col("model") == model)
    whole_conversation = F.col("semantics").isin("conversation-aggregate", "context-snapshot")
    calls = calls.where(F.when(whole_conversation, overlaps(r, "c_start", "c_end")).otherwise(F.col("timestamp_ms").isNotNull() & in_range(F.col("timestamp_ms"), r)))
    turns = of_base(g.turns).where(in_range(F.col("started_ms"), r))
    if model is not None:
        turns = turns.join(calls.select(*turn).distinct(), turn, "left_semi")
    allowed = turns.select(*turn)
    in_turn = lambda df: df.join(allowed, turn, "left_semi")
    # a call in the range is one of the model, so its turn is allowed if it is in the range
    turn_in_range = F.col("in_turn") & in_range(F.col("turn_started_ms"), r)
    calls = calls.where(whole_conversation | F.col("turn_no").isNull() | turn_in_range)
    limited = in_turn if model is not None else (lambda df: df)
    tools = limited(of_base(g.tools).where(in_range(F.col("timestamp_ms"), r)))
    samples = limited(of_base(g.samples).where(in_range(F.col("timestamp_ms"), r)))
    compactions = of_base(g.compactions).where(in_range(F.col("timestamp_ms"), r))
    work = limited(of_base(g.work).where(in_range(F.col("started_ms"), r)))
    settings = limited(of_base(_in_turns(g, "settings")).where(turn_in_range)).drop("in_turn", "turn_started_ms", "turn_status")
    active = turns.select("conversation_id").union(calls.select("conversation_id")).union(tools.select("conversation_id")).distinct().withColumn("__active", F.lit(True))
    conversations = base.join(active, "conversation_id", "left").where(overlaps(r) | F.col("__active")).drop("__active")
    if model is not None:
        conversations = conversations.join(calls.select("conversation_id").distinct(), "conversation_id", "left_semi")
    subagents = g.subagents.join(conversations.select("conversation_id"), F.col("parent_id") == F.col("conversation_id"), "left_semi").where(in_range(F.col("created_ms"), r))
    return Slice(conversations, turns, calls, tools, work, samples, settings, compactions, subagents)


def semantic_calls(s: Slice) -> DataFrame:
    """Calls whose tokens may be summed: none of unavailable providers, all of aggregate and snapshot ones, additive ones if their turn is missing or closed."""
    done = F.col("turn_no").isNull() | F.col("in_turn") & F.col("turn_status").isin("completed", "aborted")
    return s.calls.where(F.col("semantics").isin("conversation-aggregate", "context-snapshot") | (F.col("semantics") == "additive") & done)
