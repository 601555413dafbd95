"""Idempotent merges by completeness rank, scopes, retention and validation, as joins over immutable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANK = ("event_count", "content_hash")


def _rank(prefix: str = ""):
    return F.struct(*[F.col(prefix + c) for c in RANK])


def best_copy(copies: DataFrame, key: str = "conversation_id") -> DataFrame:
    """The copy of each conversation with the most events, then the larger hash, and how many others there were; one aggregate, no sort."""
    rest = [c for c in copies.columns if c != key]
    best = F.max(F.struct(*RANK, *[c for c in rest if c not in RANK]))
    return copies.groupBy(key).agg(best.alias("b"), (F.count("*") - 1).alias("duplicates")).select(key, *[F.col(f"b.{c}").alias(c) for c in rest], "duplicates")


def outcome(stored: DataFrame, incoming: DataFrame, key: str = "conversation_id") -> DataFrame:
    """What a merge does with each key: inserted, replaced (a richer copy came), skipped (equal or poorer), kept (nothing came)."""
    a = stored.select(key, *[F.col(c).alias("s_" + c) for c in RANK], F.lit(True).alias("s"))
    b = incoming.select(key, *[F.col(c).alias("i_" + c) for c in RANK], F.lit(True).alias("i"))
    what = F.when(F.col("s").isNull(), "inserted").when(F.col("i").isNull(), "kept").when(_rank_of("i_") > _rank_of("s_"), "replaced").when(_rank_of("i_") == _rank_of("s_"), "equal").otherwise("stale")
    return a.join(b, key, "full").select(key, what.alias("outcome"))


def _rank_of(prefix: str):
    return F.struct(*[F.col(prefix + c) for c in RANK])


def merge(stored: DataFrame, incoming: DataFrame, key: str = "conversation_id") -> DataFrame:
    """The table after a merge; the same whatever the order of several merges."""
    return best_copy(stored.unionByName(incoming), key).drop("duplicates")


def merge_children(stored: DataFrame, incoming: DataFrame, outcomes: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Child rows after a merge: those of inserted and replaced conversations come from the incoming side, all of them."""
    new = outcomes.where("outcome IN ('inserted', 'replaced')").select(key)
    return stored.join(new, key, "left_anti").unionByName(incoming.join(new, key, "left_semi"))


def fresh_scopes(outcomes: DataFrame, known: DataFrame, scope: list[str]) -> DataFrame:
    """Scopes whose delegation graph a merge may replace: first seen ones, and those with a richer conversation and none stale. outcomes has the scope columns."""
    flags = outcomes.groupBy(*scope).agg(F.bool_or(F.col("outcome").isin("inserted", "replaced")).alias("richer"), F.bool_or(F.col("outcome") == "stale").alias("stale"))
    first = flags.join(known.select(*scope).distinct(), scope, "left_anti").select(*scope)
    return first.union(flags.where("richer AND NOT stale").select(*scope)).distinct()


def expired(cutoff_ms: int, start: str = "started_ms", end: str = "ended_ms"):
    """Ended before the cutoff, or without an end and started before it; never without any time."""
    return F.coalesce(F.coalesce(F.col(end), F.col(start)) < cutoff_ms, F.lit(False))


def retention(conversations: DataFrame, children: dict[str, DataFrame], subagents: DataFrame, runs: DataFrame, cutoff_ms: int) -> dict[str, DataFrame]:
    """All tables without expired conversations (their children go too), edges and runs."""
    gone = conversations.where(expired(cutoff_ms)).select("conversation_id")
    out = {name: df.join(gone, "conversation_id", "left_anti") for name, df in children.items()}
    out["conversations"] = conversations.where(~expired(cutoff_ms))
    out["subagents"] = subagents.where(~F.coalesce(F.col("created_ms") < cutoff_ms, F.lit(False)))
    out["runs"] = runs.where(~F.coalesce(F.col("ingested_ms") < cutoff_ms, F.lit(False)))
    return out


def retention_preview(conversations: DataFrame, subagents: DataFrame, runs: DataFrame, cutoff_ms: int) -> DataFrame:
    """How many rows retention() would delete."""
    def n(df, ok, name):
        return df.agg(F.count_if(ok).alias(name))

    return n(conversations, expired(cutoff_ms), "conversations").crossJoin(n(subagents, F.col("created_ms") < cutoff_ms, "subagents")).crossJoin(n(runs, F.col("ingested_ms") < cutoff_ms, "runs"))


def violations(conversations: DataFrame, turns: DataFrame, calls: DataFrame) -> DataFrame:
    """Counts of rows that break each rule of the graph: unique keys, references, order of times, sums of tokens."""
    def rule(name, df):
        return df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("rule"), "n_rows")

    twice = lambda df, *key: df.groupBy(*key).count().where("count > 1")
    found = [
        rule("conversation key", twice(conversations, "conversation_id")),
        rule("turn key", twice(turns, "conversation_id", "turn_no")),
        rule("call sequence", twice(calls, "conversation_id", "sequence")),
        rule("turn without conversation", turns.join(conversations, "conversation_id", "left_anti")),
        rule("call without turn", calls.where("turn_no IS NOT NULL").join(turns, ["conversation_id", "turn_no"], "left_anti")),
        rule("ends before start", turns.where("ended_ms < started_ms")),
        rule("input sum", calls.where("input_tokens != cached_input_tokens + cache_write_input_tokens + uncached_input_tokens")),
        rule("output sum", calls.where("output_tokens != reasoning_output_tokens + visible_output_tokens")),
        rule("total sum", calls.where("total_tokens != input_tokens + output_tokens + unattributed_tokens")),
        rule("negative count", calls.where("least(uncached_input_tokens, cached_input_tokens, cache_write_input_tokens, visible_output_tokens, reasoning_output_tokens, unattributed_tokens) < 0")),
        rule("conversation ends before start", conversations.where("ended_ms < started_ms")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out
