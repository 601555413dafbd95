"""Rollouts: event logs in which turns are opened and closed by name, and settings are carried forward.

Events have the columns of EVENT. The state of a log, which turn is active, which model, which defaults, is what windows over its
order tell at each event, so no event is handled one by one:

- "context" and "start" make the turn that they name the active one, "complete" and "abort" leave none;
- a turn exists from its "start" on; started again, it forgets its counts and its end;
- the last "complete" or "abort" of a turn after its start ends it; a turn without one ends with the log;
- settings of a turn are the last that were told for it. Its first event takes the defaults that "settings" events have told so
  far, a "context" tells all of them anew, and the model of contexts is carried forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import interval_ms
from ..sources.scan import saturated, with_totals

#: Columns of an event besides its log's key and seq. names_turn: whether an item names a turn itself, be it by an invalid name.
EVENT = ["at_ms", "kind", "turn_id", "names_turn", "model", "effort", "mode", "tier", "window", "tok", "tools", "duration_ms", "ttft_ms", "item"]
SETTINGS = ["model", "effort", "mode", "tier", "window"]


def _is(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def placed(events: DataFrame, key: list[str]) -> DataFrame:
    """events with own (the turn that an event is about), turn (own, if it has started), start_no (the seq of its start), model_now and the defaults so far."""
    log = Window.partitionBy(*key).orderBy("seq")
    upto, before = log.rowsBetween(Window.unboundedPreceding, 0), log.rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(_is("context") & F.col("turn_id").isNotNull() | _is("start"), F.struct(F.col("turn_id").alias("id"))).when(_is("complete", "abort"), F.struct(F.lit(None).cast("string").alias("id")))
    active = lambda w: F.last(mark, ignorenulls=True).over(w)["id"]
    own = F.when(_is("complete", "abort"), F.coalesce("turn_id", active(before))).when(_is("item") & F.col("names_turn"), F.col("turn_id")).otherwise(active(upto))
    told = lambda c, *kinds: F.last(F.when(_is(*kinds), F.col(c)), ignorenulls=True).over(upto)
    rows = events.withColumns({"own": own, "model_now": told("model", "context"), **{f"default_{c}": told(c, "settings") for c in ("model", "effort", "mode", "tier")}})
    of_turn = Window.partitionBy(*key, "own").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    start_no = F.when(F.col("own").isNotNull(), F.max(F.when(_is("start"), F.col("seq"))).over(of_turn))
    first = F.count_if(_is("context", "start")).over(of_turn) == 1
    rows = rows.withColumns({"start_no": start_no, "first": first & _is("context", "start")})
    return rows.withColumn("turn", F.when(F.col("start_no").isNotNull(), F.col("own")))


def turns(rows: DataFrame, key: list[str]) -> DataFrame:
    """The turns of placed events."""
    mine = rows.where("own IS NOT NULL")
    last = F.max("start_no").over(Window.partitionBy(*key, "own"))
    mine = mine.withColumn("last_start", last).where("start_no = last_start")
    end = F.max_by(F.struct("at_ms", F.when(_is("complete"), "completed").otherwise("aborted").alias("status"), "duration_ms", "ttft_ms"), F.when(_is("complete", "abort"), F.col("seq")))
    whole = mine.groupBy(*key, F.col("own").alias("turn")).agg(
        F.max("last_start").alias("start_no"), F.max(F.when(_is("start") & (F.col("seq") == F.col("last_start")), F.col("at_ms"))).alias("started_ms"), end.alias("end"),
        F.count_if(_is("usage")).alias("model_calls"), F.coalesce(F.sum(F.when(_is("tool"), F.size("tools"))), F.lit(0)).alias("tool_calls"), *saturated(),
    )
    logs = rows.groupBy(*key).agg(F.max("at_ms").alias("log_end"))
    done = whole.join(logs, key).select(
        *key, "turn", "start_no", "started_ms", F.coalesce("end.at_ms", "log_end").alias("ended_ms"), F.coalesce("end.status", F.lit("in-progress")).alias("status"),
        F.col("end.duration_ms").alias("duration_ms"), F.col("end.ttft_ms").alias("ttft_ms"), "model_calls", "tool_calls", *[c for c in whole.columns if c.endswith("_tokens")],
    )
    return with_totals(done)


def settings(rows: DataFrame, key: list[str]) -> DataFrame:
    """The settings of the turns of placed events."""
    some = lambda x: F.struct(x.alias("x"))
    told = lambda x: F.when(x.isNotNull(), some(x))
    first = _is("start") & F.col("first")
    now, nothing = F.col("model_now"), F.lit(None).cast("bigint")
    writes = {
        "model": F.when(_is("context"), some(now)).when(first, some(F.coalesce(now, "default_model"))).when(_is("start"), told(now)).when(_is("settings"), told(F.col("model"))),
        "window": F.when(_is("context"), some(nothing)).when(first, some(F.col("window"))).when(_is("start", "usage"), told(F.col("window"))),
        "tier": F.when(_is("context") | first, some(F.col("default_tier"))).when(_is("settings"), told(F.col("tier"))),
    }
    for c in ("effort", "mode"):
        writes[c] = F.when(_is("context"), some(F.coalesce(c, f"default_{c}"))).when(first, some(F.col(f"default_{c}"))).when(_is("settings"), told(F.col(c)))
    last = [F.max_by(F.col(f"w_{c}"), F.when(F.col(f"w_{c}").isNotNull(), F.col("seq")))["x"].alias(c) for c in SETTINGS]
    all_turns = rows.where("own IS NOT NULL").withColumns({f"w_{c}": writes[c] for c in SETTINGS}).groupBy(*key, F.col("own").alias("turn")).agg(F.max("start_no").alias("start_no"), *last)
    return all_turns.where("start_no IS NOT NULL").drop("start_no")


def _numbered(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    return rows.withColumn("sequence", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def calls(rows: DataFrame, key: list[str]) -> DataFrame:
    return with_totals(_numbered(rows.where(_is("usage")), key, "seq").select(*key, "sequence", "turn", F.col("at_ms").alias("timestamp_ms"), F.coalesce("model_now", F.lit("unknown")).alias("model"), "tok.*"))


def samples(rows: DataFrame, key: list[str]) -> DataFrame:
    """Context sizes, numbered as the calls that they came with."""
    both = _numbered(rows.where(_is("usage")), key, "seq").where("window IS NOT NULL")
    used = sum((F.col(f"tok.{c}").cast("decimal(38,0)") for c in ("cached_input_tokens", "cache_write_input_tokens")), F.col("tok.uncached_input_tokens").cast("decimal(38,0)"))
    return both.select(*key, "sequence", "turn", F.col("at_ms").alias("timestamp_ms"), used.cast("bigint").alias("input_tokens"), F.col("window").alias("window_tokens"))


def tools(rows: DataFrame, key: list[str]) -> DataFrame:
    each = rows.where(_is("tool")).select(*key, "seq", "turn", "at_ms", F.posexplode("tools").alias("pos", "tool"))
    return _numbered(each, key, "seq", "pos").select(*key, "sequence", "turn", F.col("at_ms").alias("timestamp_ms"), "tool.*")


def items(rows: DataFrame, key: list[str]) -> DataFrame:
    out = _numbered(rows.where(_is("item")), key, "seq").select(*key, "sequence", "turn", "item.*")
    return out.withColumn("duration_ms", interval_ms(F.col("started_at_ms"), F.col("completed_at_ms")))


def compactions(rows: DataFrame, key: list[str]) -> DataFrame:
    return _numbered(rows.where(_is("compacted")), key, "seq").select(*key, "sequence", "turn", F.col("at_ms").alias("timestamp_ms"))


def conversations(rows: DataFrame, key: list[str]) -> DataFrame:
    whole = rows.groupBy(*key).agg(
        F.min("at_ms").alias("started_ms"), F.max("at_ms").alias("ended_ms"), F.count_distinct(F.when(_is("start"), F.col("turn_id"))).alias("iterations"), F.count_if(_is("usage")).alias("model_calls"),
        F.coalesce(F.sum(F.when(_is("tool"), F.size("tools"))), F.lit(0)).alias("tool_calls"), F.count_if(_is("compacted")).alias("compactions"), F.count("*").alias("event_count"),
        F.array_sort(F.collect_set(F.when(_is("context"), F.col("model_now")))).alias("models"), *saturated(),
    )
    return with_totals(whole).withColumn("duration_ms", interval_ms(F.col("started_ms"), F.col("ended_ms")))
