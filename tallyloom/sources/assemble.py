"""From a connector's facts to the tables of the usage graph.

A connector only projects its events to facts, one row per event: provider, machine, external_id, seq,
at_ms, starts (the event opens a turn), turn_key, ends (status that it gives the open turn), tok
(token parts of a call), model, tool, compaction, sample_in and sample_window; touches (the event's time is the turn's end so far; unless told, where
it ends one), effort (of the turn that it opens) and aside (the call's model isn't the turn's own). Turns, calls, tools and
the other tables then come from windows over a conversation, the same way for all connectors.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import interval_ms
from ..operators.folds import segment
from .scan import saturated, with_totals

FACTS = ["provider", "machine", "external_id", "seq", "at_ms", "starts", "turn_key", "ends", "tok", "model", "tool", "compaction", "sample_in", "sample_window", "touches", "effort", "aside"]
KEY = ["provider", "external_id"]


@dataclass(frozen=True)
class Bundle:
    conversations: DataFrame
    turns: DataFrame
    calls: DataFrame
    tools: DataFrame
    samples: DataFrame
    compactions: DataFrame
    settings: DataFrame | None = None
    work: DataFrame | None = None
    edges: DataFrame | None = None


def united(bundles: list[Bundle]) -> Bundle:
    """The graphs of several providers as one."""
    one, *rest = [[getattr(b, f.name) for f in fields(Bundle)] for b in bundles]
    for other in rest:
        one = [b if a is None else a if b is None else a.unionByName(b, allowMissingColumns=True) for a, b in zip(one, other, strict=True)]
    return Bundle(*one)


def one_copy(events: DataFrame, key: list[str], rank: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of the files of one conversation the one with the most events, then the larger rank columns; (its events, number of other files by key). events has path, n_events and digest."""
    files = events.select(*key, "path", *rank).distinct()
    best = files.groupBy(*key).agg(F.max(F.struct(*rank, "path")).alias("b"), (F.count("*") - 1).alias("duplicates"))
    kept = events.join(best.select(*key, F.col("b.path").alias("path")), [*key, "path"], "left_semi")
    return kept, best.select(*key, "duplicates")


def assemble(facts: DataFrame, first_end: bool = True, next_closes: bool = True, by_time: bool = False) -> Bundle:
    """first_end: a turn ends at the first event that ends it, else at the last; next_closes: the start of the next turn completes a turn.

    by_time: a conversation lasts from its least to its largest time, else from its first event with a time to its last one.
    facts may number the turns themselves, in turn_no.
    """
    placed = facts.select(*FACTS, "turn_no") if "turn_no" in facts.columns else segment(facts.select(FACTS), KEY, ["seq"], F.col("starts"))
    timed = F.when(F.col("at_ms").isNotNull(), F.col("at_ms" if by_time else "seq"))
    whole = placed.groupBy(*KEY).agg(
        F.max("machine").alias("machine"), F.min_by("at_ms", timed).alias("started_ms"), F.max_by("at_ms", timed).alias("ended_ms"),
        F.count_if("starts").alias("iterations"), F.count("tok").alias("model_calls"), F.count("tool").alias("tool_calls"), F.count_if("compaction").alias("compactions"), F.count("*").alias("event_count"),
        F.array_sort(F.collect_set(F.when(F.col("tok").isNotNull(), F.col("model")))).alias("models"), *saturated(),
    )
    conversations = with_totals(whole).withColumn("duration_ms", interval_ms(F.col("started_ms"), F.col("ended_ms")))
    ending = F.when(F.coalesce("touches", F.col("ends").isNotNull()) & F.col("at_ms").isNotNull(), F.col("seq"))
    turns = placed.where("turn_no > 0").groupBy(*KEY, "turn_no").agg(
        F.max(F.when(F.col("starts"), F.col("turn_key"))).alias("turn_key"), F.max(F.when(F.col("starts"), F.col("at_ms"))).alias("started_ms"), F.max(F.when(F.col("starts"), F.col("effort"))).alias("effort"),
        F.collect_set(F.when(F.col("tok").isNotNull() & ~F.coalesce("aside", F.lit(False)), F.coalesce("model", F.lit("unknown")))).alias("own_models"),
        (F.min_by if first_end else F.max_by)("at_ms", ending).alias("own_end"), F.max_by("ends", F.when(F.col("ends").isNotNull(), F.col("seq"))).alias("said"),
        F.count("tok").alias("model_calls"), F.count("tool").alias("tool_calls"), *saturated(),
    )
    w = Window.partitionBy(*KEY).orderBy("turn_no")
    turns = turns.withColumns({"next_start": F.lead("started_ms").over(w), "next_no": F.lead("turn_no").over(w)}).join(whole.select(*KEY, F.col("ended_ms").alias("last_ms")), KEY)
    closed = F.col("next_no").isNotNull() & F.lit(next_closes)
    turns = turns.withColumns({
        "status": F.when(closed, "completed").otherwise(F.coalesce("said", F.lit("in-progress"))),
        "ended_ms": F.coalesce("own_end", F.when(F.col("next_no").isNotNull(), F.col("next_start")).otherwise(F.col("last_ms"))),
    })
    turns = with_totals(turns.withColumn("duration_ms", interval_ms(F.col("started_ms"), F.col("ended_ms")))).drop("own_end", "said", "next_start", "next_no", "last_ms")
    in_turn = F.when(F.col("turn_no") > 0, F.col("turn_no")).alias("turn_no")
    number = lambda: F.row_number().over(Window.partitionBy(*KEY).orderBy("seq"))
    calls = with_totals(placed.where("tok IS NOT NULL").withColumn("sequence", number()).select(*KEY, in_turn, "sequence", F.col("at_ms").alias("timestamp_ms"), F.coalesce("model", F.lit("unknown")).alias("model"), "tok.*"))
    tools = placed.where("tool IS NOT NULL").withColumn("sequence", number()).select(*KEY, in_turn, "sequence", F.col("at_ms").alias("timestamp_ms"), "tool")
    samples = placed.where("sample_window > 0").withColumn("sequence", number()).select(*KEY, in_turn, "sequence", F.col("at_ms").alias("timestamp_ms"), F.greatest("sample_in", F.lit(0)).alias("input_tokens"), F.col("sample_window").alias("window_tokens"))
    compactions = placed.where("compaction").withColumn("sequence", number()).select(*KEY, in_turn, "sequence", F.col("at_ms").alias("timestamp_ms"))
    settings = turns.select(*KEY, "turn_no", F.when(F.size("own_models") == 1, F.col("own_models")[0]).alias("model"), "effort")
    return Bundle(conversations, turns.drop("own_models", "effort"), calls, tools, samples, compactions, settings)
