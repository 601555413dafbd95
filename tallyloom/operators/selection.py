"""Server-side selection of complete conversation graphs by time window and filters.

Windows are half-open in epoch milliseconds; None leaves an end open.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import DAY_MS


def parse_bound(text: str, end: bool = False) -> int:
    """A date is UTC midnight, as an end the next one; a timestamp needs a zone."""
    try:
        day = dt.date.fromisoformat(text)
        return int(dt.datetime(day.year, day.month, day.day, tzinfo=dt.UTC).timestamp()) * 1000 + (DAY_MS if end else 0)
    except ValueError:
        at = dt.datetime.fromisoformat(text)
        if at.tzinfo is None:
            raise ValueError("a timestamp needs a zone") from None
        return (at - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(milliseconds=1)


@dataclass(frozen=True)
class Window:
    since: int | None = None
    until: int | None = None

    @staticmethod
    def parse(since: str | None, until: str | None) -> Window:
        w = Window(since and parse_bound(since), until and parse_bound(until, end=True))
        if w.since is not None and w.until is not None and w.since >= w.until:
            raise ValueError("since must be before until")
        return w

    @property
    def open(self) -> bool:
        return self.since is None and self.until is None


@dataclass(frozen=True)
class Filters:
    providers: tuple[str, ...] = ()
    machines: tuple[str, ...] = ()
    projects: tuple[str, ...] = ()
    models: tuple[str, ...] = ()


def overlaps(w: Window, start: str = "started_ms", end: str = "ended_ms") -> Column:
    """Conversations that overlap the window; a missing end or start is taken as the other, and one without times is never selected in a bounded window."""
    s, e = F.col(start), F.col(end)
    ok = F.lit(True) if w.open else s.isNotNull() | e.isNotNull()
    if w.since is not None:
        ok &= (e >= w.since) | (e.isNull() & (s >= w.since))
    if w.until is not None:
        ok &= (s < w.until) | (s.isNull() & (e < w.until))
    return F.coalesce(ok, F.lit(False))


def conversations(g, w: Window = Window(), f: Filters = Filters()) -> DataFrame:
    """The selected conversations. A model is matched by the summary, by any call or by any setting."""
    found = g.conversations
    if not w.open:
        found = found.where(overlaps(w))
    for names, column in ((f.providers, "provider"), (f.machines, "machine"), (f.projects, "project")):
        if names:
            found = found.where(F.col(column).isin(*names))
    if f.models:
        wanted = F.array(*[F.lit(m) for m in f.models])
        by_child = g.calls.where(F.col("model").isin(*f.models)).select("conversation_id").union(g.settings.where(F.col("model").isin(*f.models)).select("conversation_id")).distinct()
        found = found.join(by_child.withColumn("__child", F.lit(True)), "conversation_id", "left").where(F.arrays_overlap("models", wanted) | F.col("__child")).drop("__child")
    return found


def children(child: DataFrame, selected: DataFrame) -> DataFrame:
    """All rows of the selected conversations, whatever their own times."""
    return child.join(selected.select("conversation_id"), "conversation_id", "left_semi")


def edges(subagents: DataFrame, selected: DataFrame) -> DataFrame:
    """Delegation edges with either end selected: two semi-joins, since one join on either key would be a nested loop."""
    ids = selected.select("conversation_id")
    return subagents.join(ids, F.col("parent_id") == F.col("conversation_id"), "left_semi").union(subagents.join(ids, F.col("child_id") == F.col("conversation_id"), "left_semi")).distinct()


def edges_in_scope(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges (provider, machine, parent_id, child_id, ...) with either end selected in their own provider and machine: two semi-joins and a union."""
    scope = selected.select("provider", "machine", F.col("conversation_id").alias("__id"))
    ends = [edges.withColumn("__id", F.col(end)).join(scope, ["provider", "machine", "__id"], "left_semi").select(edges.columns) for end in ("parent_id", "child_id")]
    return ends[0].union(ends[1]).distinct()


def day_window(w: Window) -> Window:
    """A window that tells no more than days: from the midnight before its start to the one after its end, unless it ends at one."""
    return Window(None if w.since is None else w.since // DAY_MS * DAY_MS, None if w.until is None else -(-w.until // DAY_MS) * DAY_MS)


def metadata(w: Window, day_precision: bool = False) -> dict[str, str | None]:
    """The ends of a window as canonical times of UTC, to days where a report must tell no more; None for an open end."""
    told = day_window(w) if day_precision else w
    text = lambda ms: None if ms is None else dt.datetime.fromtimestamp(ms / 1000, dt.UTC).isoformat(timespec="microseconds")
    return {"since": text(told.since), "until": text(told.until)}


def with_window(report: DataFrame, w: Window, day_precision: bool = False) -> DataFrame:
    """A report with its window in window_since and window_until."""
    return report.withColumns({f"window_{end}": F.lit(at).cast("string") for end, at in metadata(w, day_precision).items()})


def ingestion_runs(runs: DataFrame, w: Window = Window(), f: Filters = Filters()) -> DataFrame:
    """Runs in the window; only the provider filter holds for them."""
    if w.since is not None:
        runs = runs.where(F.col("ingested_ms") >= w.since)
    if w.until is not None:
        runs = runs.where(F.col("ingested_ms") < w.until)
    return runs.where(F.col("provider").isin(*f.providers)) if f.providers else runs


def estimate(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and bytes of text and integer columns of each table, as one union."""
    out = None
    for name, df in tables.items():
        width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c, t in df.dtypes if t in ("string", "bigint", "int")), F.lit(0))
        one = df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(width), F.lit(0)).cast("bigint").alias("n_bytes")).select(F.lit(name).alias("table_name"), "n_rows", "n_bytes")
        out = one if out is None else out.unionByName(one)
    return out


def filter_options(selected: DataFrame) -> DataFrame:
    """Distinct values that filters may take: kind and value."""
    kinds = [selected.select(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("provider", "machine", "project")]
    kinds.append(selected.select(F.lit("model").alias("kind"), F.explode("models").alias("value")))
    out = kinds[0]
    for k in kinds[1:]:
        out = out.union(k)
    return out.distinct()


SORTS = ("started_ms", "ended_ms", "provider", "machine", "project", "model_calls", "conversation_id")


def listed(selected: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Conversations in the order of a column, then of their id in the same direction; nulls are last when ascending and first when descending."""
    if by not in SORTS:
        raise ValueError(f"can't sort by {by}")
    order = [F.desc_nulls_first(by), F.desc("conversation_id")] if descending else [F.asc_nulls_last(by), F.asc("conversation_id")]
    return selected.orderBy(*order)


def page(selected: DataFrame, by: str, descending: bool, number: int, size: int = 200) -> DataFrame:
    """One page of listed(), counted from 0. Only number + 1 pages are kept by the sort, not the whole selection."""
    if size > 200:
        raise ValueError("a page has 200 rows at most")
    return listed(selected, by, descending).offset(number * size).limit(size)
