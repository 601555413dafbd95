"""All queries over the usage graph, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import calendars, folds, merge, metrics, privacy, records, selection, slices
from . import log_catalog
from .derive import Graph, sql

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: The window and range of the queries: June 1997, and the year up to it.
SINCE, UNTIL = selection.parse_bound("1997-06-01"), selection.parse_bound("1997-06-30", end=True)
WINDOW = selection.Window(SINCE, UNTIL)
YEAR = slices.Range(UNTIL - 365 * X.DAY_MS, UNTIL - 1)
MODEL = "Brand#11"


def query(text: str, name: str | None = None):
    """Registers a function of a graph as a query, with its SQL."""

    def add(f):
        key = name or f.__name__
        _QUERIES[key] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        _SQL[key] = text
        return f

    return add


#: SQL that several queries share.
OVERLAP = f"(started_ms IS NOT NULL OR ended_ms IS NOT NULL) AND (ended_ms >= {SINCE} OR (ended_ms IS NULL AND started_ms >= {SINCE})) AND (started_ms < {UNTIL} OR (started_ms IS NULL AND ended_ms < {UNTIL}))"
SELECTED = {"sel": f"SELECT * FROM conversations WHERE {OVERLAP}"}
_S, _E = YEAR.start, YEAR.end


def _between(c: str) -> str:
    return f"{c} BETWEEN {_S} AND {_E}"


def slice_sql(model: str | None = None) -> dict[str, str]:
    """The nine selections of slices.select() over YEAR."""
    over = f"(started_ms IS NOT NULL OR ended_ms IS NOT NULL) AND coalesce(ended_ms >= {_S}, true) AND coalesce(started_ms <= {_E}, true)"
    whole = "semantics IN ('conversation-aggregate', 'context-snapshot')"
    has = f"list_contains(models, '{model}')" if model else "true"
    of = f"model = '{model}'" if model else "true"
    turn = "(SELECT conversation_id, turn_no FROM s_turns)"
    lim = f" AND (conversation_id, turn_no) IN {turn}" if model else ""
    base = "conversation_id IN (SELECT conversation_id FROM s_base)"
    return {
        "s_base": f"SELECT * FROM conversations WHERE {has}",
        "s_calls0": f"SELECT c.*, b.provider, b.semantics FROM calls c JOIN s_base b USING (conversation_id) WHERE {of} AND CASE WHEN {whole} THEN {over} ELSE {_between('timestamp_ms')} END",
        "s_turns": f"SELECT * FROM turns WHERE {base} AND {_between('started_ms')}" + (" AND (conversation_id, turn_no) IN (SELECT conversation_id, turn_no FROM s_calls0)" if model else ""),
        "s_calls": f"SELECT * FROM s_calls0 WHERE {whole} OR (conversation_id, turn_no) IN {turn}",
        "s_tools": f"SELECT * FROM tools WHERE {base} AND {_between('timestamp_ms')}{lim}",
        "s_samples": f"SELECT * FROM samples WHERE {base} AND {_between('timestamp_ms')}{lim}",
        "s_compactions": f"SELECT * FROM compactions WHERE {base} AND {_between('timestamp_ms')}",
        "s_work": f"SELECT * FROM work WHERE {base} AND {_between('started_ms')}{lim}",
        "s_settings": f"SELECT * FROM settings WHERE {base} AND (conversation_id, turn_no) IN {turn}",
        "s_conversations": f"SELECT * FROM s_base WHERE ({over} OR conversation_id IN (SELECT conversation_id FROM s_turns UNION SELECT conversation_id FROM s_calls UNION SELECT conversation_id FROM s_tools))" + (" AND conversation_id IN (SELECT conversation_id FROM s_calls)" if model else ""),
        "s_subagents": f"SELECT * FROM subagents WHERE parent_id IN (SELECT conversation_id FROM s_conversations) AND {_between('created_ms')}",
        "semantic": f"SELECT * FROM s_calls WHERE {whole} OR (semantics = 'additive' AND (conversation_id, turn_no) IN (SELECT conversation_id, turn_no FROM s_turns WHERE status IN ('completed', 'aborted')))",
    }


def year(g: Graph) -> slices.Slice:
    return slices.select(g, YEAR)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers_overview(Graph(spark, sf_dir))


@query(sql(f"""SELECT c.provider, count(*) AS closed_turns, CAST(sum(t.total_tokens) AS BIGINT) AS tokens, round(quantile_cont(t.duration_ms, 0.5), 3) AS median_duration
    FROM turns t JOIN conversations c USING (conversation_id) WHERE status IN ('completed', 'aborted') GROUP BY 1"""))
def providers_overview(g: Graph) -> DataFrame:
    """Closed turns, tokens and median duration by provider."""
    turns = g.turns.where(slices.closed()).join(g.conversations.select("conversation_id", "provider"), "conversation_id")
    return turns.groupBy("provider").agg(F.count("*").alias("closed_turns"), F.sum("total_tokens").alias("tokens"), metrics.percentile("duration_ms", 0.5).alias("median_duration"))


# Selection


@query(sql(f"SELECT conversation_id, provider, started_ms, ended_ms FROM conversations WHERE {OVERLAP}"))
def window_overlap_conversations(g):
    return selection.conversations(g, WINDOW).select("conversation_id", "provider", "started_ms", "ended_ms")


@query(sql(f"SELECT conversation_id, started_ms, ended_ms FROM conversations WHERE (started_ms IS NOT NULL OR ended_ms IS NOT NULL) AND coalesce(ended_ms >= {_S}, true) AND coalesce(started_ms <= {_E}, true)"))
def window_open_ended_client(g):
    return g.conversations.where(slices.overlaps(YEAR)).select("conversation_id", "started_ms", "ended_ms")


@query(sql("SELECT conversation_id, provider, machine, project FROM conversations WHERE provider IN ('codex', 'crush') AND machine IN ('NATION_1', 'NATION_2', 'NATION_3') AND project IN ('BUILDING', 'MACHINERY')"))
def filter_in_lists(g):
    return selection.conversations(g, f=selection.Filters(("codex", "crush"), ("NATION_1", "NATION_2", "NATION_3"), ("BUILDING", "MACHINERY"))).select("conversation_id", "provider", "machine", "project")


@query(sql(f"SELECT conversation_id, array_to_string(models, ',') AS models FROM conversations WHERE list_contains(models, '{MODEL}') OR conversation_id IN (SELECT conversation_id FROM calls WHERE model = '{MODEL}') OR conversation_id IN (SELECT conversation_id FROM settings WHERE model = '{MODEL}')"))
def filter_model_any_source(g):
    return selection.conversations(g, f=selection.Filters(models=(MODEL,))).select("conversation_id", F.array_join("models", ",").alias("models"))


@query(sql("SELECT c.conversation_id, c.turn_no, c.sequence, c.total_tokens FROM calls c SEMI JOIN sel USING (conversation_id)", **SELECTED))
def graph_children_complete(g):
    return selection.children(g.calls, selection.conversations(g, WINDOW)).select("conversation_id", "turn_no", "sequence", "total_tokens")


@query(sql("SELECT * FROM subagents WHERE parent_id IN (SELECT conversation_id FROM sel) OR child_id IN (SELECT conversation_id FROM sel)", **SELECTED))
def subagent_either_endpoint(g):
    return selection.edges(g.subagents, selection.conversations(g, WINDOW))


@query(sql(f"SELECT * FROM runs WHERE ingested_ms >= {_S} AND ingested_ms < {UNTIL} AND provider = 'codex'"))
def ingestion_runs_window(g):
    return selection.ingestion_runs(g.runs, selection.Window(_S, UNTIL), selection.Filters(("codex",), ("ignored",)))


@query(sql("""SELECT 'calls' AS table_name, count(*) AS n_rows, CAST(sum(coalesce(strlen(CAST(conversation_id AS VARCHAR)), 0) + coalesce(strlen(model), 0) + coalesce(strlen(CAST(timestamp_ms AS VARCHAR)), 0)) AS BIGINT) AS n_bytes FROM calls
    UNION ALL SELECT 'settings', count(*), CAST(sum(strlen(CAST(conversation_id AS VARCHAR)) + strlen(model) + strlen(effort) + strlen(mode)) AS BIGINT) FROM settings
    UNION ALL SELECT 'runs', count(*), CAST(sum(strlen(provider) + strlen(CAST(month AS VARCHAR)) + strlen(CAST(received AS VARCHAR))) AS BIGINT) FROM runs"""))
def report_estimate_union(g):
    return selection.estimate({"calls": g.calls.select("conversation_id", "model", "timestamp_ms"), "settings": g.settings.select("conversation_id", "model", "effort", "mode"), "runs": g.runs.select("provider", "month", "received")})


@query(sql("SELECT 'provider' AS kind, provider AS value FROM sel UNION SELECT 'machine', machine FROM sel UNION SELECT 'project', project FROM sel UNION SELECT 'model', unnest(models) FROM sel", **SELECTED))
def filter_options_exploded(g):
    return selection.filter_options(selection.conversations(g, WINDOW))


def _counts(s: slices.Slice) -> DataFrame:
    out = None
    for name in ("conversations", "turns", "calls", "tools", "work", "samples", "settings", "compactions", "subagents"):
        one = getattr(s, name).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("section"), "n_rows")
        out = one if out is None else out.union(one)
    return out


_SECTIONS = " UNION ALL ".join(f"SELECT '{n}' AS section, count(*) AS n_rows FROM s_{n}" for n in ("conversations", "turns", "calls", "tools", "work", "samples", "settings", "compactions", "subagents"))


@query(sql(_SECTIONS, **slice_sql()))
def slice_sections(g):
    return _counts(year(g))


@query(sql(_SECTIONS, **slice_sql(MODEL)))
def slice_with_model_filter(g):
    return _counts(slices.select(g, YEAR, model=MODEL))


@query(sql("SELECT provider, semantics, count(*) AS calls, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM semantic GROUP BY ALL", **slice_sql()))
def semantic_token_calls(g):
    return slices.semantic_calls(year(g)).groupBy("provider", "semantics").agg(F.count("*").alias("calls"), F.sum("total_tokens").alias("tokens"))


# Metrics

_CLOSED = "status IN ('completed', 'aborted')"
_ISLANDS = {
    "m_turns": f"SELECT t.*, c.machine, c.semantics FROM s_turns t LEFT JOIN s_conversations c USING (conversation_id)",
    "m_mark": f"SELECT *, CASE WHEN started_ms <= max(ended_ms) OVER (PARTITION BY machine ORDER BY started_ms, ended_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM m_turns WHERE {_CLOSED} AND ended_ms IS NOT NULL",
    "m_island": "SELECT machine, sum(fresh) OVER (PARTITION BY machine ORDER BY started_ms, ended_ms ROWS UNBOUNDED PRECEDING) AS island, started_ms, ended_ms FROM m_mark",
    "m_active": "SELECT machine, CAST(sum(length_ms) AS BIGINT) AS active_ms FROM (SELECT machine, island, max(ended_ms) - min(started_ms) AS length_ms FROM m_island GROUP BY ALL) GROUP BY 1",
}


def _spread_sql(x: str, name: str) -> str:
    return ", ".join(f"round(quantile_cont({x}, {p}), 3) AS {name}_p{round(100 * p)}" for p in (0.5, 0.75, 0.95))


@query(sql(f"""SELECT turns, completed, aborted, tokens, tokens_per_turn_p50, tokens_per_turn_p75, tokens_per_turn_p95, tools_per_turn_p50, tools_per_turn_p75, tools_per_turn_p95, duration_p50, duration_p75, duration_p95, ttft_p50, ttft_p75, ttft_p95,
    cache_rate, round(CASE WHEN completed + aborted = 0 THEN 0 ELSE 100.0 * aborted / (completed + aborted) END, 3) AS abort_rate, reasoning_share, active_ms,
    round(CASE WHEN active_ms = 0 THEN 0 ELSE (completed + aborted) * CAST(3600000 AS DOUBLE) / active_ms END, 3) AS throughput, pressure_p50, pressure_p95, active_days
    FROM (SELECT count(*) AS turns, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'aborted') AS aborted,
        {_spread_sql(f"CASE WHEN {_CLOSED} AND semantics = 'additive' THEN total_tokens END", 'tokens_per_turn')}, {_spread_sql(f"CASE WHEN {_CLOSED} THEN tool_calls END", 'tools_per_turn')},
        {_spread_sql(f"CASE WHEN {_CLOSED} THEN duration_ms END", 'duration')}, {_spread_sql(f"CASE WHEN {_CLOSED} THEN ttft_ms END", 'ttft')}, count(DISTINCT started_ms // 86400000) AS active_days FROM m_turns),
    (SELECT CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens, round(CASE WHEN coalesce(sum(input_tokens), 0) = 0 THEN 0 ELSE 100.0 * sum(cached_input_tokens) / sum(input_tokens) END, 3) AS cache_rate, round(CASE WHEN coalesce(sum(output_tokens), 0) = 0 THEN 0 ELSE 100.0 * sum(reasoning_output_tokens) / sum(output_tokens) END, 3) AS reasoning_share FROM semantic),
    (SELECT CAST(coalesce(sum(active_ms), 0) AS BIGINT) AS active_ms FROM m_active),
    (SELECT round(quantile_cont(100.0 * input_tokens / CAST(window_tokens AS DOUBLE), 0.5), 3) AS pressure_p50, round(quantile_cont(100.0 * input_tokens / CAST(window_tokens AS DOUBLE), 0.95), 3) AS pressure_p95 FROM s_samples)""", **slice_sql(), **_ISLANDS))
def headline_metrics(g):
    return metrics.headline(year(g))


@query(sql(f"SELECT provider, {_spread_sql('total_tokens', 'tokens')}, {_spread_sql('tool_calls', 'tools')} FROM turns JOIN conversations USING (conversation_id) WHERE {_CLOSED} GROUP BY 1".replace("total_tokens", "turns.total_tokens")))
def percentiles_closed_turns(g):
    turns = g.turns.where(slices.closed()).join(g.conversations.select("conversation_id", "provider"), "conversation_id")
    return turns.groupBy("provider").agg(*metrics.spread("total_tokens", "tokens"), *metrics.spread("tool_calls", "tools"))


@query(sql("SELECT machine, count(DISTINCT t.started_ms // 86400000) AS active_days, CAST(make_date(CAST(min(t.started_ms // 86400000) AS INT)) AS VARCHAR) AS first_day FROM turns t JOIN conversations USING (conversation_id) GROUP BY 1"))
def active_days(g):
    turns = g.turns.join(g.conversations.select("conversation_id", "machine"), "conversation_id")
    return turns.groupBy("machine").agg(F.count_distinct(F.floor(F.col("started_ms") / X.DAY_MS)).alias("active_days"), X.day(F.min("started_ms")).alias("first_day"))


@query(sql("SELECT machine, active_ms FROM m_active", **slice_sql(), **_ISLANDS))
def active_time_merge(g):
    s = year(g)
    return metrics.active_time(s.turns.where(slices.closed()).join(s.conversations.select("conversation_id", "machine"), "conversation_id", "left"), "machine")


@query(sql(f"SELECT machine, CAST(sum(duration_ms) AS BIGINT) AS active_ms FROM m_turns WHERE {_CLOSED} GROUP BY 1", **slice_sql(), **_ISLANDS))
def active_time_share_safe(g):
    s = year(g)
    return metrics.active_time(s.turns.where(slices.closed()).join(s.conversations.select("conversation_id", "machine"), "conversation_id", "left"), "machine", share_safe=True)


def _peak_sql(where: str) -> str:
    return f"""SELECT machine, CAST(greatest(max(running), 0) AS BIGINT) AS peak FROM (SELECT machine, sum(delta) OVER (PARTITION BY machine ORDER BY tm, delta ROWS UNBOUNDED PRECEDING) AS running
    FROM (SELECT machine, started_ms AS tm, 1 AS delta FROM m_turns WHERE {where} UNION ALL SELECT machine, ended_ms, -1 FROM m_turns WHERE {where})) GROUP BY 1"""


@query(sql(_peak_sql(f"ended_ms IS NOT NULL AND {_CLOSED}"), **slice_sql(), **_ISLANDS))
def peak_concurrency(g):
    s = year(g)
    return metrics.peak_concurrency(s.turns.where(slices.closed()).join(s.conversations.select("conversation_id", "machine"), "conversation_id", "left"), "machine")


@query(sql(_peak_sql("ended_ms IS NOT NULL"), **slice_sql(), **_ISLANDS))
def peak_concurrency_all_turns(g):
    s = year(g)
    return metrics.peak_concurrency(s.turns.join(s.conversations.select("conversation_id", "machine"), "conversation_id", "left"), "machine")


_COHORT = {
    "project": "coalesce(nullif(project, ''), 'unknown')",
    "model": "coalesce(g.model, nullif(array_to_string(models, ', '), ''), 'unknown')",
    "effort": "coalesce(g.effort, 'unknown')",
    "mode": "coalesce(g.mode, 'unknown')",
    "delegation": "CASE WHEN t.conversation_id IN (SELECT parent_id FROM s_subagents) THEN 'delegated' ELSE 'not delegated' END",
    "compaction": "CASE WHEN t.conversation_id IN (SELECT conversation_id FROM s_compactions) THEN 'compacted' ELSE 'not compacted' END",
}


def _cohort_sql(by: str, having: str = "true") -> str:
    return sql(f"""SELECT c.cohort, turns, median_duration, median_tokens, mean_tools, abort_rate, pressure_p95 FROM
    (SELECT cohort, count(*) AS turns, round(quantile_cont(duration_ms, 0.5), 3) AS median_duration, round(quantile_cont(total_tokens, 0.5), 3) AS median_tokens, round(avg(tool_calls), 3) AS mean_tools, round(100.0 * count(*) FILTER (status = 'aborted') / count(*), 3) AS abort_rate FROM c_turns GROUP BY 1) c
    LEFT JOIN (SELECT cohort, round(quantile_cont(100.0 * s.input_tokens / CAST(window_tokens AS DOUBLE), 0.95), 3) AS pressure_p95 FROM s_samples s JOIN c_turns USING (conversation_id, turn_no) GROUP BY 1) p USING (cohort) WHERE {having}""",
    **slice_sql(), c_turns=f"SELECT t.*, {_COHORT[by]} AS cohort FROM s_turns t JOIN s_conversations s USING (conversation_id) LEFT JOIN settings g ON g.conversation_id = t.conversation_id AND g.turn_no = t.turn_no WHERE {_CLOSED}")


for _by in metrics.COHORTS:
    query(_cohort_sql(_by), f"cohort_{_by}")(lambda g, by=_by: metrics.cohorts(year(g), by, g.settings))


@query(_cohort_sql("model", "turns >= 5"))
def cohort_k_anonymous(g):
    return metrics.cohorts(year(g), "model", g.settings, share_safe=True)


def _rank_sql(source: str, label: str, value: str, **more: str) -> str:
    return sql(f"SELECT {label} AS label, CAST({value} AS BIGINT) AS value FROM {source} GROUP BY 1 ORDER BY value DESC, label LIMIT 10", **more)


@query(_rank_sql("semantic", "model", "sum(total_tokens)", **slice_sql()))
def rank_models(g):
    return metrics.rank(slices.semantic_calls(year(g)), "model", F.col("total_tokens"))


@query(_rank_sql("semantic", "provider", "sum(total_tokens)", **slice_sql()))
def rank_providers(g):
    return metrics.rank(slices.semantic_calls(year(g)), "provider", F.col("total_tokens"))


@query(_rank_sql("semantic JOIN s_conversations USING (conversation_id)", "project", "sum(total_tokens)", **slice_sql()))
def rank_projects(g):
    s = year(g)
    return metrics.rank(slices.semantic_calls(s).join(s.conversations.select("conversation_id", "project"), "conversation_id"), "project", F.col("total_tokens"))


@query(_rank_sql("s_tools", "tool", "count(*)", **slice_sql()))
def rank_tools(g):
    return metrics.rank(year(g).tools, "tool", F.lit(1))


@query(sql("""SELECT 'Input' AS part, CAST(sum(uncached_input_tokens + cache_write_input_tokens) AS BIGINT) AS tokens FROM semantic UNION ALL SELECT 'Cache', CAST(sum(cached_input_tokens) AS BIGINT) FROM semantic
    UNION ALL SELECT 'Output', CAST(sum(visible_output_tokens) AS BIGINT) FROM semantic UNION ALL SELECT 'Reasoning', CAST(sum(reasoning_output_tokens) AS BIGINT) FROM semantic""", **slice_sql()))
def token_composition(g):
    return metrics.composition(year(g))


# Calendars

_LAST = _E // X.DAY_MS
_SATURDAY = _LAST + (2 - _LAST) % 7
_CALENDAR = {
    "cal": f"SELECT CAST(range AS BIGINT) AS day, range BETWEEN {_S // X.DAY_MS} AND {_LAST} AS observed FROM range({_SATURDAY - 363}, {_SATURDAY + 1})",
    "act": """SELECT day, observed, CASE WHEN observed THEN coalesce(c.n, 0) END AS conversations, CASE WHEN observed THEN coalesce(t.n, 0) END AS turns, CASE WHEN observed THEN coalesce(t.d, 0) END AS duration_ms, CASE WHEN observed THEN coalesce(k.n, 0) END AS tokens FROM cal
        LEFT JOIN (SELECT started_ms // 86400000 AS day, count(*) AS n FROM s_conversations GROUP BY 1) c USING (day) LEFT JOIN (SELECT started_ms // 86400000 AS day, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS d FROM s_turns GROUP BY 1) t USING (day)
        LEFT JOIN (SELECT timestamp_ms // 86400000 AS day, CAST(sum(total_tokens) AS BIGINT) AS n FROM semantic GROUP BY 1) k USING (day)""",
}


def _calendar(g: Graph) -> DataFrame:
    return calendars.days(g.spark, YEAR.end, YEAR.start)


@query(sql("SELECT CAST(make_date(CAST(day AS INT)) AS VARCHAR) AS day, observed, conversations, turns, duration_ms, tokens FROM act", **slice_sql(), **_CALENDAR))
def calendar_activity(g):
    return calendars.activity(year(g), _calendar(g)).withColumn("day", X.day(F.col("day") * X.DAY_MS))


def _series_sql(by: str) -> str:
    return sql("SELECT day, CASE WHEN label IN (SELECT label FROM top) THEN label ELSE 'remainder' END AS bucket, CAST(sum(tokens) AS BIGINT) AS tokens FROM daily GROUP BY ALL", **slice_sql(), **_CALENDAR,
        daily=f"SELECT timestamp_ms // 86400000 AS day, {by} AS label, sum(total_tokens) AS tokens FROM semantic WHERE timestamp_ms IS NOT NULL AND timestamp_ms // 86400000 IN (SELECT day FROM cal WHERE observed) GROUP BY ALL", top="SELECT label FROM daily GROUP BY 1 ORDER BY sum(tokens) DESC, label LIMIT 5")


@query(_series_sql("provider"))
def token_series_by_provider(g):
    return calendars.series(year(g), _calendar(g), "provider")


@query(_series_sql("model"))
def token_series_by_model(g):
    return calendars.series(year(g), _calendar(g), "model")


_BUSY = {"busy": "SELECT day, observed, CASE WHEN turns >= 10 THEN turns ELSE 0 END AS turns FROM act", "runs_of_days": "SELECT day - row_number() OVER (ORDER BY day) AS run, day FROM busy WHERE turns > 0"}


@query(sql("SELECT coalesce(max(n), 0) AS longest, coalesce(max(CASE WHEN e = (SELECT max(day) FROM busy WHERE observed) THEN n END), 0) AS current FROM (SELECT run, count(*) AS n, max(day) AS e FROM runs_of_days GROUP BY 1)", **slice_sql(), **_CALENDAR, **_BUSY))
def streaks(g):
    """Streaks of days with ten turns or more, since every day has some at larger scales."""
    busy = calendars.activity(year(g), _calendar(g)).drop("conversations").withColumn("turns", F.when(F.col("turns") >= 10, F.col("turns")).otherwise(0))
    return calendars.streaks(busy)


@query(sql("""SELECT coalesce(max(n), 0) AS longest, coalesce(max(CASE WHEN e = (SELECT max(day) FROM act WHERE observed) THEN n END), 0) AS current
    FROM (SELECT run, count(*) AS n, max(day) AS e FROM (SELECT day, day - row_number() OVER (ORDER BY day) AS run FROM act WHERE observed AND (turns > 0 OR conversations > 0)) GROUP BY 1)""", **slice_sql(MODEL), **_CALENDAR))
def streaks_of_a_model(g):
    """Streaks of days on which a turn or a conversation of one model began."""
    return calendars.streaks(calendars.activity(slices.select(g, YEAR, model=MODEL), _calendar(g)))


@query(sql("SELECT max(CASE WHEN tokens > 0 THEN tokens END) AS peak_tokens FROM act", **slice_sql(), **_CALENDAR))
def daily_peak(g):
    return calendars.daily_peak(year(g), _calendar(g))


@query(sql("""SELECT * FROM (SELECT count(*) > 0 AS tokens, coalesce(bool_and(provider <> 'unknown'), false) AS by_provider, coalesce(bool_and(model <> 'unknown'), false) AS by_model FROM semantic WHERE timestamp_ms IS NOT NULL),
    (SELECT count(started_ms) > 0 AS turns, count(duration_ms) > 0 AS duration FROM s_turns), (SELECT count(started_ms) > 0 AS conversations FROM s_conversations)""", **slice_sql()))
def availability_flags(g):
    return calendars.availability(year(g))


@query(sql("SELECT CAST(make_date(CAST(day AS INT)) AS VARCHAR) AS day, CAST(CASE WHEN tokens IS NULL THEN -1 WHEN m <= 0 THEN 0 ELSE least(4, ceil(4.0 * tokens / m)) END AS INT) AS level FROM act, (SELECT max(tokens) AS m FROM act)", **slice_sql(), **_CALENDAR))
def heat_levels(g):
    act = calendars.activity(year(g), _calendar(g))
    return act.crossJoin(act.agg(F.max("tokens").alias("most"))).select(X.day(F.col("day") * X.DAY_MS).alias("day"), X.heat_level(F.col("tokens"), F.col("most")).alias("level"))


# Groups and shares


@query(sql("SELECT provider, status, count(*) AS turns FROM turns JOIN conversations USING (conversation_id) GROUP BY ALL"))
def turn_outcomes(g):
    return g.turns.join(g.conversations.select("conversation_id", "provider"), "conversation_id").groupBy("provider", "status").agg(F.count("*").alias("turns"))


@query(sql("SELECT kind, count(*) AS items, CAST(sum(coalesce(duration_ms, 0)) AS BIGINT) AS duration_ms FROM work GROUP BY 1"))
def work_by_kind(g):
    return g.work.groupBy("kind").agg(F.count("*").alias("items"), F.sum(F.coalesce("duration_ms", F.lit(0))).alias("duration_ms"))


_SHARE = "round(CASE WHEN {d} = 0 THEN 0 ELSE 100.0 * {n} / {d} END, 3)"


def _share(n: str, d: str) -> str:
    return _SHARE.format(n=n, d=d)


@query(sql(f"""SELECT * FROM (SELECT {_share('count(duration_ms)', 'count(*)')} AS duration_share, {_share('count(ttft_ms)', 'count(*)')} AS ttft_share, {_share('count(*) FILTER (tool_calls > 0)', 'count(*)')} AS tool_share FROM s_turns WHERE {_CLOSED}),
    (SELECT {_share("count(*) FILTER (model = 'unknown')", 'count(*)')} AS unknown_model_share, {_share('sum(unattributed_tokens)', 'sum(total_tokens)')} AS unattributed_share FROM s_calls),
    (SELECT {_share('(SELECT count(DISTINCT conversation_id) FROM s_compactions)', 'count(*)')} AS compacted_share, {_share('(SELECT count(DISTINCT parent_id) FROM s_subagents)', 'count(*)')} AS delegating_share FROM s_conversations)""", **slice_sql()))
def coverage_ratios(g):
    return metrics.coverage(year(g))


@query(sql(f"SELECT provider, {_spread_sql('100.0 * input_tokens / CAST(window_tokens AS DOUBLE)', 'pressure')} FROM samples JOIN conversations USING (conversation_id) GROUP BY 1"))
def context_pressure(g):
    return g.samples.join(g.conversations.select("conversation_id", "provider"), "conversation_id").groupBy("provider").agg(*metrics.spread(100.0 * F.col("input_tokens") / F.col("window_tokens"), "pressure"))


@query(sql("SELECT conversation_id, duration_ms AS p95 FROM (SELECT conversation_id, duration_ms, row_number() OVER (PARTITION BY conversation_id ORDER BY duration_ms) - 1 AS place, count(*) OVER (PARTITION BY conversation_id) AS n FROM turns WHERE duration_ms IS NOT NULL) WHERE place = CAST(floor((n - 1) * CAST(0.95 AS DOUBLE)) AS BIGINT)"))
def detail_p95_lower_rank(g):
    return metrics.lower_rank_p95(g.turns, "conversation_id", "duration_ms")


_PAIRS = {
    "w1": f"SELECT CAST(count(*) AS DOUBLE) AS turns, CAST(sum(total_tokens) AS DOUBLE) AS tokens, CAST(sum(duration_ms) AS DOUBLE) AS duration FROM turns WHERE started_ms BETWEEN {SINCE} AND {UNTIL - 1}",
    "w0": f"SELECT CAST(count(*) AS DOUBLE) AS turns, CAST(sum(total_tokens) AS DOUBLE) AS tokens, CAST(sum(duration_ms) AS DOUBLE) AS duration FROM turns WHERE started_ms BETWEEN {2 * SINCE - UNTIL} AND {SINCE - 1}",
}


@query(sql(" UNION ALL ".join(f"SELECT '{m}' AS metric, w1.{m} AS current, w0.{m} AS previous, round(100.0 * (w1.{m} - w0.{m}) / abs(w0.{m}), 3) AS change FROM w1, w0" for m in ("turns", "tokens", "duration")), **_PAIRS))
def compare_previous_period(g):
    def of(start, end):
        return g.turns.where(slices.in_range(F.col("started_ms"), slices.Range(start, end))).agg(F.count("*").alias("turns"), F.sum("total_tokens").alias("tokens"), F.sum("duration_ms").alias("duration"))

    return metrics.compared(of(SINCE, UNTIL - 1), of(2 * SINCE - UNTIL, SINCE - 1), ["turns", "tokens", "duration"])


# Lists and pages


def _list_sql(order: str, rest: str = "") -> str:
    return sql(f"SELECT conversation_id, ended_ms FROM sel ORDER BY {order} {rest}", **SELECTED)


@query(_list_sql("ended_ms DESC NULLS FIRST, conversation_id DESC"))
def list_conversations_desc(g):
    return selection.listed(selection.conversations(g, WINDOW), "ended_ms", True).select("conversation_id", "ended_ms")


@query(_list_sql("ended_ms ASC NULLS LAST, conversation_id ASC"))
def list_conversations_asc(g):
    return selection.listed(selection.conversations(g, WINDOW), "ended_ms").select("conversation_id", "ended_ms")


@query(sql("SELECT conversation_id, provider, started_ms FROM sel ORDER BY started_ms DESC NULLS FIRST, conversation_id DESC LIMIT 25 OFFSET 25", **SELECTED))
def page_two(g):
    return selection.page(selection.conversations(g, WINDOW), "started_ms", True, 1, 25).select("conversation_id", "provider", "started_ms")


# Privacy and export

_ALIASES = {n: f"SELECT value, '{n}-' || row_number() OVER (ORDER BY value) AS alias FROM (SELECT DISTINCT {c} AS value FROM sel)" for n, c in (("project", "project"), ("machine", "machine"), ("model", "unnest(models)"))}


@query(sql("""SELECT conversation_id, provider, p.alias AS project, m.alias AS machine, coalesce((SELECT string_agg(alias, ',' ORDER BY alias) FROM model WHERE list_contains(models, value)), '') AS models,
    started_ms // 86400000 * 86400000 AS started_ms, ended_ms // 86400000 * 86400000 AS ended_ms FROM sel JOIN project p ON p.value = sel.project JOIN machine m ON m.value = sel.machine""", **SELECTED, **_ALIASES))
def share_safe_dataset(g):
    return privacy.share_safe(selection.conversations(g, WINDOW)).select("conversation_id", "provider", "project", "machine", F.array_join("models", ",").alias("models"), "started_ms", "ended_ms")


@query("""SELECT c_custkey, CASE WHEN regexp_matches(t, '^[\\t\\r\\n]|^\\s*[=+@-]') THEN '''' || t ELSE t END AS cell FROM (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN '=' WHEN 1 THEN ' +' WHEN 2 THEN '-' WHEN 3 THEN '@' WHEN 4 THEN chr(9) WHEN 5 THEN 'a=' ELSE '' END || c_name AS t FROM customer)""")
def csv_neutralized(g):
    lead = F.expr("CASE c_custkey % 7 WHEN 0 THEN '=' WHEN 1 THEN ' +' WHEN 2 THEN '-' WHEN 3 THEN '@' WHEN 4 THEN '\\t' WHEN 5 THEN 'a=' ELSE '' END")
    return privacy.exported(g.table("customer").select("c_custkey", F.concat(lead, "c_name").alias("cell")))


@query(sql("SELECT conversation_id, row_number() OVER (ORDER BY conversation_id) - 1 AS local_key FROM sel", **SELECTED))
def local_keys(g):
    return privacy.with_local_keys(selection.conversations(g, WINDOW), "conversation_id", "local_key").select("conversation_id", "local_key")


@query("""SELECT tool, category, count(*) AS n FROM (SELECT tool, CASE WHEN tool IN ('exec_command', 'wait', 'write_stdin') THEN 'Shell and processes' WHEN tool IN ('apply_patch', 'view_image') THEN 'Files and workspace' WHEN tool = 'web__run' THEN 'Web'
    WHEN contains(tool, 'imagegen') THEN 'Media' WHEN starts_with(tool, 'mcp__') THEN 'Integrations' ELSE 'Other' END AS category FROM (SELECT list_extract(['exec_command', 'apply_patch', 'web__run', 'x_imagegen', 'mcp__a', 'zzz'], CAST(event_id % 6 + 1 AS INT)) AS tool FROM events)) GROUP BY ALL""")
def tool_categories(g):
    names = F.array(*[F.lit(x) for x in ("exec_command", "apply_patch", "web__run", "x_imagegen", "mcp__a", "zzz")])
    tools = g.table("events").select(F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")).alias("tool"))
    return tools.groupBy("tool", X.tool_category(F.col("tool")).alias("category")).agg(F.count("*").alias("n"))


# Folds


@query("""SELECT conv_id, turn_no, count(*) AS messages, count(*) FILTER (role = 'assistant') AS calls, CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS visible, min(turn) AS first_turn FROM
    (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn_no FROM conversations) GROUP BY 1, 2""")
def turn_segmentation(g):
    """A user's message opens a turn; an assistant's is a call of its length."""
    log = folds.segment(g.table("conversations"), ["conv_id"], ["turn"], F.col("role") == "user")
    said = F.col("role") == "assistant"
    return log.groupBy("conv_id", "turn_no").agg(F.count("*").alias("messages"), F.count_if(said).alias("calls"), F.coalesce(F.sum(F.when(said, F.length("text"))), F.lit(0)).cast("bigint").alias("visible"), F.min("turn").alias("first_turn"))


_EVENTS = {"ev": "SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_ms(ts) AS tm FROM events"}


def _events(g: Graph) -> DataFrame:
    return g.table("events").withColumns({"k": F.get_json_object("props", "$.k").cast("bigint"), "at": X.epoch_ms("ts")})


@query("WITH ev AS (" + _EVENTS["ev"] + ") SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN k END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS setting FROM ev")
def settings_carry_forward(g):
    ev = _events(g).withColumn("reported", F.when(F.col("event_type") == "signup", F.col("k")))
    return folds.carry_forward(ev, ["user_id"], ["ts", "event_id"], "reported", "setting").select("event_id", "setting")


@query("WITH ev AS (" + _EVENTS["ev"] + "), u AS (SELECT * FROM ev WHERE event_type IN ('view', 'purchase')), m AS (SELECT user_id, tm, max(event_id) AS turn FROM ev WHERE event_type = 'signup' GROUP BY ALL) SELECT u.event_id, m.turn FROM u ASOF LEFT JOIN m ON u.user_id = m.user_id AND u.tm >= m.tm")
def asof_usage_to_turn(g):
    ev = _events(g)
    usage = ev.where("event_type IN ('view', 'purchase')").select("event_id", "user_id", "at")
    marks = ev.where("event_type = 'signup'").groupBy("user_id", "at").agg(F.max("event_id").alias("turn"))
    return folds.as_of(usage, marks, ["user_id"], "at", "turn").select("event_id", "turn")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id % 2 = 1 AND (role, length(text)) NOT IN (SELECT role, length(text) FROM conversations WHERE conv_id % 2 = 0)")
def replay_antijoin(g):
    """Messages of a branch (odd conversations) that no parent (even ones) has."""
    log = g.table("conversations").withColumn("size", F.length("text"))
    return folds.without_replays(log.where("conv_id % 2 = 1"), log.where("conv_id % 2 = 0"), ["role", "size"]).select("conv_id", "turn", "role")


_COPIES = {
    "stored": "SELECT o_orderkey AS conversation_id, o_orderkey % 50 + 10 AS event_count, sha256(CAST(o_orderkey AS VARCHAR) || 'a') AS content_hash FROM orders WHERE o_orderkey % 4 <> 0",
    "incoming": "SELECT o_orderkey AS conversation_id, o_orderkey % 50 + 10 + o_orderkey % 3 - 1 AS event_count, sha256(CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey % 6 = 1 THEN 'a' ELSE 'b' END) AS content_hash FROM orders WHERE o_orderkey % 5 <> 0",
}


def _copies(g: Graph) -> tuple[DataFrame, DataFrame]:
    key = F.col("o_orderkey")
    sha = lambda x: F.sha2(F.concat(key.cast("string"), x), 256)
    a = g.table("orders").where("o_orderkey % 4 != 0").select(key.alias("conversation_id"), (key % 50 + 10).alias("event_count"), sha(F.lit("a")).alias("content_hash"))
    b = g.table("orders").where("o_orderkey % 5 != 0").select(key.alias("conversation_id"), (key % 50 + 9 + key % 3).alias("event_count"), sha(F.when(key % 6 == 1, "a").otherwise("b")).alias("content_hash"))
    return a, b


def _with(tables: dict[str, str], body: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in tables.items()) + " " + body


@query(_with(_COPIES, "SELECT conversation_id, event_count, content_hash, n - 1 AS duplicates FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY event_count DESC, content_hash DESC) AS r, count(*) OVER (PARTITION BY conversation_id) AS n FROM (SELECT * FROM stored UNION ALL SELECT * FROM incoming)) WHERE r = 1"))
def argmax_copy_dedupe(g):
    a, b = _copies(g)
    return merge.best_copy(a.unionByName(b))


_OUTCOME = "SELECT coalesce(s.conversation_id, i.conversation_id) AS conversation_id, CASE WHEN s.conversation_id IS NULL THEN 'inserted' WHEN i.conversation_id IS NULL THEN 'kept' WHEN (i.event_count, i.content_hash) > (s.event_count, s.content_hash) THEN 'replaced' WHEN (i.event_count, i.content_hash) = (s.event_count, s.content_hash) THEN 'equal' ELSE 'stale' END AS outcome FROM stored s FULL JOIN incoming i ON s.conversation_id = i.conversation_id"


@query(_with(_COPIES | {"o": _OUTCOME}, "SELECT outcome, count(*) AS conversations FROM o GROUP BY 1"))
def merge_outcomes(g):
    return merge.outcome(*_copies(g)).groupBy("outcome").agg(F.count("*").alias("conversations"))


@query(_with(_COPIES, "SELECT conversation_id, event_count, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY event_count DESC, content_hash DESC) AS r FROM (SELECT * FROM stored UNION ALL SELECT * FROM incoming)) WHERE r = 1"))
def merge_rank_upsert(g):
    return merge.merge(*_copies(g))


@query(_with(_COPIES | {"o": _OUTCOME, "ch": "SELECT l_orderkey AS conversation_id, l_linenumber, l_quantity FROM lineitem"}, "SELECT conversation_id, l_linenumber, 'old' AS side, count(*) AS n FROM ch WHERE l_linenumber % 2 = 0 AND conversation_id NOT IN (SELECT conversation_id FROM o WHERE outcome IN ('inserted', 'replaced')) GROUP BY ALL UNION ALL SELECT conversation_id, l_linenumber, 'new', count(*) FROM ch WHERE l_linenumber % 2 = 1 AND conversation_id IN (SELECT conversation_id FROM o WHERE outcome IN ('inserted', 'replaced')) GROUP BY ALL"))
def merge_children(g):
    """Children of replaced conversations all come from the incoming copy."""
    lines = g.table("lineitem").select(F.col("l_orderkey").alias("conversation_id"), "l_linenumber")
    old, new = lines.where("l_linenumber % 2 = 0").withColumn("side", F.lit("old")), lines.where("l_linenumber % 2 = 1").withColumn("side", F.lit("new"))
    return merge.merge_children(old, new, merge.outcome(*_copies(g))).groupBy("conversation_id", "l_linenumber", "side").agg(F.count("*").alias("n"))


_SCOPE = {"scoped": "SELECT o.*, c_custkey % 400 AS scope FROM o JOIN orders ON conversation_id = o_orderkey JOIN customer ON o_custkey = c_custkey"}


@query(_with(_COPIES | {"o": _OUTCOME} | _SCOPE, "SELECT scope FROM scoped GROUP BY 1 HAVING scope % 3 = 0 OR (bool_or(outcome IN ('inserted', 'replaced')) AND NOT bool_or(outcome = 'stale'))"))
def scope_freshness(g):
    scopes = g.table("orders").select(F.col("o_orderkey").alias("conversation_id"), (F.col("o_custkey") % 400).alias("scope"))
    outcomes = merge.outcome(*_copies(g)).join(scopes, "conversation_id")
    known = scopes.where("scope % 3 != 0").select("scope").distinct()
    return merge.fresh_scopes(outcomes, known, ["scope"])


_EXPIRED = f"coalesce(coalesce(ended_ms, started_ms) < {SINCE}, false)"


@query(sql(f"SELECT * FROM (SELECT count(*) FILTER ({_EXPIRED}) AS conversations FROM conversations), (SELECT count(*) FILTER (created_ms < {SINCE}) AS subagents FROM subagents), (SELECT count(*) FILTER (ingested_ms < {SINCE}) AS runs FROM runs)"))
def retention_preview(g):
    return merge.retention_preview(g.conversations, g.subagents, g.runs, SINCE)


@query(sql(f"SELECT 'conversations' AS section, count(*) AS n_rows FROM conversations WHERE NOT {_EXPIRED} UNION ALL SELECT 'turns', count(*) FROM turns WHERE conversation_id NOT IN (SELECT conversation_id FROM conversations WHERE {_EXPIRED}) UNION ALL SELECT 'calls', count(*) FROM calls WHERE conversation_id NOT IN (SELECT conversation_id FROM conversations WHERE {_EXPIRED}) UNION ALL SELECT 'subagents', count(*) FROM subagents WHERE created_ms >= {SINCE} UNION ALL SELECT 'runs', count(*) FROM runs WHERE ingested_ms >= {SINCE}"))
def retention_apply(g):
    left = merge.retention(g.conversations, {"turns": g.turns, "calls": g.calls}, g.subagents, g.runs, SINCE)
    out = None
    for name, df in left.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("section"), "n_rows")
        out = one if out is None else out.union(one)
    return out


@query(sql("""SELECT 'conversation key' AS rule, count(*) AS n_rows FROM (SELECT 1 FROM conversations GROUP BY conversation_id HAVING count(*) > 1) UNION ALL SELECT 'turn key', count(*) FROM (SELECT 1 FROM turns GROUP BY conversation_id, turn_no HAVING count(*) > 1)
    UNION ALL SELECT 'call sequence', count(*) FROM (SELECT 1 FROM bad GROUP BY conversation_id, sequence HAVING count(*) > 1) UNION ALL SELECT 'turn without conversation', count(*) FROM turns ANTI JOIN conversations USING (conversation_id)
    UNION ALL SELECT 'call without turn', count(*) FROM bad ANTI JOIN turns USING (conversation_id, turn_no) UNION ALL SELECT 'ends before start', count(*) FROM turns WHERE ended_ms < started_ms
    UNION ALL SELECT 'input sum', count(*) FROM bad WHERE input_tokens <> cached_input_tokens + cache_write_input_tokens + uncached_input_tokens UNION ALL SELECT 'output sum', count(*) FROM bad WHERE output_tokens <> reasoning_output_tokens + visible_output_tokens
    UNION ALL SELECT 'total sum', count(*) FROM bad WHERE total_tokens <> input_tokens + output_tokens + unattributed_tokens UNION ALL SELECT 'negative count', 0
    UNION ALL SELECT 'conversation ends before start', count(*) FROM conversations WHERE ended_ms < started_ms""", bad="SELECT * REPLACE (CASE WHEN conversation_id % 97 = 0 THEN sequence // 2 ELSE sequence END AS sequence, CASE WHEN conversation_id % 89 = 0 THEN turn_no + 100 ELSE turn_no END AS turn_no, CASE WHEN conversation_id % 83 = 0 THEN input_tokens + 1 ELSE input_tokens END AS input_tokens) FROM calls"))
def validate_violations(g):
    """Counts of broken rules, with some calls damaged on purpose."""
    damaged = g.calls.withColumns({"sequence": F.expr("CASE WHEN conversation_id % 97 = 0 THEN sequence div 2 ELSE sequence END"), "turn_no": F.expr("CASE WHEN conversation_id % 89 = 0 THEN turn_no + 100 ELSE turn_no END"), "input_tokens": F.expr("CASE WHEN conversation_id % 83 = 0 THEN input_tokens + 1 ELSE input_tokens END")})
    return merge.violations(g.conversations, g.turns, damaged)


@query(sql("SELECT conversation_id, sequence, CASE WHEN sequence = max(sequence) OVER (PARTITION BY conversation_id) THEN CAST(sum(total_tokens) OVER (PARTITION BY conversation_id) AS BIGINT) ELSE 0 END AS attributed FROM calls"))
def last_row_attribution(g):
    total = F.sum("total_tokens").over(W.partitionBy("conversation_id"))
    return folds.last_row_only(g.calls, ["conversation_id"], ["sequence"], total, "attributed").select("conversation_id", "sequence", "attributed")


@query(sql("SELECT o_orderkey AS conversation_id, CAST(greatest(CAST(floor(o_totalprice) AS BIGINT) - coalesce(s, 0), 0) AS BIGINT) AS residual FROM orders LEFT JOIN (SELECT conversation_id, sum(total_tokens) AS s FROM calls GROUP BY 1) ON o_orderkey = conversation_id"))
def residual_usage(g):
    total = g.table("orders").select(F.col("o_orderkey").alias("conversation_id"), F.floor("o_totalprice").cast("bigint").alias("total_tokens"))
    return folds.residual(total, g.calls, "conversation_id", "total_tokens").select("conversation_id", "residual")


@query("""SELECT c_custkey, CASE WHEN p = '/work/a/b' OR starts_with(p, '/work/a/b/') THEN 'deep' WHEN p = '/work/a' OR starts_with(p, '/work/a/') THEN 'wide' WHEN p = '/home' OR starts_with(p, '/home/') THEN 'home' ELSE 'unmapped' END AS project
    FROM (SELECT c_custkey, list_extract(['/work/a/b/c', '/work/a/bc', '/work/a', '/home/x', '/homes', '/work/a/b'], CAST(c_custkey % 6 + 1 AS INT)) AS p FROM customer)""")
def longest_prefix_project(g):
    paths = F.array(*[F.lit(x) for x in ("\\work\\a\\b\\c/", "/work/a/bc", "/work/a/", "/home/x", "/homes", "/work/a/b")])
    df = g.table("customer").select("c_custkey", F.element_at(paths, (F.col("c_custkey") % 6 + 1).cast("int")).alias("path"))
    return folds.longest_prefix(df, "path", [("/work/a", "wide"), ("/home/", "home"), ("/work/a/b", "deep"), ("/work/a/b", "later")]).select("c_custkey", "project")


_TREE = "SELECT c_custkey AS node, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent, c_nationkey AS mark FROM customer"


@query(f"WITH RECURSIVE t AS ({_TREE}), walk AS (SELECT node, parent, 0 AS depth, mark FROM t WHERE parent IS NULL UNION ALL SELECT t.node, t.parent, depth + 1, greatest(walk.mark, t.mark) FROM t JOIN walk ON t.parent = walk.node) SELECT node, depth, mark AS largest FROM walk")
def ancestor_path(g):
    """Depth and largest mark on the way to the root of a tree of parent pointers, by doubling the reach: rounds follow the logarithm of the depth, and a cycle can't run on."""
    return folds.ancestors(g.table("customer").select(F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") > 1, F.floor(F.col("c_custkey") / 2)).alias("parent"), F.col("c_nationkey").alias("mark")), rounds=6).select("node", "depth", "largest")


@query("SELECT event_type, count(*) AS n, count(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS with_k, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1")
def json_props_extract(g):
    ev = _events(g)
    return ev.groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("with_k"), F.sum("k").alias("sum_k"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))


_SESSIONS = {"ev": _EVENTS["ev"], "numbered": "SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM ev"}


@query(_with(_SESSIONS, "SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events FROM (SELECT *, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM numbered) WHERE session > 0 AND coalesce(done, 0) = 0 GROUP BY 1, 2"))
def marker_sessions(g):
    found = folds.sessions(_events(g), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "error")
    return found.groupBy("user_id", "session").agg(F.count("*").alias("events"))


@query("SELECT l_orderkey, CAST(least(sum(CAST(l_partkey AS HUGEINT) * 90000000000000), 9223372036854775807) AS BIGINT) AS tokens FROM lineitem GROUP BY 1")
def saturating_rollup(g):
    """Sums of counts stop at the largest long."""
    big = (F.col("l_partkey").cast("decimal(38,0)") * F.lit(90_000_000_000_000).cast("decimal(15,0)")).cast("decimal(38,0)")
    return g.table("lineitem").groupBy("l_orderkey").agg(F.least(F.sum(big), F.lit(X.MAX_LONG).cast("decimal(38,0)")).cast("bigint").alias("tokens"))


# Records of connectors


def _one_of(values: list[str | None], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index)


@query("SELECT list_extract(['aborted', 'in-progress', 'completed', 'failed', 'unknown', 'unknown', 'aborted'], CAST(event_id % 7 + 1 AS INT)) AS status, list_extract(['research', 'worker', 'planning', 'unspecified', 'other'], CAST(event_id % 5 + 1 AS INT)) AS role, count(*) AS n FROM events GROUP BY ALL")
def edge_states_and_roles(g):
    """States and roles of delegations under the names that logs use for them."""
    state = _one_of(["Cancelled", "IN_PROGRESS", " done ", "errored", "weird", None, "Interrupted"], (F.col("event_id") % 7 + 1).cast("int"))
    role = _one_of(["Explorer", "implementer", "PLANNER", "Unknown", "pilot"], (F.col("event_id") % 5 + 1).cast("int"))
    return g.table("events").groupBy(X.edge_status(state).alias("status"), X.agent_role(role).alias("role")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0 THEN 'failed' ELSE list_extract(['completed', 'failed', 'in-progress', 'unknown', 'unknown', 'completed'], CAST(event_id % 6 + 1 AS INT)) END AS status, count(*) AS n FROM events GROUP BY 1""")
def work_item_states(g):
    i = F.col("event_id")
    status = _one_of(["Completed", "error", "IN_PROGRESS", "paused", None, "succeeded"], (i % 6 + 1).cast("int"))
    found = X.work_status(F.when(i % 11 == 0, 2).when(i % 3 == 0, 0), F.when(i % 13 == 0, False).when(i % 4 == 0, True), F.when(i % 17 == 0, "x").when(i % 5 == 0, ""), status)
    return g.table("events").groupBy(found.alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT tool, count(*) AS n FROM (SELECT unnest(CASE event_id % 5 WHEN 0 THEN ['exec_command', 'wait'] WHEN 1 THEN ['exec'] WHEN 2 THEN ['mcp__db_query'] WHEN 3 THEN ['shell'] ELSE ['unknown'] END) AS tool FROM events) GROUP BY 1""")
def nested_tool_names(g):
    text = _one_of(["await tools.exec_command ({}); tools.nope(1); collaboration.wait(2)", "tools.nope()", "x = tools.mcp__db_query(); mytools_exec_command()", "tools.wait()", None], (F.col("event_id") % 5 + 1).cast("int"))
    outer = _one_of(["exec", "exec", "exec", "shell", "a b"], (F.col("event_id") % 5 + 1).cast("int"))
    return g.table("events").select(F.explode(X.called_tools(outer, text)).alias("tool")).groupBy("tool").agg(F.count("*").alias("n"))


@query("SELECT slug, count(*) AS n FROM (SELECT list_extract(['repo', 'my.repo', 'tool', NULL, NULL], CAST(event_id % 5 + 1 AS INT)) AS slug FROM events) GROUP BY 1")
def repository_slugs(g):
    url = _one_of(["git@host.example:team/repo.git", "https://host.example/team/my.repo/", "C:\\work\\tool", "https://host.example/a b", None], (F.col("event_id") % 5 + 1).cast("int"))
    return g.table("events").groupBy(X.repository_slug(url).alias("slug")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN p_brand WHEN p_partkey % 4 = 2 THEN p_type || '/' || p_brand ELSE p_type || '/x' END AS model, count(*) AS n FROM part GROUP BY 1")
def qualified_models(g):
    i = F.col("p_partkey") % 4
    provider = F.when(i == 1, "").when(i != 0, F.col("p_type"))
    model = F.when(i == 0, "").when(i == 3, F.concat("p_type", F.lit("/x"))).otherwise(F.col("p_brand"))
    return g.table("part").groupBy(X.qualified_model(provider, model).alias("model")).agg(F.count("*").alias("n"))


@query("SELECT metric AS id, CASE WHEN change IS NULL THEN NULL WHEN id3 = 2 THEN 'neutral' WHEN (id3 = 0 AND change > 0) OR (id3 = 1 AND change < 0) THEN 'better' ELSE 'worse' END AS style FROM (SELECT c_custkey AS metric, c_custkey % 3 AS id3, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal - 4000 END AS change FROM customer)")
def comparison_styles(g):
    change = F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") - 4000)
    style = F.when(F.col("c_custkey") % 3 == 0, X.change_style(change, "higher")).when(F.col("c_custkey") % 3 == 1, X.change_style(change, "lower")).otherwise(X.change_style(change))
    return g.table("customer").select(F.col("c_custkey").alias("id"), style.alias("style"))


@query(sql("SELECT l_orderkey AS conversation_id, l_linenumber AS turn_no, l_partkey AS part, seq FROM line QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_returnflag = 'A' DESC, qty DESC, seq DESC) = 1"))
def best_fragments(g):
    """Of several fragments of one response the finished one, then the one of most tokens, then the last."""
    df = g.lines.select(F.col("l_orderkey").alias("conversation_id"), F.col("l_linenumber").alias("turn_no"), F.col("l_partkey").alias("part"), "seq", "qty", "l_returnflag")
    return records.best_fragment(df, ["conversation_id", "turn_no"], [F.col("l_returnflag") == "A", F.col("qty"), F.col("seq")], ["part", "seq"])


@query(sql("SELECT tool, conversation_id, sequence FROM tools QUALIFY row_number() OVER (PARTITION BY tool ORDER BY conversation_id, sequence) = 1"))
def first_tool_records(g):
    return records.first_of(g.tools, ["tool"], ["conversation_id", "sequence"], ["conversation_id", "sequence"])


@query(sql("SELECT conversation_id, string_agg(model, ',' ORDER BY sequence) AS models, arg_max(timestamp_ms, sequence) FILTER (timestamp_ms IS NOT NULL) AS last_ms, max(total_tokens) AS most FROM calls GROUP BY 1"))
def merged_fragments(g):
    found = records.merged(g.calls.select("conversation_id", "sequence", "model", F.col("timestamp_ms").alias("last_ms"), F.col("total_tokens").alias("most")), ["conversation_id"], "sequence", "model", "last_ms", "most")
    return found.select("conversation_id", F.array_join("model", ",").alias("models"), "last_ms", "most")


@query(sql("""SELECT CAST(sum(n) AS BIGINT) AS parts, count(*) FILTER (n = 0) AS messages_without, max(o) AS orphans FROM (SELECT t.conversation_id, t.turn_no, count(c.turn_no) AS n FROM (SELECT * FROM turns WHERE turn_no % 4 <> 3) t LEFT JOIN (SELECT * FROM calls WHERE sequence % 2 = 0) c USING (conversation_id, turn_no) GROUP BY 1, 2),
    (SELECT count(*) AS o FROM calls c WHERE sequence % 2 = 0 AND NOT EXISTS (SELECT 1 FROM turns t WHERE turn_no % 4 <> 3 AND t.conversation_id = c.conversation_id AND t.turn_no = c.turn_no))"""))
def message_parts_and_orphans(g):
    messages, orphans = records.with_parts(g.turns.where("turn_no % 4 != 3").select("conversation_id", "turn_no"), g.calls.where("sequence % 2 = 0"), ["conversation_id", "turn_no"])
    # two frames of one row each
    return messages.agg(F.sum("n_parts").alias("parts"), F.count_if(F.col("n_parts") == 0).alias("messages_without")).crossJoin(orphans)


@query(sql("SELECT conversation_id, coalesce(tokens, 0) AS tokens, coalesce(n_tools, 0) AS n_tools FROM (SELECT conversation_id, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM calls WHERE conversation_id % 3 <> 0 GROUP BY 1) FULL JOIN (SELECT conversation_id, count(*) AS n_tools FROM tools GROUP BY 1) USING (conversation_id)"))
def usage_or_events(g):
    usage = g.calls.where("conversation_id % 3 != 0").groupBy("conversation_id").agg(F.sum("total_tokens").alias("tokens"))
    return records.either(usage, g.tools.groupBy("conversation_id").agg(F.count("*").alias("n_tools")), ["conversation_id"], ["tokens", "n_tools"])


@query(sql("""SELECT t.conversation_id, t.turn_no, e.sequence AS terminal FROM (SELECT conversation_id, turn_no, row_number() OVER (PARTITION BY conversation_id ORDER BY turn_no) AS i FROM turns WHERE status <> 'completed') t
    LEFT JOIN (SELECT conversation_id, sequence, row_number() OVER (PARTITION BY conversation_id ORDER BY sequence) AS i FROM calls WHERE sequence % 2 = 1) e ON e.conversation_id = t.conversation_id AND e.i = t.i"""))
def zipped_terminals(g):
    return records.zipped(g.turns.where("status != 'completed'").select("conversation_id", "turn_no"), g.calls.where("sequence % 2 = 1").select("conversation_id", F.col("sequence").alias("terminal")), ["conversation_id"], ["turn_no"], ["terminal"])


@query(sql("SELECT provider, machine, parent_id, child_id, 2 * p.conversation_id AS parent_key, 2 * c.conversation_id AS child_key FROM (SELECT e.parent_id, e.child_id, o.provider, o.machine FROM subagents e JOIN conversations o ON o.conversation_id = e.parent_id) e LEFT JOIN conversations p USING (provider, machine) LEFT JOIN conversations c USING (provider, machine)".replace("LEFT JOIN conversations p USING (provider, machine)", "LEFT JOIN (SELECT provider AS pp, machine AS pm, conversation_id FROM conversations) p ON pp = provider AND pm = machine AND p.conversation_id = parent_id").replace("LEFT JOIN conversations c USING (provider, machine)", "LEFT JOIN (SELECT provider AS cp, machine AS cm, conversation_id FROM conversations) c ON cp = provider AND cm = machine AND c.conversation_id = child_id")))
def edge_keys(g):
    """Edges with the keys of both ends in the parent's provider and machine."""
    edges = g.subagents.join(g.conversations.select(F.col("conversation_id").alias("parent_id"), "provider", "machine"), "parent_id").select("parent_id", "child_id", "provider", "machine")
    return records.resolved(edges, g.conversations.withColumn("key", 2 * F.col("conversation_id")), "key").select("provider", "machine", "parent_id", "child_id", "parent_key", "child_key")


@query(sql("""SELECT parent_id, child_id, created_ms FROM subagents WHERE parent_id % 3 <> 0 AND child_id % 4 <> 0
    UNION ALL SELECT parent_id, child_id, created_ms + 1 FROM subagents s WHERE child_id % 4 = 0
    UNION ALL SELECT parent_id, child_id, created_ms + 1 FROM subagents s WHERE child_id % 4 = 1 AND NOT EXISTS (SELECT 1 FROM subagents x WHERE x.parent_id % 3 <> 0 AND x.child_id = s.child_id)"""))
def edges_follow_copies(g):
    """Edges after a merge in which a quarter of the children were replaced, and for another quarter the stored copy won."""
    edges = g.subagents.select("parent_id", "child_id", "created_ms")
    outcome = edges.where("child_id % 4 IN (0, 1)").select("child_id", (F.col("child_id") % 4 == 0).alias("written")).distinct()
    return records.following_copies(edges.where("parent_id % 3 != 0"), edges.withColumn("created_ms", F.col("created_ms") + 1), outcome)


@query(sql(f"SELECT provider, CAST(sum(malformed) AS BIGINT) AS malformed, CAST(sum(received) AS BIGINT) AS received FROM runs WHERE {_between('ingested_ms')} GROUP BY 1"))
def malformed_by_provider(g):
    """Malformed and received records of the runs in a range."""
    return g.runs.where(slices.in_range(F.col("ingested_ms"), YEAR)).groupBy("provider").agg(F.sum("malformed").alias("malformed"), F.sum("received").alias("received"))


_LATEST = "SELECT max(x) AS latest_ms FROM (SELECT max(started_ms) AS x FROM conversations UNION ALL SELECT max(ended_ms) FROM conversations UNION ALL SELECT max(started_ms) FROM turns UNION ALL SELECT max(ended_ms) FROM turns UNION ALL SELECT max(timestamp_ms) FROM calls UNION ALL SELECT max(timestamp_ms) FROM tools UNION ALL SELECT max(created_ms) FROM subagents UNION ALL SELECT max(ingested_ms) FROM runs)"


@query(sql("SELECT e - 2592000000 + 1 AS start_ms, e AS end_ms, e - 2592000000 AS previous_end_ms, e - 5184000000 + 1 AS previous_start_ms FROM (SELECT (latest_ms // 86400000) * 86400000 + 86399999 AS e FROM latest)", latest=_LATEST))
def range_of_last_days(g):
    """The last 30 days that the data tell, and the 30 before them."""
    return slices.ranges(slices.observed_end(g), 30)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | log_catalog.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | log_catalog.oracle_sql()
