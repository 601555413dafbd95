"""Queries over logs: the events of each user as a connector's log, and what connectors make of such logs, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import branches, folds, groups, ingest, pages, privacy, replay, rollouts, selection, slices
from ..sources.scan import tokens
from ..sources.store import shared_dir
from ..streaming.collect import batch_receipt
from .derive import Graph, sql

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(text: str):
    """Registers a function of a graph as a query, with its SQL."""

    def add(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        _SQL[f.__name__] = text
        return f

    return add


def log(g: Graph) -> DataFrame:
    """user_id, seq (from 1), event_type, at_ms and k of all events."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return g.table("events").select("user_id", F.row_number().over(w).cast("bigint").alias("seq"), "event_type", X.epoch_ms("ts").alias("at_ms"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


_LOG = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type, epoch_ms(CAST(ts AS TIMESTAMP)) AS at_ms, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"


def log_sql(body: str, recursive: bool = False, **more: str) -> str:
    tables = {"log": _LOG} | more
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(f"{name} AS ({text})" for name, text in tables.items()) + "\n" + body


@query(log_sql("""SELECT user_id, 'm' || x AS message, list_position(final, x) AS place, (SELECT max(seq) FROM ops o WHERE o.user_id = s.user_id AND o.kind = 'write' AND o.m = x) AS last
    FROM (SELECT user_id, list AS final, unnest(list) AS x FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS r FROM step) WHERE r = 1) s""",
    recursive=True, ops="SELECT user_id, seq, k % 12 AS m, CASE WHEN event_type = 'click' THEN 'rewind' WHEN event_type = 'error' AND k % 20 = 0 THEN 'clear' ELSE 'write' END AS kind FROM log",
    step="""SELECT user_id, CAST(0 AS BIGINT) AS seq, CAST([] AS BIGINT[]) AS list FROM (SELECT DISTINCT user_id FROM ops)
        UNION ALL SELECT s.user_id, o.seq, CASE o.kind WHEN 'clear' THEN CAST([] AS BIGINT[]) WHEN 'write' THEN CASE WHEN list_contains(s.list, o.m) THEN s.list ELSE list_append(s.list, o.m) END
            ELSE list_slice(s.list, 1, coalesce(list_position(s.list, o.m), 1) - 1) END FROM step s JOIN ops o ON o.user_id = s.user_id AND o.seq = s.seq + 1"""))
def log_replay(g):
    """What each user's log ends with, clicks rewinding it to a message and some errors clearing it."""
    kind = F.when(F.col("event_type") == "click", "rewind").when((F.col("event_type") == "error") & (F.col("k") % 20 == 0), "clear").otherwise("write")
    ends = replay.replayed(log(g).select("user_id", "seq", kind.alias("kind"), F.concat(F.lit("m"), F.col("k") % 12).alias("message")), ["user_id"], "seq", "kind", "message")
    return ends.select("user_id", "message", F.row_number().over(W.partitionBy("user_id").orderBy("position")).alias("place"), "last")


#: Records of a branched log: two of three follow the record before them, others one or two further up; some tell a model or a level (that may be none).
_PARENT = "CASE WHEN seq - 1 - k % 3 * (k % 2) > 0 THEN seq - 1 - k % 3 * (k % 2) END"


@query(log_sql("SELECT n.user_id, n.seq, coalesce(own, i.model, 'unknown') AS model, level FROM n JOIN i USING (user_id, seq)", recursive=True,
    n=f"SELECT user_id, seq, {_PARENT} AS parent, CASE WHEN event_type = 'view' THEN 'm' || k % 5 END AS own, event_type = 'signup' AS tells, CASE WHEN event_type = 'signup' AND k % 4 <> 0 THEN 'l' || k % 3 END AS own_level FROM log",
    i="""SELECT user_id, seq, CAST(NULL AS VARCHAR) AS model, CAST(NULL AS VARCHAR) AS level FROM n WHERE parent IS NULL
        UNION ALL SELECT c.user_id, c.seq, coalesce(p.own, i.model), CASE WHEN p.tells THEN p.own_level ELSE i.level END FROM i JOIN n p ON p.user_id = i.user_id AND p.seq = i.seq JOIN n c ON c.user_id = i.user_id AND c.parent = i.seq"""))
def branch_inheritance(g):
    """The model and level that hold for each record of a branched log: its own, or the nearest above it."""
    rows = log(g).select("user_id", "seq", F.expr(_PARENT).alias("parent"), F.expr("CASE WHEN event_type = 'view' THEN 'm' || k % 5 END").alias("own"), F.expr("CASE WHEN event_type = 'signup' THEN named_struct('v', CASE WHEN k % 4 <> 0 THEN 'l' || k % 3 END) END").alias("told"))
    found = branches.inherited(rows.withColumn("m", F.when(F.col("own").isNotNull(), F.struct(F.col("own").alias("v")))), ["user_id"], "seq", "parent", {"m": "above", "told": "level"})
    return found.select("user_id", "seq", F.coalesce("own", "above.v", F.lit("unknown")).alias("model"), F.col("level.v").alias("level"))


_FRAGMENTS = "SELECT user_id, seq, (seq + 1) // 2 AS node, event_type, k, at_ms FROM log"


@query(log_sql("SELECT p.user_id, p.node, p.distance, CAST(f.parts AS BIGINT) AS parts, f.usage, f.model, f.at_ms FROM path p JOIN merged f USING (user_id, node)", recursive=True, f=_FRAGMENTS,
    nodes="SELECT user_id, node, arg_min(k, seq) AS k0, min(event_type = 'error') AS artifact FROM f GROUP BY ALL",
    up="SELECT user_id, node, CASE WHEN node - 1 - k0 % 3 > 0 THEN node - 1 - k0 % 3 END AS parent, artifact FROM nodes",
    merged="SELECT user_id, node, sum(k % 4) AS parts, arg_max(CASE WHEN event_type = 'purchase' THEN k END, CASE WHEN event_type = 'purchase' THEN seq END) AS usage, arg_min(CASE WHEN event_type = 'view' THEN 'm' || k % 5 END, CASE WHEN event_type = 'view' THEN seq END) AS model, max(at_ms) AS at_ms FROM f GROUP BY ALL",
    path="""SELECT user_id, max(node) AS node, CAST(0 AS BIGINT) AS distance FROM up WHERE NOT artifact GROUP BY user_id
        UNION ALL SELECT p.user_id, u.parent, p.distance + 1 FROM path p JOIN up u ON u.user_id = p.user_id AND u.node = p.node WHERE u.parent IS NOT NULL"""))
def active_branch(g):
    """Each user's active branch: from the last record that is no artifact up to the root, a record's fragments merged."""
    rows = log(g).withColumn("node", F.expr("(seq + 1) div 2"))
    merged = rows.groupBy("user_id", "node").agg(
        F.min_by("k", "seq").alias("k0"), F.min(F.col("event_type") == "error").alias("artifact"), F.sum(F.col("k") % 4).alias("parts"), F.max_by("k", F.when(F.col("event_type") == "purchase", F.col("seq"))).alias("usage"),
        F.min_by(F.concat(F.lit("m"), F.col("k") % 5), F.when(F.col("event_type") == "view", F.col("seq"))).alias("model"), F.max("at_ms").alias("at_ms"),
    ).withColumn("parent", F.expr("CASE WHEN node - 1 - k0 % 3 > 0 THEN node - 1 - k0 % 3 END"))
    leaves = merged.where("NOT artifact").groupBy("user_id").agg(F.max("node").alias("node"))
    path = branches.path_to_root(merged, leaves, ["user_id"], "node", "parent")
    return path.join(merged, ["user_id", "node"]).select("user_id", "node", "distance", "parts", "usage", "model", "at_ms")


@query(sql("SELECT member, min(other) AS \"group\" FROM reach GROUP BY 1", e="SELECT parent_id AS a, child_id AS b FROM subagents UNION SELECT child_id, parent_id FROM subagents UNION SELECT parent_id, parent_id FROM subagents UNION SELECT child_id, child_id FROM subagents",
    reach="SELECT a AS member, b AS other FROM e UNION SELECT r.member, e.b FROM reach r JOIN e ON e.a = r.other").replace("WITH ", "WITH RECURSIVE ", 1))
def transcript_groups(g):
    """Sessions that must be read together, since they are linked by delegations: each with the least of its group."""
    return groups.linked(g.subagents, "parent_id", "child_id")


@query(sql("""SELECT conversation_id, files, start // 250 AS stretch, CASE WHEN files > 250 THEN start ELSE -1 END AS own FROM (
    SELECT *, CAST(coalesce(sum(files) OVER (ORDER BY first, conversation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT conversation_id, count(*) AS files, min(uncached_input_tokens) AS first FROM calls GROUP BY 1))"""))
def batch_plan(g):
    """Batches of at most 500 records in which no conversation is split."""
    planned = groups.planned(g.calls.select("conversation_id", "uncached_input_tokens"), ["conversation_id"], ["uncached_input_tokens"], 500)
    return planned.groupBy("conversation_id", "batch").agg(F.count("*").alias("files")).select("conversation_id", "files", "batch.stretch", F.coalesce("batch.own", F.lit(-1)).alias("own"))


def rollout_events(g: Graph) -> DataFrame:
    """Each user's events as a rollout."""
    is_, k = lambda *t: F.col("event_type").isin(*t), F.col("k")
    of = lambda p, n: F.concat(F.lit(p), k % n)
    kind = F.when(is_("signup"), "start").when(is_("view"), "context").when(is_("click"), "tool").when(is_("error"), F.element_at(F.array(*[F.lit(x) for x in ("abort", "complete", "settings", "compacted")]), (k % 4 + 1).cast("int"))).when(k % 5 == 0, "item").otherwise("usage")
    name = F.when(is_("signup") & (k % 17 != 0) | is_("view") & (k % 3 != 0) | is_("error") & (k % 8 < 2) | (k % 10 == 0) & is_("purchase"), of("t", 6))
    return log(g).withColumn("kind", kind).select(
        "user_id", "seq", "at_ms", "kind", name.alias("turn_id"), (k % 10 == 0).alias("names_turn"),
        F.when(F.col("kind").isin("context", "settings") & (k % 4 != 0), of("m", 5)).alias("model"), F.when(F.col("kind").isin("context", "settings") & (k % 2 == 0), of("e", 3)).alias("effort"),
        F.when(F.col("kind").isin("context", "settings") & (k % 7 == 0), of("c", 2)).alias("mode"), F.when((F.col("kind") == "settings") & (k % 3 == 0), of("s", 2)).alias("tier"),
        F.when(F.col("kind").isin("start", "usage") & (k % 3 == 0) & (k > 0), k * 1000).alias("window"), F.when(F.col("kind") == "usage", tokens(k, k % 7, k % 3, k % 11, k % 5, 2 * k)).alias("tok"),
        F.when(F.col("kind") == "tool", F.array_repeat(F.struct(of("o", 3).alias("outer_tool"), of("x", 4).alias("tool")), (k % 2 + 1).cast("int"))).alias("tools"),
        F.when(F.col("kind").isin("complete", "abort") & (k % 9 != 0), k * 10).alias("duration_ms"), F.when(F.col("kind").isin("complete", "abort") & (k % 9 != 0), k).alias("ttft_ms"),
        F.when(F.col("kind") == "item", F.struct(of("w", 3).alias("work_kind"), F.col("at_ms").alias("started_at_ms"), (F.col("at_ms") + k - 50).alias("completed_at_ms"))).alias("item"),
    )


_UPTO = "PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND"
_TURN = "PARTITION BY user_id, own ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_ROLLOUT = {
    "e0": "SELECT *, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'context' WHEN 'click' THEN 'tool' WHEN 'error' THEN ['abort', 'complete', 'settings', 'compacted'][k % 4 + 1] ELSE CASE WHEN k % 5 = 0 THEN 'item' ELSE 'usage' END END AS kind FROM log",
    "e": """SELECT user_id, seq, at_ms, k, kind, CASE WHEN kind = 'start' AND k % 17 <> 0 OR kind = 'context' AND k % 3 <> 0 OR event_type = 'error' AND k % 8 < 2 OR event_type = 'purchase' AND k % 10 = 0 THEN 't' || k % 6 END AS turn_id,
        CASE WHEN kind IN ('context', 'settings') AND k % 4 <> 0 THEN 'm' || k % 5 END AS model, CASE WHEN kind IN ('context', 'settings') AND k % 2 = 0 THEN 'e' || k % 3 END AS effort,
        CASE WHEN kind IN ('context', 'settings') AND k % 7 = 0 THEN 'c' || k % 2 END AS mode, CASE WHEN kind = 'settings' AND k % 3 = 0 THEN 's' || k % 2 END AS tier, CASE WHEN kind IN ('start', 'usage') AND k % 3 = 0 AND k > 0 THEN k * 1000 END AS win FROM e0""",
    "a": f"""SELECT *, nullif(last_value(CASE WHEN kind = 'context' AND turn_id IS NOT NULL OR kind = 'start' THEN coalesce(turn_id, '') WHEN kind IN ('complete', 'abort') THEN '' END IGNORE NULLS) OVER ({_UPTO} CURRENT ROW), '') AS act,
        nullif(last_value(CASE WHEN kind = 'context' AND turn_id IS NOT NULL OR kind = 'start' THEN coalesce(turn_id, '') WHEN kind IN ('complete', 'abort') THEN '' END IGNORE NULLS) OVER ({_UPTO} 1 PRECEDING), '') AS act0,
        last_value(CASE WHEN kind = 'context' THEN model END IGNORE NULLS) OVER ({_UPTO} CURRENT ROW) AS model_now, last_value(CASE WHEN kind = 'settings' THEN model END IGNORE NULLS) OVER ({_UPTO} CURRENT ROW) AS d_model,
        last_value(CASE WHEN kind = 'settings' THEN effort END IGNORE NULLS) OVER ({_UPTO} CURRENT ROW) AS d_effort, last_value(CASE WHEN kind = 'settings' THEN mode END IGNORE NULLS) OVER ({_UPTO} CURRENT ROW) AS d_mode,
        last_value(CASE WHEN kind = 'settings' THEN tier END IGNORE NULLS) OVER ({_UPTO} CURRENT ROW) AS d_tier FROM e""",
    "o": "SELECT *, CASE WHEN kind IN ('complete', 'abort') THEN coalesce(turn_id, act0) WHEN kind = 'item' AND k % 10 = 0 THEN turn_id ELSE act END AS own FROM a",
    "p": f"SELECT *, CASE WHEN own IS NOT NULL THEN max(CASE WHEN kind = 'start' THEN seq END) OVER ({_TURN}) END AS start_no, kind IN ('context', 'start') AND count(*) FILTER (kind IN ('context', 'start')) OVER ({_TURN}) = 1 AS fst FROM o",
}


@query(log_sql("""SELECT t.user_id, t.turn, t.started_ms, coalesce(x.at_ms, g.log_end) AS ended_ms, coalesce(x.status, 'in-progress') AS status, x.duration_ms, x.ttft_ms, t.model_calls, CAST(t.tool_calls AS BIGINT) AS tool_calls, CAST(t.cached AS BIGINT) AS cached_input_tokens, CAST(t.total AS BIGINT) AS total_tokens
    FROM t JOIN (SELECT user_id, max(at_ms) AS log_end FROM e GROUP BY 1) g USING (user_id) LEFT JOIN x USING (user_id, turn) """, **_ROLLOUT,
    m="SELECT * FROM (SELECT *, max(start_no) OVER (PARTITION BY user_id, own) AS ls FROM p WHERE own IS NOT NULL) WHERE start_no = ls",
    t="""SELECT user_id, own AS turn, max(at_ms) FILTER (seq = ls) AS started_ms, count(*) FILTER (kind = 'usage') AS model_calls, coalesce(sum(k % 2 + 1) FILTER (kind = 'tool'), 0) AS tool_calls, coalesce(sum(k % 7) FILTER (kind = 'usage'), 0) AS cached,
        coalesce(sum(greatest(2 * k, k + k % 7 + k % 3 + k % 11 + k % 5)) FILTER (kind = 'usage'), 0) AS total FROM m GROUP BY ALL""",
    x="SELECT user_id, own AS turn, at_ms, CASE kind WHEN 'complete' THEN 'completed' ELSE 'aborted' END AS status, CASE WHEN k % 9 <> 0 THEN k * 10 END AS duration_ms, CASE WHEN k % 9 <> 0 THEN k END AS ttft_ms FROM (SELECT *, row_number() OVER (PARTITION BY user_id, own ORDER BY seq DESC) AS r FROM m WHERE kind IN ('complete', 'abort')) WHERE r = 1"))
def rollout_turns(g):
    return rollouts.turns(rollouts.placed(rollout_events(g), ["user_id"]), ["user_id"]).select("user_id", "turn", "started_ms", "ended_ms", "status", "duration_ms", "ttft_ms", "model_calls", "tool_calls", "cached_input_tokens", "total_tokens")


def _last(value: str, when: str) -> str:
    """The value of the last row for which `when` holds, be it null."""
    return f"(list({value} ORDER BY seq DESC) FILTER ({when}))[1]"


@query(log_sql(f"""SELECT user_id, own AS turn,
        {_last("CASE WHEN kind = 'start' AND fst THEN coalesce(model_now, d_model) WHEN kind = 'settings' THEN model ELSE model_now END", "kind = 'context' OR kind = 'start' AND (fst OR model_now IS NOT NULL) OR kind = 'settings' AND model IS NOT NULL")} AS model,
        {_last("CASE WHEN kind = 'context' THEN coalesce(effort, d_effort) WHEN kind = 'start' THEN d_effort ELSE effort END", "kind = 'context' OR kind = 'start' AND fst OR kind = 'settings' AND effort IS NOT NULL")} AS effort,
        {_last("CASE WHEN kind = 'context' THEN coalesce(mode, d_mode) WHEN kind = 'start' THEN d_mode ELSE mode END", "kind = 'context' OR kind = 'start' AND fst OR kind = 'settings' AND mode IS NOT NULL")} AS mode,
        {_last("CASE WHEN kind = 'settings' THEN tier ELSE d_tier END", "kind = 'context' OR kind = 'start' AND fst OR kind = 'settings' AND tier IS NOT NULL")} AS tier,
        {_last("CASE WHEN kind = 'context' THEN NULL ELSE win END", "kind = 'context' OR kind = 'start' AND (fst OR win IS NOT NULL) OR kind = 'usage' AND win IS NOT NULL")} AS "window"
    FROM p WHERE own IS NOT NULL GROUP BY 1, 2 HAVING max(start_no) IS NOT NULL""", **_ROLLOUT))
def rollout_settings(g):
    return rollouts.settings(rollouts.placed(rollout_events(g), ["user_id"]), ["user_id"])


@query(log_sql("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS sequence, CASE WHEN start_no IS NOT NULL THEN own END AS turn, coalesce(model_now, 'unknown') AS model, k + k % 7 + k % 3 AS input_tokens, k % 11 + k % 5 AS output_tokens, win AS \"window\" FROM p WHERE kind = 'usage'", **_ROLLOUT))
def rollout_calls(g):
    """Calls with their context windows, where they told one."""
    rows = rollouts.placed(rollout_events(g), ["user_id"])
    of = ["user_id", "sequence"]
    found = rollouts.calls(rows, ["user_id"]).join(rollouts.samples(rows, ["user_id"]).select(*of, F.col("window_tokens").alias("window")), of, "left")
    return found.select(*of, "turn", "model", "input_tokens", "output_tokens", "window")


@query(log_sql("""SELECT p.user_id, 'compaction' AS what, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS sequence, CASE WHEN start_no IS NOT NULL THEN own END AS turn, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS BIGINT) AS duration_ms FROM p WHERE kind = 'compacted'
    UNION ALL SELECT user_id, 'item', row_number() OVER (PARTITION BY user_id ORDER BY seq), CASE WHEN start_no IS NOT NULL THEN own END, 'w' || k % 3, greatest(k - 50, 0) FROM p WHERE kind = 'item'
    UNION ALL SELECT user_id, 'tool', row_number() OVER (PARTITION BY user_id ORDER BY seq, i), CASE WHEN start_no IS NOT NULL THEN own END, 'x' || k % 4, NULL FROM (SELECT *, unnest(range(k % 2 + 1)) AS i FROM p WHERE kind = 'tool')""", **_ROLLOUT))
def rollout_work(g):
    """Tools, work items and compactions with the turns that they belong to."""
    rows, key, none = rollouts.placed(rollout_events(g), ["user_id"]), ["user_id"], F.lit(None)
    row = lambda df, what, name, ms: df.select("user_id", F.lit(what).alias("what"), "sequence", "turn", name.cast("string").alias("name"), ms.cast("bigint").alias("duration_ms"))
    return row(rollouts.compactions(rows, key), "compaction", none, none).union(row(rollouts.items(rows, key), "item", F.col("work_kind"), F.col("duration_ms"))).union(row(rollouts.tools(rows, key), "tool", F.col("tool"), none))


_HOURS = selection.Window(867_715_200_000 + 5 * 3_600_000, 870_393_600_000 - 7 * 3_600_000)


@query(sql(f"""SELECT provider, count(*) AS conversations, strftime(make_timestamp({_HOURS.since} // 86400000 * 86400000000), '%Y-%m-%dT%H:%M:%S.%f+00:00') AS window_since,
    strftime(make_timestamp(({_HOURS.until} + 86399999) // 86400000 * 86400000000), '%Y-%m-%dT%H:%M:%S.%f+00:00') AS window_until FROM conversations
    WHERE (started_ms IS NOT NULL OR ended_ms IS NOT NULL) AND (ended_ms >= {_HOURS.since} OR (ended_ms IS NULL AND started_ms >= {_HOURS.since})) AND (started_ms < {_HOURS.until} OR (started_ms IS NULL AND ended_ms < {_HOURS.until})) GROUP BY 1"""))
def providers_in_window(g):
    """Conversations by provider in a window of hours, of which the report tells the days."""
    return selection.with_window(selection.conversations(g, _HOURS).groupBy("provider").agg(F.count("*").alias("conversations")), _HOURS, day_precision=True)


_SCOPED = "SELECT parent_id, child_id, p.provider, p.machine FROM subagents JOIN (SELECT conversation_id, provider, CASE WHEN conversation_id % 7 = 0 THEN 'elsewhere' ELSE machine END AS machine FROM conversations) p ON p.conversation_id = parent_id"


@query(sql("SELECT * FROM scoped e WHERE EXISTS (SELECT 1 FROM conversations c WHERE c.started_ms >= 946684800000 - 157680000000 AND c.provider = e.provider AND c.machine = e.machine AND (c.conversation_id = e.parent_id OR c.conversation_id = e.child_id))", scoped=_SCOPED))
def edges_in_their_scope(g):
    """Edges with an end among the later conversations of the edge's own provider and machine; some edges were told on a machine that has neither end."""
    parents = g.conversations.select(F.col("conversation_id").alias("parent_id"), "provider", F.when(F.col("conversation_id") % 7 == 0, "elsewhere").otherwise(F.col("machine")).alias("machine"))
    edges = g.subagents.select("parent_id", "child_id").join(parents, "parent_id")
    return selection.edges_in_scope(edges, g.conversations.where(F.col("started_ms") >= 946_684_800_000 - 157_680_000_000)).select("parent_id", "child_id", "provider", "machine")


_WORDS = "SELECT user_id, seq, CASE event_type WHEN 'view' THEN 'Finished' WHEN 'click' THEN 'KILLED' WHEN 'error' THEN 'errored' WHEN 'signup' THEN 'queued' ELSE 'In_Progress' END || CASE WHEN k % 9 = 0 THEN ' ' ELSE '' END AS state, CASE k % 7 WHEN 0 THEN 'General' WHEN 1 THEN 'explore' WHEN 2 THEN 'Planner' WHEN 3 THEN ' ' WHEN 4 THEN 'unspecified' WHEN 5 THEN 'pilot' END AS role FROM log"


@query(log_sql("""SELECT user_id, seq, CASE WHEN lower(state) IN ('completed', 'done', 'finished', 'success', 'succeeded') THEN 'completed' WHEN lower(state) IN ('failed', 'error', 'errored') THEN 'failed' WHEN lower(state) IN ('aborted', 'canceled', 'cancelled', 'killed', 'terminated') THEN 'aborted'
        WHEN lower(state) IN ('active', 'in-progress', 'in_progress', 'pending', 'queued', 'running', 'starting') THEN 'in-progress' ELSE 'unknown' END AS status,
    CASE WHEN role IS NULL OR trim(role) = '' THEN 'unspecified' WHEN lower(role) IN ('worker', 'general') THEN 'worker' WHEN lower(role) IN ('explore', 'explorer', 'research', 'researcher') THEN 'research' WHEN lower(role) IN ('review', 'reviewer') THEN 'review'
        WHEN lower(role) IN ('test', 'tester') THEN 'test' WHEN lower(role) IN ('planner', 'planning') THEN 'planning' WHEN lower(role) IN ('other', 'unspecified') THEN lower(role) ELSE 'other' END AS role FROM words""", words=_WORDS))
def former_states_and_roles(g):
    """States and roles as stores of the former schema told them."""
    k = F.col("k")
    states = {"view": "Finished", "click": "KILLED", "error": "errored", "signup": "queued"}
    state = F.lit("In_Progress")
    for event, word in states.items():
        state = F.when(F.col("event_type") == event, word).otherwise(state)
    role = F.get(F.array(*[F.lit(x) for x in ("General", "explore", "Planner", " ", "unspecified", "pilot")]), (k % 7).cast("int"))
    return log(g).select("user_id", "seq", X.former_status(F.concat(state, F.when(k % 9 == 0, " ").otherwise(""))).alias("status"), X.former_role(role).alias("role"))


@query(sql("SELECT provider, min(started_ms) // 86400000 * 86400000 AS since_ms, -(-max(ended_ms) // 86400000) * 86400000 AS until_ms FROM (SELECT provider, started_ms, ended_ms FROM conversations WHERE started_ms IS NOT NULL AND ended_ms IS NOT NULL) GROUP BY 1".replace("-(-max(ended_ms) // 86400000) * 86400000", "(max(ended_ms) + 86399999) // 86400000 * 86400000")))
def day_bounds(g):
    """The days that each provider's conversations span."""
    times = g.conversations.where("started_ms IS NOT NULL AND ended_ms IS NOT NULL").groupBy("provider").agg(F.min("started_ms").alias("a"), F.max("ended_ms").alias("b"))
    return times.select("provider", X.day_floor(F.col("a")).alias("since_ms"), X.day_ceiling(F.col("b")).alias("until_ms"))


@query(sql("SELECT s AS start_ms, e AS end_ms, CASE WHEN s - (e - s) - 1 >= 820454400000 THEN s - 1 END AS previous_end_ms, CASE WHEN s - (e - s) - 1 >= 820454400000 THEN s - (e - s) - 1 END AS previous_start_ms FROM (SELECT 852076800000 AS s, least((max(ended_ms) // 86400000) * 86400000 + 86399999, 867715199999) AS e FROM conversations)"))
def custom_range_in_window(g):
    """From a day to the latest one that the conversations tell, within an export window, and the range of equal width before it."""
    latest = g.conversations.agg(F.max("ended_ms").alias("at"))
    return slices.custom_range(latest, "1997-01-01", None, since=820_454_400_000, until=867_715_200_000)


@query(log_sql("""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY i) AS sequence, 'm' || i AS model, k * i AS tokens FROM (SELECT user_id, k, unnest(range(1, k % 4 + 1)) AS i FROM (SELECT user_id, arg_max(k, seq) AS k FROM log WHERE event_type = 'error' AND k % 3 <> 0 GROUP BY 1))"""))
def calls_of_last_report(g):
    """The calls that each user's last report tells, a map of models with their tokens."""
    reports = log(g).where("event_type = 'error' AND k % 3 != 0").withColumn("metrics", F.expr("map_from_entries(transform(slice(array(1L, 2L, 3L), 1, CAST(k % 4 AS int)), i -> struct('m' || i AS key, k * i AS value)))"))
    last = reports.groupBy("user_id").agg(F.max_by("metrics", "seq").alias("metrics")).select("user_id", F.explode("metrics").alias("model", "tokens"))
    return last.select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("model")).alias("sequence"), "model", "tokens")


@query(log_sql("""SELECT l.user_id, l.seq, l.k + coalesce(m.cached, 0) AS tokens, m.last FROM log l LEFT JOIN (SELECT user_id, k % 30 AS message, max(seq) AS last, arg_max(k % 13, CASE WHEN event_type = 'view' THEN seq END) AS cached FROM log WHERE event_type IN ('view', 'signup') GROUP BY 1, 2) m
    ON m.user_id = l.user_id AND m.message = l.k % 30 WHERE l.event_type = 'purchase'"""))
def ledger_of_messages(g):
    """Ledger entries with the cache counters of their message's newest answer and with its newest record, where the log has the message."""
    rows, message = log(g), F.col("k") % 30
    named = rows.where("event_type IN ('view', 'signup')").groupBy("user_id", message.alias("message")).agg(F.max("seq").alias("last"), F.max_by(F.col("k") % 13, F.when(F.col("event_type") == "view", F.col("seq"))).alias("cached"))
    entries = rows.where("event_type = 'purchase'").withColumn("message", message)
    return entries.join(named, ["user_id", "message"], "left").select("user_id", "seq", (F.col("k") + F.coalesce("cached", F.lit(0))).alias("tokens"), "last")


@query(sql("SELECT e.parent_id, e.child_id, c.started_ms AS created_ms, c.ended_ms AS updated_ms, c.machine AS role FROM subagents e LEFT JOIN (SELECT * FROM conversations WHERE conversation_id % 5 <> 0) c ON c.conversation_id = e.child_id"))
def edges_with_threads(g):
    """Edges with what the store tells of their children, where it has them."""
    threads = g.conversations.where("conversation_id % 5 != 0").select(F.col("conversation_id").alias("child_id"), F.col("started_ms").alias("created_ms"), F.col("ended_ms").alias("updated_ms"), F.col("machine").alias("role"))
    return g.subagents.select("parent_id", "child_id").join(threads, "child_id", "left").select("parent_id", "child_id", "created_ms", "updated_ms", "role")


@query(log_sql("""SELECT c.user_id, c.seq, c.message FROM m c WHERE NOT EXISTS (SELECT 1 FROM m p WHERE p.user_id = c.user_id // 2 AND p.message = c.message)""", m="SELECT user_id, seq, CASE WHEN event_type <> 'error' THEN k % 40 END AS message FROM log WHERE event_type IN ('view', 'purchase', 'error')"))
def fork_replays(g):
    """Messages of each log without those that its parent's log (half its number) has by id; messages without an id stay."""
    m = log(g).where("event_type IN ('view', 'purchase', 'error')").select("user_id", "seq", F.expr("CASE WHEN event_type <> 'error' THEN k % 40 END").alias("message"))
    parents = m.select(F.col("user_id").alias("parent"), "message")
    return folds.without_replays(m.withColumn("parent", F.expr("user_id div 2")), parents, ["parent", "message"]).select("user_id", "seq", "message")


@query(sql("""SELECT provider, CAST(2 AS BIGINT) AS batches, 2 * count(*) AS received, count(*) + count(*) FILTER (conversation_id % 3 = 2) AS written, count(*) - count(*) FILTER (conversation_id % 3 = 2) AS skipped,
    CAST(0 AS BIGINT) AS malformed, count(*) FILTER (conversation_id % 4 = 0) AS duplicates FROM conversations GROUP BY 1"""))
def ingest_replays(g):
    """Counters by provider after a batch, the same batch again under its receipt, and a second batch of which a third is richer."""
    of = lambda events: g.conversations.select("conversation_id", "provider", events.cast("bigint").alias("event_count"), F.sha2(F.col("conversation_id").cast("string"), 256).alias("content_hash"))
    n, store = F.col("model_calls") + 5, f"{shared_dir(g.spark)}/ingest-{uuid.uuid4().hex}"
    first = of(n).unionByName(of(n - 1).where("conversation_id % 4 = 0"))  # with poorer copies of a quarter
    for batch, receipt in ((first, 1), (first, 1), (of(n + F.col("conversation_id") % 3 - 1), 2)):
        ingest.ingest(batch, store, 0, batch_receipt(store, receipt))
    return ingest.summary(g.spark, store)


@query(sql("SELECT conversation_id, started_ms, position FROM (SELECT *, row_number() OVER (ORDER BY started_ms DESC, conversation_id) AS position FROM conversations WHERE started_ms IS NOT NULL) WHERE position BETWEEN 51 AND 100"))
def frozen_second_page(g):
    """The second page of the latest conversations, by its cursor."""
    kept, how = pages.Pages(), {"query": {"started": True}, "sort": "started", "descending": True, "size": 50}
    latest = g.conversations.where("started_ms IS NOT NULL").select("conversation_id", "started_ms")
    _, cursor = kept.first(latest, [F.desc("started_ms"), F.asc("conversation_id")], **how)
    return kept.next(g.spark, cursor, **how)[0]


@query(sql("SELECT conversation_id, sequence, 2 AS schema_version, CASE WHEN v = 2 AND turn_no % 2 = 0 THEN cached_input_tokens END AS cache_write_1h FROM (SELECT *, conversation_id % 2 + 1 AS v FROM calls) WHERE NOT (v = 1 AND turn_no = 3)"))
def upgraded_calls(g):
    """Calls of both schema versions as the current one; older ones that carry the newer column are refused."""
    version = (F.col("conversation_id") % 2 + 1).cast("int")
    newer = F.when((version == 2) & (F.col("turn_no") % 2 == 0) | (version == 1) & (F.col("turn_no") == 3), F.col("cached_input_tokens"))
    rows = g.calls.select("conversation_id", "sequence", version.alias("schema_version"), newer.alias("cache_write_1h"))
    return ingest.upgraded(rows, "cache_write_1h", "bigint")[0]


_DAY = lambda c: f"{c} // 86400000 * 86400000"
_CATEGORY = "CASE WHEN contains(tool, 'imagegen') THEN 'Media' WHEN starts_with(tool, 'mcp__') OR contains(tool, 'mcp_resource') THEN 'Integrations' ELSE 'Other' END"
_OF = "JOIN k USING (conversation_id)"


@query(sql(f"""SELECT 'conversations' AS shape, key AS conversation_key, CAST(NULL AS BIGINT) AS turn_no, CAST(NULL AS BIGINT) AS sequence, provider || ' ' || p.alias || ' ' || m.alias || ' ' || coalesce((SELECT string_agg(alias, ',' ORDER BY alias) FROM model WHERE list_contains(models, value)), '') AS told, {_DAY('started_ms')} AS day_ms, CAST(NULL AS BIGINT) AS n
        FROM sel {_OF} JOIN project p ON p.value = project JOIN machine m ON m.value = machine
    UNION ALL SELECT 'turns', key, turn_no, NULL, status, {_DAY('started_ms')}, coalesce(duration_ms, 0) + coalesce(ttft_ms, 0) + total_tokens FROM turns {_OF}
    UNION ALL SELECT 'calls', key, turn_no, sequence, alias, {_DAY('timestamp_ms')}, total_tokens FROM calls {_OF} JOIN model ON value = model
    UNION ALL SELECT 'tools', key, turn_no, sequence, {_CATEGORY}, {_DAY('timestamp_ms')}, NULL FROM tools {_OF}
    UNION ALL SELECT 'work', key, turn_no, NULL, kind, {_DAY('started_ms')}, duration_ms FROM work {_OF}
    UNION ALL SELECT 'samples', key, turn_no, sequence, NULL, {_DAY('timestamp_ms')}, input_tokens FROM samples {_OF}
    UNION ALL SELECT 'settings', key, turn_no, NULL, alias || ' ' || effort || ' ' || mode, NULL, NULL FROM settings {_OF} JOIN model ON value = model
    UNION ALL SELECT 'compactions', key, NULL, NULL, NULL, {_DAY('timestamp_ms')}, NULL FROM compactions {_OF}
    UNION ALL SELECT 'subagents', a.key, NULL, NULL, NULL, {_DAY('created_ms')}, b.key FROM subagents LEFT JOIN k a ON a.conversation_id = parent_id LEFT JOIN k b ON b.conversation_id = child_id WHERE a.key IS NOT NULL OR b.key IS NOT NULL
    UNION ALL SELECT 'runs', NULL, NULL, NULL, provider, {_DAY('ingested_ms')}, received FROM runs""",
    sel="SELECT * FROM conversations WHERE started_ms >= 867715200000 AND started_ms < 870393600000", k="SELECT conversation_id, row_number() OVER (ORDER BY conversation_id) - 1 AS key FROM sel",
    project="SELECT value, 'project-' || row_number() OVER (ORDER BY value) AS alias FROM (SELECT DISTINCT project AS value FROM sel)", machine="SELECT value, 'machine-' || row_number() OVER (ORDER BY value) AS alias FROM (SELECT DISTINCT machine AS value FROM sel)",
    model=f"SELECT value, 'model-' || row_number() OVER (ORDER BY value) AS alias FROM (SELECT unnest(models) AS value FROM sel UNION SELECT model FROM calls {_OF} UNION SELECT model FROM settings {_OF}) WHERE value IS NOT NULL"))
def share_safe_tables(g):
    """All ten tables of a share-safe data set, side by side."""
    chosen = g.conversations.where("started_ms >= 867715200000 AND started_ms < 870393600000")
    children = {"turns": g.turns, "calls": g.calls, "tools": g.tools, "work": g.work, "samples": g.samples, "settings": g.settings, "compactions": g.compactions}
    edges = selection.edges(g.subagents, chosen)
    safe = privacy.share_safe_graph(chosen, children, edges, g.runs)
    none = F.lit(None)
    parts = {
        "conversations": (F.concat_ws(" ", "provider", "project", "machine", F.array_join("models", ",")), "started_ms", none), "turns": (F.col("status"), "started_ms", F.coalesce("duration_ms", F.lit(0)) + F.coalesce("ttft_ms", F.lit(0)) + F.col("total_tokens")),
        "calls": (F.col("model"), "timestamp_ms", F.col("total_tokens")), "tools": (F.col("tool"), "timestamp_ms", none), "work": (F.col("kind"), "started_ms", F.col("duration_ms")), "samples": (none, "timestamp_ms", F.col("input_tokens")),
        "settings": (F.concat_ws(" ", "model", "effort", "mode"), None, none), "compactions": (none, "timestamp_ms", none), "subagents": (none, "created_ms", F.col("child_key")), "runs": (F.col("provider"), "ingested_ms", F.col("received")),
    }
    out = None
    for shape, (told, day, n) in parts.items():
        df = safe[shape]
        key = "conversation_key" if "conversation_key" in df.columns else "parent_key" if "parent_key" in df.columns else None
        own = lambda c: (F.col(c) if c in df.columns else none).cast("bigint").alias(c)  # noqa: E731, B023
        row = df.select(F.lit(shape).alias("shape"), (none if key is None else F.col(key)).cast("bigint").alias("conversation_key"), own("turn_no"), own("sequence"), told.cast("string").alias("told"), (none if day is None else F.col(day)).cast("bigint").alias("day_ms"), n.cast("bigint").alias("n"))
        out = row if out is None else out.union(row)
    return out


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
