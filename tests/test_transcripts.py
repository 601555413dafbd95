"""Small stores of each kind, with what must come of them."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import groups
from tallyloom.sources import registry, scan, sqlite, stores, transcripts


def at(n):
    return f"2026-08-01T10:{n:02d}:00Z"


T0 = 1785578400000  # 2026-08-01T10:00:00Z


def minute(ms):
    return None if ms is None else (ms - T0) / 60_000


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_gemini_replays_its_log(spark, tmp_path):
    user = lambda i, n: {"id": i, "type": "user", "timestamp": at(n)}
    said = lambda i, n, model, tokens, **more: {"id": i, "type": "gemini", "timestamp": at(n), "model": model, "tokens": tokens, **more}
    log = [
        {"sessionId": "s1", "startTime": at(0)}, user("u1", 1), said("g1", 2, "m1", {"input": 10, "cached": 4, "output": 3, "thoughts": 2, "total": 20}, toolCalls=[{"name": "read"}, {"name": "bad name"}, {"name": "write"}]),
        user("u2", 3), said("g2", 4, "m2", {"input": 1}), "not json", {"$rewindTo": "u2"}, user("u3", 5), said("g3", 6, "m2", {"input": 7}), said("g1", 7, "m1", {"input": 100, "output": 1}, toolCalls=[{"name": "read"}]),
        {"id": "e1", "type": "error", "timestamp": at(8)}, {"$set": {"lastUpdated": at(9)}},
    ]
    lines(tmp_path / "tmp/p/chats/session-1.jsonl", log)
    lines(tmp_path / "tmp/q/chats/session-2.jsonl", log[:4])  # a poorer copy
    (tmp_path / "tmp/q/chats/session-3.json").write_text(json.dumps({"sessionId": "s2", "messages": [user("a", 1), said("b", 2, "m", {"input": 5})]}))
    lines(tmp_path / "tmp/q/chats/session-4.jsonl", [{"id": "x"}])  # of no session
    graph, counters = transcripts.gemini(spark, str(tmp_path))
    assert counters.collect()[0].asDict() == {"malformed": 2, "duplicates": 1}
    assert rows(graph.turns, "external_id", "turn_key", "status", "model_calls", "tool_calls", "total_tokens") == [("s1", "u1", "completed", 1, 1, 101), ("s1", "u3", "aborted", 1, 0, 7), ("s2", "a", "completed", 1, 0, 5)]
    (c,) = graph.conversations.where("external_id = 's1'").collect()
    assert (minute(c.started_ms), minute(c.ended_ms), c.event_count, c.models) == (0, 9, 11, ["m1", "m2"])
    assert rows(graph.turns.where("external_id = 's1'").selectExpr(f"(ended_ms - {T0}) / 60000 AS e"), "e") == [(7.0,), (8.0,)]
    assert rows(graph.settings, "external_id", "turn_no", "model") == [("s1", 1, "m1"), ("s1", 2, "m2"), ("s2", 1, "m")]


def test_gemini_checkpoints(spark, tmp_path):
    message = lambda i: {"id": i, "type": "user"}
    log = [{"sessionId": "s"}, message("a"), message("b"), {"$set": {"messages": [message("c"), {"no": "id"}, message("d")]}}, message("e"), {"$rewindTo": "d"}, message("a"), {"$rewindTo": "gone"}, message("z")]
    lines(tmp_path / "tmp/p/chats/session-1.jsonl", log[:-2])
    lines(tmp_path / "tmp/p/chats/session-2.jsonl", [{"sessionId": "t"}, *log[1:]])
    graph, _ = transcripts.gemini(spark, str(tmp_path))
    assert rows(graph.turns, "external_id", "turn_no", "turn_key") == [("s", 1, "c"), ("s", 2, "a"), ("t", 1, "z")]


def test_pi_takes_turn_and_model_from_above(spark, tmp_path):
    entry = lambda i, up, n, **more: {"id": i, "parentId": up, "timestamp": at(n), **more}
    user = lambda i, up, n: entry(i, up, n, type="message", message={"role": "user"})
    said = lambda i, up, n, **m: entry(i, up, n, type="message", message={"role": "assistant", **m})
    log = [
        {"type": "session", "id": "s", "timestamp": at(0)}, entry("m", None, 1, type="model_change", provider="p", modelId="big"), entry("l", "m", 1, type="thinking_level_change", thinkingLevel="high"),
        user("u1", "l", 2), said("a1", "u1", 3, usage={"input": 5, "cacheRead": 2, "output": 9, "reasoning": 4}, stopReason="toolUse", content=[{"type": "toolCall", "name": "bash"}, {"type": "text"}]),
        said("a2", "a1", 4, provider="q", model="small", usage={"totalTokens": 50}, stopReason="stop"), entry("l2", "a2", 4, type="thinking_level_change", thinkingLevel="?"), user("u2", "l2", 5),
        said("b1", "u1", 6, usage={"input": 1}, stopReason="aborted"),  # another branch of the first turn
        entry("c", "b1", 7, type="compaction", usage={"input": 3}), said("d", "u2", 8, usage={}, stopReason="length"), said("x", None, 9, usage={"input": 2}), "{",
    ]
    lines(tmp_path / "sessions/2026/a.jsonl", log)
    lines(tmp_path / "sessions/b.jsonl", [{"type": "message"}])
    graph, counters = transcripts.pi(spark, str(tmp_path))
    assert counters.collect()[0].asDict() == {"malformed": 2, "duplicates": 0}
    assert rows(graph.calls, "sequence", "turn_no", "model", "total_tokens") == [(1, 1, "p/big", 16), (2, 1, "q/small", 50), (3, 1, "p/big", 1), (4, 1, "p/big", 3), (5, 2, "q/small", 0), (6, 2, "unknown", 2)]
    assert rows(graph.turns, "turn_no", "turn_key", "status", "model_calls", "tool_calls") == [(1, "u1", "aborted", 4, 1), (2, "u2", "completed", 2, 0)]
    assert rows(graph.settings, "turn_no", "model", "effort") == [(1, None, "high"), (2, None, None)]
    assert rows(graph.compactions, "turn_no", "sequence") == [(1, 1)]
    assert {r.turn_no: minute(r.ended_ms) for r in graph.turns.collect()} == {1: 6, 2: 9}


def test_qwen_reads_the_active_branch(spark, tmp_path):
    rec = lambda i, up, n, kind, **more: {"uuid": i, "parentUuid": up, "sessionId": "s", "timestamp": at(n), "type": kind, **more}
    part = lambda name: {"functionCall": {"name": name}}
    log = [
        rec("r", None, 0, "system"), rec("u1", "r", 1, "user"), rec("a1", "u1", 2, "assistant", model="m", usageMetadata={"promptTokenCount": 9}, message={"parts": [part("one")]}, contextWindowSize=1000),
        rec("a1", "other", 4, "assistant", usageMetadata={"promptTokenCount": 10, "cachedContentTokenCount": 4, "candidatesTokenCount": 3, "totalTokenCount": 20}, message={"parts": [part("two"), {"text": 1}]}),
        rec("dead", "a1", 5, "user"), rec("dead2", "dead", 6, "assistant", model="x"), rec("z", "a1", 6, "system", subtype="chat_compression"), rec("u2", "z", 7, "user"), rec("side", "u2", 7, "assistant", isSidechain=True),
        rec("a2", "side", 8, "assistant", message={"parts": 3}), rec("art", "dead2", 9, "system", subtype="session_artifact_event"), {"uuid": "bad", "sessionId": "s", "type": "other"}, rec(None, None, 9, "user"),
    ]
    lines(tmp_path / "projects/p/chats/1.jsonl", log)
    lines(tmp_path / "projects/p/chats/2.jsonl", [rec("a", "gone", 1, "user") | {"sessionId": "t"}])
    graph, counters = transcripts.qwen(spark, str(tmp_path))
    assert counters.collect()[0].asDict() == {"malformed": 3, "duplicates": 0}
    assert rows(graph.turns, "external_id", "turn_key", "status", "model_calls", "tool_calls", "total_tokens") == [("s", "u1", "completed", 1, 2, 20), ("s", "u2", "completed", 1, 0, 0), ("t", "a", "in-progress", 0, 0, 0)]
    assert rows(graph.calls, "sequence", "model", "cached_input_tokens", "uncached_input_tokens", "unattributed_tokens") == [(1, "m", 4, 6, 7), (2, "unknown", 0, 0, 0)]
    assert rows(graph.samples, "sequence", "input_tokens", "window_tokens") == [(1, 10, 1000)] and rows(graph.compactions, "turn_no") == [(1,)]
    assert {r.turn_key: minute(r.ended_ms) for r in graph.turns.where("external_id = 's'").collect()} == {"u1": 4, "u2": 8}


def claude_store(home):
    user = lambda i, n, **more: {"type": "user", "uuid": i, "timestamp": at(n), "sessionId": "s", "message": {"content": "x"}, **more}
    said = lambda n, request, mid, usage, **more: {"type": "assistant", "timestamp": at(n), "sessionId": "s", "requestId": request, "message": {"id": mid, "model": "m", "usage": usage, **more}}
    session = [
        user("u1", 1), said(2, "r1", "i1", {"input_tokens": 5, "output_tokens": 1}), said(3, "r1", "i1", {"input_tokens": 5, "output_tokens": 9, "output_tokens_details": {"thinking_tokens": 4}}, stop_reason="end_turn", content=[{"type": "tool_use", "id": "t1", "name": "Bash"}]),
        said(4, "r1", "i1", {"input_tokens": 500}, content=[{"type": "tool_use", "id": "t1", "name": "Bash"}, {"type": "tool_use", "name": "Read"}]), user("r", 5, message={"content": [{"type": "tool_result"}]}), user("meta", 5, isMeta=True),
        said(6, "r2", "i2", {"input_tokens": 1, "iterations": [{"type": "advisor_message", "model": "adv", "input_tokens": 7}, {"type": "message", "input_tokens": 9}]}), {"type": "system", "subtype": "compact_boundary", "timestamp": at(7), "sessionId": "s"},
        user("u2", 8), said(9, None, None, None) | {"isApiErrorMessage": True}, "{",
    ]
    agent = [user("k", 10, isSidechain=True) | {"agentId": "ag"}, said(10, "r1", "i1", {"input_tokens": 5}), said(11, "r9", "i9", {"input_tokens": 3})]
    lines(home / "projects/p/s.jsonl", session)
    lines(home / "projects/p/s/subagents/agent-ag.jsonl", agent)
    lines(home / "projects/old/s.jsonl", session[:2])
    (home / "projects/p/s/subagents/agent-ag.meta.json").write_text(json.dumps({"agentType": " Explore "}))
    lines(home / "projects/q/lone.jsonl", [{"type": "user", "timestamp": at(1), "message": {"content": [{"type": "text"}]}}])
    lines(home / "projects/q/agent-x.jsonl", [{"type": "user"}])  # an agent of no session


def test_claude(spark, tmp_path):
    claude_store(tmp_path)
    graph, counters = transcripts.claude(spark, str(tmp_path))
    assert counters.collect()[0].asDict() == {"malformed": 2, "duplicates": 1}
    calls = rows(graph.calls.where("external_id = 's'"), "sequence", "turn_no", "model", "input_tokens", "output_tokens", "reasoning_output_tokens")
    assert calls == [(1, 1, "m", 5, 9, 4), (2, 1, "m", 1, 0, 0), (3, 1, "adv", 7, 0, 0)]
    assert rows(graph.turns, "external_id", "turn_key", "status", "model_calls", "tool_calls") == [("lone", None, "in-progress", 0, 0), ("s", "u1", "completed", 3, 2), ("s", "u2", "aborted", 0, 0), ("s:agent:ag", "k", "completed", 1, 0)]
    assert rows(graph.calls.where("external_id = 's:agent:ag'"), "input_tokens") == [(3,)]  # the parent's response is left out
    assert rows(graph.edges, "parent_id", "child_id", "status", "role", "tokens_used") == [("s", "s:agent:ag", "completed", "research", 3)]
    assert rows(graph.compactions, "external_id", "turn_no") == [("s", 1)]
    assert rows(graph.settings.where("external_id = 's'"), "turn_no", "model") == [(1, "m"), (2, None)]


def test_claude_files_that_must_be_read_together(spark, tmp_path):
    claude_store(tmp_path)
    every = scan.json_lines(spark, f"{tmp_path}/projects", below="*.jsonl")
    files = transcripts.claude_files(transcripts._numbered(every))
    linked = groups.linked(files, "key", "parent")
    found = files.join(linked, files.key == linked.member).select(F.element_at(F.split("path", "/"), -1).alias("file"), "group")
    assert rows(found, "file", "group") == [("agent-ag.jsonl", "s"), ("lone.jsonl", "lone"), ("s.jsonl", "s"), ("s.jsonl", "s")]


def codex_store(home):
    msg = lambda n, kind, **p: {"timestamp": at(n), "type": "event_msg", "payload": {"type": kind, **p}}
    context = lambda n, **p: {"timestamp": at(n), "type": "turn_context", "payload": p}
    usage = lambda n, window=None, **u: msg(n, "token_count", info={"last_token_usage": u, "model_context_window": window})
    log = [
        {"timestamp": at(0), "type": "session_meta", "payload": {"id": "c1"}}, msg(0, "thread_settings_applied", thread_settings={"model": "d", "reasoning_effort": "low", "service_tier": "fast", "collaboration_mode": {"mode": "plan"}}),
        usage(0, input_tokens=1), context(1, turn_id="t1", model="m1"), usage(1, input_tokens=2), msg(2, "task_started", turn_id="t1", model_context_window=500),
        usage(3, 900, input_tokens=100, cached_input_tokens=40, cache_write_input_tokens=10, output_tokens=20, reasoning_output_tokens=5, total_tokens=130),
        {"timestamp": at(4), "type": "response_item", "payload": {"type": "custom_tool_call", "name": "exec", "input": "tools.exec_command( x ); tools.nothing("}}, {"timestamp": at(4), "type": "response_item", "payload": {"type": "function_call", "name": "shell"}},
        msg(5, "item_completed", started_at_ms=10, completed_at_ms=4, item={"type": "CommandExecution", "tool": "sh", "exit_code": 1}), {"timestamp": at(5), "type": "compacted", "payload": {}},
        msg(6, "task_complete", turn_id="t1", duration_ms=7, time_to_first_token_ms=3), msg(7, "task_started", turn_id="t2"), msg(8, "thread_settings_applied", thread_settings={"reasoning_effort": "max"}),
        msg(9, "item_completed", turn_id="nope", item={"type": "?", "status": "running"}), usage(9, input_tokens=1.5, output_tokens=True), "[]",
    ]
    lines(home / "sessions/2026/08/01/rollout.jsonl", log)
    lines(home / "sessions/2026/08/02/copy.jsonl", log[:4])
    lines(home / "sessions/x.jsonl", [msg(0, "task_started", turn_id="t")])
    db = sqlite3.connect(home / "state_5.sqlite")
    db.executescript("""CREATE TABLE thread_spawn_edges (parent_thread_id TEXT, child_thread_id TEXT, status TEXT); CREATE TABLE threads (id TEXT, created_at_ms INTEGER, updated_at_ms INTEGER, agent_role TEXT);
        INSERT INTO thread_spawn_edges VALUES ('c1', 'c2', 'Canceled'), ('c1', 'c3', NULL); INSERT INTO threads VALUES ('c2', 5, 'text', 'explorer'), ('c9', 1, 1, 'x')""")
    db.commit()
    db.close()


def test_codex(spark, tmp_path):
    codex_store(tmp_path)
    graph, counters = transcripts.codex(spark, str(tmp_path))
    assert counters.collect()[0].asDict() == {"malformed": 1, "duplicates": 1}
    mine = lambda df: df.where("external_id = 'c1'")
    assert rows(mine(graph.calls), "sequence", "turn", "model", "input_tokens", "output_tokens", "total_tokens") == [(1, None, "unknown", 1, 0, 1), (2, None, "m1", 2, 0, 2), (3, "t1", "m1", 100, 20, 130), (4, "t2", "m1", 0, 0, 0)]
    assert rows(mine(graph.turns), "turn", "status", "duration_ms", "ttft_ms", "model_calls", "tool_calls") == [("t1", "completed", 7, 3, 1, 2), ("t2", "in-progress", None, None, 1, 0)]
    assert {r.turn: (minute(r.started_ms), minute(r.ended_ms)) for r in mine(graph.turns).collect()} == {"t1": (2, 6), "t2": (7, 9)}
    assert rows(mine(graph.settings), "turn", "model", "effort", "mode", "tier", "window") == [("t1", "m1", "low", "plan", "fast", 900), ("t2", "m1", "max", "plan", "fast", None)]
    assert rows(mine(graph.tools), "sequence", "turn", "outer_tool", "tool") == [(1, "t1", "exec", "exec_command"), (2, "t1", "shell", "shell")]
    assert rows(mine(graph.work), "sequence", "turn", "work_kind", "tool", "status", "duration_ms") == [(1, "t1", "command", "sh", "failed", 0), (2, None, "other", None, "in-progress", None)]
    assert rows(mine(graph.samples), "sequence", "turn", "input_tokens", "window_tokens") == [(3, "t1", 100, 900)]
    assert rows(graph.edges, "parent_id", "child_id", "status", "created_ms", "updated_ms", "role", "tokens_used") == [("c1", "c2", "aborted", 5, None, "research", None), ("c1", "c3", "unknown", None, None, "unspecified", None)]
    (c,) = mine(graph.conversations).collect()
    assert (minute(c.started_ms), minute(c.ended_ms), c.iterations, c.model_calls, c.tool_calls, c.compactions, c.event_count, c.models, c.total_tokens) == (0, 9, 2, 4, 2, 1, 16, ["m1"], 133)


def test_copilot_takes_the_last_shutdown(spark, tmp_path):
    event = lambda kind, n, agent=None, **data: {"type": kind, "timestamp": at(n), "data": data, "id": f"e{n}"} | ({} if agent is None else {"agentId": agent})
    metric = lambda **u: {"usage": u}
    log = [
        event("session.start", 0, sessionId="s", selectedModel="chosen", reasoningEffort="high"), event("user.message", 1), event("assistant.message", 2, model="seen"), event("user.message", 2, "sub"), event("tool.execution_start", 3, toolName="t", toolCallId="k"),
        event("tool.execution_start", 4, toolName="again", toolCallId="k"), event("tool.execution_start", 4, toolName="bad name"), event("assistant.turn_end", 5), event("session.shutdown", 6, modelMetrics={"old": metric(inputTokens=1)}),
        event("session.compaction_complete", 7, success=True), event("session.compaction_complete", 7, success=False), event("user.message", 8), event("assistant.message", 9), {"type": "x"},
        event("session.shutdown", 10, shutdownType="error", modelMetrics={"b": metric(inputTokens=10, cacheReadTokens=4, cacheWriteTokens=9, outputTokens=5, reasoningTokens=7), "a": metric(inputTokens=1), "c": 5}), event("session.shutdown", 11, modelMetrics=3),
    ]
    lines(tmp_path / "session-state/1/events.jsonl", log)
    graph, counters = transcripts.copilot(spark, str(tmp_path))
    assert counters.collect()[0].asDict() == {"malformed": 4, "duplicates": 0}
    assert rows(graph.calls, "sequence", "turn_no", "model", "uncached_input_tokens", "cached_input_tokens", "cache_write_input_tokens", "visible_output_tokens", "reasoning_output_tokens") == [(1, None, "a", 1, 0, 0, 0, 0), (2, None, "b", 0, 4, 6, 0, 5)]
    assert rows(graph.turns, "turn_no", "turn_key", "status", "model_calls", "tool_calls") == [(1, "e1", "completed", 0, 1), (2, "e8", "aborted", 0, 0)]
    assert rows(graph.settings, "turn_no", "model", "effort") == [(1, "seen", "high"), (2, None, "high")] and rows(graph.compactions, "turn_no") == [(1,)]
    (c,) = graph.conversations.collect()
    assert (c.models, c.model_calls, c.total_tokens, c.event_count, minute(c.ended_ms)) == (["a", "b", "chosen", "seen"], 2, 16, 16, 11)


def goose_store(home, messages, usage, sessions):
    db = sqlite3.connect(home / "sessions.db")
    db.executescript("""CREATE TABLE sessions (id TEXT, working_dir TEXT, created_at TEXT, updated_at, provider_name TEXT, model_config_json TEXT);
        CREATE TABLE messages (id INTEGER, message_id TEXT, session_id TEXT, role TEXT, content_json TEXT, created_timestamp INTEGER, metadata_json TEXT);
        CREATE TABLE usage_ledger (id INTEGER, session_id TEXT, created_timestamp INTEGER, model TEXT, input_tokens INTEGER, output_tokens INTEGER, total_tokens INTEGER, cache_read_tokens INTEGER, cache_write_tokens INTEGER, is_compaction INTEGER)""")
    db.executemany("INSERT INTO sessions VALUES (?, ?, ?, ?, ?, ?)", sessions)
    db.executemany("INSERT INTO messages VALUES (?, ?, ?, ?, ?, ?, ?)", messages)
    db.executemany("INSERT INTO usage_ledger VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?, ?)", usage)
    db.commit()
    db.close()


def test_goose_takes_usage_to_the_turn_at_its_time(spark, tmp_path):
    t = T0 // 1000
    text, call = json.dumps([{"type": "text"}]), json.dumps([{"type": "toolRequest", "toolCall": {"value": {"name": "shell"}}}, {"type": "toolRequest", "toolCall": {}}])
    messages = [
        (1, "u1", "s", "user", text, t + 60, None), (2, None, "s", "assistant", call, t + 120, "{}"), (3, "h", "s", "user", text, t + 130, '{"userVisible": false}'), (4, "u2", "s", "user", text, t + 180, ""),
        (5, "a2", "s", "assistant", json.dumps([{"type": "error"}]), t + 240, "{}"), (6, "u3", "s", "user", text, t + 300, "{}"), (7, "x", "s", "tool", text, t, "{}"), (8, "y", "s", "user", "{", t, "{}"),
    ]
    usage = [(1, "s", t + 10, "m", 5, 1, 0, 9, 0, 0), (2, "s", t + 100, None, 10, 2, 20, 4, 3, 1), (3, "s", t + 200, "p/big", 1, 1, 2, 0, 0, 0), (4, "s", None, "m", 7, 0, 7, 0, 0, 0)]
    goose_store(tmp_path, messages, usage, [("s", "/w", at(0), (t + 600) * 1000, "p", '{"model_name": "conf"}'), ("bad id", None, None, None, None, "[")])
    graph, counters = stores.goose(spark, str(tmp_path))
    assert counters.collect()[0].asDict() == {"malformed": 5, "duplicates": 0}
    calls = rows(graph.calls, "sequence", "turn_no", "model", "uncached_input_tokens", "cached_input_tokens", "cache_write_input_tokens", "visible_output_tokens", "unattributed_tokens")
    assert calls == [(1, 3, "p/m", 7, 0, 0, 0, 0), (2, None, "p/m", 0, 5, 0, 1, 0), (3, 1, "p/conf", 3, 4, 3, 2, 8), (4, 2, "p/big", 1, 0, 0, 1, 0)]
    assert rows(graph.turns, "turn_no", "turn_key", "status", "model_calls", "tool_calls") == [(1, "u1", "completed", 1, 1), (2, "u2", "aborted", 1, 0), (3, "u3", "in-progress", 1, 0)]
    assert {r.turn_no: minute(r.ended_ms) for r in graph.turns.collect()} == {1: 2, 2: 4, 3: 10}
    (c,) = graph.conversations.collect()
    assert (minute(c.started_ms), minute(c.ended_ms), c.event_count, c.compactions, c.models) == (0, 10, 10, 1, ["p/big", "p/conf", "p/m"])


def test_amp_joins_its_ledger_to_messages(spark, tmp_path):
    user = lambda i, **more: {"role": "user", "messageId": i, "content": "x", **more}
    said = lambda i, n, **more: {"role": "assistant", "messageId": i, "timestamp": at(n), **more}
    messages = [user(1), said(2, 2, stopReason="end_turn", usage={"cacheCreationInputTokens": 8, "cacheReadInputTokens": 3, "inputTokens": 1}, content=[{"type": "tool_use", "name": "run"}]), user(None, content=[{"type": "tool_result"}]), user("u2", timestamp=at(3)), said(4, 4, stopReason="error"), 5]
    ledger = [{"model": "gpt-x", "timestamp": at(9), "toMessageId": 2, "tokens": {"input": 5, "output": 2}}, {"model": "c", "toMessageId": 2, "tokens": {"input": 5, "total": 90}}, {"model": "c", "toMessageId": 77, "tokens": {"input": 4}}, {"model": "c", "tokens": {"input": 0}}, {"tokens": {"input": 4}}, "x"]
    (tmp_path / "threads").mkdir()
    put = lambda name, doc: (tmp_path / "threads" / name).write_text(json.dumps(doc))
    put("T-1.json", {"id": "a", "created": T0, "messages": messages, "usageLedger": {"events": ledger}, "meta": {"traces": [{"endTime": at(8)}]}})
    put("T-2.json", {"messages": messages[:2] + [said(9, 5, model="m", usage={"outputTokens": 4, "maxInputTokens": 100})]})
    put("T-3.json", {"id": "c"})
    graph, counters = stores.amp(spark, str(tmp_path))
    assert counters.collect()[0].asDict() == {"malformed": 3, "duplicates": 0}
    columns = ["sequence", "turn_no", "model", "uncached_input_tokens", "cached_input_tokens", "cache_write_input_tokens", "visible_output_tokens", "unattributed_tokens"]
    assert rows(graph.calls.where("external_id = 'a'"), *columns) == [(1, 1, "gpt-x", 13, 3, 0, 2, 0), (2, 1, "c", 5, 3, 8, 0, 74), (3, None, "c", 4, 0, 0, 0, 0)]
    assert [minute(r.timestamp_ms) for r in graph.calls.where("external_id = 'a'").orderBy("sequence").collect()] == [9, None, None]
    assert rows(graph.calls.where("external_id = 'T-2'"), *columns) == [(1, 1, "unknown", 1, 3, 8, 0, 0), (2, 1, "m", 0, 0, 0, 4, 0)]
    assert rows(graph.samples, "external_id", "input_tokens", "window_tokens") == [("T-2", 0, 100)]
    assert rows(graph.turns, "external_id", "turn_key", "status", "model_calls", "tool_calls") == [("T-2", "1", "completed", 2, 1), ("a", "1", "completed", 2, 1), ("a", "u2", "aborted", 0, 0)]
    (c,) = graph.conversations.where("external_id = 'a'").collect()
    assert (minute(c.started_ms), minute(c.ended_ms), c.event_count) == (0, 8, 12)


def test_compatibility(spark, tmp_path):
    lines(tmp_path / "a/session-state/1/events.jsonl", [{"type": "session.start", "data": {"sessionId": "s"}}])
    lines(tmp_path / "b/session-state/1/events.jsonl", ["{"])
    lines(tmp_path / "c/session-state/1/events.jsonl", [""])
    assert [registry.compatibility(spark, "copilot", f"{tmp_path}/{x}") for x in "abcd"] == ["compatible", "degraded", "detected", "no-data"]


def test_sqlite_files(spark, tmp_path):
    for i, columns in enumerate(("id INTEGER, name TEXT, more REAL", "id INTEGER", "ID INTEGER, name BLOB")):
        db = sqlite3.connect(tmp_path / f"s{i}.db")
        db.execute(f"CREATE TABLE t ({columns})")
        db.execute("INSERT INTO t (id) VALUES (?)", (i,))
        if "name TEXT" in columns:
            db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(k, "é" * (k % 3), k / 2) for k in range(10, 10_010)])
        db.commit()
        db.close()
    other = sqlite3.connect(tmp_path / "s9.db")
    other.execute("CREATE TABLE u (id INTEGER)")
    other.close()
    df = sqlite.read_sqlite(spark, f"{tmp_path}/s*.db", "t", "id bigint, name string, more double, _file string")
    assert df.rdd.getNumPartitions() == 4 and df.count() == 10_003
    assert rows(df.where("id < 10"), "id", "name", "more") == [(0, None, None), (1, None, None), (2, None, None)]
    assert df.where("more IS NOT NULL").agg(F.sum("more"), F.sum(F.length("name"))).first() == (sum(k / 2 for k in range(10, 10_010)), sum(k % 3 for k in range(10, 10_010)))
    assert df.select("_file").distinct().count() == 3
    with pytest.raises(Exception, match="longer than 3 bytes"):
        sqlite.read_sqlite(spark, f"{tmp_path}/s*.db", "t", "name string", longest=3).count()
    assert sqlite.read_sqlite(spark, f"{tmp_path}/none*.db", "t", "id bigint").count() == 0
