import json

from tallyloom.sources import connectors

DAY = "2026-08-01T10:00:0{}Z"


def line(kind, second, payload=None):
    return {"timestamp": DAY.format(second), "message": {"type": kind, "payload": payload or {}}}


def test_kimi_wire_log(spark, tmp_path):
    events = [
        {"type": "metadata", "protocol_version": "1"},
        line("TurnBegin", 0),
        line("StatusUpdate", 1, {"token_usage": {"input_other": 100, "input_cache_read": 40, "input_cache_creation": True, "output": 20, "total": 170}, "context_tokens": 160, "max_context_tokens": 1000}),
        line("ToolCall", 2, {"function": {"name": "shell"}, "secret": "CANARY"}),
        line("StepInterrupted", 3),
        line("TurnBegin", 4),
        line("CompactionEnd", 5),
        line("TurnEnd", 6),
        line("StatusUpdate", 7, {"token_usage": {"input_other": "7", "output": 5.9}}),
    ]
    folder = tmp_path / "sessions" / "a" / "s1"
    folder.mkdir(parents=True)
    (folder / "wire.jsonl").write_text("\n".join(map(json.dumps, events)) + "\nnot json\n[1]\n\n")
    poorer = tmp_path / "sessions" / "b" / "s1"
    poorer.mkdir(parents=True)
    (poorer / "wire.jsonl").write_text(json.dumps(line("TurnBegin", 0)) + "\n")
    g, counters = connectors.kimi(spark, str(tmp_path), "m")
    assert tuple(counters.first()) == (2, 1)
    (c,) = g.conversations.collect()
    assert (c.external_id, c.machine, c.iterations, c.model_calls, c.tool_calls, c.compactions, c.event_count, c.duration_ms, c.models) == ("s1", "m", 2, 2, 1, 1, 8, 7000, ["unknown"])
    assert (c.input_tokens, c.cached_input_tokens, c.output_tokens, c.unattributed_tokens, c.total_tokens) == (140, 40, 25, 10, 175)
    one, two = sorted(g.turns.collect(), key=lambda r: r.turn_no)
    assert (one.status, one.duration_ms, one.model_calls, one.tool_calls, one.total_tokens) == ("completed", 3000, 1, 1, 170)
    assert (two.status, two.duration_ms, two.model_calls, two.total_tokens) == ("completed", 2000, 1, 5)
    assert [(r.turn_no, r.sequence, r.total_tokens) for r in g.calls.orderBy("sequence").collect()] == [(1, 1, 170), (2, 2, 5)]
    assert [(r.turn_no, r.tool) for r in g.tools.collect()] == [(1, "shell")]
    assert [(r.input_tokens, r.window_tokens) for r in g.samples.collect()] == [(160, 1000)]
    assert "CANARY" not in str([df.collect() for df in (g.conversations, g.turns, g.calls, g.tools)])


def test_plandex_messages(spark, tmp_path):
    folder = tmp_path / "orgs" / "o" / "plans" / "p1" / "conversation"
    folder.mkdir(parents=True)
    messages = [
        {"id": "m1", "role": "user", "createdAt": DAY.format(0), "num": 1},
        {"id": "m2", "role": "assistant", "createdAt": DAY.format(2), "tokens": 50, "stopped": True},
        {"id": "m3", "role": "system"},
    ]
    for m in messages:
        (folder / f"{m['id']}.json").write_text(json.dumps(m))
    (folder / "bad.json").write_text("{")
    g, counters = connectors.plandex(spark, str(tmp_path))
    assert tuple(counters.first()) == (2, 0)
    (t,) = g.turns.collect()
    assert (t.turn_key, t.status, t.duration_ms, t.unattributed_tokens, t.total_tokens) == ("m1", "aborted", 2000, 50, 50)
    (c,) = g.conversations.collect()
    assert (c.external_id, c.event_count, c.model_calls, c.input_tokens) == ("p1", 2, 1, 0)
