"""Each dialect on small logs written here, with expected values worked out by hand."""

import json
import sqlite3
import zipfile

import pytest

from loomlark.sources import dialects as D
from loomlark.sources import scan


def lines(spark, *records, path="/logs/a.jsonl"):
    text = "\n".join(r if isinstance(r, str) else json.dumps(r) for r in records)
    return scan.numbered(spark.createDataFrame([(path, text)], "path string, text string"))


def docs(spark, files):
    return spark.createDataFrame([(p, t if isinstance(t, str) else json.dumps(t)) for p, t in files.items()], "path string, text string")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def claude(kind, message, s, **more):
    return {"type": kind, "sessionId": "S", "timestamp": f"2026-01-02T03:04:{s:02d}Z", "cwd": "/w/p", "message": message, **more}


def test_claude(spark):
    use = {"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "/w/p/a.py"}}
    bash = {"type": "tool_use", "id": "t2", "name": "Bash", "input": {"command": "ls\npwd"}}
    spent = {"input_tokens": 10, "output_tokens": 5, "cache_read_input_tokens": 3, "cache_creation_input_tokens": 2}
    t = D.claude(lines(
        spark,
        claude("user", {"role": "user", "content": "Please read it"}, 0, version="1", gitBranch="main"),
        "", "not json", {"type": "user", "sessionId": "S"},
        claude("assistant", {"role": "assistant", "model": "m-1", "usage": spent, "content": [{"type": "text", "text": " Sure "}, use, bash]}, 1),
        claude("user", {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1"}, {"type": "tool_result", "tool_use_id": "t2", "is_error": True}, {"type": "tool_result", "tool_use_id": "gone"}]}, 2),
        claude("user", {"role": "user", "content": "<command>hidden</command>"}, 3),
        claude("user", {"role": "user", "content": "meta"}, 3, isMeta=True),
        claude("assistant", {"role": "assistant", "model": "m-1", "usage": spent, "content": [{"type": "thinking", "thinking": "hm"}]}, 4),
        claude("queue-operation", {}, 5, content="x <summary> done it </summary>"),
    ))
    s = one(t.sessions)
    assert (s.session_id, s.project_path, s.version, s.git_branch, s.model, s.tool) == ("S", "/w/p", "1", "main", "m-1", "claude")
    assert (s.user_messages, s.assistant_messages, s.tool_calls, s.tool_errors) == (1, 1, 2, 1)
    assert (s.input_tokens, s.output_tokens, s.cache_read_tokens, s.cache_creation_tokens) == (20, 10, 6, 4)
    assert s.files_read == ["/w/p/a.py"] and s.files_written == [] and s.duration_seconds == 5 and s.session_kind == "human"
    m = t.messages.orderBy("seq").collect()
    assert [(x.role, [b.type for b in x.content]) for x in m] == [
        ("user", ["text"]), ("assistant", ["model_change", "text", "tool_use", "tool_use"]), ("user", ["tool_result", "tool_result"]), ("assistant", ["thinking"]), ("system", ["queue_operation"]),
    ]
    result = m[2].content
    assert (result[0].name, result[0].success, result[0].summary) == ("Read", True, 'file="/w/p/a.py"')
    assert (result[1].name, result[1].success, result[1].summary) == ("Bash", False, "ls ↵ pwd")
    e = t.events.orderBy("sequence").collect()
    assert e[0].event_id == "evt-000001" and {x.event_kind for x in e} >= {"message", "tool_call", "tool_result", "meta_record", "queue_operation", "model_change"}


def test_codex(spark):
    r = lambda kind, s, **p: {"type": kind, "timestamp": f"2026-01-02T03:04:{s:02d}Z", "payload": p}
    count = lambda s, i, c, o, q: r("event_msg", s, type="token_count", info={"total_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "reasoning_output_tokens": q, "total_tokens": i + o}})
    t = D.codex(lines(
        spark,
        r("session_meta", 0, id="C1", cwd="/w", cli_version="9", git={"branch": "dev"}),
        r("turn_context", 1, model="gpt-5"), r("turn_context", 2, model="gpt-5"),
        r("event_msg", 2, type="user_message", message='<context ref="x">drop</context>Fix [@a](b) it'),
        r("response_item", 3, type="message", role="user", content=[]),
        r("response_item", 3, type="function_call", call_id="c", name="shell", arguments='{"command": ["cat", "x.txt", "|", "wc"]}'),
        r("response_item", 4, type="function_call_output", call_id="c", output='{"exit_code": 1}'),
        count(5, 5000, 1000, 100, 1), r("event_msg", 5, type="token_count", info=None), count(6, 10000, 6000, 700, 100),
        r("response_item", 7, type="message", role="assistant", content=[{"type": "output_text", "text": "ok"}]),
    ))
    s = one(t.sessions)
    assert (s.session_id, s.git_branch, s.model, s.user_messages, s.assistant_messages, s.tool_calls, s.tool_errors) == ("C1", "dev", "gpt-5", 1, 1, 1, 1)
    assert (s.input_tokens, s.cache_read_tokens, s.output_tokens) == (10000, 6000, 800)
    assert s.files_read == ["x.txt"] and s.first_user_text == "Fix it" and s.duration_seconds == 7
    kinds = [b.type for m in t.messages.orderBy("seq").collect() for b in m.content]
    assert kinds == ["model_change", "text", "tool_result", "text"]
    assert D.codex(lines(spark, r("turn_context", 1, model="x"))).sessions.count() == 0


def test_pi(spark):
    r = lambda kind, s, **p: {"type": kind, "timestamp": f"2026-01-02T03:04:{s:02d}Z", **p}
    t = D.pi(lines(
        spark, r("session", 0, version="1", id="P", cwd="/w"), r("model_change", 1, provider="acme", modelId="m"),
        r("message", 2, message={"role": "user", "content": [{"type": "text", "text": "hi"}]}),
        r("message", 3, message={"role": "assistant", "usage": {"input": 1, "output": 2, "cacheRead": 3, "cacheWrite": 4}, "content": [{"type": "toolCall", "id": "1", "name": "read", "arguments": {"path": "a"}}]}),
        r("message", 4, message={"role": "toolResult", "toolCallId": "1", "toolName": "read", "content": [{"type": "text", "text": "x"}]}),
        r("message", 5, message={"role": "toolResult", "toolCallId": "2", "toolName": "late", "isError": True, "content": []}),
    ))
    s = one(t.sessions)
    assert (s.model, s.tool_calls, s.tool_errors, s.files_read, s.input_tokens, s.cache_creation_tokens) == ("acme/m", 2, 1, ["a"], 1, 4)
    names = [b.name for m in t.messages.orderBy("seq").collect() for b in m.content if b.type == "tool_result"]
    assert names == ["read", "late"]


@pytest.mark.parametrize(("total", "expected"), [(1300, 400), (9999, 1000)])
def test_grok(spark, total, expected):
    d = "/g/%2Fw%2Fp/0190a000-0000-7000-8000-000000000000"
    t = D.grok(
        lines(
            spark, {"type": "user", "content": "<user_info>x</user_info>"}, {"type": "user", "content": [{"type": "text", "text": "<user_query> go </user_query>"}]},
            {"type": "assistant", "content": "fine", "model_id": "g", "tool_calls": [{"id": "1", "name": "Read", "arguments": '{"path": "a"}'}]},
            {"type": "tool_result", "tool_call_id": "1", "content": "Exit code: 2"}, {"type": "tool_result", "tool_call_id": "?", "content": "Exit code: 0"}, path=f"{d}/chat_history.jsonl",
        ),
        lines(spark, {"params": {"update": {"sessionUpdate": "turn_completed", "usage": {"inputTokens": 1000, "outputTokens": 300, "cachedReadTokens": 600, "cacheCreationTokens": 60, "totalTokens": total}}}}, path=f"{d}/updates.jsonl"),
        docs(spark, {f"{d}/signals.json": {"contextTokensUsed": 5, "contextWindowTokens": 10}}),
        docs(spark, {f"{d}/summary.json": {"info": {"id": "G"}, "generated_title": "T"}}),
    )
    s = one(t.sessions)
    assert (s.session_id, s.title, s.user_messages, s.assistant_messages, s.tool_calls, s.tool_errors, s.model) == ("G", "T", 1, 1, 1, 1, "g")
    assert (s.input_tokens, s.output_tokens, s.cache_read_tokens, s.cache_creation_tokens, s.context_used, s.context_window) == (expected, 300, 600, 60, 5, 10)
    assert s.project_path == "/w/p" and s.files_read == [] and s.started_at.year == 2024


def test_cursor(spark):
    from pyspark.sql import functions as F

    path = "/c/projects/w-p/agent-transcripts/x.jsonl"
    rows = lines(spark, {"role": "user", "message": {"content": [{"type": "text", "text": "do"}]}}, {"role": "assistant", "message": {"content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "name": "Read", "input": {"path": "a"}}]}}, path=path)
    t = D.cursor(rows, spark.createDataFrame([(path,)], "path string").withColumn("modified", F.lit("2026-01-01").cast("timestamp")))
    s = one(t.sessions)
    assert (s.project_path, s.user_messages, s.assistant_messages, s.tool_calls, s.tool_errors, s.files_read, s.duration_seconds) == ("/w/p", 1, 1, 1, 0, ["a"], 0)
    assert t.events.where("event_kind = 'tool_call'").first().tool_call_id == "cursor-tool-1"


def test_kimi(spark):
    loop = lambda at, **e: {"type": "context.append_loop_event", "event": e, "time": at}
    t = D.kimi(lines(
        spark, {"type": "metadata", "created_at": 1000}, {"type": "config.update", "modelAlias": "k"}, {"type": "turn.prompt", "input": [{"type": "text", "text": "q"}]},
        {"type": "context.append_message", "message": {"role": "user", "content": "inject"}},
        loop(2000, type="content.part", part={"type": "think", "think": "t"}), loop(3000, type="content.part", part={"type": "text", "text": "a"}),
        loop(3100, type="tool.call", toolCallId="1", name="Bash", args={"command": "ls"}), loop(3200, type="tool.result", toolCallId="1", result={"output": "", "isError": True}),
        loop(4000, type="step.end", time=9000, usage={"inputOther": 1, "output": 2, "inputCacheRead": 3, "inputCacheCreation": 4}), path="/k/S/agents/main/wire.jsonl",
    ))
    s = one(t.sessions)
    assert (s.session_id, s.model, s.user_messages, s.assistant_messages, s.tool_calls, s.tool_errors, s.input_tokens, s.duration_seconds) == ("S", "k", 2, 2, 0, 1, 0, 8)
    last = t.messages.orderBy("seq").collect()[-1]
    assert last.content[0].name == "Bash" and last.usage.output_tokens == 2
    assert [e.sequence for e in t.events.orderBy("sequence").collect()] == [1, 3]


def test_hermes_database_and_legacy(spark, tmp_path):
    db = tmp_path / "state.db"
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE sessions(id TEXT, source TEXT, model TEXT, title TEXT, started_at REAL, ended_at REAL, input_tokens INT, output_tokens INT, cache_read_tokens INT, cache_write_tokens INT, estimated_cost_usd REAL, actual_cost_usd REAL)")
        c.execute("CREATE TABLE messages(id INT, session_id TEXT, role TEXT, content TEXT, tool_call_id TEXT, tool_calls TEXT, tool_name TEXT, timestamp REAL, finish_reason TEXT, reasoning TEXT, reasoning_content TEXT)")
        c.execute("INSERT INTO sessions VALUES ('h', 'cli', 'm', 't', 100.0, 160.0, 7, 8, 9, NULL, 0.5, NULL), ('empty', 'cli', NULL, NULL, 1.0, NULL, 0, 0, 0, 0, NULL, NULL)")
        call = json.dumps([{"id": "1", "function": {"name": "read_file", "arguments": '{"path": "a"}'}}])
        c.execute("INSERT INTO messages VALUES (1, 'h', 'user', 'hello', NULL, NULL, NULL, 101.0, NULL, NULL, NULL), (2, 'h', 'assistant', NULL, NULL, ?, NULL, 102.0, NULL, NULL, 'why'), (3, 'h', 'tool', 'Error: no', '1', NULL, NULL, 103.0, NULL, NULL, NULL)", [call])
    s = scan.sqlite(spark, [str(db)], "SELECT * FROM sessions", "id string, source string, model string, title string, started_at double, ended_at double, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, estimated_cost_usd double, actual_cost_usd double")
    m = scan.sqlite(spark, [str(db)], "SELECT session_id, id, role, content, tool_call_id, tool_calls, tool_name, timestamp, finish_reason, reasoning, reasoning_content FROM messages", "session_id string, id long, role string, content string, tool_call_id string, tool_calls string, tool_name string, timestamp double, finish_reason string, reasoning string, reasoning_content string")
    t = D.hermes(s, m)
    r = one(t.sessions)
    assert (r.session_id, r.project_path, r.user_messages, r.assistant_messages, r.tool_calls, r.tool_errors, r.input_tokens, r.cost, r.duration_seconds, r.files_read) == ("h", "hermes:cli", 1, 1, 1, 1, 7, 0.5, 60, ["a"])
    assert [x.role for x in t.messages.orderBy("seq").collect()] == ["user", "assistant", "system"]
    legacy = {"session_id": "L", "session_start": "2026-01-01T00:00:00", "last_updated": "2026-01-01T00:01:00", "platform": "web", "model": "m", "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}
    ls, lm = D.hermes_legacy(docs(spark, {"/h/sessions/session_1.json": legacy, "/h/sessions/session_2.json": legacy | {"session_id": "h"}}), s.select("id"))
    assert one(D.hermes(ls, lm).sessions).session_id == "L"


def test_opencode(spark):
    part = lambda text, **k: {"type": "text", "text": text, **k}
    tool = lambda code: {"type": "tool", "tool": "read", "state": {"status": "completed", "title": "t", "input": {"filePath": "a"}, "metadata": {"exit": code}}}
    t = D.opencode(
        docs(spark, {"/o/session/p/s.json": {"id": "s", "directory": "/w", "title": "T", "time": {"created": 1000.0}}}),
        docs(spark, {"/o/message/s/m2.json": {"id": "m2", "role": "assistant", "modelID": "x", "cost": 2.0, "time": {"created": 3000.0, "completed": 5000.0}, "tokens": {"input": 13, "output": 9, "cache": {"read": 3, "write": 5}}}, "/o/message/s/m1.json": {"id": "m1", "role": "user", "time": {"created": 2000.0}}}),
        docs(spark, {"/o/part/m1/a.json": part("ask"), "/o/part/m1/b.json": part("ctx", synthetic=True), "/o/part/m1/c.json": part("Called the tool"), "/o/part/m2/b.json": tool(0), "/o/part/m2/c.json": tool(1), "/o/part/m2/a.json": part("answer")}),
    )
    s = one(t.sessions)
    assert (s.user_messages, s.assistant_messages, s.tool_calls, s.tool_errors, s.input_tokens, s.output_tokens, s.cache_read_tokens, s.cache_creation_tokens, s.cost, s.duration_seconds, s.model) == (1, 1, 2, 1, 13, 9, 3, 5, 2.0, 4, "x")
    assert [x.role for x in t.messages.orderBy("seq").collect()] == ["user", "system", "assistant"]


def test_chat_export_as_json_and_zip(spark, tmp_path):
    block = lambda kind, **k: {"type": kind, **k}
    export = [
        {"uuid": "u1", "name": "Talk", "summary": " S ", "created_at": "2026-01-01T00:00:00Z", "chat_messages": [
            {"sender": "human", "text": "hello", "content": [], "created_at": "2026-01-01T00:00:01Z"},
            {"sender": "assistant", "text": "", "created_at": "2026-01-01T00:00:02Z", "content": [block("thinking", thinking="t"), block("tool_use", name="web", id=None, input={"q": 1}), block("tool_result", tool_use_id=None, name="web", content=[]), block("text", text="bye")]}]},
        {"uuid": "", "chat_messages": []},
    ]
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("nested/conversations.json", "[]")
        z.writestr("conversations.json", json.dumps(export))
    for source in (docs(spark, {"/x/conversations.json": export}), scan.zip_members(spark, str(tmp_path))):
        t = D.chat_export(source)
        s = one(t.sessions)
        assert (s.session_id, s.title, s.user_messages, s.assistant_messages, s.tool_calls, s.duration_seconds) == ("u1", "Talk", 1, 1, 1, 2)
        assert [[b.type for b in m.content] for m in t.messages.orderBy("seq").collect()] == [["summary"], ["text"], ["thinking", "tool_use", "tool_result", "text"]]
        assert t.events.where("event_kind = 'tool_use'").first().tool_call_id.startswith("claude-chat-tool-")


def test_detection_and_selectors(spark, tmp_path):
    from pyspark.sql import functions as F

    cases = {
        ("/x/.hermes/state.db", ""): "hermes", ("/x/hermes/a.json", ""): "hermes", ("/x/rollout-1.jsonl", '{"sessionId":1}'): "codex", ("/x/.codex/a.txt", ""): "codex", ("/x/.grok/sessions/s/chat_history.jsonl", ""): "grok", ("/x/.kimi-code/agents/a/wire.jsonl", ""): "kimi", ("/x/agent-transcripts/a.jsonl", ""): "cursor",
        ("/x/opencode/session/a.json", ""): "opencode", ("/x/.pi/agent/sessions/a.jsonl", ""): "pi", ("/x/local-agent-mode-sessions/a.json", ""): "claude",
        ("/x/a.jsonl", '{"type":"session_meta"}'): "codex", ("/x/a.jsonl", '{"type":"response_item"}'): "codex", ("/x/a.jsonl", '{"type":"session","id":"1","cwd":"/"}'): "pi", ("/x/a.jsonl", '{"platform":"cli","model":"m"}'): "hermes", ("/x/a.jsonl", '{"role":"user","message":{}}'): "cursor",
        ("/x/a.jsonl", '{"type":"metadata","protocol_version":1}'): "kimi", ("/x/a.jsonl", '{"type":"system"}'): "grok", ("/x/a.jsonl", '{"type":"assistant","tool_calls":[]}'): "grok", ("/x/a.jsonl", '{"type":"tool_result"}'): "grok", ("/x/a.jsonl", '{"type":"system","sessionId":"1"}'): "claude", ("/x/a.jsonl", "{}"): "claude", ("/x/a.jsonl", None): "claude",
        ("/x/e.zip", ""): None, ("/x/state.db", ""): None, ("/x/notes.txt", '{"sessionId":1}'): None,
    }
    rows = spark.createDataFrame([(p, f, want) for (p, f), want in cases.items()], "p string, f string, want string")
    assert rows.where(~scan.detect(F.col("p"), F.col("f")).eqNullSafe(F.col("want"))).collect() == []
    firsts = spark.createDataFrame([("\n  \n a b\nc", "a b"), ("x", "x"), ("", ""), (" \r\n", "")], "t string, want string")
    assert firsts.where(scan.first_line(F.col("t")) != F.col("want")).collect() == []
    tmp_path = tmp_path / "x.bak"  # only the file's own name counts
    tmp_path.mkdir()
    for name, text in (("a.jsonl", "x\n\ny\n"), ("a.bak.jsonl", "x"), ("empty.jsonl", ""), ("b.txt", "x")):
        (tmp_path / name).write_text(text)
    files = scan.texts(spark, str(tmp_path), "claude")
    assert [r.path.rsplit("/", 1)[1] for r in files.collect()] == ["a.jsonl"]
    assert [(r.pos, r.line) for r in scan.numbered(files).orderBy("pos").collect()] == [(1, "x"), (3, "y")]
