"""One ingestion query for each log dialect: conversations written as its logs, with tool calls, failing results, results without a call
and sibling files, and read back as sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlark.plans.registry import Registry, table
from loomlark.sources import dialects, scan
from loomlark.sources.model import Tables

R = Registry()

#: Each assistant turn calls a tool that reads one of three files; every third call fails; in every fourth conversation a result has no call.
_T = """t AS (SELECT conv_id, turn, role, text, (conv_id + turn) % 3 = 0 AS bad, conv_id % 4 = 0 AS gone, 'f' || (turn % 3) AS f, 'm' || (9 - turn // 4) AS m, role = 'user' AS u, role = 'assistant' AS a FROM conversations)"""
_FILES = "coalesce(string_agg(DISTINCT f, ',' ORDER BY f) FILTER ({}), '') AS files"
_MODELS = "coalesce(string_agg(DISTINCT m, ',' ORDER BY m DESC) FILTER (a), '') AS models"


def _turns(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def _o(**fields) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


class _Turn:
    """Column expressions of a turn."""

    def __init__(self) -> None:
        conv, turn = F.col("conv_id"), F.col("turn")
        text = lambda c: c.cast("string")
        self.user, self.assistant, self.any = F.col("role") == "user", F.col("role") == "assistant", F.lit(True)
        self.first = turn == 0
        self.bad, self.gone = (conv + turn) % 3 == 0, self.assistant & (conv % 4 == 0)
        self.file, self.call = F.concat(F.lit("f"), text(turn % 3)), F.concat(F.lit("t"), text(turn))
        self.model = F.concat(F.lit("m"), text(9 - F.floor(turn / 4)))
        self.seconds = F.lit(1767225600) + conv * 3600 + turn * 7
        self.stamp = F.date_format(F.timestamp_seconds(self.seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        self.name = F.concat(F.lit("c"), text(conv))
        self.text, self.turn, self.length = F.col("text"), turn, F.length("text")

    def path(self, before: str, after: str) -> Column:
        return F.concat(F.lit(before), F.col("conv_id").cast("string"), F.lit(after))


def _lines(turns: DataFrame, path: Column, *records: tuple[int, Column, Column]) -> DataFrame:
    """path, pos, line: records (offset within the turn, condition, object)."""
    made = [F.when(when, F.struct((F.col("turn") * 10 + k + 1).cast("int").alias("pos"), F.to_json(record).alias("line"))) for k, when, record in records]
    return turns.select(path.alias("path"), F.inline(F.array_compact(F.array(*made))))


def _documents(turns: DataFrame, path: Column, record: Column) -> DataFrame:
    return turns.select(path.alias("path"), F.to_json(record).alias("text"))


def _facts(t: Tables, *more: Column | str) -> DataFrame:
    """Session facts with sets as text, and the number of events of each session."""
    events = t.events.groupBy(F.col("path").alias("_p")).agg(F.count("*").alias("events"))
    joined = lambda c, name: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",").alias(name)
    s = t.sessions.join(events, F.col("path") == F.col("_p"), "left")
    return s.select("session_id", "user_messages", "assistant_messages", "tool_calls", "tool_errors", "input_tokens", "output_tokens", joined(F.col("files_read"), "files"), joined(F.col("models_seen"), "models"), F.coalesce("events", F.lit(0)).alias("events"), *more)


@R.add(f"""
WITH {_T} SELECT 'c' || conv_id AS session_id, count(*) FILTER (u) AS user_messages, count(*) FILTER (a) AS assistant_messages, count(*) FILTER (a) AS tool_calls, count(*) FILTER (a AND bad) AS tool_errors,
  coalesce(sum(length(text)) FILTER (a), 0)::BIGINT AS input_tokens, coalesce(sum(turn) FILTER (a), 0)::BIGINT AS output_tokens, {_FILES.format('a AND NOT bad')}, {_MODELS},
  (count(*) FILTER (u) + 3 * count(*) FILTER (a) + count(DISTINCT m) FILTER (a))::BIGINT AS events, (max(turn) * 7)::BIGINT AS duration_seconds, coalesce(arg_max(m, turn) FILTER (a), '') AS model FROM t GROUP BY conv_id""")
def ingest_claude(spark, sf_dir):
    c = _Turn()
    head = {"sessionId": c.name, "timestamp": c.stamp, "cwd": "/w/p"}
    null = lambda kind: F.lit(None).cast(kind)
    said = _o(type="text", text=c.text, id=null("string"), name=null("string"), input=null("struct<file_path:string>"))
    use = _o(type="tool_use", text=null("string"), id=c.call, name="Read", input=_o(file_path=c.file))
    results = F.array_compact(F.array(_o(type="tool_result", tool_use_id=c.call, is_error=c.bad), F.when(c.gone, _o(type="tool_result", tool_use_id="gone", is_error=F.lit(True)))))
    lines = _lines(
        _turns(spark, sf_dir), c.path("/l/", ".jsonl"),
        (0, c.user, _o(type="user", **head, message=_o(role="user", content=c.text))),
        (0, c.assistant, _o(type="assistant", **head, message=_o(role="assistant", model=c.model, usage=_o(input_tokens=c.length, output_tokens=c.turn), content=F.array(said, use)))),
        (1, c.assistant, _o(type="user", **head, message=_o(role="user", content=results))),
        (0, ~c.user & ~c.assistant, _o(type="system", **head, message=_o(role="system"))),
        (2, c.user, _o(type="user", **head, message=_o(role="user", content="<injected>not a user's</injected>"))),
    )
    events = _facts(dialects.claude(lines), "duration_seconds", F.coalesce("model", F.lit("")).alias("model"))
    # injected texts stay training events
    return events.withColumn("events", F.col("events") - F.col("user_messages"))


@R.add(f"""
WITH {_T} SELECT 'c' || conv_id AS session_id, count(*) FILTER (u) AS user_messages, count(*) FILTER (a) AS assistant_messages, count(*) FILTER (a) AS tool_calls, count(*) FILTER (a AND bad) AS tool_errors,
  coalesce(max(turn) FILTER (a) * 10 + 5, 0)::BIGINT AS input_tokens, coalesce(max(turn) FILTER (a) * 2 + 1, 0)::BIGINT AS output_tokens, {_FILES.format('a')}, {_MODELS},
  (count(*) FILTER (u) + 3 * count(*) FILTER (a) + count(DISTINCT m) FILTER (a))::BIGINT AS events, coalesce(max(turn) FILTER (a), 0)::BIGINT AS cache_read_tokens, 'dev' AS git_branch FROM t GROUP BY conv_id""")
def ingest_codex(spark, sf_dir):
    """Cumulative counters, of which the last stands; files from shell commands; a cleaned prompt."""
    c = _Turn()
    record = lambda kind, **p: _o(type=kind, timestamp=c.stamp, payload=_o(**p))
    usage = _o(input_tokens=c.turn * 10 + 5, cached_input_tokens=c.turn, output_tokens=c.turn * 2, reasoning_output_tokens=1, total_tokens=c.turn * 12 + 5)
    command = F.to_json(_o(command=F.array(F.lit("cat"), c.file, F.lit("|"), F.lit("wc"))))
    lines = _lines(
        _turns(spark, sf_dir), c.path("/l/rollout-", ".jsonl"),
        (0, c.first, record("session_meta", id=c.name, cwd="/w", cli_version="1", git=_o(branch="dev"))),
        (1, c.assistant, record("turn_context", model=c.model)),
        (2, c.user, record("event_msg", type="user_message", message=F.concat(F.lit('<context ref="x">injected</context> '), c.text))),
        (3, c.user, record("response_item", type="message", role="user", content=F.array(_o(type="input_text", text=c.text)))),
        (3, c.assistant, record("response_item", type="message", role="assistant", content=F.array(_o(type="output_text", text=c.text)))),
        (4, c.assistant, record("response_item", type="function_call", call_id=c.call, name="shell", arguments=command)),
        (5, c.assistant, record("response_item", type="function_call_output", call_id=c.call, output=F.when(c.bad, '{"exit_code": 2}').otherwise("fine"))),
        (6, c.gone, record("response_item", type="function_call_output", call_id="gone", output='{"exit_code": 1}')),
        (7, c.assistant, record("event_msg", type="token_count", info=_o(total_token_usage=usage))),
    )
    return _facts(dialects.codex(lines), "cache_read_tokens", "git_branch")


@R.add(f"""
WITH {_T} SELECT 'c' || conv_id AS session_id, count(*) FILTER (u) AS user_messages, count(*) FILTER (a) AS assistant_messages, (count(*) FILTER (a) + count(*) FILTER (a AND gone))::BIGINT AS tool_calls,
  (count(*) FILTER (a AND bad) + count(*) FILTER (a AND gone))::BIGINT AS tool_errors, coalesce(sum(length(text)) FILTER (a), 0)::BIGINT AS input_tokens, coalesce(sum(turn) FILTER (a), 0)::BIGINT AS output_tokens,
  {_FILES.format('a AND NOT bad')}, coalesce(string_agg(DISTINCT 'acme/' || m, ',' ORDER BY 'acme/' || m DESC) FILTER (a), '') AS models,
  (count(*) FILTER (u) + 3 * count(*) FILTER (a) + count(*) FILTER (a AND gone) + count(DISTINCT m) FILTER (a))::BIGINT AS events FROM t GROUP BY conv_id""")
def ingest_pi(spark, sf_dir):
    """Provider and model combined; a result without a call keeps its own tool's name."""
    c = _Turn()
    message = lambda **m: _o(type="message", timestamp=c.stamp, message=_o(**m))
    null = F.lit(None).cast("string")
    blocks = F.array(_o(type="text", text=c.text, id=null, name=null, arguments=F.lit(None).cast("struct<path:string>")), _o(type="toolCall", text=null, id=c.call, name="read", arguments=_o(path=c.file)))
    lines = _lines(
        _turns(spark, sf_dir), c.path("/l/", ".jsonl"),
        (0, c.first, _o(type="session", timestamp=c.stamp, version="1", id=c.name, cwd="/w")),
        (1, c.assistant, _o(type="model_change", timestamp=c.stamp, provider="acme", modelId=c.model)),
        (2, c.user, message(role="user", content=F.array(_o(type="text", text=c.text)))),
        (2, c.assistant, message(role="assistant", usage=_o(input=c.length, output=c.turn), content=blocks)),
        (3, c.assistant, message(role="toolResult", toolCallId=c.call, toolName="read", isError=c.bad, content=F.array(_o(type="text", text="x")))),
        (4, c.gone, message(role="toolResult", toolCallId="gone", toolName="late", isError=F.lit(True), content=F.array(_o(type="text", text="x")))),
    )
    return _facts(dialects.pi(lines))


@R.add(f"""
WITH {_T} SELECT 'c' || conv_id AS session_id, count(*) FILTER (u) AS user_messages, count(*) FILTER (a) AS assistant_messages, count(*) FILTER (a) AS tool_calls, count(*) FILTER (a AND bad) AS tool_errors,
  coalesce(sum(CASE WHEN turn % 2 = 0 THEN 900 ELSE 1000 END) FILTER (a), 0)::BIGINT AS input_tokens, (300 * count(*) FILTER (a))::BIGINT AS output_tokens, {_FILES.format('a AND NOT bad')}, {_MODELS},
  (count(*) FILTER (u) + count(*) FILTER (a) + count(*) FILTER (a AND gone))::BIGINT AS events, 5::BIGINT AS context_used, 10::BIGINT AS context_window, 'T' || conv_id AS title, '/w/p q' AS project_path FROM t GROUP BY conv_id""")
def ingest_grok(spark, sf_dir):
    """Sibling files by directory: usage of two schemas, context numbers, title; the project from an escaped directory."""
    c = _Turn()
    turns = _turns(spark, sf_dir)
    at = lambda name: c.path("/g/%2Fw%2Fp%20q/", f"/{name}")
    use = F.array(_o(id=c.call, name="Read", arguments=F.to_json(_o(path=c.file))))
    lines = _lines(
        turns, at("chat_history.jsonl"),
        (0, ~c.user & ~c.assistant, _o(type="system", content=c.text)),
        (0, c.user, _o(type="user", content=F.array(_o(type="text", text=F.concat(F.lit("<user_info>x</user_info><user_query> "), c.text, F.lit(" </user_query>")))))),
        (1, c.user, _o(type="user", content="<git_status>injected</git_status>")),
        (0, c.assistant, _o(type="assistant", content=c.text, model_id=c.model, tool_calls=use)),
        (1, c.assistant, _o(type="tool_result", tool_call_id=c.call, content=F.when(c.bad, "out\nExit code: 3").otherwise("Exit code: 0"))),
        (2, c.gone, _o(type="tool_result", tool_call_id="gone", content="fine")),
    )
    total = F.when(c.turn % 2 == 0, 1300).otherwise(1400)  # the input holds the cached tokens only where input and output make the total
    spent = _o(inputTokens=1000, outputTokens=300, cachedReadTokens=100, cacheCreationTokens=0, totalTokens=total)
    updates = _lines(turns, at("updates.jsonl"), (0, c.assistant, _o(params=_o(update=_o(sessionUpdate="turn_completed", usage=spent)))), (1, c.assistant, _o(params=_o(update=_o(sessionUpdate="other")))))
    first = turns.where(c.first)
    signals = _documents(first, at("signals.json"), _o(contextTokensUsed=5, contextWindowTokens=10))
    summaries = _documents(first, at("summary.json"), _o(info=_o(id=c.name), generated_title=F.concat(F.lit("T"), F.col("conv_id").cast("string"))))
    return _facts(dialects.grok(lines, updates, signals, summaries), "context_used", "context_window", "title", "project_path")


@R.add(f"""
WITH {_T} SELECT conv_id::VARCHAR AS session_id, count(*) FILTER (u) AS user_messages, count(*) FILTER (a) AS assistant_messages, count(*) FILTER (a) AS tool_calls, 0::BIGINT AS tool_errors, 0::BIGINT AS input_tokens, 0::BIGINT AS output_tokens,
  {_FILES.format('a')}, '' AS models, (count(*) FILTER (u) + count(*) FILTER (a))::BIGINT AS events, '/w/p' AS project_path FROM t GROUP BY conv_id HAVING count(*) FILTER (u OR a) > 0""")
def ingest_cursor(spark, sf_dir):
    """No times and no results; the project from a slug."""
    c = _Turn()
    null = F.lit(None).cast("string")
    blocks = F.array(_o(type="text", text=c.text, name=null, input=F.lit(None).cast("struct<path:string>")), _o(type="tool_use", text=null, name="Read", input=_o(path=c.file)))
    lines = _lines(
        _turns(spark, sf_dir), c.path("/c/projects/w-p/agent-transcripts/", ".jsonl"),
        (0, c.user, _o(role="user", message=_o(content=F.array(_o(type="text", text=F.concat(F.lit("<user_query>"), c.text, F.lit("</user_query>"))))))),
        (0, c.assistant, _o(role="assistant", message=_o(content=blocks))),
    )
    modified = lines.select("path").distinct().withColumn("modified", F.lit("2026-01-01").cast("timestamp"))
    return _facts(dialects.cursor(lines, modified), "project_path")


@R.add(f"""
WITH {_T} SELECT 'S' || conv_id AS session_id, (2 * count(*) FILTER (u))::BIGINT AS user_messages, (2 * count(*) FILTER (a))::BIGINT AS assistant_messages, (count(*) FILTER (a AND NOT bad) + count(*) FILTER (a AND gone))::BIGINT AS tool_calls,
  count(*) FILTER (a AND bad) AS tool_errors, 0::BIGINT AS input_tokens, 0::BIGINT AS output_tokens, '' AS files, {_MODELS},
  (count(*) FILTER (u) + count(*) FILTER (a) + count(*) FILTER (a AND gone))::BIGINT AS events, 'T' AS title, '/w' AS project_path, coalesce(sum(turn) FILTER (a), 0)::BIGINT AS message_output_tokens FROM t GROUP BY conv_id""")
def ingest_kimi(spark, sf_dir):
    """Thinking and injected messages count; usage belongs to the message before it; state in a sibling file three folders up."""
    c = _Turn()
    turns = _turns(spark, sf_dir)
    loop = lambda **e: _o(type="context.append_loop_event", time=c.seconds * 1000, event=_o(**e))
    lines = _lines(
        turns, c.path("/k/S", "/agents/main/wire.jsonl"),
        (0, c.first, _o(type="metadata", protocol_version=1, created_at=c.seconds * 1000)),
        (1, c.assistant, _o(type="config.update", modelAlias=c.model)),
        (1, c.user, _o(type="turn.prompt", time=c.seconds * 1000, input=F.array(_o(type="text", text=c.text)))),
        (2, c.user, _o(type="context.append_message", message=_o(role="user", content="injected"))),
        (2, c.assistant, loop(type="content.part", part=_o(type="think", think="hm"))),
        (3, c.assistant, loop(type="content.part", part=_o(type="text", text=c.text))),
        (4, c.assistant, loop(type="tool.call", toolCallId=c.call, name="ReadFile", args=_o(path=c.file))),
        (5, c.assistant, loop(type="tool.result", toolCallId=c.call, result=_o(output="x", isError=c.bad))),
        (6, c.gone, loop(type="tool.result", toolCallId="gone", result=_o(output="x"))),
        (7, c.assistant, loop(type="step.end", time=c.seconds * 1000, usage=_o(inputOther=1, output=c.turn))),
    )
    states = _documents(turns.where(c.first), c.path("/k/S", "/state.json"), _o(workDir="/w", title="T"))
    t = dialects.kimi(lines, states)
    spent = t.messages.groupBy(F.col("path").alias("_m")).agg(F.sum("usage.output_tokens").alias("_o"))
    t = Tables(t.sessions.join(spent, F.col("path") == F.col("_m"), "left"), t.messages, t.events)
    return _facts(t, "title", "project_path", F.coalesce("_o", F.lit(0)).alias("message_output_tokens"))


@R.add(f"""
WITH {_T} SELECT 'c' || conv_id AS session_id, count(*) FILTER (u) AS user_messages, count(*) FILTER (a) AS assistant_messages, count(*) FILTER (a) AS tool_calls, count(*) FILTER (a AND bad) AS tool_errors,
  CASE WHEN conv_id % 5 = 0 THEN 0 ELSE 7 END::BIGINT AS input_tokens, CASE WHEN conv_id % 5 = 0 THEN 0 ELSE 8 END::BIGINT AS output_tokens, {_FILES.format('a')}, 'base' AS models,
  (count(*) FILTER (u) + 3 * count(*) FILTER (a) + count(*) FILTER (a AND gone) + count(*) FILTER (NOT u AND NOT a))::BIGINT AS events, 'hermes:' || CASE WHEN conv_id % 5 = 0 THEN 'web' ELSE 'cli' END AS project_path FROM t GROUP BY conv_id""")
def ingest_hermes(spark, sf_dir):
    """The database's two tables, of which sessions without messages go, and legacy files, of which those that the database has go."""
    c = _Turn()
    turns = _turns(spark, sf_dir)
    conv = F.col("conv_id")
    null = lambda kind: F.lit(None).cast(kind)
    calls = F.to_json(F.array(_o(id=c.call, function=_o(name="read_file", arguments=F.to_json(_o(path=c.file))))))
    row = lambda when, k, role, content, call=null("string"), uses=null("string"): F.when(when, _o(id=c.turn * 10 + k, role=role, content=content, tool_call_id=call, tool_calls=uses, tool_name=null("string"), timestamp=c.seconds.cast("double"), finish_reason=null("string"), reasoning=null("string"), reasoning_content=null("string")))
    output = F.when(c.bad, "Error: no").otherwise("fine")
    made = F.array_compact(F.array(row(c.user, 0, "user", c.text), row(c.assistant, 0, "assistant", c.text, uses=calls), row(c.assistant, 1, "tool", output, c.call), row(c.gone, 2, "tool", F.lit("fine"), F.lit("gone")), row(~c.user & ~c.assistant, 0, "system", c.text)))
    stored = turns.where(conv % 5 != 0)
    first = lambda t: t.where(c.first)
    facts = {"source": "cli", "model": "base", "title": null("string"), "started_at": c.seconds.cast("double"), "ended_at": c.seconds.cast("double"), "input_tokens": F.lit(7).cast("long"), "output_tokens": F.lit(8).cast("long"), "cache_read_tokens": null("long"), "cache_write_tokens": null("long"), "estimated_cost_usd": F.lit(0.5), "actual_cost_usd": null("double")}
    sessions = first(stored).select(F.lit("/h/state.db").alias("path"), c.name.alias("id"), *[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in facts.items()])
    sessions = sessions.unionByName(sessions.withColumn("id", F.concat(F.lit("empty-"), F.col("id"))))
    messages = stored.select(F.lit("/h/state.db").alias("path"), c.name.alias("session_id"), F.inline(made))
    # every conversation also as a legacy file
    said = turns.select("conv_id", F.explode(made).alias("m")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("m.id").alias("at"), "m"))).alias("ms"))
    legacy_message = lambda m: F.struct(m["m"]["role"].alias("role"), m["m"]["content"].alias("content"), m["m"]["tool_call_id"].alias("tool_call_id"), F.try_parse_json(m["m"]["tool_calls"]).alias("tool_calls"))
    document = _o(session_id=F.concat(F.lit("c"), conv.cast("string")), session_start="2026-01-01T00:00:00", last_updated="2026-01-01T00:01:00", platform="web", model="base", messages=F.transform("ms", legacy_message))
    files = said.select(F.concat(F.lit("/h/sessions/session_"), conv.cast("string"), F.lit(".json")).alias("path"), F.to_json(document).alias("text"))
    old_sessions, old_messages = dialects.hermes_legacy(files, sessions.select("id"))
    kept = _facts(dialects.hermes(sessions, messages), "project_path")
    return kept.unionByName(_facts(dialects.hermes(old_sessions, old_messages), "project_path"))


@R.add(f"""
WITH {_T} SELECT 'c' || conv_id AS session_id, count(*) FILTER (u) AS user_messages, count(*) FILTER (a) AS assistant_messages, count(*) FILTER (a) AS tool_calls, count(*) FILTER (a AND bad) AS tool_errors,
  coalesce(sum(length(text)) FILTER (a), 0)::BIGINT AS input_tokens, coalesce(sum(turn) FILTER (a), 0)::BIGINT AS output_tokens, {_FILES.format('a AND NOT bad')}, {_MODELS},
  (2 * count(*) FILTER (u) + 2 * count(*) FILTER (a) + count(DISTINCT m) FILTER (a))::BIGINT AS events, coalesce(nullif(0.5 * count(*) FILTER (a), 0), -1)::DOUBLE AS cost, (max(turn) * 7)::BIGINT AS duration_seconds FROM t GROUP BY conv_id""")
def ingest_opencode(spark, sf_dir):
    """Three trees of fragments joined by directory, messages by time and parts by id; cost summed where there is any."""
    c = _Turn()
    turns = _turns(spark, sf_dir)
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    folder = lambda kind: F.concat(F.lit(f"/o/{kind}/p/") if kind == "session" else F.lit(f"/o/{kind}/c"), conv)
    sessions = _documents(turns.where(c.first), F.concat(folder("session"), F.lit(".json")), _o(id=c.name, directory="/w", title="T", time=_o(created=c.seconds.cast("double") * 1000)))
    mid = F.concat(F.lit("m"), conv, F.lit("-"), turn)
    message = _o(id=mid, role=F.col("role"), modelID=F.when(c.assistant, c.model), cost=F.when(c.assistant, 0.5), time=_o(created=c.seconds.cast("double") * 1000), tokens=F.when(c.assistant, _o(input=c.length, output=c.turn, cache=_o(read=0, write=0))))
    messages = _documents(turns, F.concat(folder("message"), F.lit("/"), mid, F.lit(".json")), message)
    tool = _o(type="tool", tool="read", state=_o(status="completed", title="t", input=_o(filePath=c.file), metadata=_o(exit=F.when(c.bad, 1).otherwise(0))))
    parts = [(c.user | c.assistant, "a", _o(type="text", text=c.text)), (c.user, "b", _o(type="text", text="injected", synthetic=F.lit(True))), (c.assistant, "b", tool)]
    made = F.array_compact(F.array(*[F.when(when, F.struct(F.concat(F.lit("/o/part/"), mid, F.lit(f"/{name}.json")).alias("path"), F.to_json(part).alias("text"))) for when, name, part in parts]))
    t = dialects.opencode(sessions, messages, turns.select(F.inline(made)))
    return _facts(t, F.coalesce("cost", F.lit(-1.0)).alias("cost"), "duration_seconds")


@R.add(f"""
WITH {_T} SELECT 'c' || conv_id AS session_id, count(*) FILTER (u) AS user_messages, count(*) FILTER (a) AS assistant_messages, count(*) FILTER (a) AS tool_calls, count(*) FILTER (a AND bad) AS tool_errors, 0::BIGINT AS input_tokens, 0::BIGINT AS output_tokens,
  {_FILES.format('a')}, '' AS models, (count(*) FILTER (u) + 3 * count(*) FILTER (a) + count(*) FILTER (NOT u AND NOT a) + 1)::BIGINT AS events, 'claude-chat' AS project_path, coalesce(CASE WHEN conv_id % 2 = 0 THEN 'Talk' END, '') AS title FROM t GROUP BY conv_id""")
def ingest_chat_export(spark, sf_dir):
    """One file of all conversations, plain and block contents, a summary as a note, a conversation without an id."""
    c = _Turn()
    null = F.lit(None).cast("string")
    said = _o(type="text", text=c.text, id=null, name=null, input=F.lit(None).cast("struct<path:string>"), tool_use_id=null, is_error=F.lit(None).cast("boolean"))
    use = _o(type="tool_use", text=null, id=c.call, name="view", input=_o(path=c.file), tool_use_id=null, is_error=F.lit(None).cast("boolean"))
    result = _o(type="tool_result", text=null, id=null, name="view", input=F.lit(None).cast("struct<path:string>"), tool_use_id=c.call, is_error=c.bad)
    sender = F.when(c.user, "human").otherwise(F.col("role"))
    message = _o(sender=sender, text=F.when(~c.assistant, c.text).otherwise(""), created_at=c.stamp, content=F.when(c.assistant, F.array(said, use, result)).otherwise(F.array().cast("array<struct<type:string,text:string,id:string,name:string,input:struct<path:string>,tool_use_id:string,is_error:boolean>>")))
    per = _turns(spark, sf_dir).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.to_json(message).alias("m")))).alias("ms"))
    talk = F.concat(F.lit('{"uuid": "c'), F.col("conv_id").cast("string"), F.lit('", "name": '), F.when(F.col("conv_id") % 2 == 0, '"Talk"').otherwise('" "'), F.lit(', "summary": " S ", "created_at": "2026-01-01T00:00:00Z", "chat_messages": ['), F.array_join(F.transform("ms", lambda m: m["m"]), ","), F.lit("]}"))
    files = per.groupBy(F.concat(F.lit("/x/"), (F.col("conv_id") % 3).cast("string"), F.lit("/conversations.json")).alias("path")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(talk), ","), F.lit(', {"uuid": "", "chat_messages": []}]')).alias("text"))
    return _facts(dialects.chat_export(files), "project_path", F.coalesce("title", F.lit("")).alias("title"))


_PATHS = ["/u/.codex/a.jsonl", "/u/x/rollout-1.jsonl", "/u/.hermes/state.db", "/u/hermes/s.json", "/u/local-agent-mode-sessions/a.jsonl", "/u/opencode/session/p/s.json", "/u/.pi/agent/sessions/a.jsonl", "/u/.grok/sessions/p/chat_history.jsonl", "/u/.cursor/projects/p/agent-transcripts/a.jsonl", "/u/.kimi-code/s/wire.jsonl", "/u/notes.txt", "/u/.grok/sessions/p/other.json", "/u/plain.jsonl"]
_FIRST = ['{"sessionId":"1","type":"session_meta"}', '{"type":"session_meta"}', '{"type":"response_item"}', '{"platform":"cli","model":"m"}', '{"type":"session","cwd":"/"}', '{"role":"user","message":{}}', '{"type":"metadata","protocol_version":1}', '{"type":"system"}', '{"type":"tool_result"}', '{"type":"assistant","tool_calls":[]}', '{"type":"assistant"}', "", "no json"]


@R.add("""
WITH e AS (SELECT event_id, event_id % 13 AS p, event_id // 13 % 13 AS f FROM events)
SELECT event_id, CASE p WHEN 0 THEN 'codex' WHEN 1 THEN 'codex' WHEN 2 THEN 'hermes' WHEN 3 THEN 'hermes' WHEN 4 THEN 'claude' WHEN 5 THEN 'opencode' WHEN 6 THEN 'pi' WHEN 7 THEN 'grok' WHEN 8 THEN 'cursor' WHEN 9 THEN 'kimi' WHEN 10 THEN '' WHEN 11 THEN ''
  ELSE CASE f WHEN 1 THEN 'codex' WHEN 2 THEN 'codex' WHEN 3 THEN 'hermes' WHEN 4 THEN 'pi' WHEN 5 THEN 'cursor' WHEN 6 THEN 'kimi' WHEN 7 THEN 'grok' WHEN 8 THEN 'grok' WHEN 9 THEN 'grok' ELSE 'claude' END END AS dialect FROM e""")
def detect_format(spark, sf_dir):
    """Eight rules on the path, seven on the first line; a file that is no log has no dialect."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    path, first = pick(_PATHS, F.col("event_id")), pick(_FIRST, F.floor(F.col("event_id") / 13))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(scan.detect(path, first), F.lit("")).alias("dialect"))
