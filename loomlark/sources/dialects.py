"""The nine log dialects: raw records to items and metadata (see ``model``).

Each function takes tables of numbered JSON lines or JSON documents and returns lazily built tables. JSON is
read as VARIANT, so that content may be a string, an array of blocks, or broken, row by row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlark.functions.text import clean_user_text, combine_model, output_failed, percent_decoded, queue_summary, shell_reads, slug_to_path, trimmed, user_query
from loomlark.functions.timeutil import any_timestamp, uuid7_time
from loomlark.sources.model import Rules, Source, Tables, assemble, items, union, usage
from loomlark.sources.scan import records


def _s(path: str, v: str = "v") -> Column:
    """A string of a VARIANT column; other scalars as text, null if absent."""
    return F.try_variant_get(F.col(v), path, "string")


def _has(path: str, v: str = "v") -> Column:
    return F.try_variant_get(F.col(v), path, "variant").isNotNull()


def _is_array(path: str, v: str = "v") -> Column:
    return F.schema_of_variant(F.try_variant_get(F.col(v), path, "variant")).startswith("ARRAY")


def _is_string(path: str, v: str = "v") -> Column:
    return F.schema_of_variant(F.try_variant_get(F.col(v), path, "variant")) == "STRING"


def _json(path: str, v: str = "v") -> Column:
    return F.to_json(F.try_variant_get(F.col(v), path, "variant"))


def _blocks(rows: Source, path: str, k: str = "k", b: str = "b") -> Source:
    """One row per element of an array, from k = 1; rows without an array go."""
    array = F.try_variant_get(F.col("v"), path, "array<variant>")
    return Source(rows.where(_is_array(path)).df.select("*", F.posexplode(array).alias(k, b)).withColumn(k, F.col(k) + 1))


def _joined_text(path: str) -> Column:
    """The texts of an array's blocks, line by line; a string as it is."""
    parts = F.transform(F.try_variant_get(F.col("v"), path, "array<variant>"), lambda b: F.try_variant_get(b, "$.text", "string"))
    return F.when(_is_array(path), F.array_join(F.filter(parts, lambda t: t.isNotNull()), "\n")).when(_is_string(path), _s(path))


def _first_meta(rows: Source, **columns: Column) -> DataFrame:
    """Metadata of the first row of each path."""
    return rows.df.groupBy("path").agg(*[F.min_by(c, F.struct("pos")).alias(n) for n, c in columns.items()])


def _stripped(text: Column) -> Column:
    return F.nullif(trimmed(text), F.lit(""))


CLAUDE = Rules("claude")
_CLAUDE_USAGE = ("$.message.usage.input_tokens", "$.message.usage.output_tokens", "$.message.usage.cache_read_input_tokens", "$.message.usage.cache_creation_input_tokens")


def claude(lines: DataFrame) -> Tables:
    """Lines that lack any of the five required fields are dropped; text that starts with ``<`` is not a user's."""
    required = reduce(lambda a, b: a & b, [_has(p) for p in ("$.type", "$.sessionId", "$.timestamp", "$.cwd", "$.message")])
    queue = (_s("$.type") == "queue-operation") & _has("$.content")
    rows = Source(records(lines).where(required).withColumn("ts", any_timestamp(_s("$.timestamp"))))
    common = {"path": F.col("path"), "pos": F.col("pos"), "ts": F.col("ts")}
    type_, role = _s("$.type"), _s("$.message.role")
    is_meta = F.coalesce(F.try_variant_get("v", "$.isMeta", "boolean"), F.lit(False))
    user, asst = rows.where((type_ == "user") & (role == "user") & ~is_meta), rows.where((type_ == "assistant") & (role == "assistant"))
    b = lambda p: _s(p, "b")

    plain, said = user.where(_is_string("$.message.content")), _s("$.message.content")
    keep = ~F.startswith(said, F.lit("<")) & _stripped(said).isNotNull()
    plain = items(plain, **common, k=F.lit(1), kind=F.when(keep, "text").otherwise("hidden"), role=F.lit("user"), text=trimmed(said), counts=F.when(keep, "user"), event_kind=F.lit("message"))
    ub = _blocks(user, "$.message.content").withColumn("t", b("$.text"))
    keep = ~F.startswith("t", F.lit("<")) & _stripped(F.col("t")).isNotNull()
    texts = items(ub.where(b("$.type") == "text"), **common, k=F.col("k"), kind=F.when(keep, "text").otherwise("hidden"), role=F.lit("user"), text=trimmed(F.col("t")), counts=F.when(keep, "user"), event_kind=F.lit("message"))
    results = items(ub.where(b("$.type") == "tool_result"), **common, k=F.col("k"), kind=F.lit("tool_result"), role=F.lit("user"), call_id=b("$.tool_use_id"), text=_json("$.content", "b"), failed=F.coalesce(F.try_variant_get("b", "$.is_error", "boolean"), F.lit(False)), event_kind=F.lit("tool_result"))
    model = F.when(_s("$.message.model") != "<synthetic>", _s("$.message.model"))
    change = items(asst.where(model.isNotNull()), **common, k=F.lit(0), kind=F.lit("model_change"), role=F.lit("assistant"), model=model, event_kind=F.lit("model_change"))
    spent = items(asst.where(_has("$.message.usage")), **common, k=F.lit(-1), kind=F.lit("usage"), role=F.lit("assistant"), usage=usage(F.col("v"), *_CLAUDE_USAGE))
    ab = _blocks(asst, "$.message.content").withColumn("t", b("$.text"))
    said = items(ab.where((b("$.type") == "text") & _stripped(F.col("t")).isNotNull()), **common, k=F.col("k"), kind=F.lit("text"), role=F.lit("assistant"), text=trimmed(F.col("t")), counts=F.lit("assistant"), event_kind=F.lit("message"))
    thought = items(ab.where((b("$.type") == "thinking") & (b("$.thinking") != "")), **common, k=F.col("k"), kind=F.lit("thinking"), role=F.lit("assistant"), text=b("$.thinking"), event_kind=F.lit("message"))
    calls = items(ab.where(b("$.type") == "tool_use"), **common, k=F.col("k"), kind=F.lit("tool_use"), role=F.lit("assistant"), name=F.coalesce(b("$.name"), F.lit("")), call_id=F.coalesce(b("$.id"), F.lit("")), input=F.coalesce(_json("$.input", "b"), F.lit("{}")), event_kind=F.lit("tool_call"))
    hidden = items(rows.where((type_ == "user") & is_meta), **common, k=F.lit(1), kind=F.lit("meta"), role=F.lit("system"), text=_json("$.message"), event_kind=F.lit("meta_record"))
    queued = rows.where(queue).withColumn("_queued", queue_summary(_s("$.content")))
    queued = items(queued.where(F.col("_queued") != ""), **common, k=F.lit(1), kind=F.lit("queue_operation"), role=F.lit("system"), text=F.col("_queued"), event_kind=F.lit("queue_operation"))
    clock = items(rows, **common, k=F.lit(-2), kind=F.lit("clock"))
    meta = _first_meta(rows, session_id=_s("$.sessionId"), project_path=_s("$.cwd"), started_at=F.col("ts"), version=_s("$.version"), git_branch=_s("$.gitBranch"), title=F.lit(None).cast("string"))
    return assemble(union(clock, plain, texts, results, change, spent, said, thought, calls, hidden, queued), meta, CLAUDE)


CODEX = Rules("codex", summary="codex", path_keys=("path",), read=(), write=(), edit=(), usage_summed=False)


def codex(lines: DataFrame) -> Tables:
    """Token counts are cumulative: the last one stands, reasoning counts as output. A later session record replaces the metadata."""
    rows = Source(records(lines).where(_has("$.type") & _has("$.payload") & _has("$.timestamp")).withColumn("ts", any_timestamp(_s("$.timestamp"))))
    common = {"path": F.col("path"), "pos": F.col("pos"), "ts": F.col("ts")}
    type_, kind = _s("$.type"), _s("$.payload.type")
    item, event = rows.where(type_ == "response_item"), rows.where(type_ == "event_msg")
    b = lambda p: _s(p, "b")
    said = _blocks(item.where((kind == "message") & (_s("$.payload.role") == "assistant")), "$.payload.content")
    said = items(said.where((b("$.type") == "output_text") & _stripped(b("$.text")).isNotNull()), **common, k=F.col("k"), kind=F.lit("text"), role=F.lit("assistant"), text=trimmed(b("$.text")), counts=F.lit("assistant"), event_kind=F.lit("message"))
    arguments = F.coalesce(_s("$.payload.arguments"), F.lit("{}"))
    calls = items(item.where(kind == "function_call"), **common, k=F.lit(1), kind=F.lit("call"), role=F.lit("assistant"), name=F.coalesce(_s("$.payload.name"), F.lit("")), call_id=F.nullif(_s("$.payload.call_id"), F.lit("")), input=arguments, event_kind=F.lit("tool_call"))
    output = F.coalesce(_s("$.payload.output"), F.lit(""))
    failed = F.coalesce(F.try_variant_get(F.try_parse_json(output), "$.exit_code", "bigint") != 0, F.lit(False))
    results = items(item.where(kind == "function_call_output"), **common, k=F.lit(1), kind=F.lit("tool_result"), role=F.lit("assistant"), call_id=_s("$.payload.call_id"), text=output, failed=failed, event_kind=F.lit("tool_result"))
    reasoning = items(item.where(kind == "reasoning"), **common, k=F.lit(1), kind=F.lit("reasoning"), role=F.lit("assistant"), text=_json("$.payload"), event_kind=F.lit("message"))
    total = "$.payload.info.total_token_usage"
    n = lambda f: F.coalesce(F.try_variant_get("v", f"{total}.{f}", "bigint"), F.lit(0).cast("bigint"))
    spent = F.struct(n("input_tokens").alias("input_tokens"), (n("output_tokens") + n("reasoning_output_tokens")).alias("output_tokens"), n("cached_input_tokens").alias("cache_read_tokens"), F.lit(0).cast("bigint").alias("cache_creation_tokens"))
    counted = items(event.where((kind == "token_count") & _has(total)), **common, k=F.lit(1), kind=F.lit("usage"), usage=spent)
    prompts = event.where((kind == "user_message") & _has("$.payload.message")).withColumn("t", clean_user_text(_s("$.payload.message")))
    kept = F.col("t") != ""
    prompts = items(prompts, **common, k=F.lit(1), kind=F.when(kept, "text").otherwise("hidden"), role=F.lit("user"), text=F.col("t"), counts=F.when(kept, "user"), event_kind=F.lit("message"))
    change = items(rows.where((type_ == "turn_context") & _has("$.payload.model")), **common, k=F.lit(1), kind=F.lit("model_change"), role=F.lit("system"), model=_s("$.payload.model"), event_kind=F.lit("model_change"))
    clock = items(rows, **common, k=F.lit(-2), kind=F.lit("clock"))
    m = rows.where(type_ == "session_meta").df
    meta = m.groupBy("path").agg(F.max_by(F.struct(F.coalesce(_s("$.payload.id"), F.lit("")).alias("session_id"), F.coalesce(_s("$.payload.cwd"), F.lit("")).alias("project_path"), F.coalesce(any_timestamp(_s("$.payload.timestamp")), F.col("ts")).alias("started_at"), _s("$.payload.cli_version").alias("version"), _s("$.payload.git.branch").alias("git_branch"), F.lit(None).cast("string").alias("title")), "pos").alias("m")).select("path", "m.*")
    tables = assemble(union(clock, said, calls, results, reasoning, counted, prompts, change), meta, CODEX)
    # a shell call that was answered reads the files its command names
    shell = records(lines).where((_s("$.payload.type") == "function_call") & (_s("$.payload.name") == "shell")).select("path", F.try_parse_json(_s("$.payload.arguments")).alias("v"), _s("$.payload.call_id").alias("id"))
    command = F.when(_is_array("$.command"), F.array_join(F.try_variant_get("v", "$.command", "array<string>"), " ")).otherwise(_s("$.command"))
    answered = records(lines).where(_s("$.payload.type") == "function_call_output").select(F.col("path").alias("_p"), _s("$.payload.call_id").alias("_id"))
    reads = shell.join(answered, (F.col("path") == F.col("_p")) & (F.col("id") == F.col("_id")), "left_semi").select("path", F.explode(shell_reads(command)).alias("f")).groupBy(F.col("path").alias("_p")).agg(F.array_sort(F.collect_set("f")).alias("_reads"))
    sessions = tables.sessions.join(reads, F.col("path") == F.col("_p"), "left").withColumn("files_read", F.coalesce("_reads", "files_read")).drop("_p", "_reads")
    return Tables(sessions, tables.messages, tables.events)


PI = Rules("pi", unmatched="unknown", summary="pi", path_keys=("path", "file_path", "filePath"), read=("read", "Read"), write=("write", "Write"), edit=("edit", "Edit"))


def pi(lines: DataFrame) -> Tables:
    """A model is ``provider/model``; a file without session record yields nothing."""
    rows = Source(records(lines).withColumn("ts", any_timestamp(_s("$.timestamp"))))
    common = {"path": F.col("path"), "pos": F.col("pos"), "ts": F.col("ts")}
    role = _s("$.message.role")
    said = rows.where(_s("$.type") == "message")
    b = lambda p: _s(p, "b")
    model = combine_model(F.coalesce(_s("$.provider"), F.lit("")), F.coalesce(_s("$.modelId"), F.lit("")))
    change = items(rows.where((_s("$.type") == "model_change") & (model != "")), **common, k=F.lit(0), kind=F.lit("model_change"), role=F.lit("system"), model=model, event_kind=F.lit("model_change"))
    blocks = _blocks(said.where(role.isin("user", "assistant")), "$.message.content")
    full = _stripped(b("$.text")).isNotNull()
    texts = items(blocks.where(b("$.type") == "text"), **common, k=F.col("k"), kind=F.when(full, "text").otherwise("hidden"), role=role, text=trimmed(F.coalesce(b("$.text"), F.lit(""))), counts=F.when(full, role), event_kind=F.lit("message"))
    thought = items(blocks.where((role == "assistant") & (b("$.type") == "thinking")), **common, k=F.col("k"), kind=F.lit("thinking"), role=role, text=F.coalesce(b("$.thinking"), F.lit("")), event_kind=F.lit("message"))
    calls = items(blocks.where((role == "assistant") & (b("$.type") == "toolCall")), **common, k=F.col("k"), kind=F.lit("tool_use"), role=role, name=F.coalesce(b("$.name"), F.lit("unknown")), call_id=F.coalesce(b("$.id"), F.lit("")), input=F.coalesce(_json("$.arguments", "b"), F.lit("{}")), event_kind=F.lit("tool_call"))
    results = items(said.where(role == "toolResult"), **common, k=F.lit(1), kind=F.lit("tool_result"), role=F.lit("assistant"), call_id=F.coalesce(_s("$.message.toolCallId"), F.lit("")), name=_s("$.message.toolName"), text=_joined_text("$.message.content"), failed=F.coalesce(F.try_variant_get("v", "$.message.isError", "boolean"), F.lit(False)), event_kind=F.lit("tool_result"))
    spent = items(said.where((role == "assistant") & _has("$.message.usage")), **common, k=F.lit(-1), kind=F.lit("usage"), role=role, usage=usage(F.col("v"), "$.message.usage.input", "$.message.usage.output", "$.message.usage.cacheRead", "$.message.usage.cacheWrite"))
    clock = items(rows, **common, k=F.lit(-2), kind=F.lit("clock"))
    meta = _first_meta(rows.where(_s("$.type") == "session"), session_id=F.coalesce(_s("$.id"), F.lit("")), project_path=F.coalesce(_s("$.cwd"), F.lit("")), started_at=F.col("ts"), version=_s("$.version"), git_branch=F.lit(None).cast("string"), title=F.lit(None).cast("string"))
    return assemble(union(clock, change, texts, thought, calls, results, spent), meta, PI)


GROK = Rules("grok", unmatched="unknown", calls_at="call", summary="grok", path_keys=("path", "file_path", "filePath"), read=("Read", "read"), write=("Write", "write"), edit=("Edit", "edit", "StrReplace", "search_replace"))


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def _arguments(path: str, v: str) -> Column:
    """Tool arguments: an object, a JSON string, or any other string wrapped as ``raw``."""
    raw = _s(path, v)
    text = F.coalesce(F.to_json(F.try_parse_json(raw)), F.to_json(F.struct(raw.alias("raw"))))
    return F.when(_is_string(path, v), text).otherwise(F.coalesce(_json(path, v), F.lit("{}")))


def grok(lines: DataFrame, updates: DataFrame | None = None, signals: DataFrame | None = None, summaries: DataFrame | None = None) -> Tables:
    """``updates``: numbered lines of the sibling files with usage; ``signals`` and ``summaries``: path, text of siblings. All join by directory."""
    rows = Source(records(lines))
    type_ = _s("$.type")
    common = {"path": F.col("path"), "pos": F.col("pos")}
    prompts = rows.where(type_ == "user").withColumn("t", user_query(_joined_text("$.content"))).where(F.col("t").isNotNull())
    prompts = items(prompts, **common, k=F.lit(1), kind=F.lit("text"), role=F.lit("user"), text=F.col("t"), counts=F.lit("user"), event_kind=F.lit("message"))
    reasoning = rows.where(type_ == "reasoning").withColumn("_reason", _joined_text("$.summary"))
    reasoning = items(reasoning.where(_stripped(F.col("_reason")).isNotNull()), **common, k=F.lit(1), kind=F.lit("thinking"), role=F.lit("assistant"), text=F.col("_reason"))
    asst = rows.where(type_ == "assistant")
    seen = items(asst.where(_has("$.model_id")), **common, k=F.lit(0), kind=F.lit("model"), model=_s("$.model_id"))
    said = items(asst.where(_stripped(_s("$.content")).isNotNull()), **common, k=F.lit(0), kind=F.lit("text"), role=F.lit("assistant"), text=_s("$.content"), model=_s("$.model_id"), counts=F.lit("assistant"))
    calls = _blocks(asst, "$.tool_calls")
    calls = items(calls, **common, k=F.col("k"), kind=F.lit("tool_use"), role=F.lit("assistant"), name=F.coalesce(_s("$.name", "b"), F.lit("unknown")), call_id=F.coalesce(_s("$.id", "b"), F.lit("")), input=_arguments("$.arguments", "b"), model=_s("$.model_id"))
    output = F.coalesce(_s("$.content"), F.lit(""))
    results = items(rows.where(type_ == "tool_result"), **common, k=F.lit(1), kind=F.lit("tool_result"), role=F.lit("assistant"), call_id=F.coalesce(_s("$.tool_call_id"), F.lit("")), text=output, failed=output_failed(output), event_kind=F.lit("tool_result"))
    parts = [prompts, reasoning, seen, said, calls, results]
    paths = rows.df.select("path").distinct().withColumn("_dir", _directory(F.col("path")))
    if updates is not None:
        u = records(updates).where((_s("$.params.update.sessionUpdate") == "turn_completed") & _has("$.params.update.usage"))
        n = lambda f: F.coalesce(F.try_variant_get("v", f"$.params.update.usage.{f}", "bigint"), F.lit(0).cast("bigint"))
        total = F.try_variant_get("v", "$.params.update.usage.totalTokens", "bigint")
        included = F.coalesce(n("inputTokens") + n("outputTokens") == total, F.lit(False))
        spent = F.struct(F.when(included, F.greatest(n("inputTokens") - n("cachedReadTokens"), F.lit(0).cast("bigint"))).otherwise(n("inputTokens")).alias("input_tokens"), n("outputTokens").alias("output_tokens"), n("cachedReadTokens").alias("cache_read_tokens"), n("cacheCreationTokens").alias("cache_creation_tokens"))
        u = u.select(_directory(F.col("path")).alias("_d"), F.col("pos").alias("_pos"), spent.alias("_u"))
        parts.append(items(Source(paths.join(u, F.col("_dir") == F.col("_d"))), path=F.col("path"), pos=F.lit(0), k=F.col("_pos"), kind=F.lit("usage"), usage=F.col("_u")))
    meta = paths.select("path", "_dir", F.element_at(F.split("_dir", "/"), -1).alias("_leaf"))
    if summaries is not None:
        s = summaries.select(_directory(F.col("path")).alias("_d"), F.try_parse_json("text").alias("v")).where("v is not null")
        s = s.select("_d", _s("$.info.id").alias("_id"), _s("$.info.cwd").alias("_cwd"), any_timestamp(_s("$.created_at")).alias("_at"), _s("$.generated_title").alias("_title"), _s("$.head_branch").alias("_branch"))
        meta = meta.join(s, F.col("_dir") == F.col("_d"), "left")
    else:
        meta = meta.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("_id", "string"), ("_cwd", "string"), ("_at", "timestamp"), ("_title", "string"), ("_branch", "string"))])
    born = F.when(F.col("_leaf").rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-7"), uuid7_time(F.col("_leaf")))
    project = percent_decoded(F.element_at(F.split("_dir", "/"), -2))
    meta = meta.select("path", F.coalesce("_id", "_leaf").alias("session_id"), F.coalesce("_cwd", project).alias("project_path"), F.coalesce("_at", born).alias("started_at"), F.lit(None).cast("string").alias("version"), F.col("_branch").alias("git_branch"), F.col("_title").alias("title"))
    tables = assemble(union(*parts), meta, GROK)
    if signals is None:
        return tables
    g = signals.select(_directory(F.col("path")).alias("_d"), F.try_parse_json("text").alias("v"))
    g = g.select("_d", F.try_variant_get("v", "$.contextTokensUsed", "bigint").alias("context_used"), F.try_variant_get("v", "$.contextWindowTokens", "bigint").alias("context_window"))
    return Tables(tables.sessions.join(g, _directory(F.col("path")) == F.col("_d"), "left").drop("_d"), tables.messages, tables.events)


CURSOR = Rules("cursor", calls_at="call", files_at="call", summary="grok", path_keys=("path", "target_notebook"), read=("Read",), write=("Write",), edit=("StrReplace", "Edit", "search_replace"))


def cursor(lines: DataFrame, modified: DataFrame) -> Tables:
    """There are no timestamps and no results: a session starts when its file (``modified``: path, modified) was written, and calls are numbered."""
    rows = Source(records(lines))
    common = {"path": F.col("path"), "pos": F.col("pos")}
    prompts = rows.where(_s("$.role") == "user").withColumn("t", user_query(_joined_text("$.message.content"))).where(F.col("t").isNotNull())
    prompts = items(prompts, **common, k=F.lit(1), kind=F.lit("text"), role=F.lit("user"), text=F.col("t"), counts=F.lit("user"), event_kind=F.lit("message"))
    blocks = _blocks(rows.where(_s("$.role") == "assistant"), "$.message.content")
    b = lambda p: _s(p, "b")
    said = items(blocks.where((b("$.type") == "text") & _stripped(b("$.text")).isNotNull()), **common, k=F.col("k"), kind=F.lit("text"), role=F.lit("assistant"), text=b("$.text"), counts=F.lit("assistant"))
    calls = blocks.where(b("$.type") == "tool_use").withColumn("_n", F.count(F.when(b("$.type") == "tool_use", 1)).over(Window.partitionBy("path").orderBy("pos", "k")))
    calls = items(calls, **common, k=F.col("k"), kind=F.lit("tool_use"), role=F.lit("assistant"), name=F.coalesce(b("$.name"), F.lit("unknown")), call_id=F.concat(F.lit("cursor-tool-"), F.col("_n").cast("string")), input=F.coalesce(_json("$.input", "b"), F.lit("{}")), event_kind=F.lit("tool_call"))
    slug = F.regexp_extract("path", r"/projects/([^/]+)/", 1)
    meta = modified.join(rows.df.select("path").distinct(), "path", "left_semi").select("path", F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.jsonl$", "").alias("session_id"), F.when(slug != "", slug_to_path(slug)).otherwise("").alias("project_path"), F.col("modified").alias("started_at"), F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("git_branch"), F.lit(None).cast("string").alias("title"))
    t = assemble(union(prompts, said, calls), meta, CURSOR)
    return Tables(t.sessions.withColumn("duration_seconds", F.lit(0).cast("long")), t.messages, t.events)


KIMI = Rules("kimi", unmatched="unknown", calls_at="success", summary="grok", path_keys=(), read=(), write=(), edit=())


def kimi(lines: DataFrame, states: DataFrame | None = None) -> Tables:
    """Times are milliseconds. Usage belongs to the last message before it and not to the session's totals; thinking counts as a
    message; injected user messages take a number in the training stream but give no event."""
    rows = Source(records(lines).withColumn("ts", F.timestamp_millis(F.try_variant_get("v", "$.time", "bigint"))))
    common = {"path": F.col("path"), "pos": F.col("pos"), "k": F.lit(1)}
    type_, event = _s("$.type"), _s("$.event.type")
    loop = rows.where(type_ == "context.append_loop_event")
    models = items(rows.where((type_ == "config.update") & _has("$.modelAlias")), **common, kind=F.lit("model"), model=_s("$.modelAlias"))
    prompts = rows.where(type_ == "turn.prompt").withColumn("t", _stripped(_joined_text("$.input"))).where(F.col("t").isNotNull())
    prompts = items(prompts, **common, kind=F.lit("text"), role=F.lit("user"), text=F.col("t"), counts=F.lit("user"), event_kind=F.lit("message"))
    injected = rows.where((type_ == "context.append_message") & (_s("$.message.role") == "user")).withColumn("_injected", _stripped(_joined_text("$.message.content"))).where(F.col("_injected").isNotNull())
    injected = items(injected, **common, kind=F.lit("text"), role=F.lit("user"), text=F.col("_injected"), counts=F.lit("user"), event_kind=F.lit("skip"))
    part = loop.where(event == "content.part")
    said = items(part.where((_s("$.event.part.type") == "text") & _stripped(_s("$.event.part.text")).isNotNull()), **common, ts=F.col("ts"), kind=F.lit("text"), role=F.lit("assistant"), text=_s("$.event.part.text"), counts=F.lit("assistant"))
    thought = items(part.where((_s("$.event.part.type") == "think") & _stripped(_s("$.event.part.think")).isNotNull()), **common, ts=F.col("ts"), kind=F.lit("thinking"), role=F.lit("assistant"), text=_s("$.event.part.think"), counts=F.lit("assistant"))
    calls = items(loop.where(event == "tool.call"), **common, kind=F.lit("call"), name=F.coalesce(_s("$.event.name"), F.lit("unknown")), call_id=F.coalesce(_s("$.event.toolCallId"), F.lit("")), input=F.coalesce(_json("$.event.args"), F.lit("{}")))
    output = F.coalesce(_s("$.event.result.output"), F.lit(""))
    failed = F.coalesce(F.try_variant_get("v", "$.event.result.isError", "boolean"), F.lit(False)) | output_failed(output)
    results = items(loop.where(event == "tool.result"), **common, ts=F.col("ts"), kind=F.lit("tool_result"), role=F.lit("assistant"), call_id=F.coalesce(_s("$.event.toolCallId"), F.lit("")), text=output, failed=failed, event_kind=F.lit("tool_result"))
    everything = union(models, prompts, injected, said, thought, calls, results)
    start = F.timestamp_millis(F.min(F.coalesce(F.try_variant_get("v", "$.created_at", "bigint"), F.try_variant_get("v", "$.time", "bigint"))))
    end = F.timestamp_millis(F.max_by(F.try_variant_get("v", "$.event.time", "bigint"), F.when((event == "step.end") & _has("$.event.time"), F.col("pos"))))
    meta = rows.df.groupBy("path").agg(start.alias("started_at"), end.alias("_end")).withColumn("_dir", _directory(_directory(_directory(F.col("path")))))
    if states is not None:
        s = states.select(_directory(F.col("path")).alias("_d"), F.try_parse_json("text").alias("v"))
        s = s.select("_d", F.coalesce(_s("$.workDir"), _s("$.cwd")).alias("_cwd"), _s("$.title").alias("_title"))
        meta = meta.join(s, F.col("_dir") == F.col("_d"), "left").drop("_d")
    else:
        meta = meta.withColumn("_cwd", F.lit(None).cast("string")).withColumn("_title", F.lit(None).cast("string"))
    seconds = F.unix_timestamp("_end") - F.unix_timestamp("started_at")
    meta = meta.select("path", F.element_at(F.split("_dir", "/"), -1).alias("session_id"), F.coalesce("_cwd", F.lit("")).alias("project_path"), "started_at", F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("git_branch"), F.col("_title").alias("title"), F.when(seconds >= 0, seconds).otherwise(F.lit(0)).alias("_seconds"))
    t = assemble(everything, meta, KIMI)
    # usage of a step goes to the message before it; of several, the last stands
    spent = loop.where((event == "step.end") & _has("$.event.usage")).df.select("path", "pos", usage(F.col("v"), "$.event.usage.inputOther", "$.event.usage.output", "$.event.usage.inputCacheRead", "$.event.usage.inputCacheCreation").alias("_u"))
    line = t.messages.select("path", "pos", F.col("seq").alias("_seq")).unionByName(spent.select("path", "pos", "_u"), allowMissingColumns=True)
    owner = F.last("_seq", ignorenulls=True).over(Window.partitionBy("path").orderBy("pos"))
    spent = line.withColumn("_seq", F.when(F.col("_u").isNotNull(), owner)).where("_seq is not null").groupBy(F.col("path").alias("_p"), "_seq").agg(F.max_by("_u", "pos").alias("_u"))
    messages = t.messages.join(spent, (F.col("path") == F.col("_p")) & (F.col("seq") == F.col("_seq")), "left").withColumn("usage", F.coalesce("_u", "usage")).drop("_p", "_seq", "_u")
    return Tables(t.sessions.withColumn("duration_seconds", F.col("_seconds").cast("long")).drop("_seconds"), messages, t.events)


HERMES = Rules("hermes", unmatched="tool", calls_at="call", files_at="call", path_keys=("path", "file_path"), read=("read_file",), write=("write_file",), edit=("patch", "edit_file"))


def hermes(sessions: DataFrame, messages: DataFrame) -> Tables:
    """``sessions``: path, id, source, model, title, started_at, ended_at, the four token counts, estimated_cost_usd, actual_cost_usd; ``messages``: path, session_id,
    id, role, content, tool_call_id, tool_calls, tool_name, timestamp, finish_reason, reasoning, reasoning_content. Sessions without messages go (semi join)."""
    key = F.concat_ws("/", "path", "sid")
    s = sessions.withColumn("sid", F.col("id")).join(messages.select(F.col("path").alias("_p"), "session_id").distinct(), (F.col("path") == F.col("_p")) & (F.col("id") == F.col("session_id")), "left_semi")
    order = F.row_number().over(Window.partitionBy("path", "session_id").orderBy("timestamp", "id"))
    m = messages.withColumn("pos", order).withColumn("sid", F.col("session_id")).withColumn("_path", key).join(s.select(F.col("path").alias("_sp"), F.col("sid").alias("_ss"), F.col("model").alias("_model")), (F.col("path") == F.col("_sp")) & (F.col("sid") == F.col("_ss"))).withColumn("path", F.col("_path"))
    m = m.withColumn("ts", any_timestamp(F.col("timestamp").cast("string"))).withColumn("v", F.try_parse_json("content"))
    parts = F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.try_variant_get(b, "$.content", "string")))
    text = F.when(F.coalesce(_is_array("$"), F.lit(False)), F.array_join(F.filter(parts, lambda t: t.isNotNull()), "\n")).otherwise(F.col("content"))
    m = Source(m.withColumn("t", text))
    common = {"path": F.col("path"), "pos": F.col("pos"), "ts": F.col("ts")}
    role = F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("system")
    model = F.when(F.col("role") == "assistant", F.col("_model"))
    reasoning = F.coalesce("reasoning_content", "reasoning")
    thought = items(m.where((F.col("role") == "assistant") & _stripped(reasoning).isNotNull()), **common, k=F.lit(0), kind=F.lit("thinking"), role=role, text=reasoning, model=model, counts=F.lit("assistant"))
    said = items(m.where((F.col("role") != "tool") & _stripped(F.col("t")).isNotNull()), **common, k=F.lit(1), kind=F.lit("text"), role=role, text=F.col("t"), model=model, counts=F.when(role != "system", role), event_kind=F.lit("message"))
    called = _blocks(Source(m.where(F.col("role") == "assistant").df.withColumn("v", F.try_parse_json("tool_calls"))), "$")
    named = F.coalesce(_s("$.function.name", "b"), _s("$.name", "b"), F.lit("tool"))
    arguments = F.when(_has("$.function.arguments", "b"), _arguments("$.function.arguments", "b")).otherwise(_arguments("$.arguments", "b"))
    calls = items(called, **common, k=F.col("k") + 1, kind=F.lit("tool_use"), role=F.lit("assistant"), name=named, call_id=F.coalesce(_s("$.id", "b"), _s("$.call_id", "b"), F.lit("")), input=arguments, model=model, counts=F.lit("assistant"), event_kind=F.lit("tool_use"))
    output = F.coalesce("t", F.lit(""))
    failed = F.lower(trimmed(output)).rlike(r"^(?:error:|traceback )") | F.coalesce(F.col("finish_reason") == "error", F.lit(False))
    results = items(m.where(F.col("role") == "tool"), **common, k=F.lit(1), kind=F.lit("tool_result"), role=F.lit("system"), name=F.col("tool_name"), call_id=F.coalesce("tool_call_id", F.concat(F.lit("tool-result-"), (F.col("pos") - 1).cast("string"))), text=output, failed=failed, event_kind=F.lit("tool_result"))
    zero = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint"))
    spent = items(Source(s), path=key, pos=F.lit(0), k=F.lit(0), kind=F.lit("usage"), model=F.col("model"), usage=F.struct(zero("input_tokens").alias("input_tokens"), zero("output_tokens").alias("output_tokens"), zero("cache_read_tokens").alias("cache_read_tokens"), zero("cache_write_tokens").alias("cache_creation_tokens")))
    start, end = any_timestamp(F.col("started_at").cast("string")), any_timestamp(F.col("ended_at").cast("string"))
    meta = s.select(key.alias("path"), F.col("sid").alias("session_id"), F.concat(F.lit("hermes:"), F.col("source")).alias("project_path"), start.alias("started_at"), F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("git_branch"), "title", F.coalesce("actual_cost_usd", "estimated_cost_usd").alias("cost"), (F.unix_timestamp(end) - F.unix_timestamp(start)).alias("_seconds"))
    t = assemble(union(spent, thought, said, calls, results), meta, HERMES)
    return Tables(t.sessions.withColumn("duration_seconds", F.coalesce("_seconds", "duration_seconds")).drop("_seconds"), t.messages, t.events)


def hermes_legacy(documents: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """path, text of legacy JSON files -> the two tables of ``hermes``, without sessions that the database (``known``: id) has (anti join)."""
    v = documents.select("path", F.try_parse_json("text").alias("v")).where("v is not null")
    s = v.select("path", _s("$.session_id").alias("id"), F.coalesce(_s("$.platform"), F.lit("unknown")).alias("source"), _s("$.model").alias("model"), _s("$.title").alias("title"), _s("$.session_start").alias("started_at"), _s("$.last_updated").alias("ended_at"), *[F.lit(0).cast("bigint").alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")], F.lit(None).cast("double").alias("estimated_cost_usd"), F.lit(None).cast("double").alias("actual_cost_usd"))
    if known is not None:
        s = s.join(known.select("id"), "id", "left_anti").select(s.columns)
    b = lambda p: _s(p, "b")
    m = _blocks(Source(v.withColumn("session_id", _s("$.session_id"))), "$.messages").df.select(
        "path", "session_id", F.col("k").cast("bigint").alias("id"), b("$.role").alias("role"), F.when(_is_string("$.content", "b"), b("$.content")).otherwise(_json("$.content", "b")).alias("content"), b("$.tool_call_id").alias("tool_call_id"),
        _json("$.tool_calls", "b").alias("tool_calls"), b("$.name").alias("tool_name"), F.lit(None).cast("double").alias("timestamp"), b("$.finish_reason").alias("finish_reason"), b("$.reasoning").alias("reasoning"), b("$.reasoning_content").alias("reasoning_content"),
    )
    return s, m


OPENCODE = Rules("opencode", unmatched="unknown", files_at="result", path_keys=("filePath",), read=("read",), write=("write",), edit=())


def opencode(session_files: DataFrame, message_files: DataFrame, part_files: DataFrame) -> Tables:
    """Three trees of JSON fragments (path, text), joined by the directory that names the parent; messages in order of creation, parts of id."""
    parent = lambda: F.element_at(F.split("path", "/"), -2)
    s = session_files.select("path", F.try_parse_json("text").alias("v")).where("v is not null").select("path", _s("$.id").alias("sid"), _s("$.directory").alias("dir"), _s("$.title").alias("title"), F.try_variant_get("v", "$.time.created", "double").alias("born"))
    m = message_files.select(parent().alias("sid"), F.try_parse_json("text").alias("v")).where("v is not null").withColumn("mid", _s("$.id"))
    created = F.coalesce(F.try_variant_get("v", "$.time.created", "double"), F.lit(0.0))
    m = s.join(m, "sid").withColumn("pos", F.row_number().over(Window.partitionBy("path").orderBy(created, "mid")))
    ms = lambda c: F.timestamp_millis(c.cast("bigint"))
    m = Source(m.withColumn("ts", ms(F.coalesce(F.try_variant_get("v", "$.time.completed", "double"), F.try_variant_get("v", "$.time.created", "double")))))
    common = {"path": F.col("path"), "pos": F.col("pos"), "ts": F.col("ts")}
    change = items(m.where(_has("$.modelID")), **common, k=F.lit(0), kind=F.lit("model_change"), role=F.lit("system"), model=_s("$.modelID"), event_kind=F.lit("model_change"))
    spent = items(m.where(_has("$.tokens")), **common, k=F.lit(-1), kind=F.lit("usage"), usage=usage(F.col("v"), "$.tokens.input", "$.tokens.output", "$.tokens.cache.read", "$.tokens.cache.write"))
    clock = items(m, **common, k=F.lit(-2), kind=F.lit("clock"))
    p = part_files.select(parent().alias("_mid"), F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json$", "").alias("pid"), F.try_parse_json("text").alias("b")).where("b is not null")
    rows = Source(m.df.join(p, F.col("mid") == F.col("_mid")).withColumn("k", F.row_number().over(Window.partitionBy("path", "pos").orderBy("pid"))))
    b = lambda q: _s(q, "b")
    role = _s("$.role")
    text = rows.where((b("$.type") == "text") & b("$.text").isNotNull() & role.isin("user", "assistant"))
    synthetic = (role == "user") & F.coalesce(F.try_variant_get("b", "$.synthetic", "boolean"), F.lit(False))
    own = ~synthetic & ~((role == "user") & b("$.text").rlike(r"^(?:<file>|Called the)")) & _stripped(b("$.text")).isNotNull()
    texts = items(text, **common, k=F.col("k"), kind=F.when(own, "text").otherwise("hidden"), role=F.when(synthetic, "system").otherwise(role), text=trimmed(b("$.text")), counts=F.when(own, role), event_kind=F.when(synthetic, "system_context").otherwise("message"))
    tools = rows.where((role == "assistant") & (b("$.type") == "tool") & _has("$.state", "b"))
    failed = F.coalesce(F.try_variant_get("b", "$.state.metadata.exit", "bigint") != 0, F.lit(False))
    title = F.coalesce(b("$.state.title"), b("$.state.metadata.description"), F.lit(""))
    results = items(tools, **common, k=F.col("k"), kind=F.lit("tool_result"), role=F.lit("assistant"), name=F.coalesce(b("$.tool"), F.lit("unknown")), call_id=F.col("pid"), input=_json("$.state.input", "b"), text=title, failed=failed, event_kind=F.lit("tool_result"))
    cost = m.df.groupBy("path").agg(F.sum(F.try_variant_get("v", "$.cost", "double")).alias("_cost"))
    meta = s.join(cost, "path", "left").select("path", F.col("sid").alias("session_id"), F.coalesce("dir", F.lit("")).alias("project_path"), ms(F.col("born")).alias("started_at"), F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("git_branch"), "title", F.when(F.col("_cost") > 0, F.col("_cost")).alias("cost"))
    t = assemble(union(clock, change, spent, texts, results), meta, OPENCODE)
    seconds = F.unix_timestamp("last_at") - F.unix_timestamp("started_at")
    return Tables(t.sessions.withColumn("duration_seconds", F.when(seconds >= 0, seconds)), t.messages, t.events)


CHAT = Rules("claude-chat", unmatched="unknown", calls_at="call", files_at="call", path_keys=("file_path", "path"), read=("Read", "view"), write=("Write", "create_file"), edit=("Edit", "str_replace"))


def chat_export(documents: DataFrame) -> Tables:
    """path, text of exported ``conversations.json`` -> one session per conversation, its path ``file/uuid``. A conversation without uuid is
    skipped; tool ids that are missing get numbers; a summary that is not blank becomes a system note."""
    c = documents.select("path", F.explode(F.try_variant_get(F.try_parse_json("text"), "$", "array<variant>")).alias("v")).withColumn("uuid", _s("$.uuid")).where("coalesce(uuid, '') <> ''")
    c = Source(c.withColumn("path", F.concat_ws("/", "path", "uuid")))
    note = c.where(_stripped(_s("$.summary")).isNotNull())
    summary = items(note, path=F.col("path"), pos=F.lit(0), k=F.lit(1), ts=any_timestamp(_s("$.created_at")), kind=F.lit("summary"), role=F.lit("system"), text=trimmed(_s("$.summary")), event_kind=F.lit("summary"))
    m = _blocks(c, "$.chat_messages", "pos", "m").df.drop("v").withColumnRenamed("m", "v").withColumn("ts", any_timestamp(_s("$.created_at")))
    role = F.when(_s("$.sender") == "human", "user").when(_s("$.sender") == "assistant", "assistant").otherwise("system")
    m = Source(m.withColumn("role", role))
    common = {"path": F.col("path"), "pos": F.col("pos"), "ts": F.col("ts"), "role": F.col("role")}
    counts = F.when(F.col("role") != "system", F.col("role"))
    filled = _is_array("$.content") & (F.size(F.try_variant_get("v", "$.content", "array<variant>")) > 0)
    filled = F.coalesce(filled, F.lit(False))
    string = F.coalesce(_is_string("$.content"), F.lit(False)) & (_s("$.content") != "")
    plain = F.when(string, _s("$.content")).otherwise(_stripped(_s("$.text")))
    flat = items(m.where(~filled & plain.isNotNull()), **common, k=F.lit(1), kind=F.lit("text"), text=plain, counts=counts, event_kind=F.lit("message"))
    blocks = _blocks(m.where(filled), "$.content")
    b = lambda p: _s(p, "b")
    number = F.row_number().over(Window.partitionBy("path").orderBy("pos", "k")).cast("string")
    texts = items(blocks.where((b("$.type") == "text") & (b("$.text") != "")), **common, k=F.col("k"), kind=F.lit("text"), text=b("$.text"), counts=counts, event_kind=F.lit("message"))
    thought = items(blocks.where((b("$.type") == "thinking") & (b("$.thinking") != "")), **common, k=F.col("k"), kind=F.lit("thinking"), text=b("$.thinking"), counts=counts, event_kind=F.lit("thinking"))
    tool = Source(blocks.where(b("$.type").isin("tool_use", "tool_result")).df.withColumn("_id", F.nullif(F.when(b("$.type") == "tool_use", b("$.id")).otherwise(b("$.tool_use_id")), F.lit(""))))
    tool = Source(tool.df.withColumn("_id", F.coalesce("_id", F.concat(F.when(b("$.type") == "tool_use", "claude-chat-tool-").otherwise("claude-chat-tool-result-"), number))))
    calls = items(tool.where(b("$.type") == "tool_use"), **common, k=F.col("k"), kind=F.lit("tool_use"), name=F.coalesce(b("$.name"), F.lit("unknown")), call_id=F.col("_id"), input=_json("$.input", "b"), counts=counts, event_kind=F.lit("tool_use"))
    results = items(tool.where(b("$.type") == "tool_result"), **common, k=F.col("k"), kind=F.lit("tool_result"), name=b("$.name"), call_id=F.col("_id"), text=_json("$.content", "b"), failed=F.coalesce(F.try_variant_get("b", "$.is_error", "boolean"), F.lit(False)), counts=counts, event_kind=F.lit("tool_result"))
    meta = c.df.select("path", F.col("uuid").alias("session_id"), F.lit("claude-chat").alias("project_path"), any_timestamp(_s("$.created_at")).alias("started_at"), F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("git_branch"), _stripped(_s("$.name")).alias("title"))
    return assemble(union(summary, flat, texts, thought, calls, results), meta, CHAT)
