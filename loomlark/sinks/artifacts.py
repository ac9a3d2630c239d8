"""Session artifacts as columns, and their writes. Whatever leaves here is redacted first."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlark.functions.text import ASSISTANT, META, QUEUE, TOOL_FAILED, TOOL_OK, USER, format_duration, format_tokens, shorten_model
from loomlark.operators.names import output_name, without_collisions
from loomlark.operators.redact import KINDS, json_counts, redact_json, redact_json_array, redacted, suspect, with_audit
from loomlark.session import ship
from loomlark.sources.model import Tables

_FACTS = ("session_id", "project_path", "version", "git_branch", "model", "title")
_SETS = ("models_seen", "files_read", "files_written", "files_edited")
_TEXTS = ("text", "id", "name", "summary", "model")


def clean(t: Tables) -> Tables:
    """Sessions, messages and events with every string redacted: facts and path sets, the blocks' texts, names, summaries and inputs (string by
    string inside JSON), and of events all but their ids and kinds. ``path`` stays, as it is the key."""
    each = lambda c: F.transform(c, redacted)
    sessions = t.sessions.withColumns({c: redacted(F.col(c)) for c in _FACTS if c in t.sessions.columns} | {c: each(F.col(c)) for c in _SETS if c in t.sessions.columns})
    kept = [f.name for f in t.messages.schema["content"].dataType.elementType]
    inputs = t.messages.withColumn("_inputs", redact_json_array(F.transform("content", lambda b: b["input"])))
    block = lambda b, i: F.struct(*[(redacted(b[c]) if c in _TEXTS else F.get(F.col("_inputs"), i) if c == "input" else b[c]).alias(c) for c in kept])
    messages = inputs.withColumns({"model": redacted(F.col("model")), "content": F.transform("content", block)}).drop("_inputs")
    events = t.events.withColumns({c: redacted(F.col(c)) for c in ("role", "model", "raw_text", "tool_name", "tool_call_id")} | {"tool_input_raw": redact_json(F.col("tool_input_raw"), strict=False), "tool_output_raw": redact_json(F.col("tool_output_raw"), strict=False), "source_record_refs": each(F.col("source_record_refs"))})
    return Tables(sessions, messages, events)


def redactions(t: Tables) -> DataFrame:
    """path, redaction_count, redaction_kinds over all strings that ``clean`` covers; facts count in the transcript and in the training session. Only suspect
    strings meet the patterns."""
    s = t.sessions
    facts = F.concat(F.array(*[F.col(c) for c in _FACTS], *[F.col(c) for c in _FACTS if c != "model"], F.col("path")), F.coalesce("models_seen", F.array().cast("array<string>")))
    blocks = F.flatten(F.transform("content", lambda b: F.array(*[b[c] for c in _TEXTS])))
    fields = F.concat(F.array("role", "model", "raw_text", "tool_name", "tool_call_id"), "source_record_refs")
    plain = reduce(DataFrame.unionByName, [s.select("path", F.explode(facts).alias("x")), t.messages.select("path", F.explode(F.concat(F.array("model"), blocks)).alias("x")), t.events.select("path", F.explode(fields).alias("x"))])
    json = t.messages.select("path", F.explode(F.transform("content", lambda b: b["input"])).alias("x")).unionByName(t.events.select("path", F.explode(F.array("tool_input_raw", "tool_output_raw")).alias("x")))
    counts = [f"n_{k}" for k in KINDS]
    rows = with_audit(plain.where(suspect(F.col("x"))), "x").select("path", *counts)
    rows = rows.unionByName(json.where(suspect(F.col("x"))).withColumn("n", json_counts(F.col("x"))).select("path", "n.*"))
    per = rows.groupBy("path").agg(*[F.sum(c).alias(c) for c in counts])
    kinds = F.array_compact(F.array(*[F.when(F.col(f"n_{k}") > 0, F.lit(k)) for k in KINDS]))
    return per.select("path", reduce(lambda a, b: a + b, map(F.col, counts)).alias("redaction_count"), kinds.alias("redaction_kinds"))


def _line(mark: str, label: str, value: Column) -> Column:
    """``mark label: value``, null where the value is."""
    return F.when(value.isNotNull(), F.concat(F.lit(f"{mark} {label}: "), value))


def _header(s: DataFrame) -> Column:
    tool = F.col("tool")
    iso = F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ssxxx")
    return F.array_compact(F.array(
        _line(META, "Session", F.col("session_id")), _line(META, "Project", F.col("project_path")), _line(META, "Started", iso), _line(META, "Session Kind", F.col("session_kind")),
        _line(META, "Version", F.when(tool == "claude", F.col("version"))), _line(META, "Title", F.when(tool.isin("claude-chat", "opencode", "grok"), F.col("title"))),
        F.when((tool == "codex") & F.col("version").isNotNull(), F.concat(F.lit(f"{META} CLI: codex "), F.col("version"))), _line(META, "Branch", F.col("git_branch")), F.lit(""),
    ))


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _footer(s: DataFrame) -> Column:
    n = lambda c: F.col(c).cast("string")
    pair = lambda a, la, b, lb: F.concat(n(a), F.lit(f" {la}, "), n(b), F.lit(f" {lb}"))
    count = lambda c, label: F.when(F.size(c) > 0, F.concat(F.size(c).cast("string"), F.lit(f" {label}")))
    files = F.nullif(F.concat_ws(", ", count("files_read", "read"), count("files_written", "written"), count("files_edited", "edited")), F.lit(""))
    tokens = [F.when(F.col(c) > least, F.concat(format_tokens(F.col(c)), F.lit(f" {label}"))) for c, label, least in (("input_tokens", "in", -1), ("output_tokens", "out", -1), ("cache_read_tokens", "cache_read", 0), ("cache_creation_tokens", "cache_write", 0))]
    any_token = (F.col("input_tokens") > 0) | (F.col("output_tokens") > 0) | (F.col("cache_read_tokens") > 0) | (F.col("cache_creation_tokens") > 0)
    used, window, cost = _optional(s, "context_used", "long"), _optional(s, "context_window", "long"), _optional(s, "cost", "double")
    context = F.when((window > 0) & used.isNotNull(), F.concat(format_tokens(used), F.lit(" / "), format_tokens(window), F.lit(" ("), F.round(used * 100 / window).cast("long").cast("string"), F.lit("%)")))
    lines = F.array_compact(F.array(
        F.lit(""), F.lit(f"{META} --- Summary ---"), _line(META, "Duration", format_duration(F.col("duration_seconds"), detailed=True)), _line(META, "Model", F.when(F.col("tool") == "codex", F.col("model"))),
        _line(META, "Messages", pair("user_messages", "user", "assistant_messages", "assistant")),
        F.concat(F.lit(f"{META} "), F.when(F.col("tool") == "codex", "Function calls").otherwise("Tool calls"), F.lit(": "), pair("tool_calls", "total", "tool_errors", "failed")),
        _line(META, "Files", files), _line(META, "Tokens", F.when(any_token, F.concat_ws(", ", *tokens))), _line(META, "Context", context),
        F.when(cost > 0, F.concat(F.lit(f"{META} Cost: $"), F.format_string("%.4f", cost))),
    ))
    return F.when((F.col("user_messages") > 0) | (F.col("assistant_messages") > 0), lines).otherwise(F.array().cast("array<string>"))


def _block_line(role: Column, b: Column) -> Column:
    mark = F.when(role == "user", USER).when(role == "assistant", ASSISTANT).otherwise(META)
    kind = b["type"]
    said = F.concat(mark, F.lit(" "), b["text"])
    result = F.concat(F.when(b["success"], TOOL_OK).otherwise(TOOL_FAILED), F.lit(" "), b["name"], F.lit(": "), b["summary"])
    return F.when(kind.isin("text", "summary"), said).when(kind == "tool_result", result).when(kind == "model_change", F.concat(F.lit(f"{META} Model: "), shorten_model(b["model"]))).when(kind == "queue_operation", F.concat(F.lit(f"{QUEUE} "), b["text"]))


def transcripts(t: Tables) -> DataFrame:
    """path, month, stem, text: header, one line per shown block in order, summary. One aggregation per session."""
    t = clean(t)
    shown = t.messages.select("path", "seq", F.posexplode("content").alias("k", "b"), "role").withColumn("line", _block_line(F.col("role"), F.col("b"))).where("line is not null")
    body = shown.groupBy(F.col("path").alias("_p")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "k", "line"))), lambda s: s["line"]).alias("body"))
    s = t.sessions.join(body, F.col("path") == F.col("_p"), "left")
    lines = F.concat(_header(s), F.coalesce("body", F.array().cast("array<string>")), _footer(s))
    name = output_name(F.col("started_at"), F.col("tool"))
    return s.select("path", name["month"].alias("month"), name["stem"].alias("stem"), F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("text"))


def json_lines(t: Tables) -> DataFrame:
    """path, n, line: metadata first, then messages, then statistics."""
    t = clean(t)
    facts = {"session_id", "tool", "project_path", "started_at", "session_kind", "version", "git_branch", "model", "title"}
    meta = t.sessions.select("path", F.lit(0).cast("long").alias("n"), F.to_json(F.struct(*[c for c in t.sessions.columns if c in facts])).alias("line"))
    said = t.messages.select("path", F.col("seq").cast("long").alias("n"), F.to_json(F.struct("role", "ts", "model", "content", "usage")).alias("line"))
    hidden = {"path", "first_user_text"}
    stats = t.sessions.select("path", F.lit((1 << 62)).alias("n"), F.to_json(F.struct(*[c for c in t.sessions.columns if c not in facts and c not in hidden])).alias("line"))
    return meta.unionByName(said).unionByName(stats)


def training_json(t: Tables, raw: bool = False) -> DataFrame:
    """path, json: the whole training session as one pretty object, redacted, with a report of what was replaced; ``raw`` adds the originals."""
    report, original = redactions(t).withColumnRenamed("path", "_r"), t.events
    t = clean(t)
    own = F.struct("event_id", "sequence", F.col("ts").alias("timestamp"), "role", "event_kind", "model", F.col("raw_text").alias("sanitized_text"), "tool_name", "tool_call_id", F.try_parse_json("tool_input_raw").alias("tool_input_sanitized"), F.try_parse_json("tool_output_raw").alias("tool_output_sanitized"), *([F.col("_o.raw_text").alias("raw_text"), F.col("_o.tool_input_raw").alias("tool_input_raw"), F.col("_o.tool_output_raw").alias("tool_output_raw")] if raw else []), "usage", "source_record_refs")
    e = t.events
    if raw:
        e = e.join(original.select(F.col("path").alias("_op"), F.col("sequence").alias("_os"), F.struct("raw_text", "tool_input_raw", "tool_output_raw").alias("_o")), (F.col("path") == F.col("_op")) & (F.col("sequence") == F.col("_os")))
    per = e.select("path", "sequence", F.to_json(own).alias("e")).groupBy(F.col("path").alias("_p")).agg(F.transform(F.array_sort(F.collect_list(F.struct("sequence", "e"))), lambda s: F.parse_json(s["e"])).alias("events"))
    s = t.sessions.join(per, F.col("path") == F.col("_p"), "left").join(report, F.col("path") == F.col("_r"), "left")
    source = F.struct("tool", redacted(F.col("path")).alias("source_path"), "session_id")
    metadata = F.struct(F.col("project_path").alias("project_path_sanitized"), "started_at", F.col("last_at").alias("ended_at"), "session_kind", "models_seen", "version", "git_branch", "title")
    stats = F.struct("user_messages", "assistant_messages", "tool_calls", "tool_errors", "duration_seconds", "files_read", "files_written", "files_edited", F.struct("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens").alias("total_tokens"))
    none = F.array().cast("array<string>")
    sanitization = F.struct(F.lit("sanitization.v1").alias("policy_version"), F.coalesce("redaction_count", F.lit(0)).alias("redaction_count"), F.coalesce("redaction_kinds", none).alias("redaction_kinds"), F.lit(0).alias("dropped_block_count"), none.alias("dropped_block_kinds"))
    return s.select("path", F.to_json(F.struct(F.lit("training_session.v1").alias("schema_version"), source.alias("source"), metadata.alias("metadata"), "events", stats.alias("stats"), sanitization.alias("sanitization")), {"pretty": "true"}).alias("json"))


EXTENSIONS = {"text": "md", "jsonl": "jsonl", "training": "training.json"}


def artifacts(t: Tables, kind: str = "text") -> DataFrame:
    """path, month, stem, name (unique within its month), text of each session's artifact: ``text``, ``jsonl`` or ``training``."""
    if kind not in EXTENSIONS:
        raise ValueError(f"unknown format: {kind}")
    named = output_name(F.col("started_at"), F.col("tool"))
    place = t.sessions.select(F.col("path").alias("_p"), named["month"].alias("month"), named["stem"].alias("stem"))
    if kind == "text":
        rows = transcripts(t)
    elif kind == "training":
        rows = training_json(t).withColumnRenamed("json", "text").join(place, F.col("path") == F.col("_p")).drop("_p")
    else:
        per = json_lines(t).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: s["line"]), "\n").alias("text"))
        rows = per.join(place, F.col("path") == F.col("_p")).drop("_p")
    return without_collisions(rows, "month", "stem", "path")


def write_artifacts(t: Tables, root: str, kind: str = "text") -> None:
    """Artifacts as Parquet rows under ``root/<kind>``, partitioned by month, each with its unique file name."""
    artifacts(t, kind).write.mode("overwrite").partitionBy("month").parquet(f"{root}/{kind}")


def write_files(rows: DataFrame, root: str, kind: str = "text") -> int:
    """Rows of ``artifacts`` as files ``root/<month>/<name>.<extension>``, and how many. ``root``: a URI or path that all executors see. Each file is
    written beside its place and then renamed, so that a lost executor leaves no half of one, and a repeated task writes the same file."""
    ship(rows.sparkSession)
    extension = EXTENSIONS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow.fs import FileSystem

        files, base = FileSystem.from_uri(root)
        n = 0
        for batch in batches:
            for month, name, text in zip(batch["month"], batch["name"], batch["text"]):
                files.create_dir(f"{base}/{month}", recursive=True)
                beside = f"{base}/{month}/.{name}.{uuid.uuid4().hex}"
                with files.open_output_stream(beside) as f:
                    f.write(text.encode())
                files.move(beside, f"{base}/{month}/{name}.{extension}")
                n += 1
        yield pd.DataFrame({"n": [n]})

    return rows.select(F.coalesce("month", F.lit("unknown")).alias("month"), "name", "text").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_metrics(metrics: DataFrame, root: str) -> None:
    """One JSON row per period, dimension and bucket, partitioned by the period's month; a week goes to its Monday's."""
    from loomlark.functions.timeutil import week_days

    month = F.when(F.col("period").rlike("W"), F.date_format(F.element_at(week_days(F.col("period")), 1), "yyyy-MM")).otherwise(F.substring("period", 1, 7))
    metrics.withColumn("month", month).write.mode("overwrite").partitionBy("month").json(root)


def append_progress(events: DataFrame, path: str) -> None:
    """One JSON line per attempt, appended."""
    events.write.mode("append").json(path)


MOST_SHOWN = 10_000


def markdown(rows: DataFrame, title: str | None = None, total: str = "Total") -> str:
    """A small aggregate as a table with a bold total row. Only for results that are read by people: more than ``MOST_SHOWN`` rows are an error."""
    names = rows.columns
    got = rows.limit(MOST_SHOWN + 1).collect()
    if len(got) > MOST_SHOWN:
        raise ValueError(f"more than {MOST_SHOWN} rows")
    cell = lambda x: "-" if x is None else str(x)
    out = [f"## {title}", ""] if title else []
    out += ["| " + " | ".join(names) + " |", "|" + "|".join(" --- " for _ in names) + "|"]
    for r in [r for r in got if r[0] != total] + [r for r in got if r[0] == total]:
        out.append("| " + " | ".join(f"**{cell(x)}**" if r[0] == total else cell(x) for x in r) + " |")
    return "\n".join(out) + "\n"
