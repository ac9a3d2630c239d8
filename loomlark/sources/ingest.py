"""From folders of logs to one set of tables: each dialect's files by its selector, its siblings by name, and the union of all."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlark.sources import dialects, scan
from loomlark.sources.model import Tables

_SESSION_COLUMNS = "id string, source string, model string, title string, started_at double, ended_at double, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, estimated_cost_usd double, actual_cost_usd double"
_MESSAGE_COLUMNS = "session_id string, id long, role string, content string, tool_call_id string, tool_calls string, tool_name string, timestamp double, finish_reason string, reasoning string, reasoning_content string"


def _lines(dialect: str, read: Callable[[DataFrame], Tables]) -> Callable[[SparkSession, str], Tables]:
    return lambda spark, root: read(scan.numbered(scan.texts(spark, root, dialect)))


def _grok(spark: SparkSession, root: str) -> Tables:
    beside = lambda name: scan.texts(spark, root, glob=name)
    return dialects.grok(scan.numbered(scan.texts(spark, root, "grok")), scan.numbered(beside("updates.jsonl")), beside("signals.json"), beside("summary.json"))


def _cursor(spark: SparkSession, root: str) -> Tables:
    files = scan.texts(spark, root, "cursor")
    return dialects.cursor(scan.numbered(files), files.select("path", "modified"))


def _kimi(spark: SparkSession, root: str) -> Tables:
    return dialects.kimi(scan.numbered(scan.texts(spark, root, "kimi")), scan.texts(spark, root, glob="state.json"))


def _opencode(spark: SparkSession, root: str) -> Tables:
    files = scan.texts(spark, root, glob="*.json")
    tree = lambda kind: files.where(F.col("path").rlike(f"/{kind}/[^/]+/[^/]+$"))
    return dialects.opencode(tree("session"), tree("message"), tree("part"))


def _hermes(spark: SparkSession, root: str) -> Tables:
    """The databases' paths are listed by the driver: one row a database."""
    stores = [r["path"] for r in scan.listed(spark, root, "state.db").collect()]
    legacy = scan.texts(spark, root, "hermes").where(F.col("path").endswith(".json"))
    if not stores:
        return dialects.hermes(*dialects.hermes_legacy(legacy))
    fields = lambda columns: ", ".join(c.split()[0] for c in columns.split(", "))
    sessions = scan.sqlite(spark, stores, f"SELECT {fields(_SESSION_COLUMNS)} FROM sessions", _SESSION_COLUMNS)
    messages = scan.sqlite(spark, stores, f"SELECT {fields(_MESSAGE_COLUMNS)} FROM messages", _MESSAGE_COLUMNS)
    return union([dialects.hermes(sessions, messages), dialects.hermes(*dialects.hermes_legacy(legacy, sessions.select("id")))])


def _chat(spark: SparkSession, root: str) -> Tables:
    plain = scan.texts(spark, root, glob="conversations.json").select("path", "text")
    return dialects.chat_export(plain.unionByName(scan.zip_members(spark, root)))


READERS: dict[str, Callable[[SparkSession, str], Tables]] = {
    "claude": _lines("claude", dialects.claude), "codex": _lines("codex", dialects.codex), "pi": _lines("pi", dialects.pi), "grok": _grok, "cursor": _cursor, "kimi": _kimi, "opencode": _opencode, "hermes": _hermes, "claude-chat": _chat,
}


def union(tables: list[Tables]) -> Tables:
    """All sessions, messages and events; columns that a dialect lacks are null."""
    every = lambda name: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [getattr(t, name) for t in tables])
    return Tables(every("sessions"), every("messages"), every("events"))


def kept(t: Tables, project: str | None = None) -> Tables:
    """Sessions in which someone said something, and, if asked, whose working directory starts with ``project``; their messages and events."""
    said: Column = (F.col("user_messages") > 0) | (F.col("assistant_messages") > 0)
    if project is not None:
        said = said & F.startswith("project_path", F.lit(project))
    sessions = t.sessions.where(said)
    own = sessions.select("path")
    return Tables(sessions, t.messages.join(own, "path", "left_semi"), t.events.join(own, "path", "left_semi"))


def stored(t: Tables, root: str) -> Tables:
    """The three tables written under ``root`` and read again."""
    spark = t.sessions.sparkSession

    def again(name: str) -> DataFrame:
        df = getattr(t, name)
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    return Tables(again("sessions"), again("messages"), again("events"))


def ingest(spark: SparkSession, roots: dict[str, str], project: str | None = None, store: str | None = None) -> Tables:
    """``roots``: dialect -> folder. Lazy; ``sinks.artifacts`` writes what it gives. With ``store``, a folder that all executors see, each dialect's tables
    are written there first: logs are then read once for all that follows, and plans over many dialects stay small."""
    unknown = roots.keys() - READERS.keys()
    if unknown or not roots:
        raise ValueError(f"unknown dialects: {sorted(unknown)}" if unknown else "no folders")
    read = {d: READERS[d](spark, root) for d, root in roots.items()}
    return kept(union([stored(t, f"{store}/{d}") if store else t for d, t in read.items()]), project)


def dialect_of(spark: SparkSession, path: str) -> str:
    """The dialect of one file. A file that is no log is an error."""
    found = scan.texts(spark, path).select("path", scan.detect(F.col("path"), scan.first_line(F.col("text"))).alias("d")).first()
    if found is None or found["d"] is None:
        raise ValueError(f"no known log: {path}")
    return found["d"]
