"""From a dialect's items to sessions, messages and training events.

A dialect yields *items*: one row per content block or record, in order of (pos, k). What the dialects share happens
here once: results meet their calls, repeated models are dropped, blocks become messages, and statistics
are one aggregation per session. Windows partition by session file."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlark.functions.digests import event_id
from loomlark.functions.text import truncate_bytes
from loomlark.operators.kinds import session_kind
from loomlark.operators.ordered import changed, open_call

ITEMS = (
    "path string, pos int, k int, ts timestamp, kind string, role string, text string, name string, call_id string, input string, failed boolean, "
    "model string, event_kind string, counts string, usage struct<input_tokens:bigint,output_tokens:bigint,cache_read_tokens:bigint,cache_creation_tokens:bigint>"
)
COLUMNS = [c.split()[0] for c in ITEMS.replace(":bigint,", "").split(", ")]


@dataclass(frozen=True)
class Rules:
    """How a dialect differs. ``unmatched``: what a result without call becomes (``drop``, or a name). ``calls_at``: what counts
    as a tool call: ``call``, ``result`` or ``success``. ``duration``: from record times, or ``none``."""

    tool: str
    unmatched: str = "drop"
    calls_at: str = "result"
    files_at: str = "result"
    path_keys: tuple[str, ...] = ("file_path",)
    read: tuple[str, ...] = ("Read",)
    write: tuple[str, ...] = ("Write",)
    edit: tuple[str, ...] = ("Edit",)
    summary: str = "claude"
    usage_summed: bool = True


def usage(v: Column, input_: str, output: str, read: str, write: str) -> Column:
    """A usage struct from four JSON paths, null where there is no object."""
    n = lambda p: F.coalesce(F.try_variant_get(v, p, "bigint"), F.lit(0).cast("bigint"))
    return F.struct(n(input_).alias("input_tokens"), n(output).alias("output_tokens"), n(read).alias("cache_read_tokens"), n(write).alias("cache_creation_tokens"))


class Source:
    """Rows of a table under a condition. All sources made by ``where`` and ``withColumn`` share their table, so that the items
    of many conditions come from one scan: each row yields an array of those items whose condition holds."""

    def __init__(self, table: DataFrame | list, condition: Column | None = None):
        self.table = table if isinstance(table, list) else [table]
        self.condition = condition

    @property
    def df(self) -> DataFrame:
        return self.table[0] if self.condition is None else self.table[0].where(self.condition)

    def where(self, condition: Column) -> Source:
        return Source(self.table, condition if self.condition is None else self.condition & condition)

    def withColumn(self, name: str, column: Column) -> Source:
        if name in self.table[0].columns:
            raise ValueError(f"the shared table has a column {name}")
        self.table[0] = self.table[0].withColumn(name, column)
        return self


def items(rows: Source, **columns: Column) -> tuple[Source, Column]:
    """Items of a source; columns that are not given are null."""
    types = dict(f.strip().split(" ", 1) for f in ITEMS.replace(", ", "\n").split("\n"))
    return rows, F.struct(*[columns.get(c, F.lit(None)).cast(types[c]).alias(c) for c in COLUMNS])


def union(*parts: tuple[Source, Column]) -> DataFrame:
    """All items, with one scan per shared table."""
    tables: dict[int, tuple[list, list[Column]]] = {}
    for source, item in parts:
        tables.setdefault(id(source.table), (source.table, []))[1].append(item if source.condition is None else F.when(source.condition, item))
    return reduce(DataFrame.unionByName, [table[0].select(F.inline(F.array_compact(F.array(*own)))) for table, own in tables.values()])


def _get(json: Column, key: str) -> Column:
    return F.get_json_object(json, f"$.{key}")


def _cut(c: Column, most: int) -> Column:
    return F.when(F.octet_length(c) > most, F.concat(truncate_bytes(c, most), F.lit("..."))).otherwise(c)


def _listed(json: Column, key: str, label: str) -> Column:
    """``status: label`` of each complete entry of an array."""
    entries = F.from_json(_get(json, key), "array<string>")
    complete = F.filter(entries, lambda e: _get(e, label).isNotNull() & _get(e, "status").isNotNull())
    return _cut(F.array_join(F.transform(complete, lambda e: F.concat_ws(": ", _get(e, "status"), _get(e, label))), "; "), 150)


def input_summary(name: Column, json: Column, style: str = "claude") -> Column:
    """One line on a tool's input, by tool name."""
    json = F.coalesce(json, F.lit("{}"))
    text = lambda key: F.coalesce(_get(json, key), F.lit(""))
    quoted = lambda label, value: F.concat(F.lit(f'{label}="'), value, F.lit('"'))
    low = F.lower(name)
    path = F.coalesce(_get(json, "file_path"), _get(json, "path"), _get(json, "filePath"), F.lit(""))
    where = F.when(_get(json, "path").isNotNull(), F.concat(F.lit(" "), quoted("path", _get(json, "path")))).otherwise("")
    rest = _cut(json, 150)
    if style == "codex":
        array = F.from_json(_get(json, "command"), "array<string>")
        command = F.when(_get(json, "command").rlike(r"^\["), F.array_join(array, " ")).otherwise(text("command"))
        plan = F.when(_get(json, "plan").rlike(r"^\["), _listed(json, "plan", "step")).otherwise(rest)
        return F.when(name == "shell", F.replace(_cut(command, 200), F.lit("\n"), F.lit(" "))).when(name.isin("read_file", "write_file"), quoted("file", text("path"))).when(name == "update_plan", plan).otherwise(rest)
    todo = F.when(_get(json, "todos").rlike(r"^\["), _listed(json, "todos", "content")).otherwise(rest)
    known = name if style == "claude" else low
    names = (lambda *n: known.isin(*n)) if style == "claude" else (lambda *n: known.isin(*[x.lower() for x in n]))
    return (
        F.when(names("Bash"), F.replace(_cut(text("command"), 200), F.lit("\n"), F.lit(" ↵ ")))
        .when(names("Read", "Write", "Edit", *([] if style == "claude" else ["StrReplace", "search_replace"])), quoted("file", path))
        .when(names("Glob", "Grep"), F.concat(quoted("pattern", text("pattern")), where))
        .when(names("Task"), F.concat(text("subagent_type"), F.lit(': "'), text("description"), F.lit('"')))
        .when(names("WebFetch", "web_fetch"), quoted("url", text("url")))
        .when(names("WebSearch", "web_search"), quoted("query", text("query")))
        .when(names("TodoWrite"), todo)
        .otherwise(rest)
    )


def paired(rows: DataFrame, rules: Rules) -> DataFrame:
    """Items whose results carry the name and input of the latest earlier call with the same id, which serves once."""
    call = open_call(["path", "call_id"], ["pos", "k"], F.col("kind").isin("tool_use", "call"), F.struct("name", "input"))
    result = F.col("kind") == "tool_result"
    rows = rows.withColumn("_call", F.when(result & F.col("call_id").isNotNull(), call))
    if rules.unmatched == "drop":
        rows = rows.where(~result | F.col("_call").isNotNull())
    missing = F.lit("unknown" if rules.unmatched == "drop" else rules.unmatched)
    return rows.withColumn("name", F.when(result, F.coalesce(F.col("_call.name"), F.col("name"), missing)).otherwise(F.col("name"))).withColumn("input", F.when(result, F.coalesce(F.col("_call.input"), F.col("input"))).otherwise(F.col("input"))).drop("_call")


def models_changed(rows: DataFrame) -> DataFrame:
    """Items without model records that repeat the model before them."""
    model = F.col("kind") == "model_change"
    return rows.withColumn("_new", changed(["path"], ["pos", "k"], F.when(model, F.col("model")))).where(~model | F.col("_new")).drop("_new")


BLOCK = "struct<type:string,text:string,id:string,name:string,input:string,success:boolean,summary:string,model:string>"


def messages(rows: DataFrame, rules: Rules) -> DataFrame:
    """path, seq, role, ts, model, usage, content (blocks) of transcript items; a message is a record's blocks of one role."""
    result = F.col("kind") == "tool_result"
    block = F.struct(
        F.col("kind").alias("type"), F.when(~result, F.col("text")).alias("text"), F.col("call_id").alias("id"), "name", F.when(F.col("kind") == "tool_use", F.col("input")).alias("input"),
        F.when(result, ~F.coalesce("failed", F.lit(False))).alias("success"), F.when(result, F.coalesce(F.when(F.col("input").isNotNull(), input_summary(F.col("name"), F.col("input"), rules.summary)), F.col("text"), F.lit("{}"))).alias("summary"),
        F.when(F.col("kind") == "model_change", F.col("model")).alias("model"),
    )
    shown = rows.where(F.col("kind").isin("text", "thinking", "tool_use", "tool_result", "model_change", "queue_operation", "summary") & F.col("role").isNotNull())
    grouped = shown.groupBy("path", "pos", "role").agg(F.min("k").alias("_k"), F.min("ts").alias("ts"), F.max("model").alias("model"), F.first("usage", ignorenulls=True).alias("usage"), F.transform(F.array_sort(F.collect_list(F.struct("k", block.alias("b")))), lambda s: s["b"]).alias("content"))
    seq = F.row_number().over(Window.partitionBy("path").orderBy("pos", "_k"))
    return grouped.withColumn("seq", seq).drop("_k")


def training_events(rows: DataFrame) -> DataFrame:
    """path, sequence, event_id and the fields of events, for items with an event kind; ``skip`` counts without an event."""
    seq = F.row_number().over(Window.partitionBy("path").orderBy("pos", "k"))
    out = rows.where(F.col("event_kind").isNotNull()).withColumn("sequence", seq).where(F.col("event_kind") != "skip")
    return out.select("path", "sequence", event_id(F.col("sequence")).alias("event_id"), "ts", F.col("role").alias("role"), "event_kind", "model", F.when(F.col("event_kind") != "tool_result", F.col("text")).alias("raw_text"), F.col("name").alias("tool_name"), F.col("call_id").alias("tool_call_id"), F.col("input").alias("tool_input_raw"), F.when(F.col("event_kind") == "tool_result", F.col("text")).alias("tool_output_raw"), "usage", F.array(F.concat(F.lit("jsonl:"), F.col("pos").cast("string"))).alias("source_record_refs"))


def statistics(rows: DataFrame, rules: Rules) -> DataFrame:
    """One row per path: message, call and error counts, token totals, path sets, last model, first user text, duration."""
    kind, failed = F.col("kind"), F.coalesce("failed", F.lit(False))
    call = kind.isin("tool_use", "call") if rules.calls_at == "call" else ((kind == "tool_result") & ~failed if rules.calls_at == "success" else kind == "tool_result")
    path = F.coalesce(*[_get(F.col("input"), k) for k in rules.path_keys], F.lit(None).cast("string"))
    at = kind.isin("tool_use", "call") if rules.files_at == "call" else (kind == "tool_result") & ~failed
    files = lambda names: F.array_sort(F.collect_set(F.when(at & (F.col("name").isin(*names) if names else F.lit(False)), path)))
    token = lambda f: F.coalesce(F.sum(F.col("usage")[f]) if rules.usage_summed else F.max_by(F.col("usage")[f], F.when(F.col("usage").isNotNull(), F.struct("pos", "k"))), F.lit(0)).cast("long").alias(f)
    place = F.struct("pos", "k")
    seconds = F.unix_timestamp(F.max_by("ts", F.when(F.col("ts").isNotNull(), place))) - F.unix_timestamp(F.min_by("ts", F.when(F.col("ts").isNotNull(), place)))
    user = (kind == "text") & (F.col("role") == "user") & F.col("text").rlike(r"(?U)\S")
    out = rows.groupBy("path").agg(
        F.countDistinct(F.when(F.col("counts") == "user", F.struct("pos", F.lit(0)))).alias("user_messages"),
        F.countDistinct(F.when(F.col("counts") == "assistant", F.struct("pos", F.lit(0)))).alias("assistant_messages"),
        F.count(F.when(call, 1)).alias("tool_calls"), F.count(F.when((kind == "tool_result") & failed, 1)).alias("tool_errors"),
        *[token(f) for f in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")],
        files(rules.read).alias("files_read"), files(rules.write).alias("files_written"), files(rules.edit).alias("files_edited"),
        F.max_by("model", F.when(F.col("model").isNotNull(), place)).alias("model"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("model").isNotNull(), F.struct("pos", "k", "model")))), lambda s: s["model"])).alias("models_seen"),
        F.min_by("text", F.when(user, place)).alias("first_user_text"),
        F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.when(seconds >= 0, seconds).alias("duration_seconds"),
    )
    return out.withColumn("session_kind", session_kind(F.col("first_user_text"))).withColumn("tool", F.lit(rules.tool))


@dataclass(frozen=True)
class Tables:
    """What a dialect yields. ``sessions`` joins metadata (by path) and statistics."""

    sessions: DataFrame
    messages: DataFrame
    events: DataFrame


def assemble(rows: DataFrame, meta: DataFrame, rules: Rules) -> Tables:
    rows = models_changed(paired(rows.repartition("path"), rules))  # every window and group below is within a path
    sessions = meta.join(statistics(rows, rules), "path")
    return Tables(sessions, messages(rows, rules).join(meta.select("path"), "path", "left_semi"), training_events(rows).join(meta.select("path"), "path", "left_semi"))
