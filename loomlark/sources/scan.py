"""File scans: numbered JSON lines, whole JSON documents, zip members, SQLite tables, dialect detection."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomlark.functions.text import lines as split_lines
from loomlark.functions.text import percent_decoded
from loomlark.session import ship

#: Dialect -> (file name glob, pattern that the path must match, pattern that it must not match). Fixed values.
SELECTORS: dict[str, tuple[str, str, str]] = {
    "claude": ("*.jsonl", r".", r"\.bak[^/]*$"),
    "codex": ("rollout-*.jsonl", r".", r"\A\z"),
    "hermes": ("*.{json,jsonl,db}", r"(?:/state\.db|/sessions/session_[^/]*\.json|/sessions/[^/]*\.jsonl)$", r"\A\z"),
    "opencode": ("*.json", r"/session/[^/]+/[^/]+\.json$", r"\A\z"),
    "pi": ("*.jsonl", r".", r"\A\z"),
    "grok": ("chat_history.jsonl", r".", r"\A\z"),
    "cursor": ("*.jsonl", r"/agent-transcripts/", r"\A\z"),
    "kimi": ("wire.jsonl", r"/agents/[^/]+/wire\.jsonl$", r"\A\z"),
}


def texts(spark: SparkSession, root: str, dialect: str | None = None, glob: str = "*") -> DataFrame:
    """path, modified, size, text of every file under ``root``; empty files are left out. A dialect adds its selector."""
    name, must, must_not = SELECTORS[dialect] if dialect else (glob, ".", r"\A\z")
    files = spark.read.format("text").option("pathGlobFilter", name).option("recursiveFileLookup", "true").option("wholetext", "true").load(root)
    at = F.col("_metadata.file_path")  # a URI: the path itself may hold percent signs
    files = files.where((F.col("_metadata.file_size") > 0) & at.rlike(must) & ~at.rlike(must_not))
    return files.select(percent_decoded(at).alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))


def numbered(files: DataFrame) -> DataFrame:
    """path, pos, line: blank lines are dropped but count in the numbering, from 1."""
    rows = files.select("path", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    return rows.select("path", (F.col("pos") + 1).alias("pos"), "line").where(F.col("line").rlike(r"(?U)\S"))


def records(rows: DataFrame) -> DataFrame:
    """Numbered lines with ``v``, their VARIANT; lines that are no JSON go."""
    return rows.withColumn("v", F.try_parse_json("line")).where(F.col("v").isNotNull())


def detect(path: Column, first_line: Column) -> Column:
    """Dialect of a file: what its path holds decides; a JSON-lines file whose path tells nothing goes by its first line that is not
    blank, at last as ``claude``; any other file has none (null). The literals are fixed values."""
    in_path = lambda *parts: reduce(lambda a, b: a | b, [F.contains(path, F.lit(x)) for x in parts])
    line = F.coalesce(first_line, F.lit(""))
    in_line = lambda *parts: reduce(lambda a, b: a & b, [F.contains(line, F.lit(x)) for x in parts])
    by_line = (
        F.when(in_line('"sessionId"'), "claude")
        .when(in_line('"session_meta"') | in_line('"response_item"'), "codex")
        .when(in_line('"platform"', '"model"'), "hermes")
        .when(in_line('"type":"session"', '"cwd"'), "pi")
        .when(in_line('"role":', '"message":'), "cursor")
        .when(in_line('"type":"metadata"', '"protocol_version"'), "kimi")
        .when(in_line('"type":"system"') | in_line('"type":"tool_result"') | in_line('"type":"assistant"', '"tool_calls"'), "grok")
        .otherwise("claude")
    )
    return (
        F.when(in_path(".codex", "rollout-"), "codex")
        .when(in_path(".hermes", "/hermes/"), "hermes")
        .when(in_path("local-agent-mode-sessions"), "claude")
        .when(in_path("opencode"), "opencode")
        .when(in_path(".pi/agent/sessions", "/pi/agent/sessions"), "pi")
        .when(in_path(".grok/sessions") & in_path("chat_history.jsonl"), "grok")
        .when(in_path("/agent-transcripts/"), "cursor")
        .when(in_path(".kimi-code", "/kimi-code/"), "kimi")
        .when(path.endswith(".jsonl"), by_line)
    )


def first_line(text: Column) -> Column:
    """The first line that is not blank."""
    return F.regexp_extract(text, r"(?U)\A\s*([^\r\n]*)", 1)


def listed(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path of the files whose name matches; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root).select("path")


def united(*lists: DataFrame) -> DataFrame:
    """path: several lists of files as one, each file once."""
    return reduce(DataFrame.unionByName, [x.select("path") for x in lists]).distinct()


def first_lines(rows: DataFrame) -> DataFrame:
    """path and its first numbered line."""
    return rows.groupBy("path").agg(F.min_by("line", "pos").alias("first_line"))


def zip_members(spark: SparkSession, root: str, member: str = "conversations.json") -> DataFrame:
    """path, text of the wanted member of each zip file: at the top if there, else the first nested one."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("path").endswith(".zip") | ~F.col("path").rlike(r"\.[A-Za-z]+$")).where(F.substring("content", 1, 2) == F.lit(b"PK"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    found = sorted((n for n in z.namelist() if n == member or n.endswith("/" + member)), key=lambda n: (n != member, n))
                    if found:
                        out.append((path, z.read(found[0]).decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["path", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, text string")


class SqliteSource(DataSource):
    """``spark.read.format("sqlite")``, options ``path`` (one or more, comma-separated), ``query`` and a schema: each file is a partition."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        raise ValueError("give a schema")

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.options, self.schema = dict(options), schema

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.options["path"].split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import sqlite3

        path = str(partition.value).removeprefix("file://").removeprefix("file:")
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            for row in db.execute(self.options["query"]):
                yield (partition.value, *row)


def sqlite(spark: SparkSession, paths: list[str], query: str, schema: str) -> DataFrame:
    """Rows of a query over SQLite files, with ``path`` first."""
    ship(spark)
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").schema(f"path string, {schema}").option("path", ",".join(paths)).option("query", query).load()


def up_to_date(inputs: DataFrame, *outputs: DataFrame) -> DataFrame:
    """Inputs (path, modified) of which any of the outputs (path, written) is missing or older: transcripts need their training files to be current too."""
    stale = None
    for k, output in enumerate(outputs):
        out = output.select(F.col("path").alias(f"_p{k}"), F.col("written").alias(f"_w{k}"))
        inputs = inputs.join(out, F.col("path") == F.col(f"_p{k}"), "left")
        old = F.col(f"_w{k}").isNull() | (F.col(f"_w{k}") < F.col("modified"))
        stale = old if stale is None else stale | old
    return inputs.where(stale).drop(*[f"_{x}{k}" for k in range(len(outputs)) for x in "pw"])
