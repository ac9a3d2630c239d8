"""Scans of written artifacts: transcript headers and footers to session facts, and embedded YAML blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlark.functions.text import META, parse_duration, parse_token_value
from loomlark.operators.kinds import transcript_kind
from loomlark.operators.names import session_name
from loomlark.operators.search import line_table
from loomlark.session import ship


def _value(label: str) -> Column:
    """What follows the label on a metadata line, else null."""
    return F.when(F.startswith("line", F.lit(f"{META} {label}: ")), F.substr(F.col("line"), F.lit(len(META) + len(label) + 4)))


def _int(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, r"^\s*(\d{1,9})(?:\s|$)", 1).try_cast("int"), F.lit(0))


def _tokens(value: Column, label: str) -> Column:
    return parse_token_value(F.coalesce(F.nullif(F.regexp_extract(value, rf"(?:^|, )\s*(\S+) {label}(?:,|$)", 1), F.lit("")), F.lit("0")))


_KEYS = ("Session", "Project", "Started", "Session Kind", "Model", "Duration", "Messages", "Tool calls", "Function calls", "Files", "Tokens", "Cost")


def header_values(files: DataFrame) -> DataFrame:
    """path, text -> one column per key: the last metadata line with that key stands."""
    rows = line_table(files.select("path", "text"), "path").where(F.startswith("line", F.lit(META)))
    return rows.groupBy("path").agg(*[F.max_by(_value(k), F.when(_value(k).isNotNull(), F.col("pos"))).alias(k) for k in _KEYS])


def session_facts(files: DataFrame) -> DataFrame:
    """path, name, text of transcript files -> date, tool, project, model, counts, tokens, duration, kind. Files whose name is no session's go."""
    named = files.select("path", session_name(F.col("name")).alias("f")).where("f is not null")
    v = named.join(header_values(files), "path")
    pair = F.split("Messages", ", ")
    calls = F.split(F.coalesce("Tool calls", "Function calls"), ", ")
    failed = F.coalesce(_int(F.get(calls, F.lit(1))), F.lit(0))
    out = v.select(
        "path", F.col("f.date").alias("date"), F.col("f.tool").alias("tool"), F.coalesce("Project", F.lit("")).alias("project"), F.col("Model").alias("model"),
        F.coalesce(_int(F.get(pair, F.lit(0))), F.lit(0)).alias("user_msgs"), F.coalesce(_int(F.get(pair, F.lit(1))), F.lit(0)).alias("asst_msgs"),
        F.greatest(F.coalesce(_int(F.get(calls, F.lit(0))), F.lit(0)) - failed, F.lit(0)).alias("tool_ok"), failed.alias("tool_fail"),
        *[F.coalesce(_tokens(F.col("Tokens"), label), F.lit(0).cast("long")).alias(name) for label, name in (("in", "input_tokens"), ("out", "output_tokens"), ("cache_read", "cache_read_tokens"), ("cache_write", "cache_write_tokens"))],
        F.coalesce(parse_duration(F.col("Duration")), F.lit(0).cast("long")).alias("duration_secs"), F.regexp_extract("Cost", r"^\$([\d.]+)", 1).try_cast("double").alias("cost_usd"),
    )
    return out.withColumn("kind", transcript_kind(F.col("user_msgs"), F.col("asst_msgs")))


def evidence_blocks(files: DataFrame, heading: str = "CaseStudyEvidence") -> DataFrame:
    """path, yaml: the first fenced YAML block after the heading; files without one go."""
    block = F.regexp_extract("text", rf"(?ms)^##\s+{heading}\s*$.*?^```ya?ml\s*$\n(.*?)^```", 1)
    return files.select("path", block.alias("yaml")).where("yaml <> ''")


EVIDENCE = (
    "period string, period_kind string, projects array<string>, volume struct<sessions:long,user_turns:long,corrections:long,decisions:long>, agents_used array<struct<tool:string,model:string,sessions:long,tokens_in:long,tokens_out:long,cost_usd:double>>, "
    "instruction_deltas array<struct<summary:string,target:string,quote:string,codified:boolean>>, corrections array<struct<type:string,quote:string,context:string,codified_into:string>>, outcomes array<struct<unit:string,result:string,sessions:long,notes:string>>, "
    "process_invocations array<string>, open_threads array<string>, case_study_quotes array<string>, metrics_ref string, notes string"
)


def parse_evidence(blocks: DataFrame) -> DataFrame:
    """path, yaml -> path and ``e``, the block as a struct (null if it is no YAML mapping). YAML has no native reader: an Arrow UDF
    turns it into JSON, and from_json gives it types."""
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def as_json(texts: pd.Series) -> pd.Series:
        import json

        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading evidence needs the yaml package") from e

        def one(t):
            try:
                found = yaml.safe_load(t)
            except yaml.YAMLError:
                return None
            return json.dumps(found, default=str) if isinstance(found, dict) else None

        return texts.map(one)

    return blocks.select("path", F.from_json(as_json("yaml"), EVIDENCE).alias("e"))
