"""File names of artifacts: parsing, classification and collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlark.functions.text import TOOL_SUFFIXES, tool_suffix


def artifact_of(name: Column) -> Column:
    """monthly, daily, training, session or null, by file name."""
    stem = F.regexp_replace(name, r"\.(?:md|txt)$", "")
    session = name.rlike(r"\.(?:md|txt)$") & (F.startswith(name, F.lit("unknown-")) | ((F.octet_length(stem) >= 20) & stem.rlike(r"^.{4}-.{2}-.{2}T")))
    return F.when(name.rlike(r"\.monthly\.md$"), "monthly").when(name.rlike(r"\.(?:daily|compaction)\.md$"), "daily").when(name.rlike(r"\.training\.json$"), "training").when(session, "session")


def session_name(name: Column, strict: bool = False) -> Column:
    """struct<date, tool> of a session's file name. ``strict`` accepts only ``.md`` with a time in the stem."""
    stem = F.regexp_replace(name, r"\.(?:md|txt)$", "")
    ok = name.rlike(r"^\d{4}-\d{2}-\d{2}T.*\.md$") if strict else name.rlike(r"^\d{4}-\d{2}-\d{2}.*\.(?:md|txt)$")
    tool = tool_suffix(stem)
    return F.when(ok & tool.isNotNull() & ~name.rlike(r"\.(?:monthly|daily|compaction)\.md$"), F.struct(F.substring(stem, 1, 10).alias("date"), tool.alias("tool")))


def output_name(started_at: Column, tool: Column) -> Column:
    """struct<month, stem>."""
    return F.struct(F.date_format(started_at, "yyyy-MM").alias("month"), F.concat_ws("-", F.date_format(started_at, "yyyy-MM-dd'T'HH-mm-ss"), tool).alias("stem"))


def without_collisions(rows: DataFrame, folder: str, stem: str, path: str) -> DataFrame:
    """``name``: within (folder, stem) the lowest path keeps the stem; the others get eight digits of their path's digest before the tool."""
    nth = F.row_number().over(Window.partitionBy(folder, stem).orderBy(path))
    mark = F.substring(F.sha2(F.col(path).cast("string"), 256), 1, 8)
    ends = f"^(.*)-({'|'.join(TOOL_SUFFIXES)})$"
    inside = F.concat_ws("-", F.regexp_extract(stem, ends, 1), mark, F.regexp_extract(stem, ends, 2))
    other = F.when(F.col(stem).rlike(ends), inside).otherwise(F.concat_ws("-", F.col(stem), mark))
    return rows.withColumn("name", F.when(nth == 1, F.col(stem)).otherwise(other))
