"""Planning of compaction: which lines, which periods, how many calls. The model is a callable given by the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlark.functions.text import ASSISTANT, META, TOOL_FAILED, TOOL_OK, USER
from loomlark.functions.timeutil import iso_week, valid_day, valid_month
from loomlark.operators.ordered import greedy_chunks

LINE_LIMIT = 5
ITEM_OVERHEAD = 30
MAX_INPUT_BYTES = 102_400


def extract_lines(rows: DataFrame, key: str, limit: int = LINE_LIMIT) -> DataFrame:
    """path, pos, line -> the lines that are compacted: metadata, user and assistant lines, and of what follows an
    assistant line the first ``limit`` lines that are not blank, up to the next marked line."""
    starts = lambda *marks: F.coalesce(*[F.when(F.startswith("line", F.lit(m)), m) for m in marks])
    rows = rows.withColumn("_mark", starts(META, USER, ASSISTANT, TOOL_OK, TOOL_FAILED))
    w = Window.partitionBy(key).orderBy("pos")
    rows = rows.withColumn("_island", F.count("_mark").over(w)).withColumn("_open", F.last("_mark", ignorenulls=True).over(w))
    more = F.col("_mark").isNull() & (F.col("_open") == ASSISTANT) & F.col("line").rlike(r"(?U)\S")
    nth = F.sum(F.when(more, 1).otherwise(0)).over(Window.partitionBy(key, "_island").orderBy("pos"))
    kept = F.coalesce(F.col("_mark").isin(META, USER, ASSISTANT), F.lit(False)) | (more & (F.col("_nth") <= limit))
    return rows.withColumn("_nth", nth).where(kept).drop("_mark", "_island", "_open", "_nth")


def plan_calls(items: DataFrame, period: str, name: str, size: str, prompt_bytes: int, budget: int = MAX_INPUT_BYTES) -> DataFrame:
    """period, items, total_bytes, chunks, calls: one call if all fits, else one per chunk and a merge. A null size counts as 0."""
    left = budget - prompt_bytes - 100
    rows = items.withColumn(size, F.coalesce(size, F.lit(0))).withColumn("_item", (F.col(size) + F.octet_length(F.col(name).cast("string")) + ITEM_OVERHEAD).cast("long"))
    chunked = greedy_chunks(rows.select(period, name, size, "_item"), [period], [name], "_item", left)
    out = chunked.groupBy(period).agg(F.count("*").alias("items"), F.sum(size).alias("total_bytes"), (F.max("chunk") + 1).cast("long").alias("chunks"))
    single = F.col("total_bytes") + prompt_bytes + 100 <= budget
    return out.withColumn("calls", F.when(single, F.lit(1).cast("long")).otherwise(F.col("chunks") + 1)).withColumn("chunks", F.when(single, F.lit(1).cast("long")).otherwise(F.col("chunks")))


def reports(files: DataFrame) -> DataFrame:
    """Report files (month, name, ...) with ``kind`` (daily, weekly, monthly) and ``covers`` (the day, week or month in the name).
    Other files go."""
    ends = r"\.(daily|compaction|weekly|monthly)\.md$"
    kind = F.regexp_extract("name", ends, 1)
    named = files.withColumn("kind", F.when(kind == "compaction", "daily").otherwise(kind)).where("kind <> ''")
    return named.withColumn("covers", F.regexp_replace("name", ends, ""))


def of_pending_weeks(files: DataFrame) -> DataFrame:
    """Daily reports whose ISO week has no weekly report in any folder, with ``week``. Names without a valid day are ignored."""
    rows = reports(files)
    days = rows.where((F.col("kind") == "daily") & valid_day(F.col("covers"))).withColumn("week", iso_week(F.col("covers").try_cast("date")))
    return days.join(rows.where("kind = 'weekly'").select(F.col("covers").alias("week")), "week", "left_anti")


def of_pending_months(files: DataFrame, source: str = "auto") -> DataFrame:
    """Reports that a monthly report is made of, for months that have daily reports and no monthly one. ``source``: dailies,
    weeklies, or auto (weekly reports where the month has any). A month without reports of its source gives no rows."""
    if source not in ("auto", "dailies", "weeklies"):
        raise ValueError(f"not a source of monthly reports: {source}")
    rows = reports(files).where(valid_month(F.col("month")))
    have = rows.groupBy("month").agg(F.bool_or(F.col("kind") == "daily").alias("_d"), F.bool_or(F.col("kind") == "weekly").alias("_w"), F.bool_or((F.col("kind") == "monthly") & (F.col("covers") == F.col("month"))).alias("_m"))
    use = F.when(F.col("_w"), "weekly").otherwise("daily") if source == "auto" else F.lit({"dailies": "daily", "weeklies": "weekly"}[source])
    wanted = have.where("_d and not _m").select("month", use.alias("kind"))
    return rows.join(wanted, ["month", "kind"], "left_semi")


def plan_weeks(files: DataFrame, prompt_bytes: int, budget: int = MAX_INPUT_BYTES, size: str = "bytes") -> DataFrame:
    """``plan_calls`` of each pending week."""
    return plan_calls(of_pending_weeks(files), "week", "name", size, prompt_bytes, budget)


def plan_months(files: DataFrame, prompt_bytes: int, budget: int = MAX_INPUT_BYTES, source: str = "auto", size: str = "bytes") -> DataFrame:
    """``plan_calls`` of each pending month."""
    return plan_calls(of_pending_months(files, source), "month", "name", size, prompt_bytes, budget)


def uncached(chunks: DataFrame, cache: DataFrame, *by: str) -> DataFrame:
    """Planned chunks without a stored result for the same keys and input digest: those that still need a call."""
    return chunks.join(cache.select(*by), list(by), "left_anti")


def pending(periods: DataFrame, done: DataFrame, period: str, limit: int | None = None) -> DataFrame:
    """Periods without output, oldest first."""
    out = periods.select(period).distinct().join(done.select(period), period, "left_anti").orderBy(period)
    return out if limit is None else out.limit(limit)
