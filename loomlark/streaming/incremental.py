"""Incremental runs. The file source's checkpoint replaces modification-time checks: a run with ``availableNow`` reads only files
that no earlier run has read, and a failed run resumes. State lives in the checkpoint folder, not in the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlark.functions.text import percent_decoded
from loomlark.operators.index import changed, stale, upserted
from loomlark.operators.metrics import buckets


def new_texts(spark: SparkSession, root: str, glob: str = "*", files_per_batch: int = 10_000) -> DataFrame:
    """A stream of path, modified, text of new files under ``root``."""
    files = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("maxFilesPerTrigger", str(files_per_batch)).load(root)
    return files.select(percent_decoded(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))


def ingest(stream: DataFrame, normalise: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Each batch of new files through ``normalise`` and appended to ``out``. The batch id is a partition that a repeated batch
    overwrites, so a retry leaves no doubles."""

    def step(batch: DataFrame, n: int) -> None:
        normalise(batch).withColumn("batch", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_index(stream: DataFrame, chunks_of: Callable[[DataFrame], DataFrame], index_root: str, checkpoint: str) -> None:
    """Chunks of new and changed files merged into an index by id; each batch writes a new version beside the old one, only changed chunks are
    new. Where chunks have a ``path``, those that a file read again no longer gives are gone."""
    spark = stream.sparkSession

    def step(batch: DataFrame, n: int) -> None:
        chunks = chunks_of(batch)
        new = chunks
        if n:
            old = spark.read.parquet(f"{index_root}/v{n - 1}")
            new = upserted(old, changed(chunks, old), stale(chunks, old, batch) if "path" in chunks.columns else None)
        new.write.mode("overwrite").parquet(f"{index_root}/v{n}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 day", late: str = "2 days", *keys: str) -> DataFrame:
    """Counts per tumbling window and keys; on a stream, the watermark bounds the state kept for late rows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def metrics_of_batch(facts: DataFrame, date: str, keys: dict, measures: dict) -> DataFrame:
    """Day metrics of the days that a batch touches."""
    return buckets(facts, F.date_format(F.col(date), "yyyy-MM-dd"), keys, measures)
