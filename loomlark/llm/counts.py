"""Operator 8, token counts through a digest cache.

Content is normalised (white space runs to one space, ends trimmed: the tokenizer drops white space, so the
count stays), digested, and joined with the tokenizer version to stored counts. Distinct misses alone are
encoded and then appended to the cache, so copies and later runs cost a join.

Cases: null text counts as empty, 0 tokens; texts are counted whole; special strings inside texts count as
the library's default has it; rows with equal or null ids each keep their row; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlark.llm.ledger import addressed, unseen
from loomlark.llm.shared import bounded_batches, fresh_path, text_or_empty, written
from loomlark.llm.tokens import word_counts

CACHE = "digest binary, version string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file."""
    import hashlib

    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def encode_counts(texts: DataFrame, tokenizer_path: str) -> DataFrame:
    """digest, text -> digest, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = word_counts(tokenizer_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(t.as_py()) for t in batch.column(1)], pa.int64())], ["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def count_tokens(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", cache_path: str | None = None, limit: int = 2048) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit. ``cache_path``: a Parquet folder of stored counts, appended to; without
    one, a new cache in the shared folder serves this call."""
    spark = docs.sparkSession
    bounded_batches(spark)
    version = tokenizer_version(tokenizer_path)
    content = F.trim(F.regexp_replace(text_or_empty(F.col("text")), r"[ \t-\r]+", " "))
    rows = written(addressed(docs, key, content), "digests")
    store = None
    if cache_path is None:
        cache_path = fresh_path(spark, "token-cache")
    else:
        spark.createDataFrame([], CACHE).write.mode("append").parquet(cache_path)
        store = spark.read.schema(CACHE).parquet(cache_path).where(F.col("version") == version)
    new = encode_counts(unseen(docs, rows, key, content, store), tokenizer_path)
    new.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache_path)
    counts = spark.read.schema(CACHE).parquet(cache_path).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = written(counts, "counts")  # so that the join with a hot content can be split
    return rows.join(counts, "digest").select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
