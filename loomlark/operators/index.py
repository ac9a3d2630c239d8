"""Chunks of an archive for semantic search: paragraphs, greedy packing, long lines, ids, diff, upsert."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from loomlark.functions.digests import chunk_id, text_hash
from loomlark.functions.text import TOOL_FAILED, TOOL_OK, scrub_paths, trimmed, truncate_line
from loomlark.functions.vectors import cosine
from loomlark.operators.ordered import greedy_chunks, islands
from loomlark.session import ship

MAX_BYTES = 1800


def embedding_line(line, include_paths: bool = False):
    """The text of a line that is embedded; tool status lines give none unless paths are included."""
    if include_paths:
        return trimmed(line)
    tool = F.startswith(line, F.lit(TOOL_OK)) | F.startswith(line, F.lit(TOOL_FAILED))
    return F.when(tool, "").otherwise(trimmed(scrub_paths(line)))


def split_long(rows: DataFrame, text: str, most: int = MAX_BYTES) -> DataFrame:
    """Lines over ``most`` bytes cut every ``most`` characters: ``segment`` from 0 and ``part``."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / most).cast("int")), lambda k: F.substr(F.col(text), k * most + 1, F.lit(most)))
    return rows.where(F.octet_length(text) > most).select("*", F.posexplode(pieces).alias("segment", "part"))


def chunk_lines(rows: DataFrame, path: str = "path", artifact: str = "artifact", include_paths: bool = False, most: int = MAX_BYTES) -> DataFrame:
    """path, artifact, pos, line -> chunks. Blank and long lines close a chunk; a long line is cut into chunks of its own."""
    rows = rows.select(path, artifact, "pos", "line", embedding_line(F.col("line"), include_paths).alias("_e"))
    short = (F.col("_e") != "") & (F.octet_length("_e") <= most)
    marked = rows.withColumn("_island", islands([path], ["pos"], ~short)).withColumn("_size", F.octet_length("_e").cast("long"))
    packed = greedy_chunks(marked.where(short), [path, "_island"], ["pos"], "_size", most, separator=1)
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c.alias("t")))), lambda s: s["t"]), "\n")
    chunks = packed.groupBy(path, artifact, "_island", "chunk").agg(F.min("pos").alias("line_start"), F.max("pos").alias("line_end"), joined(trimmed(F.col("line"))).alias("chunk_text"), joined(F.col("_e")).alias("embedding_text")).withColumn("segment", F.lit(0))
    long = split_long(rows, "_e", most).select(path, artifact, F.col("pos").alias("line_start"), F.col("pos").alias("line_end"), F.col("part").alias("chunk_text"), F.col("part").alias("embedding_text"), "segment")
    every = chunks.drop("_island", "chunk").unionByName(long)
    return every.withColumn("id", chunk_id(F.col(path), F.col(artifact), F.col("line_start"), F.col("line_end"), F.col("segment"))).withColumn("content_hash", text_hash(F.col("embedding_text")))


def changed(chunks: DataFrame, existing: DataFrame) -> DataFrame:
    """Chunks that the index lacks or holds with another hash."""
    old = existing.select(F.col("id").alias("_id"), F.col("content_hash").alias("_hash"))
    return chunks.join(old, F.col("id") == F.col("_id"), "left").where(~F.col("content_hash").eqNullSafe(F.col("_hash"))).drop("_id", "_hash")


def stale(chunks: DataFrame, existing: DataFrame, scanned: DataFrame, source: str = "path") -> DataFrame:
    """Index rows of scanned sources that no chunk has any more."""
    return existing.join(scanned.select(source).distinct(), source, "left_semi").join(chunks.select("id"), "id", "left_anti")


def upserted(existing: DataFrame, new: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """The index after replacing and adding ``new`` by id and dropping ``gone``."""
    kept = existing.join(new.select("id"), "id", "left_anti")
    if gone is not None:
        kept = kept.join(gone.select("id"), "id", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


#: Texts -> one vector each. A provider runs in Python workers, so it opens its own model or connection.
Provider = Callable[[list[str]], list[list[float]]]


def embedded(chunks: DataFrame, provider: Provider, batch_size: int = 16, text: str = "embedding_text", out: str = "embedding") -> DataFrame:
    """``chunks`` with a vector of ``provider``, called on at most ``batch_size`` texts at a time. Null texts count as empty;
    another number of vectors than texts is an error."""
    ship(chunks.sparkSession)
    schema = StructType([*chunks.schema.fields, StructField(out, ArrayType(FloatType()))])
    at = chunks.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            found: list[list[float]] = []
            for s in range(0, len(texts), batch_size):
                asked = texts[s : s + batch_size]
                got = provider(asked)
                if len(got) != len(asked):
                    raise ValueError(f"the provider gave {len(got)} vectors for {len(asked)} texts")
                found += [list(map(float, v)) for v in got]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float32()))], [f.name for f in schema.fields])

    return chunks.mapInArrow(run, schema)


def build_index(rows: DataFrame, provider: Provider, existing: DataFrame | None = None, keep: tuple[str, ...] = (), batch_size: int = 16, include_paths: bool = False) -> tuple[DataFrame, DataFrame]:
    """(index, report). ``rows``: path, artifact, pos, line and the columns ``keep`` of a path. Only chunks that are new or
    changed are embedded; chunks of scanned paths that no line gives any more go; those of other paths stay. ``report``: one row
    with chunks, embedded, removed. Both are lazy: write the index before it replaces ``existing``."""
    chunks = chunk_lines(rows, include_paths=include_paths)
    if keep:
        chunks = chunks.join(rows.groupBy("path").agg(*[F.min(c).alias(c) for c in keep]), "path")
    new = chunks if existing is None else changed(chunks, existing)
    gone = None if existing is None else stale(chunks, existing, rows)
    index = embedded(new, provider, batch_size)
    if existing is not None:
        index = upserted(existing, index, gone)
    counts = [chunks.select(F.lit("chunks").alias("what")), new.select(F.lit("embedded").alias("what")), *([gone.select(F.lit("removed").alias("what"))] if gone is not None else [])]
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    report = every.agg(*[F.count_if(F.col("what") == w).alias(w) for w in ("chunks", "embedded", "removed")])
    return index, report


def semantic_search(index: DataFrame, query: str, provider: Provider, k: int = 10, scope: Column | None = None, width: int = 500) -> DataFrame:
    """The ``k`` chunks nearest to ``query``, with ``score``, the chunk's text cut to ``width`` characters."""
    if not query.strip():
        raise ValueError("the query is empty")
    return nearest(index, provider([query])[0], k, scope=scope).withColumn("chunk_text", truncate_line(F.col("chunk_text"), width))


def nearest(chunks: DataFrame, query: list[float], k: int = 10, vector: str = "embedding", key: str = "id", scope=None) -> DataFrame:
    """Top k by cosine; a heap of k rows per task, then one merge (TakeOrderedAndProject)."""
    rows = chunks if scope is None else chunks.where(scope)
    own = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("score", cosine(F.col(vector), own)).where(F.col("score").isNotNull()).orderBy(F.desc("score"), key).limit(k)
