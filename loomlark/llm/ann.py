"""Operator 7, approximate nearest neighbours by multi-index hashing.

Inner product becomes an angle: vectors are scaled by the largest norm and get one more component that makes
their length 1. Rotations learned on a bounded sample (iterative quantisation from random starts) turn them into
binary codes, which are split into 8-bit substrings, each with its own inverted index. A code within Hamming radius r
of the query must be close in some substring (pigeonhole), so probing each index within its share
of r retrieves every code within r. Only rows that a probe returns are compared with the query's code, and only those within r are
reranked, by the exact inner product in double precision.

Plan: all rows are indexed, in shards of bounded size; a query block visits each shard, so memory is one
shard and one block whatever the table's size. Vectors travel in their own type, once for each block of 16,384 queries. Each visit sends on
at most k rows a query. The radius is learned from the sample, where neighbours are farther than in the whole table, for ``cover`` of
the true neighbours. Queries with fewer than k found are answered again over every code (an exact way for the rest).

How much the index spares depends on the data: with groups of close vectors the probes return a small part of the rows, while
vectors spread evenly over many dimensions have their nearest neighbours at such a radius that the probes return most (README).

Cases: null, zero and non-finite vectors take no part, nor do those whose length differs from the most frequent one; repeated
rows are candidates of each other; an empty table gives an empty result; fewer than k candidates give all; of equal scores, also in
different shards, the smaller vec_id stands first.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlark.llm.shared import bounded_batches, written

FOUND = "query_row long, query_id long, vec_id long, score double"
_ONES = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


def _lifted(x: np.ndarray, norm: float) -> np.ndarray:
    x = x / norm
    return np.concatenate((x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))), 1)


def fit(sample: np.ndarray, norm: float, bits: int = 256, steps: int = 30, seed: int = 5) -> np.ndarray:
    """A (dimension + 1) x bits projection of learned rotations."""
    x = _lifted(sample, norm)
    d = x.shape[1]
    _, vectors = np.linalg.eigh(x.T @ x)
    basis = vectors[:, ::-1][:, : min(64, d)]
    y, rng, out = x @ basis, np.random.default_rng(seed), []
    for _ in range(ceil(bits / basis.shape[1])):
        r = np.linalg.qr(rng.standard_normal((basis.shape[1],) * 2))[0]
        for _ in range(steps):
            u, _, vt = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
            r = (u @ vt).T
        out.append(basis @ r)
    return np.concatenate(out, 1)[:, :bits]


def codes(x: np.ndarray, projection: np.ndarray) -> np.ndarray:
    return np.packbits(x @ projection >= 0, axis=1)


def _query_codes(q: np.ndarray, projection: np.ndarray) -> np.ndarray:
    return codes(np.concatenate((q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))), 1), projection)


def radius(sample: np.ndarray, norm: float, projection: np.ndarray, k: int, cover: float, queries: int = 300) -> int:
    """The Hamming distance within which ``cover`` of the true neighbours in the sample lie. A query is none of its own neighbours."""
    q = sample[:queries]
    score = q @ sample.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    own, other = _query_codes(q, projection), codes(_lifted(sample, norm), projection)
    distance = np.bitwise_count(own[:, None, :] ^ other[near]).sum(2)
    return int(np.quantile(distance, cover)) if distance.size else projection.shape[1]


class Index:
    """Inverted indexes over the substrings of one shard's codes. The union of a probe's buckets is kept for the next query
    with that byte there: at most 256 row sets for each substring."""

    def __init__(self, own: np.ndarray):
        self.words = np.ascontiguousarray(np.pad(own, ((0, 0), (0, -own.shape[1] % 8)))).view(np.uint64).T.copy()
        self.order = [np.argsort(own[:, j], kind="stable").astype(np.int32) for j in range(own.shape[1])]
        self.sizes = [np.bincount(own[:, j], minlength=256) for j in range(own.shape[1])]
        self.n = len(own)
        self.compared = 0
        self.probed: dict[tuple[int, int, int], np.ndarray] = {}

    def probe(self, j: int, value: int, r: int) -> np.ndarray:
        """Which rows have a byte within ``r`` bits of ``value`` in substring ``j``."""
        found = self.probed.get((j, value, r))
        if found is None:
            found = np.zeros(self.n, bool)
            found[self.order[j][np.repeat(_ONES[value] <= r, self.sizes[j])]] = True  # the posting lists of the buckets in the ball
            self.probed[j, value, r] = found
        return found

    def within(self, query: np.ndarray, most: int) -> np.ndarray:
        """Every row whose code is within ``most`` bits of the query's. ``compared`` counts the codes that were looked at."""
        if most >= 8 * len(query):
            return np.arange(self.n)
        share, more = divmod(most, len(query))
        seen = np.zeros(self.n, bool)
        for j, value in enumerate(query.tolist()):
            r = share if j <= more else share - 1  # if none of these holds, the distance exceeds ``most``
            if r >= 0:
                seen |= self.probe(j, value, r)
        rows = np.flatnonzero(seen)
        self.compared += len(rows)
        own = np.pad(query, (0, -len(query) % 8)).view(np.uint64)
        distance = np.zeros(len(rows), np.uint16)
        for column, word in zip(self.words, own):
            distance += np.bitwise_count(column[rows] ^ word)
        return rows[distance <= most]


def _visit(shard: pd.DataFrame, block: pd.DataFrame, norm: float, projection: np.ndarray, most: int, k: int) -> pd.DataFrame:
    if not len(shard) or not len(block):
        return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []})
    x = np.stack(shard["vector"].to_numpy()).astype(np.float64)
    q = np.stack(block["vector"].to_numpy()).astype(np.float64)
    ids, rows = shard["vec_id"].to_numpy(), shard["row"].to_numpy()
    index = Index(codes(_lifted(x, norm), projection))
    out: list[tuple] = []
    for own, code, query, row in zip(q, _query_codes(q, projection), block["vec_id"].tolist(), block["row"].tolist()):
        near = index.within(code, most)
        near = near[rows[near] != row]
        score = (x[near] * own).sum(1)
        if len(near) > k:
            floor = np.partition(score, len(score) - k)[len(score) - k]
            keep = score >= floor
            near, score = near[keep], score[keep]
        best = np.lexsort((ids[near], -score))[:k]
        out += [(row, query, i, s) for i, s in zip(ids[near[best]].tolist(), score[best].tolist())]
    return pd.DataFrame(out, columns=["query_row", "query_id", "vec_id", "score"])


def search(vectors: DataFrame, every: int = 20, k: int = 20, bits: int = 256, cover: float = 0.97, sample_rows: int = 10_000, shard_rows: int | None = None, block_rows: int = 16_384) -> DataFrame:
    """vec_id, embedding -> query_id, rank, vec_id, score. Queries: rows whose vec_id is divisible by ``every``. ``shard_rows``: by default
    8192 to 65,536, as many as give each core two shards; the result doesn't depend on it."""
    spark = vectors.sparkSession
    bounded_batches(spark, 5000)
    vector = F.transform("embedding", lambda e: e.cast("double"))
    sound = F.forall(vector, lambda e: e.isNotNull() & (F.abs(e) < float("inf")) & ~F.isnan(e)) & F.exists(vector, lambda e: e != 0)
    plain = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("embedding") if plain else vector).alias("vector"), sound.alias("sound"))
    rows = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.col("sound")).drop("sound")
    rows = written(rows, "vectors").withColumn("row", F.monotonically_increasing_id())
    size = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.sqrt(F.max(F.aggregate("vector", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))).alias("norm")).orderBy(F.desc("n"), F.desc("d")).first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vector") == size["d"])
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("row")).limit(sample_rows).select("vector").collect()], float)
    projection = fit(sample, size["norm"], bits)
    most, norm = radius(sample, size["norm"], projection, k, cover), float(size["norm"])
    shard_rows = shard_rows or min(max(8192, ceil(size["n"] / (2 * spark.sparkContext.defaultParallelism))), 65_536)
    shards = max(1, ceil(size["n"] / shard_rows))
    blocks = max(1, ceil(size["n"] / every / block_rows))
    queries = written(rows.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")), "queries")
    indexed = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))

    # both sides' keys are of one type: a cogroup compares bytes and casts nothing
    def visits(asked: DataFrame, within: int) -> DataFrame:
        left = indexed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(lambda a, b: _visit(a, b, norm, projection, within, k), FOUND)

    found = written(visits(queries, most), "found")
    few = found.groupBy("query_row").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, size["n"] - 1))
    lacking = written(queries.join(few, queries["row"] == few["query_row"], "left_anti"), "lacking")
    if size["n"] > 1 and lacking.head(1):
        found = found.join(lacking.select(F.col("row").alias("query_row")), "query_row", "left_anti").unionByName(visits(lacking, bits))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
