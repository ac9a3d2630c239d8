"""Operator 3, SimHash near-duplicates through a segment-popcount embedding.

A fingerprint is embedded as the bit counts of ``SEGMENTS`` segments of two bits. The Manhattan distance of two
embeddings is at most their Hamming distance, so fingerprints that link (``radius`` bits or fewer) lie within
``radius`` of each other in the embedding too. Segments are grouped into axes; a Manhattan distance of ``radius`` can touch at
most ``radius`` axes, so the pair shares a grid cell on some choice of all axes but ``radius``. Every choice is one grid: the range
join is the union of these joins by cell. Within a cell, pairs are filtered by the Manhattan lower bound and then verified
exactly by Hamming distance. The links are the same for any number of axes; it follows the number of fingerprints (``axes_for``),
so that a cell holds few by chance.

Plan: fingerprints are computed where texts are read and written once (id, fingerprint); copies collapse
to one row by fingerprint with map-side combining. The grid rows are 16 bytes each, 70 per distinct
fingerprint up to 268 million of them, in one exchange; sorted by cell within partitions they are streamed through numpy. A cell emits
the edges of a spanning forest, never its pairs, so a large group of near copies costs rows in proportion to its
size. Components come from alternating star contraction over written edge tables. The least neighbour of each node, and of each
component the least key, are written before they are joined: both sides of these joins are scans, so that Spark can split
a node or component that holds a third of all rows. Nothing is collected.

Cases: null and empty texts have fingerprint 0 and link like any other; under ``words`` words the whole sequence
is one shingle; null ids are nodes by their fingerprint and are never the smallest; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlark.llm.shared import bounded_batches, text_or_empty, unused, written

AXES, RADIUS, SEGMENTS = 8, 4, 32
_ONES = np.uint64(0x0101010101010101)
_PAIR = np.uint64(0x5555555555555555)


def fingerprint(text: bytes, words: int = 4) -> int:
    """The 64-bit fingerprint as a signed integer. ``bytes.lower`` maps A-Z alone and ``bytes.split`` cuts at the
    six ASCII white space characters alone."""
    from xxhash import xxh64_intdigest

    parts = text.lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    ends = ends[words - 1 :] if len(parts) > words else ends[-1:]
    h = np.fromiter((xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends.tolist())), np.uint64, n)
    # eight byte-wide counters at a time, in blocks of at most 255 rows
    pad = -n % 255
    block = np.concatenate((h, np.zeros(pad, np.uint64))).reshape(-1, 255)
    total = np.empty((8, 8), np.int64)  # [bit in byte, byte]
    for k in range(8):
        lanes = ((block >> np.uint64(k)) & _ONES).sum(axis=1, dtype=np.uint64)
        total[k] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = (2 * total.T.reshape(64) > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", words: int = 4) -> DataFrame:
    """key, fp (long)."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_buffer().to_pybytes(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], [key, "fp"])

    return docs.select(key, text_or_empty(F.col("text")).alias("text")).mapInArrow(run, f"`{key}` {kind}, fp long")


def embed(fp: np.ndarray) -> np.ndarray:
    """Bit counts of 32 two-bit segments, packed in two bits each."""
    fp = fp.view(np.uint64)
    return (fp & _PAIR) + ((fp >> np.uint64(1)) & _PAIR)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of packed embeddings. Counts 0, 1, 2 in unary (00, 01, 11) differ in as many bits as they differ."""
    return np.bitwise_count(_unary(a) ^ _unary(b))


def _unary(e: np.ndarray) -> np.ndarray:
    high = (e >> np.uint64(1)) & _PAIR
    return (e & ~(high << np.uint64(1))) | high | (high << np.uint64(1))


def axes_for(fingerprints: int, by_chance: int = 16) -> int:
    """The fewest axes, ``AXES`` at least, at which a cell holds at most ``by_chance`` of random fingerprints: a segment's count tells 1.5 bits."""
    axes = AXES
    while axes < SEGMENTS and fingerprints > by_chance * 2 ** (1.5 * SEGMENTS * (axes - RADIUS) / axes):
        axes += 1
    return axes


def _grids(axes: int) -> list[tuple[int, np.uint64]]:
    ends = [2 * (SEGMENTS * a // axes) for a in range(axes + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:])]
    return [(k, np.uint64(sum(chosen))) for k, chosen in enumerate(combinations(masks, axes - RADIUS))]


def _forest(fp: np.ndarray, edges: list[np.ndarray]) -> None:
    """Spanning-forest edges of one cell. The unvisited shrink with each visit, so a dense group costs about its size."""
    rest, emb = fp, _unary(embed(fp))
    while len(rest) > 1:
        front, rest, emb = rest[:1], rest[1:], emb[1:]
        while len(front) and len(rest):
            u, front = front[:1], front[1:]
            near = np.flatnonzero(np.bitwise_count(emb ^ _unary(embed(u))) <= RADIUS)
            near = near[np.bitwise_count(rest[near].view(np.uint64) ^ u.view(np.uint64)) <= RADIUS]
            if len(near):
                got = rest[near]
                edges.append(np.stack((np.repeat(u, len(near)), got), 1))
                keep = np.ones(len(rest), bool)
                keep[near] = False
                rest, emb, front = rest[keep], emb[keep], np.concatenate((front, got))


SMALL = 24


def _cell_edges(cell: np.ndarray, grid: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Edges within runs of equal (grid, cell): small runs by shifted comparison, large ones by ``_forest``."""
    change = np.flatnonzero((cell[1:] != cell[:-1]) | (grid[1:] != grid[:-1])) + 1
    first = np.concatenate(([0], change))
    size = np.diff(np.concatenate((first, [len(cell)])))
    run = np.repeat(np.arange(len(first)), size)
    edges: list[np.ndarray] = []
    small = size[run] <= SMALL
    index, own = np.flatnonzero(small & (size[run] > 1)), None
    own, emb = fp[index], _unary(embed(fp[index]))
    at = run[index]
    for d in range(1, SMALL):
        if len(at) <= d:
            break
        hit = np.flatnonzero((at[d:] == at[:-d]) & (np.bitwise_count(emb[d:] ^ emb[:-d]) <= RADIUS))
        hit = hit[np.bitwise_count(own[hit + d].view(np.uint64) ^ own[hit].view(np.uint64)) <= RADIUS]
        if len(hit):
            edges.append(np.stack((own[hit], own[hit + d]), 1))
    for k in np.flatnonzero(size > SMALL):
        _forest(fp[first[k] : first[k] + size[k]], edges)
    return np.concatenate(edges) if edges else np.empty((0, 2), np.int64)


def links(distinct: DataFrame, axes: int | None = None) -> DataFrame:
    """fp (distinct) -> edges a < b whose components are those of all pairs within the radius."""
    axes = axes or axes_for(distinct.count())

    def grid_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = _grids(axes)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            e = embed(fp)
            for s in range(0, len(fp), 4096):
                part, own = e[s : s + 4096], fp[s : s + 4096]
                cells = np.concatenate([part & m for _, m in grids]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([k for k, _ in grids], np.int16), len(own))), pa.array(cells), pa.array(np.tile(own, len(grids)))], ["grid", "cell", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def flush(parts):
            grid, cell, fp = (np.concatenate(x) for x in zip(*parts))
            found = _cell_edges(cell, grid, fp)
            low, high = np.minimum(found[:, 0], found[:, 1]), np.maximum(found[:, 0], found[:, 1])
            return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["a", "b"])

        for batch in batches:
            new = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(new[0]):
                continue
            held.append(new)
            rows += len(new[0])
            if rows < 50_000:
                continue
            whole = tuple(np.concatenate(x) for x in zip(*held))
            grid, cell = whole[0], whole[1]
            last = np.flatnonzero((grid != grid[-1]) | (cell != cell[-1]))
            if not len(last):
                held = [whole]
                continue
            stop = last[-1] + 1  # the last cell may go on in the next batch
            yield flush([tuple(x[:stop] for x in whole)])
            held, rows = [tuple(x[stop:] for x in whole)], len(grid) - stop
        if held:
            yield flush(held)

    cells = distinct.select("fp").mapInArrow(grid_rows, "grid short, cell long, fp long")
    dealt = cells.repartition("grid", "cell").sortWithinPartitions("grid", "cell", "fp")
    return dealt.mapInArrow(verify, "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b) -> node, label (smallest node of its component), for nodes with an edge.

    Alternating star contraction: each round links every node's larger neighbours to its smallest (large star),
    then every node's smaller neighbours to the smallest (small star), until nothing changes. Each round
    writes its edges; the number of rounds grows with the logarithm of the longest chain."""
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(most_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = written(both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct(), "edges")
        low = written(large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m")), "least")
        new = written(large.join(low, F.col("b") == F.col("u")).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct(), "edges")
        # a star forest, each node below one centre that is below none: nothing moves any more
        tangled = new.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").limit(1).unionByName(new.join(new.select(F.col("b").alias("_b")).distinct(), F.col("a") == F.col("_b"), "left_semi").select("b", F.lit(1).cast("long").alias("n")).limit(1))
        edges = new
        if not tangled.head(1):
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", words: int = 4) -> DataFrame:
    """key, fp, label (the component's own name), component (smallest key reachable), one row for each row of ``docs``."""
    own = written(fingerprints(docs, key, words), "fingerprints")
    distinct = written(own.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    label = components(links(distinct))
    known = written(distinct.join(label, distinct["fp"] == label["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "classes")
    top = written(known.groupBy("label").agg(F.min("least").alias("component")), "components")
    return own.join(known.join(top, "label").select("fp", "label", "component"), "fp").select(key, "fp", "label", "component")


def keep_one(docs: DataFrame, key: str = "doc_id", words: int = 4) -> DataFrame:
    """One row of each component of ``docs``, columns as they are: that with the smallest key. Where a key
    occurs more than once or is null, rows are told apart by their fingerprints as well."""
    found = written(near_duplicates(docs, key, words), "near-duplicates")
    best = found.groupBy("label").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "fp")).alias("b")).select("b.key", "b.fp")
    often = found.groupBy(F.col(key).alias("often")).agg(F.count("*").alias("n")).where("n > 1 or often is null").select("often")
    often = written(best.join(often, best["key"].eqNullSafe(often["often"]), "left_semi"), "repeated")
    once = best.join(often.select(F.col("key").alias("_o")).distinct(), F.col("key").eqNullSafe(F.col("_o")), "left_anti")
    id_, row = unused(docs, "__key"), unused(docs, "__row")
    kept = docs.join(once.select(F.col("key").alias(id_)).hint("shuffle_hash"), docs[key] == F.col(id_), "left_semi")
    if not often.head(1):
        return kept
    rows = docs.join(often.select(F.col("key").alias(id_)).distinct(), docs[key].eqNullSafe(F.col(id_)), "left_semi")
    marked = written(rows.withColumn(row, F.monotonically_increasing_id()), "repeated-rows")
    own = fingerprints(marked.select(F.col(row).alias("row"), "text"), "row", words).join(marked.select(F.col(row).alias("row"), F.col(key).alias("id")), "row")
    pick = own.join(often, own["id"].eqNullSafe(often["key"]) & (own["fp"] == often["fp"]), "left_semi").groupBy("id", "fp").agg(F.min("row").alias(id_)).select(id_)
    return kept.unionByName(marked.join(pick, F.col(row) == F.col(id_), "left_semi").drop(row))
