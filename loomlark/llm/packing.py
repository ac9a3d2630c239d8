"""Operator 1, best-fit packing: vector best-fit over token, document-count and attention-cost capacities.

Plan: documents are tokenised and cut where they are read (a narrow map), the piece lengths (some 40
bytes a piece, not the texts) are written once, dealt by a hash of the row number into groups of about
``group_pieces``, and each group is packed on its own. A group is bounded, so no task grows with the
input; a group wastes at most its last bins, under 0.1 % at the default size.

With the default capacities (as many documents as tokens, the cost of one full sequence) the token capacity alone can bind, as the
sum of squared lengths never exceeds the square of their sum; the other two then only break ties. Lower ``max_documents`` or
``max_cost`` and they bind.

Ids come from the byte-pair encoder of another library on the same public vocabulary, in that library's file format (``tokens``);
tests hold them equal to those of ``tokenizers`` on the ``.json``, on documents and on random strings.

Cases: null and empty texts give one piece that holds the separator alone; repeated rows and null ids are
packed like any other row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlark.llm.shared import bounded_batches, text_or_empty, written
from loomlark.llm.tokens import byte_ids

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(total: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` ids: only the first may be shorter than ``limit``."""
    first = total % limit or limit
    return [(0, first)] + [(s, limit) for s in range(first, total, limit)]


def pieces(docs: DataFrame, ranks_path: str, limit: int = 2048, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, text -> one row per piece; ``with_ids`` adds the ids themselves."""
    bounded_batches(docs.sparkSession)
    schema = PIECES + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = byte_ids(ranks_path), separator.to_bytes(4, "little")
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = encode(text) + end
                for k, (s, n) in enumerate(cut(len(raw) // 4, limit)):
                    own = raw[4 * s : 4 * (s + n)]
                    for column, x in zip(out, (doc, k, s, n, zlib.crc32(own))):
                        column.append(x)
                    if with_ids:
                        out[5].append(memoryview(own).cast("I").tolist())
            arrays = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))]
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays(arrays[: len(names)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text")).mapInArrow(run, schema)


def best_fit(lengths: list[int], capacity: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm") -> list[tuple[int, int]]:
    """(bin, offset) of each item. An item demands (length, 1, length squared); a bin accepts it only if all
    three residuals suffice. Items go longest first. ``norm``: the bin whose weighted residual is smallest
    afterwards; ``dot``: the bin whose residual has the largest weighted dot product with the demand.

    Bins with equal residuals are one state. States are kept by residual tokens, and a bit mask tells which
    residuals occur, so the search for ``norm`` walks up from the exact fit and ends when the token term alone
    exceeds the best found: the choice is the same as over all bins."""
    T, D, A = capacity
    wt, wd, wa = weights
    held: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(T + 1)]  # residual tokens -> (documents, cost) -> bins
    mask, bins, filled = 0, 0, []
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        if n > T or n * n > A or D < 1:
            raise ValueError(f"an item of {n} tokens fits no bin of {capacity}")
        best, at = None, None
        rest = mask >> n
        r = n - 1
        while rest:
            step = (rest & -rest).bit_length()
            r += step
            rest >>= step
            least = wt * ((r - n) / T) ** 2
            if rule == "norm" and best is not None and least >= best:
                break
            for d, a in held[r]:
                if d >= 1 and a >= n * n:
                    if rule == "norm":
                        score = least + wd * ((d - 1) / D) ** 2 + wa * ((a - n * n) / A) ** 2
                    else:
                        score = -(wt * n * r / T**2 + wd * d / D**2 + wa * n * n * a / A**2)
                    if best is None or score < best:
                        best, at = score, (r, d, a)
        if at is None:
            b, (r, d, a) = bins, (T, D, A)
            bins += 1
            filled.append(0)
        else:
            r, d, a = at
            stack = held[r][d, a]
            b = stack.pop()
            if not stack:
                del held[r][d, a]
                if not held[r]:
                    mask &= ~(1 << r)
        placed[i] = (b, filled[b])
        filled[b] += n
        if r - n and d > 1:
            held[r - n].setdefault((d - 1, a - n * n), []).append(b)
            mask |= 1 << (r - n)
    return placed


def pack(rows: DataFrame, limit: int = 2048, max_documents: int | None = None, max_cost: int | None = None, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm", group_pieces: int = 20_000) -> DataFrame:
    """Pieces with sequence_id and offset. ``max_documents`` and ``max_cost`` (sum of squared lengths) default
    to what a full sequence can hold, so that tokens decide alone."""
    capacity = (limit, max_documents or limit, max_cost or limit * limit)
    rows = written(rows, "pieces")
    names = rows.columns
    groups = max(1, ceil(rows.count() / group_pieces))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        placed = best_fit(part["length"].tolist(), capacity, weights, rule)
        base = int(key[0]) << 32
        return part[names].assign(sequence_id=[base + b for b, _ in placed], offset=[o for _, o in placed])

    dealt = rows.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(run, schema + ", sequence_id long, offset long")
