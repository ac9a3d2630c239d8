"""Operator 2, mixing sources to target weights by systematic sampling.

Each document of a source expects the same number of copies, target / source size. The expectations are
prefix-summed along the source, one random offset is added, and a document is emitted once for each integer
that its interval crosses. Documents stand in order of size, so that the sample is stratified by size and a
source's words stay near its target.

Plan: sizes are counted where texts are read and written once (id, source, size). One range exchange of
these narrow rows by (source, size) spreads a hot source over many tasks; the prefix sum is then
position in partition + rows of the source in earlier partitions, a table of at most
partitions + sources rows. No window runs over a whole source.

Cases: null text has size 0; the null source is a source of its own, last in order; a source without
words has target 0 and gives nothing; repeated rows are rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlark.llm.shared import unused, word_count, written


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, size -> per source: source_size, target. ``share`` of all words is dealt by weight; no target
    exceeds ``most`` times its source, and what is cut off goes to the others by weight. In order of
    cap / weight that water level is found with two running sums over the table of sources, one row each, which one task sorts."""
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("_cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.lit(share) * F.sum("source_size").over(every) - before) / onward
    per = per.withColumn("_level", level)
    per = per.withColumn("_level", F.min(F.when(F.col("_cap") >= F.col("_level") * F.col("_w"), F.struct(F.col("_cap") / F.col("_w"), "_level"))).over(every)["_level"])
    return per.select("source", "source_size", F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).cast("double").alias("target"))


def _offset(source: Column, seed: int) -> Column:
    """One number in [0, 1) for each source and seed, from a digest that other engines have too."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") / F.lit(float(1 << 28))


def copies(sizes: DataFrame, key: str, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 17, row: str | None = None) -> DataFrame:
    """key, source, size -> key, source, size, source_size, target, copies. ``row`` names a further column, a number unique to
    each row, which tells rows with equal keys apart and is returned last."""
    rows = [row] if row else []
    sizes = written(sizes.select(key, "source", F.col("size").cast("long").alias("size"), *rows), "sizes")
    at = sizes.withColumn("_row", F.col(row) if row else F.monotonically_increasing_id())
    at = at.repartitionByRange(F.col("source").asc_nulls_last(), "size", key, "_row").sortWithinPartitions(F.col("source").asc_nulls_last(), "size", key, "_row")
    at = written(at.withColumn("_pos", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_pos", 33)).drop("_row"), "ordered")
    runs = at.groupBy("_part", "source").agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_shift", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first"))
    tell = targets(sizes, weights, share, most)
    runs = runs.alias("r").join(tell.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r._part", F.col("r.source").alias("_source"), "r._shift", "t.source_size", "t.target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    row = F.col("_pos") + F.col("_shift")
    up_to = lambda n: F.floor(rate * n + _offset(F.col("source"), seed))
    out = at.join(runs, (at["_part"] == runs["_part"]) & at["source"].eqNullSafe(runs["_source"]))
    return out.select(key, "source", "size", "source_size", "target", F.least(up_to(row + 1) - up_to(row), F.lit(most).cast("long")).cast("long").alias("copies"), *rows)


def mix(docs: DataFrame, key: str = "doc_id", copy: str | None = None, **how) -> DataFrame:
    """One row per emitted copy, columns as they are; ``copy`` names a further column with the copy's number from 0.
    Each row has its own number of copies, also where keys repeat or are null: rows are numbered as they are written once."""
    row, name, many = unused(docs, "__row"), unused(docs, "__taken"), unused(docs, "__copies")
    marked = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    counted = copies(marked.select(key, "source", word_count(F.col("text")).alias("size"), row), key, row=row, **how)
    taken = counted.where("copies > 0").select(F.col(row).alias(name), F.col("copies").alias(many))
    out = marked.join(taken, marked[row] == taken[name]).withColumn(many, F.explode(F.sequence(F.lit(0), (F.col(many) - 1).cast("int"))))
    return out.select(*[marked[c] for c in docs.columns], *([F.col(many).alias(copy)] if copy else []))
