"""Summaries over session facts: one row per session with dimensions and additive measures.

All three are one aggregation with partial sums before the exchange; totals come from grouping sets in
the same pass and not from a second scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_month_and_tool(facts: DataFrame, month: str, tool: str, *measures: Column) -> DataFrame:
    """Long form of the pivot: (month, tool), with ``Total`` for row, column and grand totals."""
    grouped = facts.groupingSets([[F.col(month), F.col(tool)], [F.col(month)], [F.col(tool)], []], F.col(month), F.col(tool))
    out = grouped.agg(*measures, F.grouping(F.col(month)).alias("_m"), F.grouping(F.col(tool)).alias("_t"))
    return out.withColumn(month, F.when(F.col("_m") == 1, "Total").otherwise(F.col(month))).withColumn(tool, F.when(F.col("_t") == 1, "Total").otherwise(F.col(tool))).drop("_m", "_t")


def pivoted(facts: DataFrame, month: str, tool: str, tools: list[str], measure: Column) -> DataFrame:
    """Wide form: a column per tool of a given list (no extra scan to find them)."""
    return facts.groupBy(month).pivot(tool, tools).agg(measure)


def by_key(facts: DataFrame, key: str, *measures: Column, missing: str | None = None) -> DataFrame:
    """One row per key and a ``Total`` row; null or empty keys become ``missing``."""
    if missing is not None:
        facts = facts.withColumn(key, F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit(missing)))
    out = facts.rollup(key).agg(*measures, F.grouping(F.col(key)).alias("_g"))
    return out.withColumn(key, F.when(F.col("_g") == 1, "Total").otherwise(F.col(key))).drop("_g")
