"""Day and ISO-week metrics: totals and breakdown maps, from one aggregation by all breakdown keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlark.functions.timeutil import iso_week


def buckets(facts: DataFrame, period: Column, keys: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
    """period, dimension, bucket, measures: totals (dimension ``total``) and one row per value of each key."""
    rows = facts.select(period.alias("period"), *[k.alias(f"_k{n}") for n, k in keys.items()], *facts.columns)
    names = [f"_k{n}" for n in keys]
    sets = [["period"], *[["period", n] for n in names]]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], F.col("period"), *[F.col(n) for n in names]).agg(*[m.alias(n) for n, m in measures.items()], *[F.grouping(F.col(n)).alias(f"_g{n}") for n in names])
    dimension, bucket = F.lit("total"), F.lit("all")
    for n in keys:
        here = F.col(f"_g_k{n}") == 0
        dimension, bucket = F.when(here, n).otherwise(dimension), F.when(here, F.col(f"_k{n}").cast("string")).otherwise(bucket)
    return out.select("period", dimension.alias("dimension"), bucket.alias("bucket"), *measures)


def day_metrics(facts: DataFrame, date: str, keys: dict[str, Column], measures: dict[str, Column], day: str | None = None) -> DataFrame:
    """Metrics per day; ``day`` alone reads one day's partition."""
    rows = facts if day is None else facts.where(F.col(date) == F.lit(day).cast("date"))
    return buckets(rows, F.date_format(F.col(date), "yyyy-MM-dd"), keys, measures)


def week_metrics(facts: DataFrame, date: str, keys: dict[str, Column], measures: dict[str, Column], week: str | None = None) -> DataFrame:
    """Metrics per ISO week; ``week`` alone keeps its seven days by a range on the date, which prunes partitions."""
    rows = facts
    if week is not None:
        from datetime import date as day_of

        first = day_of.fromisocalendar(int(week[:4]), int(week[6:]), 1)
        last = day_of.fromisocalendar(int(week[:4]), int(week[6:]), 7)
        rows = facts.where(F.col(date).between(F.lit(first), F.lit(last)))
    return buckets(rows, iso_week(F.col(date)), keys, measures)


def as_maps(metrics: DataFrame, *measures: str) -> DataFrame:
    """period, totals and one map per dimension, its keys in byte order."""
    value = F.struct(*measures)
    entries = F.array_sort(F.collect_list(F.struct(F.col("bucket"), value.alias("value"))))
    per = metrics.groupBy("period", "dimension").agg(F.map_from_entries(entries).alias("m"))
    return per.groupBy("period").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dimension", "m")), lambda a, b: F.when(a["dimension"] < b["dimension"], -1).when(a["dimension"] > b["dimension"], 1).otherwise(0))).alias("by"))
