"""Token prices: the first pattern that a model's name contains decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: USD per million tokens: pattern, input, output, cache read, cache write. Order is match priority (fixed values).
PRICES: tuple[tuple[str, float, float, float, float], ...] = (
    ("opus", 5.0, 25.0, 0.50, 6.25),
    ("sonnet", 3.0, 15.0, 0.30, 3.75),
    ("haiku", 1.0, 5.0, 0.10, 1.25),
    ("o3-pro", 20.0, 80.0, 0.0, 0.0),
    ("o3-mini", 1.10, 4.40, 0.0, 0.0),
    ("o3", 2.0, 8.0, 0.0, 0.0),
    ("o4-mini", 1.10, 4.40, 0.0, 0.0),
    ("gpt-5.3-codex", 1.75, 14.0, 0.0, 0.0),
    ("gpt-5.3", 1.75, 14.0, 0.0, 0.0),
    ("gpt-5.2-codex", 1.75, 14.0, 0.0, 0.0),
    ("gpt-5.2", 1.75, 14.0, 0.0, 0.0),
    ("gpt-5.1-codex-mini", 0.25, 2.0, 0.0, 0.0),
    ("gpt-5.1-codex", 1.25, 10.0, 0.0, 0.0),
    ("gpt-5.1", 1.25, 10.0, 0.0, 0.0),
    ("gpt-5-nano", 0.05, 0.40, 0.005, 0.0),
    ("gpt-5-codex", 1.25, 10.0, 0.0, 0.0),
    ("gpt-5", 1.25, 10.0, 0.0, 0.0),
    ("gpt-4.1-mini", 0.40, 1.60, 0.0, 0.0),
    ("gpt-4.1-nano", 0.10, 0.40, 0.0, 0.0),
    ("gpt-4.1", 2.0, 8.0, 0.0, 0.0),
    ("gpt-4o-mini", 0.15, 0.60, 0.0, 0.0),
    ("gpt-4o", 2.50, 10.0, 0.0, 0.0),
    ("codex-mini", 1.50, 6.0, 0.0, 0.0),
    ("grok-code-fast", 0.20, 1.50, 0.02, 0.0),
    ("grok-code", 0.20, 1.50, 0.02, 0.0),
    ("grok-4.1-fast", 0.20, 0.50, 0.05, 0.0),
    ("grok-4-fast", 0.20, 0.50, 0.05, 0.0),
    ("grok-4", 3.0, 15.0, 0.0, 0.0),
    ("kimi-k2-thinking", 0.60, 2.50, 0.15, 0.0),
    ("kimi-k2", 0.60, 2.50, 0.15, 0.0),
    ("glm-4.7-flash", 0.0, 0.0, 0.0, 0.0),
    ("glm-4.7-free", 0.0, 0.0, 0.0, 0.0),
    ("glm-4.7", 0.60, 2.20, 0.0, 0.0),
    ("glm-4.6", 0.30, 0.90, 0.0, 0.0),
    ("glm-5", 1.0, 3.20, 0.0, 0.0),
    ("glm-4", 0.60, 2.20, 0.0, 0.0),
    ("gemini-3-flash", 0.50, 3.0, 0.0, 0.0),
    ("gemini-3-pro", 2.0, 12.0, 0.0, 0.0),
    ("gemini-2.5-pro", 1.25, 10.0, 0.0, 0.0),
    ("qwen3-coder", 0.22, 1.0, 0.0, 0.0),
    ("deepseek-chat-v3.1", 0.15, 0.75, 0.0, 0.0),
    ("deepseek-v3.2", 0.28, 0.42, 0.028, 0.0),
    ("deepseek-v3", 0.27, 1.10, 0.0, 0.0),
    ("deepseek-r1", 0.55, 2.19, 0.0, 0.0),
    ("minimax-m2.5", 0.30, 1.20, 0.0, 0.0),
    ("minimax-m2", 0.30, 1.20, 0.0, 0.0),
)
FIELDS = ("input", "output", "cache_read", "cache_write")


def price_of(model: Column, prices: tuple[tuple, ...] = PRICES) -> Column:
    """struct<rank, pattern, input, output, cache_read, cache_write> of the first match, else null. One expression over
    a literal array: no join, and the work per row ends with the few patterns."""
    rows = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(p[0]).alias("pattern"), *[F.lit(float(v)).alias(f) for f, v in zip(FIELDS, p[1:])]) for k, p in enumerate(prices)])
    name = F.lower(model)
    return F.get(F.filter(rows, lambda r: F.contains(name, r["pattern"])), F.lit(0))


def estimate_cost(model: Column, input_tokens: Column, output_tokens: Column, cache_read: Column | None = None, cache_write: Column | None = None, prices: tuple[tuple, ...] = PRICES) -> Column:
    """USD, null for an unknown model."""
    price = price_of(model, prices)
    cost = input_tokens * price["input"] / 1e6 + output_tokens * price["output"] / 1e6
    for tokens, field in ((cache_read, "cache_read"), (cache_write, "cache_write")):
        if tokens is not None:
            cost = cost + tokens * price[field] / 1e6
    return cost


def price_table(spark: SparkSession, prices: tuple[tuple, ...] = PRICES) -> DataFrame:
    """The prices as a dimension table."""
    return spark.createDataFrame([(k, *p) for k, p in enumerate(prices)], "rank int, pattern string, input double, output double, cache_read double, cache_write double")
