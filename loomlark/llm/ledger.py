"""Content addressing shared by the secret ledger and the token-count cache.

``addressed`` gives each row the digest of its content; ``unseen`` gives one row with its text for each
digest that a store lacks. Only (digest, key) pairs are grouped and compared; texts cross the network
once, for the chosen rows, and under a key that is unique to a row, so that a hot content (a third of all
rows, say) is reduced to one row before anything is shuffled by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def addressed(docs: DataFrame, key: str, content: Column) -> DataFrame:
    """docs -> key, digest (SHA-256 of ``content``), n_bytes of the text itself."""
    return docs.select(F.col(key).alias("key"), F.unhex(F.sha2(content, 256)).alias("digest"), F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_bytes"))


def unseen(docs: DataFrame, where: DataFrame, key: str, content: Column, store: DataFrame | None) -> DataFrame:
    """digest, text for each distinct digest of ``where`` (an ``addressed`` table) not in ``store``.
    Repeated rows with one key and one content may yield it twice; the caller's result is by digest."""
    missing = where.groupBy("digest").agg(F.min("key").alias("_rep"))
    if store is not None:
        missing = missing.join(store.select("digest").distinct(), "digest", "left_anti")
    texts = docs.select(F.col(key).alias("_key"), F.unhex(F.sha2(content, 256)).alias("digest"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("d")
    missing = missing.alias("m")
    same = (F.col("d.digest") == F.col("m.digest")) & F.col("d._key").eqNullSafe(F.col("m._rep"))
    return texts.join(missing.hint("shuffle_hash"), same, "left_semi").select("digest", "text")
