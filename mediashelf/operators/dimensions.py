"""Insert-if-absent and overwrite-if-changed on dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(rows: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Attributes of the earliest ``seq`` per key.

    Equal spellings are folded first in a hash aggregate, so a key that sits in a third of
    all rows reaches the shuffle as a handful of rows per task.
    """
    spellings = rows.groupBy(key, *attributes).agg(F.min("seq").alias("seq"))
    chosen = F.min(F.struct("seq", *attributes)).alias("chosen")
    return spellings.groupBy(key).agg(chosen).select(
        key, *[F.col(f"chosen.{a}").alias(a) for a in attributes])


def last_seen(rows: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Attributes of the latest ``seq`` per key, folded the same way."""
    spellings = rows.groupBy(key, *attributes).agg(F.max("seq").alias("seq"))
    chosen = F.max(F.struct("seq", *attributes)).alias("chosen")
    return spellings.groupBy(key).agg(chosen).select(
        key, *[F.col(f"chosen.{a}").alias(a) for a in attributes])


def absent(incoming: DataFrame, existing: DataFrame, on: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored; the stored row always wins."""
    return incoming.join(existing.select(*on), on, "left_anti")


def overwrite(existing: DataFrame, incoming: DataFrame, key: str, surrogate: str) -> DataFrame:
    """Stored and incoming rows merged on ``key``, incoming attributes winning.

    Keeps the stored surrogate; it is null on rows that are new.  ``changed`` tells
    whether the row is new or any attribute differs.  Both sides are unique on ``key``.
    """
    attributes = [c for c in incoming.columns if c != key]
    new = F.struct(*[F.col(f"n.{a}").alias(a) for a in attributes])
    old = F.struct(*[F.col(f"o.{a}").alias(a) for a in attributes])
    arrived = F.col("n._arrived").isNotNull()
    merged = existing.alias("o").join(
        incoming.withColumn("_arrived", F.lit(1)).alias("n"),
        F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return merged.select(
        F.col(f"o.{surrogate}").alias(surrogate),
        F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key),
        *[F.when(arrived, F.col(f"n.{a}")).otherwise(F.col(f"o.{a}")).alias(a) for a in attributes],
        (arrived & (F.col(f"o.{surrogate}").isNull() | ~new.eqNullSafe(old))).alias("changed"),
    )
