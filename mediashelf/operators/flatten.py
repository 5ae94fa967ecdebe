"""Unnesting documents into rows, and collapsing repeated list entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediashelf.functions import text as X

FIRST_COLUMNS = ["date_start", "date_end", "score", "status"]


def _unnest(docs: DataFrame, array: str, carry: list[str]) -> DataFrame:
    return docs.select(*carry, F.explode(array).alias("item")).select(*carry, "item.*")


def tag_rows(docs: DataFrame, carry: list[str]) -> DataFrame:
    return _unnest(docs, "tags", carry)


def studio_rows(docs: DataFrame, carry: list[str]) -> DataFrame:
    return _unnest(docs, "studios", carry)


def staff_rows(docs: DataFrame, carry: list[str]) -> DataFrame:
    return _unnest(docs, "staff", carry)


def title_name_rows(docs: DataFrame, carry: list[str]) -> DataFrame:
    return _unnest(docs, "names", carry)


def genre_rows(docs: DataFrame, carry: list[str]) -> DataFrame:
    return docs.select(*carry, F.explode("genres").alias("genre"))


def entry_rows(docs: DataFrame, carry: list[str]) -> DataFrame:
    """List entries with their position in document order."""
    return docs.select(*carry, F.posexplode("entries").alias("pos", "item")).select(
        *carry, "pos", "item.*")


def collapse_entries(
    entries: DataFrame, keys: list[str], order: list[str], first: list[str] = FIRST_COLUMNS,
) -> DataFrame:
    """One row per key: dates, score and status of the first entry, progress and repeats summed.

    All aggregates combine on the map side, so a hot key shrinks before the shuffle.  With one
    order column and no texts among ``first`` they also stay in a hash aggregate.
    """
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    if len(order) == 1:
        picked = [F.min_by(c, position).alias(c) for c in first]
        unpacked = first
    else:
        picked = [F.min_by(F.struct(*first), position).alias("first")]
        unpacked = [f"first.{c}" for c in first]
    return (
        entries.groupBy(*keys)
        .agg(
            *picked,
            X.wrapped_int(F.sum("progress")).alias("progress"),
            X.wrapped_int(F.sum("repeat")).alias("rewatched"),
        )
        .select(*keys, *unpacked, "progress", "rewatched")
    )


def first_in_order(frame: DataFrame, order: list[str]) -> DataFrame:
    """The first record of a topic."""
    return frame.orderBy(*order).limit(1)
