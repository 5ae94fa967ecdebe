"""Joins from wide facts to unique keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

BROADCAST_BYTES = 64 * 1024 * 1024
COLUMN_BYTES = 16


def plain_bytes(rows: int, columns: int) -> int:
    """Size of rows without text."""
    return rows * columns * COLUMN_BYTES


def size_of(frame: DataFrame) -> int:
    """Size of a dimension in bytes, texts and array elements included, from one aggregation over it."""
    long = {f.name: F.octet_length(f.name) for f in frame.schema if isinstance(f.dataType, StringType)}
    long |= {f.name: F.size(f.name) * COLUMN_BYTES for f in frame.schema if isinstance(f.dataType, ArrayType)}
    lengths = [F.coalesce(F.sum(bytes_of), F.lit(0)).alias(c) for c, bytes_of in long.items()]
    row = frame.agg(F.count(F.lit(1)).alias("_rows"), *lengths).first()
    return plain_bytes(row["_rows"], len(frame.columns)) + sum(row[c] for c in long)


def lookup_join(
    fact: DataFrame, dim: DataFrame, on: list[str], how: str = "inner", dim_bytes: int | None = None,
) -> DataFrame:
    """Joins ``fact`` to ``dim``, whose ``on`` columns are unique and never null in the fact.

    A dimension measured at no more than ``BROADCAST_BYTES`` is broadcast.  A larger one is
    joined by shuffle, where adaptive execution splits the partitions of hot keys: the unique
    side of such a key is one row, which every split reads.
    """
    size = size_of(dim) if dim_bytes is None else dim_bytes
    return fact.join(F.broadcast(dim) if size <= BROADCAST_BYTES else dim, on, how)


def missing_keys(fact: DataFrame, dim: DataFrame, on: list[str]) -> DataFrame:
    """Distinct fact keys the dimension does not hold; keys are made distinct before the join."""
    return fact.select(*on).distinct().join(dim.select(*on), on, "left_anti")


def names_of(names: DataFrame, kind: str, id_column: str, name_column: str) -> DataFrame:
    """One kind of the shared name dimension under the given column names."""
    return names.filter(F.col("kind") == kind).select(
        F.col("name_id").alias(id_column), F.col("name").alias(name_column))


def media_genres(links: DataFrame, names: DataFrame) -> DataFrame:
    genre = names_of(names, "genre", "genre_id", "genre")
    return lookup_join(links, genre, ["genre_id"]).select("media_id", "genre")


def tags_with_category(tags: DataFrame, names: DataFrame) -> DataFrame:
    category = names_of(names, "tagcategory", "category_id", "category")
    return lookup_join(tags, category, ["category_id"]).select(
        "tag_id", "ext_tag_id", "name", "category")


def media_tags(links: DataFrame, tags: DataFrame, names: DataFrame) -> DataFrame:
    return lookup_join(links, tags_with_category(tags, names), ["tag_id"]).select(
        "media_id", "ext_tag_id", "name", "category")


def media_studios(links: DataFrame, studios: DataFrame) -> DataFrame:
    return lookup_join(links, studios, ["studio_id"]).select(
        "media_id", "ext_studio_id", "name", "is_main")


def media_staff(links: DataFrame, staff: DataFrame) -> DataFrame:
    return lookup_join(links, staff, ["staff_id"]).select(
        "media_id", "ext_staff_id", "first_name", "last_name", "full_name", "native_name", "role")


def media_names(media_name: DataFrame, names: DataFrame) -> DataFrame:
    kind = names_of(names, "nametype", "name_type_id", "name_type")
    return lookup_join(media_name, kind, ["name_type_id"]).select("media_id", "name_type", "name")
