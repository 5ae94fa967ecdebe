"""Key, reference, null and length checks; each returns the offending values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(frame: DataFrame, key: list[str]) -> DataFrame:
    """Keys held by more than one row."""
    counts = frame.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.filter(F.col("n_rows") > 1)


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child values without a parent, with how many rows hold them; null passes.

    The child is folded to its distinct values first, so a column with few or lopsided
    values never makes a skewed join.
    """
    values = (
        child.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    return values.join(parent.select(F.col(parent_column).alias("value")), "value", "left_anti")


def null_counts(frame: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with its number of nulls, in a single pass."""
    totals = frame.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return totals.unpivot([], columns, "column_name", "n_nulls")


def too_long(frame: DataFrame, bounds: dict[str, int]) -> DataFrame:
    """One row per bounded column with how many values exceed the bound and the longest length."""
    per_column = [
        F.struct(
            F.lit(column).alias("column_name"),
            F.count_if(F.length(column) > bound).alias("n_too_long"),
            F.coalesce(F.max(F.length(column)), F.lit(0)).alias("longest"),
        ).alias(column)
        for column, bound in bounds.items()
    ]
    totals = frame.agg(*per_column)
    return totals.select(F.inline(F.array(*[F.col(c) for c in bounds])))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _key_rows(frame: DataFrame, columns: list[str], constraint: str, unique: bool, side: str) -> DataFrame:
    """One row per key without nulls: what it is known by, whatever its type, and its side."""
    digest = F.unhex(F.md5(F.to_json(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)])).cast("binary")))
    return frame.dropna(subset=columns).select(
        F.lit(constraint).alias("constraint"), F.lit(unique).alias("is_unique"), digest.alias("digest"),
        F.lit(int(side == "parent")).alias("parent"), F.lit(int(side == "child")).alias("child"))


def key_checks(
    unique: dict[str, tuple[DataFrame, list[str]]],
    references: dict[str, tuple[DataFrame, list[str], DataFrame, list[str]]],
) -> DataFrame:
    """``constraint, is_unique, n_keys, n_values, n_rows``: all declared keys in one shuffle.

    ``unique`` maps a name to a table and the columns of its key, ``references`` to a child, its
    columns, the parent and its columns.  ``n_keys`` counts the keys looked at; ``n_values`` and
    ``n_rows`` count those that break the constraint, and the rows that hold them: keys of more
    than one row, or a child's without a parent.  Keys with a null pass.  Constraints without any
    key are left out.

    Every key becomes a digest under its constraint's name, and counts of both sides are added up
    on the map side, so neither a hot key nor a further constraint costs a shuffle of its own.
    """
    rows = [_key_rows(frame, columns, name, True, "parent") for name, (frame, columns) in unique.items()]
    for name, (child, columns, parent, key) in references.items():
        rows += [_key_rows(child, columns, name, False, "child"), _key_rows(parent, key, name, False, "parent")]
    held = union_all(rows).groupBy("constraint", "is_unique", "digest").agg(
        F.sum("parent").alias("parents"), F.sum("child").alias("children"))
    looked = F.col("is_unique") | (F.col("children") > 0)
    broken = F.when(F.col("is_unique"), F.col("parents") > 1).otherwise((F.col("parents") == 0) & (F.col("children") > 0))
    n_rows = F.when(F.col("is_unique"), F.col("parents")).otherwise(F.col("children"))
    return held.groupBy("constraint", "is_unique").agg(
        F.count_if(looked).alias("n_keys"), F.count_if(broken).alias("n_values"),
        F.coalesce(F.sum(F.when(broken, n_rows)), F.lit(0)).alias("n_rows"))
