"""The declared constraints checked on a store: one row per constraint with its violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediashelf.operators import audit
from mediashelf.schemas import (
    FOREIGN_KEYS, LENGTH_BOUNDS, NAME_LENGTH_BOUNDS, REQUIRED_COLUMNS, UNIQUE_KEYS,
)
from mediashelf.sources.tables import Store


def _report(frame: DataFrame, check: str, table: str, column, violations) -> DataFrame:
    return frame.select(
        F.lit(check).alias("check"), F.lit(table).alias("table"), column.alias("column"),
        F.coalesce(violations, F.lit(0)).cast("bigint").alias("violations"))


def uniqueness(store: Store) -> DataFrame:
    """Key values held by more than one row."""
    parts = []
    for table, keys in UNIQUE_KEYS.items():
        for key in keys:
            repeated = audit.duplicate_keys(store.read(table), key)
            total = repeated.agg(F.count(F.lit(1)).alias("n"))
            parts.append(_report(total, "unique", table, F.lit(", ".join(key)), F.col("n")))
    return audit.union_all(parts)


def references(store: Store) -> DataFrame:
    """Rows that refer to nothing."""
    parts = []
    for table, column, parent, key in FOREIGN_KEYS:
        lost = audit.orphans(
            store.read(table), column, store.read(parent), key)
        total = lost.agg(F.sum("n_rows").alias("n"))
        parts.append(_report(total, "reference", table, F.lit(column), F.col("n")))
    return audit.union_all(parts)


def required(store: Store) -> DataFrame:
    """Nulls in columns that may not be null."""
    return audit.union_all([
        _report(audit.null_counts(store.read(table), columns),
                "required", table, F.col("column_name"), F.col("n_nulls"))
        for table, columns in REQUIRED_COLUMNS.items()])


def lengths(store: Store) -> DataFrame:
    """Texts longer than their bound; they are reported, not rejected."""
    parts = [
        _report(audit.too_long(store.read(table), bounds),
                "length", table, F.col("column_name"), F.col("n_too_long"))
        for table, bounds in LENGTH_BOUNDS.items()]
    names = store.read("name")
    kinds = [
        F.when(F.col("kind") == kind, F.col("name")).alias(kind) for kind in NAME_LENGTH_BOUNDS]
    by_kind = audit.too_long(names.select(*kinds), NAME_LENGTH_BOUNDS)
    parts.append(_report(by_kind, "length", "name", F.col("column_name"), F.col("n_too_long")))
    return audit.union_all(parts)
