"""Two-way difference between stored and incoming rows of a scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediashelf.operators.lookups import lookup_join, plain_bytes

INSERT, DELETE, UPDATE, KEEP, OUTSIDE = "insert", "delete", "update", "keep", "outside"


def two_way_diff(
    existing: DataFrame,
    incoming: DataFrame,
    scope: DataFrame,
    scope_key: str,
    keys: list[str],
    payload: list[str] = (),
    retained: list[str] = (),
    scope_rows: int | None = None,
) -> DataFrame:
    """Every stored or incoming row once, with what has to happen to it.

    ``scope`` holds the scope keys the batch speaks for: a stored row of such a key that is
    not incoming is deleted, stored rows of other keys are ``outside`` and stay.  Rows are
    compared on ``scope_key`` and ``keys``; ``payload`` comes from the incoming row,
    ``retained`` (a surrogate) from the stored one.

    Stored rows of the scope and incoming rows meet in one aggregation on the whole identity,
    which no single scope key can skew; stored rows outside the scope pass by it.  Marking the
    stored rows takes no shuffle while the scope is small enough to broadcast.  Incoming rows
    must be of the scope.
    """
    identity = [scope_key, *keys]
    payload, retained = list(payload), list(retained)
    marks = scope.select(scope_key, F.lit(True).alias("_in_scope"))
    size = None if scope_rows is None else plain_bytes(scope_rows, 2)
    marked = lookup_join(existing, marks, [scope_key], "left", size)
    outside = marked.filter(F.col("_in_scope").isNull()).select(
        *identity, *payload, *retained, F.lit(OUTSIDE).alias("action"))
    rows = marked.filter("_in_scope").select(
        *identity, *payload, *retained, F.lit(True).alias("_stored"),
    ).unionByName(
        incoming.select(*identity, *payload, F.lit(False).alias("_stored")),
        allowMissingColumns=True,
    )
    stored = F.col("_stored")
    merged = rows.groupBy(*identity).agg(
        F.bool_or(stored).alias("_stored"),
        F.bool_or(~stored).alias("_arrived"),
        *[F.max(F.when(stored, F.col(c))).alias(f"_old_{c}") for c in payload],
        *[F.max(F.when(~stored, F.col(c))).alias(f"_new_{c}") for c in payload],
        *[F.max(c).alias(c) for c in retained],
    )
    same = F.lit(True)
    for c in payload:
        same = same & F.col(f"_old_{c}").eqNullSafe(F.col(f"_new_{c}"))
    action = (
        F.when(~F.col("_stored"), INSERT)
        .when(F.col("_arrived"), F.when(same, KEEP).otherwise(UPDATE))
        .otherwise(DELETE)
    )
    return merged.select(
        *identity,
        *[F.when(F.col("_arrived"), F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}")).alias(c)
          for c in payload],
        *retained,
        action.alias("action"),
    ).unionByName(outside)


def after_diff(diff: DataFrame) -> DataFrame:
    """The relation once the actions are carried out."""
    return diff.filter(F.col("action") != DELETE).drop("action")


def changes(diff: DataFrame) -> DataFrame:
    """Only the rows to insert, update or delete; none when both sides are equal."""
    return diff.filter(F.col("action").isin(INSERT, UPDATE, DELETE))
