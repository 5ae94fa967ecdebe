"""Surrogate keys for new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICES = 4096
PARTS_PER_SCAN = 4


def dealt(rows: DataFrame, scans: int, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` before an aggregation that leaves most of them; ``scans`` is the number
    of tasks that read them.

    The number of parts is given and follows the input.  Adaptive execution would join parts by
    their compressed bytes, and so leave tasks with tens of millions of narrow rows.
    """
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(usual, PARTS_PER_SCAN * scans), *keys)


def assign_keys(new: DataFrame, key: list[str], surrogate: str, after: int) -> DataFrame:
    """Adds ids ``after + 1 .. after + n`` to rows that are unique on ``key``.

    Rows are numbered inside hash slices of the key and the slices are laid end to end.
    An id depends only on the set of keys, never on task order, so a task that is run
    again gives the same ids.  Only the slice counts meet in one place.
    ``new`` is read twice and should be a written table.
    """
    sliced = new.withColumn("_slice", F.pmod(F.xxhash64(*key), F.lit(SLICES)).cast("int"))
    counts = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    position = F.row_number().over(Window.partitionBy("_slice").orderBy(*key))
    return (
        sliced.withColumn("_position", position)
        .join(F.broadcast(starts), "_slice")  # at most SLICES rows
        .withColumn(surrogate, F.lit(after).cast("bigint") + F.col("_start") + F.col("_position"))
        .drop("_slice", "_start", "_position")
    )
