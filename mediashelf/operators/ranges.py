"""Range joins of dates by the power-of-two bins that make up an interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 23  # bins of up to 2 ** 22 days cover every date


def _day(date: Column) -> Column:
    """Days since a day before all dates of years 1 to 9999, so that numbers are positive."""
    return F.datediff(date, F.lit("0001-01-01").cast("date")).cast("bigint") + 1


def interval_bins(low: Column, high: Column) -> Column:
    """``level, bin`` of the bins that exactly make up the days from low to high, both included;
    two of each size at most, none if low is after high."""
    first, end = _day(low), _day(high) + 1

    def of_level(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
        a = F.call_function("div", first + size - 1, size)
        b = F.call_function("div", end, size)
        return F.array_compact(F.array(
            F.when((a < b) & (a % 2 == 1), F.struct(level.alias("level"), a.alias("bin"))),
            F.when((a < b) & (b % 2 == 1), F.struct(level.alias("level"), (b - 1).alias("bin")))))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), of_level))


def in_interval(
    points: DataFrame, date: str, intervals: DataFrame, low: str, high: str, folded: list[Column] = (),
) -> DataFrame:
    """Every pair of a point and an interval that it lies in; all columns of both, whose names
    must differ.  Dates of years 1 to 9999; null ends, and null points, meet nothing.

    An interval is made up of bins of power-of-two sizes, two of each at most however long it is,
    and a day lies in one bin of each size that occurs, so each pair meets in one bin and in an
    equi-join.

    With ``folded``, named aggregates of the points, the points of each bin are folded before they
    meet: an interval comes with one row per bin of its own that holds any point, and the aggregates
    in place of the points' columns, so that rows do not grow with the number of pairs.
    """
    known = intervals.where(F.col(low).isNotNull() & F.col(high).isNotNull())
    parts = known.withColumn("_part", F.explode(interval_bins(F.col(low), F.col(high)))).select(
        "*", F.col("_part.level").alias("_level"), F.col("_part.bin").alias("_bin")).drop("_part")
    sizes = sorted(r[0] for r in parts.select("_level").distinct().collect())  # LEVELS at most
    if not sizes:
        return (points.agg(*folded) if folded else points).join(known, F.lit(False))
    level = F.explode(F.array(*[F.lit(n) for n in sizes]))
    days = points.where(F.col(date).isNotNull()).withColumn("_level", level).withColumn(
        "_bin", F.call_function("div", _day(F.col(date)), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_level"))))
    if folded:
        days = days.groupBy("_level", "_bin").agg(*folded)
    return days.join(parts, ["_level", "_bin"]).drop("_level", "_bin")
