"""Source options kept in small text files of ``key value`` lines, and the config table."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediashelf.operators.lookups import lookup_join

# Offset words passed through, and the column a config kind is kept in.
OFFSET_WORDS = ("earliest", "latest")
CONFIG_COLUMNS = {"int": "value_int", "str": "value_str"}


def read_options(spark: SparkSession, path: str) -> dict[str, str]:
    """Options of one file; a missing file or a line without a value is an error."""
    try:
        parts = F.split("value", r"\s+")
        rows = spark.read.text(path).select(
            F.get(parts, F.lit(0)).alias("key"), F.get(parts, F.lit(1)).alias("option")).collect()
    except Exception as error:
        raise ValueError(f"option file {path} cannot be read") from error
    if any(row.option is None for row in rows):
        raise ValueError(f"option file {path} has a line without a value")
    return {row.key: row.option for row in rows}


def with_starting_offsets(options: dict[str, str]) -> dict[str, str]:
    """Options whose starting offset is a word or a per-topic position on partition 0."""
    offset = options.get("startingOffsets", "earliest")
    if offset not in OFFSET_WORDS:
        offset = json.dumps({options["subscribe"]: {"0": int(offset)}}, separators=(",", ":"))
    return {**options, "startingOffsets": offset}


def starting_offsets(topic: Column, offset: Column) -> Column:
    """The same rule as a column, for a table of topics."""
    position = F.concat(F.lit('{"'), topic, F.lit('":{"0":'), offset, F.lit("}}"))
    return (
        F.when(offset.isNull(), "earliest")
        .when(offset.isin(*OFFSET_WORDS), offset)
        .otherwise(position)
    )


def config_column(kind: str) -> str:
    if kind not in CONFIG_COLUMNS:
        raise ValueError(f"unsupported config kind {kind}")
    return CONFIG_COLUMNS[kind]


def config_values(counters: DataFrame, wanted: DataFrame, kind: str, default: str) -> DataFrame:
    """The value of every ``wanted`` counter name as text, or the default.

    The first non-null value by counter id counts.
    """
    column = config_column(kind)
    stored = (
        counters.filter(F.col(column).isNotNull())
        .groupBy("counter_name")
        .agg(F.min_by(F.col(column).cast("string"), "counter_id").alias("value"))
    )
    return lookup_join(wanted, stored, ["counter_name"], "left").select(
        "counter_name", F.coalesce("value", F.lit(default)).alias("value"))


def config_value(counters: DataFrame, name: str, kind: str, default: str) -> str:
    """One config value as text."""
    column = config_column(kind)
    row = (
        counters.filter((F.col("counter_name") == name) & F.col(column).isNotNull())
        .agg(F.min_by(F.col(column).cast("string"), "counter_id").alias("value"))
        .first()
    )
    return default if row.value is None else row.value
