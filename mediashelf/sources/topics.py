"""Topics of documents: Kafka, or any file format that carries ``value`` and ``seq``."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOPIC_SCHEMA = "arrived bigint, seq bigint, value string"


def _documents(frame: DataFrame, source: str, arrival: bool = True) -> DataFrame:
    """``arrived, seq, value``; the first two give arrival order.

    In Kafka they are a record's offset and partition, which only together are unique; in
    files the time of the append and the number given to the document.
    """
    value = F.col("value").cast("string").alias("value")
    if source == "kafka":
        return frame.select(
            F.col("offset").alias("arrived"), F.col("partition").cast("bigint").alias("seq"), value)
    if not arrival:
        return frame.select("seq", value)
    return frame.select(F.coalesce("arrived", F.lit(0).cast("bigint")).alias("arrived"), "seq", value)


def _reader(reader, source: str, options: dict[str, str]):
    reader = reader.format(source).options(**options)
    return reader if source == "kafka" else reader.schema(TOPIC_SCHEMA)


def read_topic(spark: SparkSession, source: str, options: dict[str, str]) -> DataFrame:
    """All documents of a topic as a batch; of a file topic ``seq, value``."""
    return _documents(_reader(spark.read, source, options).load(), source, arrival=False)


def stream_topic(spark: SparkSession, source: str, options: dict[str, str]) -> DataFrame:
    """The documents of a topic as a stream, with their arrival."""
    return _documents(_reader(spark.readStream, source, options).load(), source)


def write_topic(frame: DataFrame, sink: str, options: dict[str, str]) -> None:
    """Appends documents to a topic; a file topic also keeps when, and in which order: ``seq``."""
    arrived = F.lit(time.time_ns() // 1000).alias("arrived")
    columns = ["value"] if sink == "kafka" else [arrived, "seq", "value"]
    frame.select(*columns).write.format(sink).options(**options).mode("append").save()


def tick_stream(spark: SparkSession, rows_per_second: int = 1, ramp_up_seconds: int = 5) -> DataFrame:
    """Ticks at a steady rate, numbered from 0."""
    return (
        spark.readStream.format("rate")
        .option("rowsPerSecond", rows_per_second)
        .option("rampUpTime", f"{ramp_up_seconds}s")
        .option("numPartitions", 1)
        .load()
    )


def tick_batches(spark: SparkSession, rows_per_batch: int, partitions: int = 1) -> DataFrame:
    """Ticks numbered from 0, so many in every micro-batch however long it takes."""
    return (
        spark.readStream.format("rate-micro-batch")
        .option("rowsPerBatch", rows_per_batch)
        .option("numPartitions", partitions)
        .load()
    )


def id_range(spark: SparkSession, boundary: int) -> DataFrame:
    """Every id of a bounded walk, the boundary included."""
    return spark.range(0, boundary + 1).select(F.col("id").cast("int").alias("id"))
