"""Writing a stream batch by batch."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

# Fixed value: how often a stream takes a batch.
TRIGGER = "10 seconds"

BatchFunction = Callable[[DataFrame, int], None]


def batch_sink(
    frame: DataFrame, checkpoint: str, apply: BatchFunction, bounded: bool = False, every: str = TRIGGER,
) -> DataStreamWriter:
    """A writer that hands every micro-batch to ``apply``.

    ``bounded`` reads what is there now and ends; otherwise a batch starts ``every`` so often.
    """
    trigger = {"availableNow": True} if bounded else {"processingTime": every}
    return (
        frame.writeStream.trigger(**trigger)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(apply)
    )


def partition_per_batch(path: str) -> BatchFunction:
    """A function that writes every micro-batch as a partition ``batch`` of a Parquet table.

    A batch that is done again after a failure overwrites what it wrote before, so the table holds
    every row once wherever between writing and committing the stream was cut off.
    """

    def write(frame: DataFrame, batch_id: int) -> None:
        frame.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return write


def stream_identity(spark: SparkSession, checkpoint: str) -> str:
    """The id a checkpoint keeps over restarts; a new checkpoint counts batches anew."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/metadata")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["id"]
    finally:
        stream.close()
