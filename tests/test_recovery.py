"""A walk over an endless tick source that is cut off between writing and committing."""

import pytest
from mediashelf.session import new_scratch
from mediashelf.sources import topics
from mediashelf.sources.requests import from_table
from mediashelf.streaming.publish import walk_ticks
from mediashelf.streaming.sinks import partition_per_batch
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

BOUNDARY = 40


def walk(spark, write, checkpoint):
    table = spark.range(BOUNDARY + 1).select(F.col("id").cast("int"), F.concat(F.lit("d"), "id").alias("data"))
    walk_ticks(topics.tick_batches(spark, 130), from_table(table, "data"), write, BOUNDARY, checkpoint,
               every="0 seconds").run(poll_seconds=0.2)


def rows(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).select("seq", "value", "batch").collect())


@pytest.mark.parametrize("before", [True, False])
def test_restart_gives_the_rows_of_an_undisturbed_run(spark, before):
    plain, cut, checkpoint = new_scratch(spark, "plain"), new_scratch(spark, "cut"), new_scratch(spark, "checkpoint")
    walk(spark, partition_per_batch(plain), new_scratch(spark, "checkpoint"))
    fail = {1, 2}
    write = partition_per_batch(cut)

    def failing(frame, batch_id):
        if batch_id in fail and before:
            fail.discard(batch_id)
            raise RuntimeError("cut off before writing")
        write(frame, batch_id)
        if batch_id in fail:
            fail.discard(batch_id)
            raise RuntimeError("cut off before committing")

    for _ in range(2):
        with pytest.raises(StreamingQueryException):
            walk(spark, failing, checkpoint)
    walk(spark, failing, checkpoint)
    want = [(i, f"d{i}") for i in range(BOUNDARY + 1)]
    # batches after the one that reached the boundary hold no rows
    assert [r[:2] for r in rows(spark, plain)] == want and rows(spark, cut) == rows(spark, plain)
