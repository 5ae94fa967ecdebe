"""Walking a range of ids at the pace of a tick stream and publishing their documents."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mediashelf.functions.messages import is_due, tick_id
from mediashelf.functions.text import max_or_zero
from mediashelf.sources.requests import list_messages, media_messages
from mediashelf.streaming.sinks import TRIGGER, BatchFunction, batch_sink

FetchStep = Callable[[DataFrame], DataFrame]
WriteStep = Callable[[DataFrame], None]


def due_ids(ticks: DataFrame, boundary: int) -> DataFrame:
    """Ids whose turn has come, up to and including the boundary."""
    value = F.col("value")
    return ticks.filter(is_due(value)).select(tick_id(value).alias("id")).filter(
        F.col("id") <= boundary)


class IdWalk:
    """A publishing stream that ends once the ticks have reached the boundary.

    A bounded source is read out whatever the order of its ticks; an endless one gives them in
    order, and the walk stops when the batch that reached the boundary has been committed.
    Documents are fetched once per batch: the position of the walk is taken from the ticks,
    not from the fetched rows.  ``write_batch`` takes the batch's number as well, in place of
    ``write``.
    """

    def __init__(self, ticks: DataFrame, fetch: FetchStep, messages: FetchStep, write: WriteStep,
                 boundary: int, checkpoint: str, bounded: bool = False, every: str = TRIGGER,
                 write_batch: BatchFunction | None = None):
        self._last: int | None = None

        def apply(batch: DataFrame, batch_id: int) -> None:
            found = messages(fetch(due_ids(batch, boundary)))
            if write_batch is None:
                write(found)
            else:
                write_batch(found, batch_id)
            if bounded:
                return
            reached = batch.agg(max_or_zero(tick_id(F.col("value"))).alias("id")).first().id
            if reached >= boundary and self._last is None:
                self._last = batch_id

        self._writer = batch_sink(ticks, checkpoint, apply, bounded, every)

    def run(self, poll_seconds: float = 10) -> None:
        """Runs until the boundary is reached or a bounded source is read."""
        query = self._writer.start()
        while query.isActive and not self._committed(query):
            time.sleep(poll_seconds)
        query.stop()
        if query.exception() is not None:
            raise query.exception()

    def _committed(self, query: StreamingQuery) -> bool:
        """Whether the batch that reached the boundary is done; progress follows the commit."""
        progress = query.lastProgress
        return self._last is not None and progress is not None and progress["batchId"] >= self._last


def publish_media(ticks: DataFrame, fetch: FetchStep, write: WriteStep, boundary: int,
                  checkpoint: str, bounded: bool = False) -> IdWalk:
    """Fetched ``id, data`` documents, error documents left out."""
    return IdWalk(ticks, fetch, media_messages, write, boundary, checkpoint, bounded)


def publish_lists(ticks: DataFrame, fetch: FetchStep, write: WriteStep, boundary: int,
                  checkpoint: str, bounded: bool = False) -> IdWalk:
    """Fetched ``id, anime, manga`` documents with at least one good side, in envelopes."""
    return IdWalk(ticks, fetch, list_messages, write, boundary, checkpoint, bounded)


def walk_ticks(ticks: DataFrame, fetch: FetchStep, write_batch: BatchFunction, boundary: int,
               checkpoint: str, every: str = TRIGGER) -> IdWalk:
    """Fetched ``id, data`` documents of an endless tick source, written batch by batch."""
    return IdWalk(ticks, fetch, media_messages, lambda frame: None, boundary, checkpoint, False, every, write_batch)
