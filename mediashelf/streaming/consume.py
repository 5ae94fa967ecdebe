"""Topics of documents into the stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from mediashelf.plans.reconcile import reconcile_lists, reconcile_media
from mediashelf.sources.tables import Store
from mediashelf.streaming.sinks import batch_sink, stream_identity

COMPACT_EVERY = 100


def _consume(
    documents: DataFrame, store: Store, checkpoint: str, bounded: bool,
    reconcile: Callable[..., bool], compact_every: int, **options,
) -> DataStreamWriter:
    def apply(batch: DataFrame, batch_id: int) -> None:
        stream = stream_identity(store.spark, checkpoint)
        reconcile(store, batch, batch_id=batch_id, stream=stream, **options)
        if batch_id % compact_every == compact_every - 1:
            store.compact()

    return batch_sink(documents, checkpoint, apply, bounded)


def consume_media(
    documents: DataFrame, store: Store, checkpoint: str, bounded: bool = False,
    compact_every: int = COMPACT_EVERY,
) -> DataStreamWriter:
    """Reconciles every micro-batch of media documents; a batch cut off by a failure is done again."""
    return _consume(
        documents, store, checkpoint, bounded, reconcile_media, compact_every)


def consume_lists(
    documents: DataFrame, store: Store, checkpoint: str, bounded: bool = False,
    fetch_media: Callable[[DataFrame], DataFrame] | None = None,
    compact_every: int = COMPACT_EVERY,
) -> DataStreamWriter:
    """The same for list documents."""
    return _consume(
        documents, store, checkpoint, bounded, reconcile_lists, compact_every,
        fetch_media=fetch_media)
