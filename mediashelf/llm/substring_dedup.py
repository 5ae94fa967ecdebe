"""Removal of repeated substrings by suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediashelf.llm import anchors, induced
from mediashelf.llm.common import small, staged

SHARD_BYTES = 1 << 20  # text of one suffix array, about, which takes some 70 times as much memory; larger ones work on disk
CROWD_BYTES = 256 << 20  # an anchor whose different contexts are longer in sum is settled window by window
ID_ROWS = 1_000_000  # keys (16 bytes each) broadcast at most
SPANS = "array<struct<begin:int,end:int>>"


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``id, d, t``: the id, a hash of id and text to tell rows apart, and the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(doc_id), t).alias("d"), t.alias("t"))


def _anchored(length: int):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            owner, columns = [], ([], [], [], [])
            for i, t in enumerate(part.column(2).cast(pa.binary())):
                data = t.as_buffer()
                found, first, last = anchors.contexts(np.frombuffer(data, np.uint8), length)
                if not len(found):
                    continue
                view = memoryview(data)
                own = np.fromiter(
                    (xxhash.xxh3_64_intdigest(view[a:b + length])
                     for a, b in zip(first.tolist(), last.tolist(), strict=True)),
                    np.uint64, len(first))
                owner.append(np.full(len(first), i))
                for column, values in zip(columns, (first, last - first + length,
                                                    found.view(np.int64), own.view(np.int64)), strict=True):
                    column.append(values)
            if not owner:
                continue
            rows = pa.array(np.concatenate(owner))
            start, size, anchor, own = (np.concatenate(c) for c in columns)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(rows), part.column(1).take(rows), pa.array(start.astype(np.int32)),
                 pa.array(size.astype(np.int32)), pa.array(anchor), pa.array(own)],
                names=["id", "d", "start", "size", "h", "c"])

    return batches


def _runs(marks: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return [{"begin": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _sliced(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the contexts asked for of each text."""
    for part in parts:
        rows: list[tuple[int, int, int, bytes]] = []
        for t, asked in zip(part.column(0).cast(pa.binary()), part.column(1).to_pylist(), strict=True):
            view = memoryview(t.as_buffer())
            rows += [(a["h"], a["c"], a["k"], bytes(view[a["start"]:a["start"] + a["size"]]))
                     for a in asked]
            if sum(len(r[3]) for r in rows) > 4 << 20:
                yield _piece_batch(rows)
                rows = []
        if rows:
            yield _piece_batch(rows)


def _piece_batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    h, c, k, piece = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(k, pa.int64()),
         pa.array(piece, pa.binary())], names=["h", "c", "k", "piece"])


def _suffix_sorted(length: int, memory: int, base: int):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[np.ndarray, np.ndarray]] = []

        def pieces() -> Iterator[bytes]:
            for part in parts:
                keys.append((part.column(0).to_numpy(), part.column(1).to_numpy()))
                for piece in part.column(3):
                    yield piece.as_py()

        found = induced.repeated_in(pieces(), length, memory, base)
        h: list[int] = []
        c: list[int] = []
        spans: list[list[dict[str, int]]] = []
        order: Iterator[tuple[int, int]] | None = None
        for marks in found:  # the first comes when all pieces are read
            if order is None:
                order = (pair for a, b in keys for pair in zip(a.tolist(), b.tolist(), strict=True))
            x, y = next(order)
            if marks.any():
                h.append(x)
                c.append(y)
                spans.append(_runs(marks))
        if h:
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(spans, kind)],
                names=["h", "c", "spans"])

    return batches


def _windows(length: int):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for h, c, piece in zip(part.column(0).to_pylist(), part.column(1).to_pylist(),
                                   part.column(3), strict=True):
                view = memoryview(piece.as_buffer())
                n = len(view) - length + 1
                digests = [xxhash.xxh3_128_digest(view[i:i + length]) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, h)), pa.array(np.full(n, c)),
                     pa.array(np.arange(n, dtype=np.int32)), pa.array(digests, pa.binary())],
                    names=["h", "c", "at", "w"])

    return batches


def repeated_spans(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400,
    shard_bytes: int = SHARD_BYTES, crowd: int = CROWD_BYTES, memory: int = induced.MEMORY,
    base: int = induced.BASE,
) -> DataFrame:
    """``id, d, spans``: the maximal runs of bytes that are covered by a ``length``-byte string
    which also starts anywhere else; only documents that have any.

    Texts are UTF-8 bytes, and strings never cross documents.  Rows with equal id and text have
    one entry (``d`` hashes both) and count as repeats of each other.

    Every ``length``-byte string chooses an anchor inside it by its content, so equal strings
    choose equal anchors, and strings whose anchor is alone in the corpus are done.  The strings
    of one anchor make up one stretch of text, its context.  Equal contexts are merged before
    any text moves; where an anchor has several different ones, they go to a shard chosen by the
    anchor, and the shard's suffix array, sorted by induction in bounded memory, marks what is
    repeated.  An anchor with more than ``crowd`` bytes of different contexts is too much for
    one task: its strings are counted one by one by their 128-bit hashes, with partial sums.
    """
    keyed = _keyed(docs, doc_id, text)
    kind = dict(keyed.dtypes)["id"]
    found = staged(keyed.mapInArrow(
        _anchored(length), f"id {kind}, d bigint, start int, size int, h bigint, c bigint"), "anchors")
    shared = staged(found.groupBy("h").agg(
        F.count("*").alias("n"), (F.min("c") != F.max("c")).alias("mixed")
    ).where("n > 1").select("h", "mixed"), "shared-anchors")
    alive = staged(found.join(shared, "h"), "shared-contexts")
    mixed = staged(alive.where("mixed").groupBy("h", "c").agg(
        F.count("*").alias("k"), F.min(F.struct("id", "d", "start", "size")).alias("rep")
    ).select("h", "c", "k", "rep.*"), "contexts")
    crowds = staged(mixed.groupBy("h").agg(F.sum("size").alias("long")).where(F.col("long") > crowd).select("h"), "crowds")
    asked = mixed.groupBy("id", "d").agg(
        F.collect_list(F.struct("h", "c", "k", "start", "size")).alias("asked"))
    asked = staged(asked, "asked").withColumnRenamed("id", "id2").withColumnRenamed("d", "d2")
    pieces = _having(keyed, asked).select("t", "asked").mapInArrow(
        _sliced, "h bigint, c bigint, k bigint, piece binary")
    pieces = staged(pieces, "pieces")
    alone = pieces.join(small(crowds), "h", "left_anti")
    total = mixed.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    sorted_ = alone.repartition(shards, "h").mapInArrow(
        _suffix_sorted(length, memory, base), f"h bigint, c bigint, spans {SPANS}")
    windows = staged(pieces.join(small(crowds), "h", "left_semi").mapInArrow(
        _windows(length), "h bigint, c bigint, at int, w binary"), "windows")
    common = staged(windows.groupBy("w").count().where("count > 1").select("w"), "common")
    counted = windows.join(common, "w").groupBy("h", "c").agg(F.transform(
        F.collect_list("at"), lambda a: F.struct(a.alias("begin"), (a + 1).alias("end"))).alias("spans"))
    # a context that occurs more than once is repeated as a whole
    whole = F.array(F.struct(F.lit(0).alias("begin"), (F.col("size") - length + 1).alias("end")))
    marks = staged(
        sorted_.unionByName(counted).join(mixed.where("k > 1").select("h", "c"), ["h", "c"], "left_anti")
        .unionByName(mixed.where("k > 1").select("h", "c", whole.cast(SPANS).alias("spans"))), "marks")
    places = alive.where("NOT mixed").select(
        "id", "d", F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b"))
    places = places.unionByName(
        alive.where("mixed").select("id", "d", "start", "h", "c").join(marks, ["h", "c"]).select(
            "id", "d", "start", F.explode("spans").alias("s")).select(
            "id", "d", (F.col("start") + F.col("s.begin")).alias("a"),
            (F.col("start") + F.col("s.end") - 1 + length).alias("b")))
    # runs of one document, merged where they touch; their number is bounded by its length
    runs = places.groupBy("id", "d").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return staged(runs.mapInArrow(_merged, f"id {kind}, d bigint, spans {SPANS}"), "spans")


def _merged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every document's spans in order, those that touch or overlap as one."""
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    for part in parts:
        out = []
        for spans in part.column(2):
            a, b = (spans.values.field(k).to_numpy() for k in ("a", "b"))
            order = np.argsort(a, kind="stable")
            a, reach = a[order], np.maximum.accumulate(b[order])
            first = np.concatenate([[True], a[1:] > reach[:-1]])
            last = np.concatenate([first[1:], [True]])
            out.append([{"begin": int(x), "end": int(y)} for x, y in zip(a[first], reach[last], strict=True)])
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, kind)], names=["id", "d", "spans"])


def _having(keyed: DataFrame, other: DataFrame) -> DataFrame:
    """Texts with the columns of ``other`` (keys ``id2, d2``), without moving texts it lacks."""
    same = keyed["id"].eqNullSafe(F.col("id2")) & (keyed["d"] == F.col("d2"))
    keys = small(other.select("id2", "d2"), ID_ROWS)
    return keyed.join(keys, same, "left_semi").alias("k").join(
        other, F.col("k.id").eqNullSafe(F.col("id2")) & (F.col("k.d") == F.col("d2")))


def _cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        kept = []
        for t, spans in zip(part.column(2).cast(pa.binary()), part.column(3).to_pylist(), strict=True):
            view, at, out = memoryview(t.as_buffer()), 0, []
            for s in spans:
                out.append(bytes(view[at:s["begin"]]))
                at = s["end"]
            kept.append(b"".join([*out, bytes(view[at:])]))
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), part.column(3), pa.array(kept, pa.binary())],
            names=["id", "d", "spans", "kept"])


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400,
                    **limits) -> DataFrame:
    """``id, d, spans, kept``: the repeated runs and the bytes left, of documents that have any.

    ``limits`` are those of ``repeated_spans``.  Bytes are cut wherever a run ends, also inside
    a character.
    """
    spans = repeated_spans(docs, doc_id, text, length, **limits)
    keyed = _keyed(docs, doc_id, text)
    kind = dict(keyed.dtypes)["id"]
    asked = spans.withColumnRenamed("id", "id2").withColumnRenamed("d", "d2")
    return _having(keyed, asked).select("id", "d", "t", "spans").mapInArrow(
        _cut, f"id {kind}, d bigint, spans {SPANS}, kept binary").dropDuplicates(["id", "d"])


def summary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400,
            **limits) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``: one row per row of ``docs``.

    Null texts count as empty; documents shorter than ``length`` keep all; an empty table
    gives an empty result.
    """
    cut = staged(without_repeats(docs, doc_id, text, length, **limits).select(
        F.col("id").alias("id2"), F.col("d").alias("d2"), F.size("spans").cast("bigint").alias("n_spans"),
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["begin"]).alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256")), "cut")
    rows = _keyed(docs, doc_id, text).select(
        "id", "d", F.octet_length("t").cast("bigint").alias("n_bytes"),
        F.sha2(F.col("t").cast("binary"), 256).alias("whole"))
    return rows.join(cut, rows["id"].eqNullSafe(F.col("id2")) & (F.col("d") == F.col("d2")), "left").select(
        F.col("id").alias("doc_id"), "n_bytes", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("bigint")).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
