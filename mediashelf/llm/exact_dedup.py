"""Exact deduplication by composable polynomial fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediashelf.llm.common import lower_ascii, staged, text_digest, without_rows

MODULI = (2147483647, 2147483629)  # primes below 2**31
BASES = (1315423911, 1640531527)
BLOCK = 256  # bytes hashed by one dot product: 2**8 * 2**31 * BLOCK stays exact in a double
ROWS = 4_096  # blocks hashed at a time
CHUNK = 65_536  # bytes compared at a time
CHUNKS = 64  # chunks that leave a task together


def _power(base: int, n, modulus: int) -> np.ndarray:
    """``base ** n`` modulo ``modulus`` for an array of exponents, by squaring."""
    n = np.asarray(n, dtype=np.int64).copy()
    result, square = np.ones(n.shape, dtype=np.uint64), np.uint64(base % modulus)
    m = np.uint64(modulus)
    while n.any():
        result = np.where(n & 1, result * square % m, result)
        square = square * square % m
        n >>= 1
    return result


def combine(left, right, right_length, lane: int):
    """The fingerprint of two texts put together, from theirs and the right one's length."""
    m = np.uint64(MODULI[lane])
    shift = _power(BASES[lane], right_length, MODULI[lane])
    return (np.asarray(left, np.uint64) * shift + np.asarray(right, np.uint64)) % m


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial fingerprints of the byte ranges ``[starts, ends)`` of ``data``, a row a lane.

    Each range is cut into blocks, all blocks are hashed at once, and neighbouring parts are
    combined pairwise, halving their number, until one is left for each range.
    """
    lanes, m = len(MODULI), np.array(MODULI, dtype=np.uint64)[:, None]
    powers = np.stack([_power(BASES[i], np.arange(BLOCK - 1, -1, -1), MODULI[i])
                       for i in range(lanes)], axis=1).astype(np.float64)
    blocks = -(-(ends - starts) // BLOCK)
    owner = np.repeat(np.arange(len(starts)), blocks)
    # place from the right; the leftmost block of a range is the short one
    place = blocks[owner] - 1 - (np.arange(len(owner)) - (np.cumsum(blocks) - blocks)[owner])
    end = ends[owner] - place * BLOCK
    windows = np.lib.stride_tricks.sliding_window_view(
        np.concatenate([np.zeros(BLOCK, np.uint8), data]), BLOCK)
    value = np.zeros((lanes, len(owner)), dtype=np.uint64)
    for a in range(0, len(owner), ROWS):
        rows = windows[end[a:a + ROWS]].astype(np.float64)
        missing = starts[owner[a:a + ROWS]] + BLOCK - end[a:a + ROWS]
        for r in np.flatnonzero(missing > 0):
            rows[r, :missing[r]] = 0
        value[:, a:a + ROWS] = (rows @ powers).T.astype(np.uint64) % m
    # every right-hand part spans a power of two of blocks, so one shift serves a round
    span = BLOCK
    while len(owner) > np.count_nonzero(blocks):
        left = np.flatnonzero(place & 1)
        shift = np.array([_power(BASES[i], [span], MODULI[i]) for i in range(lanes)])
        value[:, left] = (value[:, left] * shift + value[:, left + 1]) % m
        keep = np.ones(len(owner), dtype=bool)
        keep[left + 1] = False
        owner, value, place = owner[keep], value[:, keep], place[keep] >> 1
        span *= 2
    result = np.zeros((lanes, len(starts)), dtype=np.uint64)
    result[:, owner] = value
    return result


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(1).cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        lanes = fingerprints(data, offsets[:-1], offsets[1:])
        joined = (lanes[0] << np.uint64(31) | lanes[1]).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(joined), pa.array(np.diff(offsets)), batch.column(2), batch.column(3)],
            names=["id", "fp", "n_bytes", "text_sha256", "digest"])


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of every text by their place, a few at a time."""
    for batch in batches:
        names = ["fp", "n_bytes", "place", "chunk"]
        for fp, size, text in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.large_binary()), strict=True):
            data = text.as_buffer()
            for first in range(0, len(data) or 1, CHUNK * CHUNKS):
                places = range(first // CHUNK, max(-(-min(len(data), first + CHUNK * CHUNKS) // CHUNK), 1))
                chunks = [data.slice(p * CHUNK, min(CHUNK, len(data) - p * CHUNK)).to_pybytes() for p in places]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(fp, len(chunks)), pa.repeat(size, len(chunks)), pa.array(places, pa.int64()),
                     pa.array(chunks, pa.binary())], names=names)


def _judged(docs: DataFrame, doc_id: str, text: str, keep_bits: int) -> DataFrame:
    """``id, digest, text_sha256, keep_id, group_size, alone`` of every row and the columns of KEY,
    which name its group; the digest is that of the text as it is."""
    normal = docs.select(
        F.col(doc_id).alias("id"), lower_ascii(F.coalesce(F.col(text), F.lit(""))).alias("t"),
        text_digest(F.col(text)).alias("digest"))
    hashed = normal.select("id", "t", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"), "digest")
    kind = dict(normal.dtypes)["id"]
    prints = hashed.mapInArrow(
        _fingerprint_batches, f"id {kind}, fp bigint, n_bytes bigint, text_sha256 string, digest binary")
    mask = (1 << keep_bits) - 1
    prints = staged(prints.withColumn("fp", F.col("fp").bitwiseAND(F.lit(mask))), "fingerprints")
    many = prints.groupBy("fp", "n_bytes").agg(F.count("*").alias("n")).where("n > 1").select("fp", "n_bytes")
    many = staged(many, "shared-fingerprints")
    # what is compared is found by what its text is known by, so repeated or missing ids do no harm
    members = prints.join(many, ["fp", "n_bytes"]).select("text_sha256", "fp", "n_bytes").distinct()
    chunks = hashed.join(members, "text_sha256").select("fp", "n_bytes", "t").mapInArrow(
        _chunk_batches, "fp bigint, n_bytes bigint, place bigint, chunk binary")
    differing = chunks.groupBy("fp", "n_bytes", "place").agg(
        F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a <> b")
    differing = staged(differing.select("fp", "n_bytes").distinct(), "collisions")
    if differing.isEmpty():
        keyed = prints.withColumn("exact", F.lit(""))
    else:
        # a fingerprint that stands for several texts: their digests tell them apart
        differing = differing.withColumn("apart", F.lit(True))
        keyed = prints.join(differing, ["fp", "n_bytes"], "left").withColumn(
            "exact", F.when(F.col("apart"), F.col("text_sha256")).otherwise("")).drop("apart")
    groups = keyed.groupBy(*KEY).agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    return keyed.join(groups, KEY)


KEY = ["fp", "n_bytes", "exact"]


def duplicate_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_bits: int = 62,
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per row of ``docs``.

    Null texts count as empty.  Texts are equal if they are identical after lower-casing A-Z;
    of equal texts the row with the largest id stays.  Null ids are smaller than every other;
    rows that share an id and a text share the verdict.  An empty table gives an empty result.

    Two 31-bit polynomial fingerprints make the key (``keep_bits`` keeps only that many, for
    tests of collisions).  Where documents share fingerprint and length, their texts are
    compared chunk by chunk: tasks cut them one chunk after the other, and in each place all must
    hold the same chunk, which partial aggregation settles without gathering them.  Groups that
    differ somewhere are regrouped by the SHA-256 digests of their whole texts.
    """
    return _judged(docs, doc_id, text, keep_bits).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of equal texts; all columns as they were.

    The row with the largest id stays, null ids being smaller than every other.  If several rows
    of a group have that id, the one with the smallest digest of its text as it is stays (a null
    text after all others), and of rows equal in that too any one.
    """
    found = staged(_judged(docs, doc_id, text, 62), "judged")
    largest = F.col("id").eqNullSafe(F.col("keep_id"))
    several = found.where(largest).groupBy(*KEY).agg(
        F.min("digest").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    tied = staged(found.where(largest).join(several, KEY), "tied")
    first = F.col("digest").eqNullSafe(F.col("first"))
    gone = found.where(~largest).select("id", "digest").unionByName(tied.where(~first).select("id", "digest"))
    again = tied.where(first).groupBy("id", "digest").count().where("count > 1")
    return without_rows(docs, doc_id, text, gone.distinct(), again.select("id", "digest"))
