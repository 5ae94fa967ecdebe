"""Fill-in-the-middle rewriting by rotating blocks of a text in place."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
SEED = "1"  # hashed before the id, as in "1:17"
REWRITTEN = 90  # of 100 documents so many are rewritten,
SUFFIX_FIRST = 20  # and of 100 of those so many with the suffix first
ROWS = 512  # texts held by a task at a time
SCRATCH = 1 << 16  # bytes exchanged at a time


def draws(doc_id: object, seed: str = SEED) -> tuple[int, int, int, int]:
    """Four 32-bit numbers that depend on the seed and the id as text; a null id counts as empty."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, three, four = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    return one, two, three, four


def reverse(data: np.ndarray, start: int, end: int) -> None:
    """Reverses ``data[start:end]`` where it lies, from both ends inwards."""
    while end - start > 1:
        size = min(SCRATCH, (end - start) // 2)
        front = data[start:start + size].copy()
        data[start:start + size] = data[end - size:end][::-1]
        data[end - size:end] = front[::-1]
        start, end = start + size, end - size


def rotate(buffer: bytearray, start: int, middle: int, end: int) -> None:
    """Exchanges the neighbours ``[start, middle)`` and ``[middle, end)``: each is reversed, then both."""
    data = np.frombuffer(buffer, dtype=np.uint8)
    reverse(data, start, middle)
    reverse(data, middle, end)
    reverse(data, start, end)


def scan_cuts(text: bytes, first: int, second: int) -> tuple[int, int, int]:
    """The number of code points, and the bytes that the two drawn code points start at."""
    starts = np.flatnonzero((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)
    n = len(starts)
    a, b = sorted((first % (n + 1), second % (n + 1)))
    places = np.append(starts, len(text))
    return n, int(places[a]), int(places[b])


def form_of(text: bytes, chosen: int, order: int) -> str:
    """The form that the draws give a text; one that is empty or holds a sentinel stays plain."""
    if not text or chosen % 100 >= REWRITTEN or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return PLAIN
    return SPM if order % 100 < SUFFIX_FIRST else PSM


def rewrite(text: bytes, form: str, cut: int, end: int) -> bytes:
    """The text with sentinels before its three parts, in the order of the form."""
    if form == PLAIN:
        return text
    buffer = bytearray(text)
    for place, sentinel in ((end, SUFFIX), (cut, MIDDLE), (0, PREFIX)):
        buffer[place:place] = sentinel
    middle, suffix = cut + len(PREFIX), end + len(PREFIX) + len(MIDDLE)
    rotate(buffer, middle if form == PSM else 0, suffix, len(buffer))
    return bytes(buffer)


def restore(output: bytes, form: str) -> bytes:
    """The text that ``rewrite`` was given, from its output and form alone."""
    if form == PLAIN:
        return output
    buffer = bytearray(output)
    start = buffer.index(SUFFIX) if form == PSM else 0
    # the suffix ends where the middle (psm) or the prefix (spm) starts
    rotate(buffer, start, buffer.index(MIDDLE if form == PSM else PREFIX), len(buffer))
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        place = buffer.index(sentinel)
        del buffer[place:place + len(sentinel)]
    return bytes(buffer)


def _rewritten(seed: str):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a in range(0, part.num_rows, ROWS):
                few = part.slice(a, ROWS)
                rows = []
                texts = few.column(1).cast(pa.large_binary()).to_pylist()
                for key, text in zip(few.column(2).to_pylist(), texts, strict=True):
                    text = text or b""
                    h1, h2, h3, h4 = draws(key, seed)
                    n, cut, end = scan_cuts(text, h1, h2)
                    form = form_of(text, h3, h4)
                    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                    parts_of = (None, None) if form == PLAIN else (low, high - low)
                    rows.append((n, form, *parts_of, rewrite(text, form, cut, end)))
                n, form, prefix, middle, output = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [few.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array(output, pa.large_binary()).cast(pa.large_string())
                     .cast(pa.string())],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return batches


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: str = SEED) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output``: one row per row of ``docs``.

    ``n`` counts code points; a null text counts as empty.  Two cuts drawn from the id divide the
    text into prefix, middle and suffix, any of which may be empty.  ``output`` is the text itself
    (``plain``: empty texts, texts that hold a sentinel, and those that the draw leaves alone; the
    two lengths then are null), ``<P>``prefix``<S>``suffix``<M>``middle (``psm``) or
    ``<S>``suffix``<P>``prefix``<M>``middle (``spm``).  Rows are independent: repeated rows give
    repeated results, a null id draws as the empty id, an empty table gives none.

    Sentinels are put in front of the parts of a byte array, whose blocks then change places by
    three reversals, with SCRATCH bytes of further memory; cuts never fall inside a code point.
    """
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"), F.col(doc_id).cast("string").alias("key"))
    return rows.mapInArrow(
        _rewritten(seed), f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def with_restored(rewritten: DataFrame) -> DataFrame:
    """``rewritten`` with a column ``restored``: the original text, from output and form alone."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a in range(0, part.num_rows, ROWS):
                few = part.slice(a, ROWS)
                outputs = few.column("output").cast(pa.large_binary()).to_pylist()
                texts = [restore(o, f) for o, f in zip(outputs, few.column("form").to_pylist(), strict=True)]
                restored = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*few.columns, restored], names=[*few.schema.names, "restored"])

    fields = ", ".join(f"`{n}` {t}" for n, t in rewritten.dtypes)
    return rewritten.mapInArrow(batches, f"{fields}, restored string")
