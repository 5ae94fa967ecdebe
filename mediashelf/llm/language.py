"""Language identification by cross-parsing with suffix automata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediashelf.llm.common import small

PIECES, PIECE_CHARS = 100, 300  # learned from each language: so many pieces of so many characters
SEGMENT = 256  # texts are parsed in segments of so many symbols, all segments side by side
SYMBOLS = 96  # the most frequent letters have symbols of their own
GAP, OTHER, END = 0, 1, 2  # symbols of a run of non-letters, of any other letter, of no text
UNDETERMINED = "und"


def _fold_table() -> np.ndarray:
    """For every code point the lower-case code point if it is a letter, else 0."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        letter = chr(c)
        if letter.isalpha():
            table[c] = ord(letter.lower()[0])
    return table


_FOLDED: list[np.ndarray] = []


def _letters(text: str) -> np.ndarray:
    """Folded letters of a text, runs of anything else as one 0."""
    if not _FOLDED:
        _FOLDED.append(_fold_table())
    folded = _FOLDED[0][np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
    keep = np.ones(len(folded), dtype=bool)
    keep[1:] = (folded[1:] != 0) | (folded[:-1] != 0)
    return folded[keep]


def suffix_automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions of the suffix automaton of a sequence, ``-1`` where there is none."""
    room = 2 * len(symbols) + 2
    step = np.full((room, width), -1, dtype=np.int32)
    link, length = [-1] * room, [0] * room
    size, last = 1, 0
    for c in symbols:
        state, size = size, size + 1
        length[state] = length[last] + 1
        p = last
        while p != -1 and step[p, c] == -1:
            step[p, c] = state
            p = link[p]
        if p == -1:
            link[state] = 0
        else:
            q = int(step[p, c])
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                clone, size = size, size + 1
                length[clone] = length[p] + 1
                step[clone] = step[q]
                link[clone] = link[q]
                while p != -1 and step[p, c] == q:
                    step[p, c] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    return step[:size]


@dataclass(frozen=True)
class Model:
    """Languages, the letters that have symbols, and one table of all automata.

    An entry that is not negative is the next state; a negative one says that the phrase ends
    here and is the complement of the state that the next phrase begins in.
    """

    languages: tuple[str, ...]
    letters: tuple[int, ...]
    table: np.ndarray
    roots: tuple[int, ...]


def build(samples: dict[str, list[str]]) -> Model:
    """The model of the given texts of each language."""
    languages = tuple(sorted(samples))
    arrays = {n: [_letters(t) for t in samples[n]] for n in languages}
    seen = [a for n in languages for a in arrays[n]]
    values, counts = np.unique(np.concatenate(seen or [np.zeros(0, np.uint32)]), return_counts=True)
    frequent = values[np.argsort(-counts, kind="stable")]
    letters = tuple(int(v) for v in frequent[frequent != 0][:SYMBOLS - 3])
    width = len(letters) + 3
    symbol = {0: GAP, **{v: i + 3 for i, v in enumerate(letters)}}
    tables, roots, base = [], [], 0
    for n in languages:
        sequence = [symbol.get(int(v), OTHER) for a in arrays[n] for v in [0, *a, 0]]
        step = suffix_automaton(sequence, width)
        restart = np.maximum(step[0], 0) + base
        table = np.where(step >= 0, step + base, ~restart[None, :].astype(np.int32))
        table[:, END] = np.arange(len(step)) + base  # nothing more to parse
        tables.append(table.astype(np.int32))
        roots.append(base)
        base += len(step)
    table = np.concatenate(tables) if tables else np.zeros((0, width), np.int32)
    return Model(languages, letters, table, tuple(roots))


def phrases(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases per text and language, symbols per text, and whether a text has a letter."""
    lookup = np.full(0x110000, OTHER, dtype=np.uint8)
    lookup[0] = GAP
    lookup[list(model.letters)] = np.arange(3, len(model.letters) + 3)
    rows = [_letters(t) for t in texts]
    n = np.array([len(r) for r in rows], dtype=np.int64)
    lettered = np.array([bool(r.any()) for r in rows], dtype=bool)
    count = -(-n // SEGMENT)
    grid = np.full((int(count.sum()), SEGMENT), END, dtype=np.uint8)
    at = 0
    for row, k in zip(rows, count, strict=True):
        grid[at:at + k].reshape(-1)[:len(row)] = lookup[row]
        at += k
    owner = np.repeat(np.arange(len(texts)), count)
    columns = np.ascontiguousarray(grid.T)
    flat, width = model.table.reshape(-1), model.table.shape[1]
    out = np.zeros((len(texts), len(model.languages)), dtype=np.int64)
    for i, root in enumerate(model.roots):
        state = np.full(len(owner), root, dtype=np.int32 if len(flat) < 1 << 31 else np.int64)
        ended = np.ones(len(owner), dtype=np.int32)
        for column in columns:
            state = flat[state * state.dtype.type(width) + column].astype(state.dtype, copy=False)
            over = state >> (8 * state.itemsize - 1)  # -1 where a phrase ends
            ended -= over.astype(np.int32, copy=False)
            state ^= over
        out[:, i] = np.bincount(owner, weights=ended, minlength=len(texts))
    return out, n, lettered


def predictions(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    """The language of each text and how sure it is: phrases times the bits that point to one,
    per symbol, are the entropy against a language; the score is its share among the languages'
    likelihoods of 64 symbols."""
    found, n, lettered = phrases(texts, model)
    lettered &= len(model.languages) > 0
    names, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if lettered.any():
        bits = np.log(np.maximum(2, len(model.table) / len(model.languages)))
        entropy = found[lettered] * bits / n[lettered, None]
        best = entropy.argmin(axis=1)
        gap = (entropy - entropy.min(axis=1, keepdims=True)) * np.minimum(n[lettered], 64)[:, None]
        score[lettered] = 1 / np.exp(-gap).sum(axis=1)
        for i, b in zip(np.flatnonzero(lettered), best, strict=True):
            names[i] = model.languages[b]
    return names, score


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from the documents given whose language is not null (hold out others before).

    The sample is bounded: of each language PIECES pieces of PIECE_CHARS characters, each cut
    out of a document at a place chosen by a hash, the documents taken in the order of a hash.
    """
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(lang).alias("lang"),
                       F.col(text).alias("t")).where("lang IS NOT NULL AND t IS NOT NULL")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    hashed = F.xxhash64(F.coalesce("id", F.lit("")), F.lit(41))
    # thinned by hash first, so that the ordering works on a bounded number of rows a language
    thinned = rows.join(small(counts), "lang").where(
        F.pmod(hashed, F.lit(1 << 30)) / (1 << 30) < 4.0 * PIECES / F.col("n"))
    start = F.pmod(F.xxhash64("id", F.lit(43)), F.greatest(F.length("t") - PIECE_CHARS, F.lit(0)) + 1)
    pieces = thinned.select("lang", "id", F.substring(
        F.col("t"), start.cast("int") + 1, F.lit(PIECE_CHARS)).alias("piece"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(47)), "id", "piece")
    kept = pieces.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PIECES)
    samples: dict[str, list[str]] = {}
    for row in kept.orderBy("lang", "rank").collect():
        samples.setdefault(row["lang"], []).append(row["piece"])
    return build(samples)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, lang_pred, score`` for every whole text, one row per row of ``docs``.

    ``und`` with score 0 if the text is null or has no letter (or nothing was learned); of
    languages with equally many phrases the first by name.  Nothing but the text is looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a in range(0, part.num_rows, 512):
                few = part.slice(a, 512)
                texts = [t or "" for t in few.column(1).to_pylist()]
                names, score = predictions(texts, shared.value)
                yield pa.RecordBatch.from_arrays(
                    [few.column(0), pa.array(names, pa.string()), pa.array(score)],
                    names=["id", "lang_pred", "score"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).mapInArrow(
        batches, f"id {kind}, lang_pred string, score double")
