"""Quality classifier: texts that a dictionary of good text compresses better than one of bad."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVEL = 3
DICT_BYTES = 112_640
SAMPLE_DOCS = 1_500  # labelled documents of either class that the dictionaries are built from
CALIBRATION_DOCS = 1_500  # further labelled documents of either class for the calibration
PIECE_CHARS, SAMPLE_PIECES = 2_000, 3_000  # bounds the bytes of the sample, however long a text
DOC_PIECES = 8  # pieces of one document in the sample at most, or its even share if that is more


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the calibration: weights, their scaling and an offset."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    offset: float
    prior: float


def _pieces(text: bytes) -> Iterator[bytes]:
    """The whole text, cut after every PIECE_CHARS characters as the learned pieces are (and
    after as many bytes as those can have, where bytes are no UTF-8)."""
    at, most = 0, 4 * PIECE_CHARS
    while len(text) - at > PIECE_CHARS:
        window = np.frombuffer(text, np.uint8, min(most + 1, len(text) - at), at)
        firsts = np.flatnonzero((window & 0xC0) != 0x80)  # first bytes of characters
        if len(firsts) > PIECE_CHARS:
            end = at + int(firsts[PIECE_CHARS])
        else:
            end = min(at + most, len(text))
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


def _sizes(texts: list[bytes], dictionary: bytes) -> np.ndarray:
    if dictionary:
        prepared = zstandard.ZstdCompressionDict(dictionary)
        prepared.precompute_compress(level=LEVEL)
        press = zstandard.ZstdCompressor(dict_data=prepared, write_checksum=False,
                                         write_content_size=False, write_dict_id=False)
    else:
        press = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False,
                                         write_content_size=False)
    return np.array([sum(len(press.compress(p)) for p in _pieces(t)) for t in texts],
                    dtype=np.float64)


def features(texts: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """Per text: the compressed-size difference normalised by the sizes' sum, the same
    normalised by the length, and the logarithm of the better rate it stands for.  Sizes are
    sums over all pieces of a text, each compressed on its own: in one frame a long text would
    be its own dictionary."""
    a, b = _sizes(texts, good), _sizes(texts, bad)
    n = np.array([max(1, len(t)) for t in texts], dtype=np.float64)
    return np.stack([(b - a) / (a + b), (b - a) / n, np.log(np.minimum(a, b) / n)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + 1e-3 * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; plain content where there is too little text to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        content = b"\n".join(texts)[-DICT_BYTES:]
        return content if len(content) >= 8 else b""


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
    label: str = "quality",
) -> Model:
    """Learns from the labelled documents given (hold out others before).

    ``labels`` holds ``doc_id`` and ``label`` (0 or 1; other values and nulls are left out; of
    several labels of a document the smallest counts).  The sample is bounded: of either class
    SAMPLE_DOCS documents for the dictionaries and CALIBRATION_DOCS for the calibration, taken
    in the order of a hash of their ids, and of those at most SAMPLE_PIECES pieces of
    PIECE_CHARS characters per class: one piece of every document first, then a second one of
    each, and so on.  No document gives more than DOC_PIECES pieces, or than its even share of
    SAMPLE_PIECES where the class has few documents; which of its pieces, from the whole text, is
    up to a hash.  So at most DOC_PIECES * SAMPLE_DOCS pieces of a half are ordered.  With one class only, or
    none, every text scores the share of label 1 (0.5 without labels).
    """
    marked = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where(
        "id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return Model(b"", b"", (0.0,) * 3, (0.0,) * 3, (1.0,) * 3, 0.0, prior)
    want = SAMPLE_DOCS + CALIBRATION_DOCS
    order = F.xxhash64(F.col("id").cast("string"), F.lit(29))
    share = F.lit(None).cast("double")
    for y, n in counts.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, 4 * want / n))).otherwise(share)
    # thinned by hash first, so that the ordering works on a bounded number of rows
    thinned = marked.where(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(31)),
                                  F.lit(1 << 20)) < share * (1 << 20))
    ranked = thinned.withColumn("rank", F.row_number().over(
        Window.partitionBy("y").orderBy(order, "id"))).where(F.col("rank") <= want)
    chosen = ranked.withColumn("fit", F.col("rank") % 2 == 0)
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # at most 2 * want rows of ids
    sample = texts.where("t <> ''").join(F.broadcast(chosen), "id")
    share = F.lit(DOC_PIECES)
    for r in sample.groupBy("y", "fit").agg(F.countDistinct("id").alias("n")).collect():
        share = F.when((F.col("y") == r["y"]) & (F.col("fit") == r["fit"]), F.lit(
            max(DOC_PIECES, -(-SAMPLE_PIECES // r["n"])))).otherwise(share)
    # places are chosen before any text is cut, so that a long text gives its share only
    places = F.transform(
        F.sequence(F.lit(0), F.floor((F.length("t") - 1) / PIECE_CHARS).cast("int")),
        lambda i: F.struct(F.xxhash64(F.col("id").cast("string"), i).alias("by"), i.alias("place")))
    pieces = sample.withColumn("share", share).select("id", "y", "fit", "share", F.explode(F.transform(
        F.slice(F.array_sort(places), F.lit(1), F.col("share")),
        lambda p: F.struct(p["by"].alias("by"), F.substring(
            F.col("t"), p["place"] * PIECE_CHARS + 1, F.lit(PIECE_CHARS)).alias("piece")))).alias("p"))
    turns = pieces.select("id", "y", "fit", "share", "p.by", "p.piece").withColumn(
        "turn", F.row_number().over(Window.partitionBy("y", "fit", "id").orderBy("by", "piece")))
    kept = turns.where("turn <= share").withColumn("rank", F.row_number().over(
        Window.partitionBy("y", "fit").orderBy("turn", "by", "id", "piece")))
    rows = kept.where(F.col("rank") <= SAMPLE_PIECES).select("y", "fit", "piece").collect()
    split = {(y, f): [r["piece"].encode() for r in rows if r["y"] == y and r["fit"] == f]
             for y in (0, 1) for f in (False, True)}
    good, bad = _dictionary(split[1, True]), _dictionary(split[0, True])
    held = split[1, False], split[0, False]
    if not held[0] or not held[1]:
        held = split[1, True], split[0, True]
    if not held[0] or not held[1]:
        return Model(b"", b"", (0.0,) * 3, (0.0,) * 3, (1.0,) * 3, 0.0, prior)
    x = features([*held[0], *held[1]], good, bad)
    y = np.repeat([1.0, 0.0], [len(held[0]), len(held[1])])
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    # classes count as often as they occur among all labels, not as in the sample
    weight = np.where(y == 1, prior / len(held[0]), (1 - prior) / len(held[1])) * len(y)
    w = _logistic((x - centre) / scale, y, weight)
    return Model(good, bad, tuple(map(float, w[:-1])), tuple(map(float, centre)),
                 tuple(map(float, scale)), float(w[-1]), prior)


def scores_of(texts: list[bytes], model: Model) -> np.ndarray:
    """The score of each text; empty texts score the share of label 1."""
    score = np.full(len(texts), model.prior)
    filled = [i for i, t in enumerate(texts) if t]
    if filled and any(model.weights):
        x = features([texts[i] for i in filled], model.good, model.bad)
        z = ((x - np.array(model.centre)) / np.array(model.scale)) @ np.array(model.weights)
        score[filled] = 1 / (1 + np.exp(-np.clip(z + model.offset, -30, 30)))
    return score


def _slices(parts: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches cut into few rows, so that few texts are unpacked at a time."""
    for part in parts:
        for a in range(0, part.num_rows, rows):
            yield part.slice(a, rows)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, score``: the chance of label 1 of every whole text (null counts as empty), one row
    per row of ``docs``.  Nothing but the text is looked at."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(parts):
            texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(scores_of(texts, model))], names=["id", "score"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).mapInArrow(
        batches, f"id {kind}, score double")


def keep_good(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more, with all their columns."""
    place = docs.columns.index(text)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(parts):
            texts = [t or b"" for t in part.column(place).cast(pa.binary()).to_pylist()]
            yield part.filter(pa.array(scores_of(texts, model) >= least))

    return docs.mapInArrow(batches, docs.schema)
