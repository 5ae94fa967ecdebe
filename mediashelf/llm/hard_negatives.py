"""Hard negatives by zone maps over candidate blocks in Hilbert order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediashelf.llm.common import staged

SCALE = 256  # a component x counts as floor(SCALE * x)
BITS = 4  # of a component that the curve tells apart
BLOCK = 1_024  # candidates of a block
BATCH = 256  # anchors that look for blocks together
PAGE = 256  # zone maps that meet a batch at a time, about
SEEDS = 2  # blocks that are read first for every window, to know what others must reach
PAIRS = 32  # pairs of a batch and a block, or a page, that a Python worker gets at a time
LONGEST = 2.0 ** 62  # vectors of at least this squared length take no part: scores are longs
MOST, LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Places along a Hilbert curve of rows of cells below ``2 ** bits``, as bytes that sort alike.

    The usual transform between axes and the transposed index: exchanges and inversions from the
    highest bit down, then Gray code, on all rows at once.
    """
    x = cells.astype(np.uint32).T.copy()
    top = 1 << (bits - 1)
    bit = top
    while bit > 1:
        below = np.uint32(bit - 1)
        for i in range(len(x)):
            inverted = (x[i] & bit) != 0
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & below).astype(np.uint32)
            x[0] ^= np.where(inverted, below, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    last, bit = np.zeros(x.shape[1], dtype=np.uint32), top
    while bit > 1:
        last ^= np.where((x[-1] & bit) != 0, np.uint32(bit - 1), np.uint32(0))
        bit >>= 1
    x ^= last
    planes = np.stack([(x >> np.uint32(b)) & 1 for b in reversed(range(bits))])  # bit, axis, row
    packed = np.packbits(planes.reshape(-1, x.shape[1]).astype(np.uint8), axis=0).T
    return [row.tobytes() for row in packed]


def _keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A place on the curve for every vector, by its direction: components over the largest."""
    for part in parts:
        lists = part.column("v")
        sizes = np.diff(lists.offsets.to_numpy())
        flat, keys = lists.flatten().to_numpy(), [b""] * len(sizes)
        starts = np.cumsum(sizes) - sizes
        for size in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == size)
            v = flat[starts[rows][:, None] + np.arange(size)].astype(np.float64)
            v /= np.maximum(1, np.abs(v).max(axis=1, keepdims=True))
            cells = np.minimum((v + 1) * (1 << (BITS - 1)), (1 << BITS) - 1)
            for row, key in zip(rows, hilbert_keys(cells), strict=True):
                keys[row] = key
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.binary())], names=[*part.schema.names, "key"])


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """Rows in the order of the curve within a label and size, ``most`` or fewer to a block, with
    the least and the greatest value of every dimension."""
    kinds = dict(rows.dtypes)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, of, schema = TaskContext.get().partitionId() << 32, [], None, None

        def block() -> pa.RecordBatch:
            label, size = of
            ids, vectors = zip(*sorted(held, key=lambda r: r[0]), strict=True)
            matrix = np.array(vectors, dtype=np.int64).reshape(len(ids), size)
            low, high = (matrix.min(axis=0), matrix.max(axis=0)) if size else (matrix[0], matrix[0])
            width = next(w for w in (1, 2, 4, 8) if w == 8 or np.abs(matrix).max(initial=0) < 1 << (8 * w - 1))
            return pa.RecordBatch.from_pylist([{
                "block": number, "label": label, "size": size, "n": len(ids), "ids": list(ids), "width": width,
                "data": matrix.astype(f"<i{width}").tobytes(), "low": low.tobytes(), "high": high.tobytes()}],
                schema=schema)

        for part in parts:
            schema = schema or pa.schema([
                ("block", pa.int64()), ("label", part.schema.field("label").type), ("size", pa.int32()),
                ("n", pa.int32()), ("ids", pa.list_(part.schema.field("id").type)), ("width", pa.int32()),
                ("data", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])
            for key, label, vector in zip(part.column("id").to_pylist(), part.column("label").to_pylist(),
                                          part.column("v").to_pylist(), strict=True):
                if held and (len(held) == most or of != (label, len(vector))):
                    yield block()
                    held, number = [], number + 1
                of = (label, len(vector))
                held.append((key, vector))
        if held:
            yield block()

    order = ["label", "size", "key", "id"]
    return rows.select(*order, "v").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        batches, f"block bigint, label {kinds['label']}, size int, n int, ids array<{kinds['id']}>, width int, "
        "data binary, low binary, high binary")


def _pages(blocks: DataFrame) -> DataFrame:
    """Zone maps in pages that mix all labels of one size."""
    pages = blocks.groupBy("size").agg(F.ceil(F.count("*") / PAGE).alias("pages"))
    zones = blocks.select("block", "label", "size", "low", "high").join(pages, "size")
    return zones.groupBy("size", F.pmod(F.xxhash64("block"), F.col("pages")).alias("page"), "pages").agg(
        F.collect_list(F.struct("block", "label", "low", "high")).alias("zones"))


def _matrix(data, width: int, size: int) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), f"<i{width}").reshape(-1, size) if size else np.zeros((0, 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    size = a.shape[1]
    largest = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0))
    if largest * size < 2.0 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def reach(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest inner product of every row with any point of every zone, by interval
    arithmetic; rounded outwards where doubles are not exact."""
    up, down = np.maximum(a, 0).astype(np.float64), np.minimum(a, 0).astype(np.float64)
    low, high = low.astype(np.float64), high.astype(np.float64)
    least, greatest = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    spread = (up - down) @ np.maximum(np.abs(low), np.abs(high)).T
    slack = np.where(spread < 2.0 ** 53, 0, spread * 2.0 ** -40)
    return least - slack, greatest + slack


def _windows(row) -> dict[str, np.ndarray]:
    flat = row.values
    return {k: flat.field(k).to_numpy(zero_copy_only=False) for k in ("i", "j", "low", "high")}


def _choosing(own: bool, seeds: bool) -> Callable:
    """Blocks of a page that a batch reads: for each window rank those whose middle lies nearest to
    the window's upper end (seeds), or all that any window may reach into."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[tuple[int, int, int, float]] = []
            for r in range(part.num_rows):
                batch, size = part.column("batch")[r].as_py(), part.column("size")[r].as_py()
                a = _matrix(part.column("data")[r], part.column("width")[r].as_py(), size)
                zones = part.column("zones")[r].values
                same = np.array([v == part.column("label")[r].as_py() for v in zones.field("label").to_pylist()])
                zones = zones.filter(pa.array(same == own))
                if not len(zones):
                    continue
                low, high = (np.frombuffer(b"".join(zones.field(k).to_pylist()), np.int64).reshape(len(zones), size)
                             for k in ("low", "high"))
                names, window = zones.field("block").to_numpy(), _windows(part.column("windows")[r])
                least, greatest = reach(a, low, high) if size else (np.zeros((len(a) or 1, len(zones))),) * 2
                least, greatest = least[window["i"]], greatest[window["i"]]
                if seeds:
                    middle, top = (least + greatest) / 2, window["high"][:, None]
                    off = np.where(top == MOST, -middle, np.abs(middle - top.astype(np.float64)))
                    for j in np.unique(window["j"]):
                        mean = off[window["j"] == j].mean(axis=0)
                        for k in np.argsort(mean, kind="stable")[:SEEDS]:
                            out.append((batch, int(names[k]), int(j), float(mean[k])))
                else:
                    may = (greatest >= window["low"][:, None]) & (least <= window["high"][:, None])
                    out += [(batch, int(b), 0, 0.0) for b in names[may.any(axis=0)]]
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["batch", "block", "j", "off"])

    return batches


def best_in(scores: np.ndarray, low: np.ndarray, high: np.ndarray, out: np.ndarray, most: int):
    """Rows and columns of the ``most`` greatest scores of every row within ``low..high``, ties by
    column; ``out`` marks what does not count."""
    inside = (scores >= low[:, None]) & (scores <= high[:, None]) & ~out
    if scores.shape[1] > most:
        masked = np.where(inside, scores, LEAST)
        inside &= masked >= np.partition(masked, scores.shape[1] - most, axis=1)[:, -most][:, None]
    row, column = np.nonzero(inside)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, row)
    kept = np.arange(len(row)) - first < most
    return row[kept], column[kept]


def _reading(own: bool, most: int) -> Callable:
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in range(part.num_rows):
                size = part.column("size")[r].as_py()
                a = _matrix(part.column("data")[r], part.column("width")[r].as_py(), size)
                x = _matrix(part.column("x")[r], part.column("x_width")[r].as_py(), size)
                ids, anchors = part.column("x_ids")[r].values, part.column("ids")[r].values
                window = _windows(part.column("windows")[r])
                i = window["i"]
                scores = products(a, x)[i] if size else np.zeros((len(i), len(ids)), np.int64)
                same = np.zeros(scores.shape, dtype=bool)
                if own:
                    known = ids.to_numpy(zero_copy_only=False)
                    same = anchors.to_numpy(zero_copy_only=False)[i][:, None] == known[None, :]
                w, c = best_in(scores, window["low"], window["high"], same, most)
                at = pa.array(w)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(w), part.column("batch")[r].as_py(), np.int64)),
                    pa.array(i[w], pa.int32()), pa.array(window["j"][w], pa.int32()),
                    anchors.take(pa.array(i[w])), part.column("windows")[r].values.field("id").take(at),
                    pa.array(window["low"][w]), pa.array(window["high"][w]),
                    ids.take(pa.array(c)), pa.array(scores[w, c])],
                    names=["batch", "i", "j", "anchor", "id", "low", "high", "found", "score"])

    return batches


class _Search:
    """Anchors in batches, candidates in blocks, and the zone maps of the blocks."""

    def __init__(self, rows: DataFrame, most: int) -> None:
        self.kind, self.most = dict(rows.dtypes)["id"], most
        self.blocks = staged(_packed(rows.drop("anchor"), BLOCK), "blocks")
        self.batches = staged(_packed(rows.where("anchor").drop("anchor"), BATCH).withColumnRenamed(
            "block", "batch").drop("low", "high"), "batches")
        self.pages = staged(_pages(self.blocks), "zones")

    def _asked(self, windows: DataFrame) -> DataFrame:
        """Batches with their windows; a batch has at most as many as anchors times positives."""
        lists = windows.groupBy("batch").agg(F.collect_list(F.struct("i", "j", "low", "high", "id")).alias("windows"))
        return staged(self.batches.join(lists, "batch"), "windows")

    def _read(self, asked: DataFrame, own: bool, seeds: bool) -> DataFrame:
        """The best candidates of every window among the blocks that are chosen."""
        sizes = self.pages.select("size", "pages").distinct()
        met = asked.join(sizes, "size").withColumn(
            "page", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pages") - 1))).drop("pages").join(
            self.pages.drop("pages"), ["size", "page"])
        chosen = staged(met.mapInArrow(_choosing(own, seeds), "batch bigint, block bigint, j int, off double"),
                        "chosen", PAIRS)
        if seeds:
            order = Window.partitionBy("batch", "j").orderBy("off", "block")
            chosen = chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SEEDS)
        pairs = chosen.select("batch", "block").distinct().join(asked, "batch").join(self.blocks.select(
            "block", F.col("ids").alias("x_ids"), F.col("width").alias("x_width"), F.col("data").alias("x")), "block")
        shape = (f"batch bigint, i int, j int, anchor {self.kind}, id {self.kind}, low bigint, high bigint, "
                 f"found {self.kind}, score bigint")
        found = staged(pairs.mapInArrow(_reading(own, self.most), shape), "found", PAIRS)
        order = Window.partitionBy("batch", "i", "j").orderBy(F.col("score").desc(), "found")
        ranked = found.withColumn("rank", F.row_number().over(order))
        return staged(ranked.where(F.col("rank") <= self.most), "best")

    def best(self, windows: DataFrame, own: bool) -> DataFrame:
        """The best candidates of every window: a few blocks tell what score the last of them has at
        least, then every block that may hold a better one is read."""
        first = self._read(self._asked(windows), own, True)
        last = first.where(F.col("rank") == self.most).select("batch", "i", "j", F.col("score").alias("least"))
        raised = windows.join(last, ["batch", "i", "j"], "left").withColumn(
            "low", F.greatest("low", F.coalesce("least", "low"))).drop("least")
        return self._read(self._asked(raised), own, False)


def _share(score: Column, percent: int) -> Column:
    """The least integer that is ``percent`` of a score or more, without leaving the longs."""
    rest = F.pmod(score, F.lit(100))
    return F.call_function("div", score - rest, F.lit(100)) * percent + F.ceil(rest * percent / 100)


def hard_negatives(
    vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding",
    label: str | Column = "label", most: int = 5, percent: int = 80,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components count as floor(SCALE * x).  For every row that ``anchor`` names, its positives are
    the ``most`` best rows of its label with another id; for each of them the ``most`` best rows of
    other labels are returned whose score is at most the positive's and at least ``percent`` of it.
    Scores are integer inner products, ties go to the smaller id.  Rows without id, label or vector,
    with null or non-finite components, or so long that scores are no longs (LONGEST) take no part;
    vectors of different sizes do not meet, empty ones score 0.  Repeated rows count each.  Anchors
    without positives, and positives without negatives, give no rows; empty tables give none.

    Candidates of a label are sorted along a Hilbert curve of their directions and stored as Parquet
    rows of BLOCK vectors with the least and greatest value of every dimension.  Batches of anchors
    meet those zone maps page by page; interval arithmetic bounds the scores of a block, and only
    blocks that may reach into an anchor's window are read.  Every pair of a batch and a block is a
    row of its own, so neither blocks nor anchors that many others choose are gathered.
    """
    name = F.col(label) if isinstance(label, str) else label
    values = F.transform(F.col(embedding), lambda x: x.cast("double") * SCALE)
    inside = F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0 ** 62))
    length = F.aggregate("values", F.lit(0.0), lambda total, x: total + (F.abs(x) + 1) * (F.abs(x) + 1))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & inside & (length < LONGEST), F.lit(False))
    rows = vectors.select(F.col(vec_id).alias("id"), name.alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
                          values.alias("values")).where(usable)
    rows = rows.select("id", "label", "anchor", F.transform("values", lambda x: F.floor(x)).alias("v"), F.size("values").alias("size"))
    shape = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    rows = staged(rows.mapInArrow(_keys, f"{shape}, key binary"), "vectors")
    search = _Search(rows, most)
    each = search.batches.select("batch", F.explode(F.expr("sequence(0, n - 1)")).alias("i"))
    everything = each.select("batch", "i", F.lit(0).alias("j"), F.lit(int(LEAST)).alias("low"), F.lit(int(MOST)).alias(
        "high"), F.lit(None).cast(search.kind).alias("id"))
    positives = search.best(everything, True)
    windows = positives.select("batch", "i", F.col("rank").alias("j"), _share(F.col("score"), percent).alias("low"),
                               F.col("score").alias("high"), F.col("found").alias("id"))
    found = search.best(windows, False)
    return found.select(
        F.col("anchor").alias("anchor_id"), F.col("id").alias("positive_id"), "rank",
        F.col("found").alias("negative_id"), F.col("high").alias("positive_score"),
        F.col("score").alias("negative_score"))
