"""Embedding near-duplicates by binary codes of randomly rotated vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediashelf.llm.common import components, small, staged

BUCKET = 1_024  # vectors of one label that share a bucket, about
BLOCK = 2_048  # a bucket of more vectors is compared block by block
MISS = 1e-6  # chance that a pair at the threshold shares a bucket in no table
SIGMAS = 5.0  # width of the confidence bounds, in standard deviations
_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def rotation(size: int, number: int) -> np.ndarray:
    """The ``number``-th random rotation of vectors of ``size`` components."""
    key = size, number
    if key not in _ROTATIONS:
        if len(_ROTATIONS) > 64:
            _ROTATIONS.clear()
        draw = np.random.default_rng([20_240_607, size, number]).standard_normal((size, size))
        q, r = np.linalg.qr(draw)
        _ROTATIONS[key] = q * np.sign(np.diag(r))
    return _ROTATIONS[key]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors in double precision, of length 1."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def encode(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign codes of the rotated vectors and their correction factors: the inner product of
    each vector with the corner of the cube that its code stands for."""
    turned = units @ rotation(units.shape[1], 0).T
    return turned >= 0, np.abs(turned).sum(axis=1) / math.sqrt(units.shape[1])


def estimates(signs: np.ndarray, factors: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of coded vectors with rotated ones."""
    corners = np.where(signs, 1.0, -1.0) / math.sqrt(signs.shape[1])
    return (corners @ turned.T) / factors[:, None]


def bounds(factors: np.ndarray, size: int, least: float) -> np.ndarray:
    """How far an estimate can lie below an inner product of ``least`` or more: the error
    comes from the part of the other vector that is perpendicular to the coded one, whose
    length is at most sqrt(1 - least ** 2)."""
    spread = np.sqrt(np.maximum(0, 1 - factors ** 2)) / factors / math.sqrt(max(1, size - 1))
    return SIGMAS * spread * math.sqrt(1 - least ** 2) if size >= 16 else np.full(len(factors), 9.0)


def coarse(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotated vectors in one byte a component, and each vector's width of a step; a component
    is the middle of its step, which lies on its own side of zero."""
    steps = np.abs(turned).max(axis=1) / 127.5
    return np.clip(np.floor(turned / steps[:, None]), -128, 127).astype(np.int8), steps


def restored(coarse_bytes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Rotated vectors from their bytes, off by half a step in a component at most."""
    return (coarse_bytes + 0.5) * steps[:, None]


def may_reach(signs: np.ndarray, factors: np.ndarray, slack: np.ndarray, turned: np.ndarray,
              steps: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of ``i`` and ``j`` have estimates whose bounds reach ``least`` from both ends.

    ``turned`` may be off by half a step of ``steps`` in each component, all of one sign at worst;
    the bounds are wider by what that can change an estimate.
    """
    off = steps * (math.sqrt(signs.shape[1]) / 2 * (1 + 1e-9))
    near = estimates(signs[i], factors[i], turned[j]) + slack[i, None] + (
        off[None, j] / factors[i, None]) >= least
    near &= (estimates(signs[j], factors[j], turned[i]) + slack[j, None] + (
        off[None, i] / factors[j, None]) >= least).T
    return near


def met_before(keys: np.ndarray, table: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Pairs that an earlier table has brought together."""
    return (keys[u, :table] == keys[v, :table]).any(axis=1)


def packed_keys(keys: np.ndarray, bits: int) -> np.ndarray:
    """A row's keys of ``bits`` bits each, in whole bytes."""
    wide = (keys[:, :, None] >> np.arange(bits)) & 1
    return np.packbits(wide.reshape(len(keys), keys.shape[1] * bits).astype(np.uint8), axis=1)


def unpacked_keys(packed: np.ndarray, bits: int, tables: int) -> np.ndarray:
    wide = np.unpackbits(packed, axis=1)[:, :bits * tables].reshape(len(packed), tables, bits)
    return wide.astype(np.int64) @ (1 << np.arange(bits))


def tables_of(bits: int, least: float) -> int:
    """Tables of ``bits`` bits in which a pair at ``least`` meets with a probability of 1 - MISS."""
    same = (1 - math.acos(least) / math.pi) ** bits
    return 1 if bits == 0 else math.ceil(math.log(MISS) / math.log(1 - same))


def plan(most: int, least: float) -> tuple[int, int]:
    """Bits of a bucket and number of tables for a label of ``most`` vectors."""
    bits = max(0, math.ceil(math.log2(max(1, most) / BUCKET)))
    return bits, tables_of(bits, least)


def _coded(least: float):
    """Adds what is dealt of a vector; ``n`` counts its label's vectors."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = part.column("vector").to_pylist()
            plans = np.array([(len(v), *plan(n, least)) for v, n in zip(
                lists, part.column("n").to_pylist(), strict=True)], dtype=np.int64).reshape(len(lists), 3)
            factors, steps = np.zeros(len(lists)), np.zeros(len(lists))
            middles, known, keys = ([None] * len(lists) for _ in range(3))
            for size, bits, tables in np.unique(plans, axis=0).tolist():
                rows = np.flatnonzero((plans == [size, bits, tables]).all(axis=1))
                x = unit(np.array([lists[i] for i in rows]))
                _, factors[rows] = encode(x)
                middle, steps[rows] = coarse(x @ rotation(size, 0).T)
                key = np.zeros((len(rows), tables), dtype=np.int64)
                # every table reads the next bits; further rotations supply more of them
                for t in range(tables):
                    for bit in range(t * bits, (t + 1) * bits):
                        normal = rotation(size, 1 + bit // size)[bit % size]
                        key[:, t] = key[:, t] * 2 + (x @ normal >= 0)
                packed = packed_keys(key, bits)
                for at, i in enumerate(rows):
                    middles[i], known[i], keys[i] = middle[at].tobytes(), packed[at].tobytes(), key[at]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(plans[:, 0]), pa.array(plans[:, 1].astype(np.int32)),
                 pa.array(factors), pa.array(steps), pa.array(middles, pa.binary()),
                 pa.array(known, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=[*part.schema.names, "size", "bits", "factor", "step", "middles", "known", "keys"])

    return batches


def _bytes(column: pd.Series, kind: type) -> np.ndarray:
    """A column of equally long byte strings as rows of an array."""
    return np.frombuffer(b"".join(column), kind).reshape(len(column), len(column.iloc[0]))


def _chosen(near: np.ndarray, i: np.ndarray, j: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs marked, each once where a block meets itself."""
    if same:
        near &= j[None, :] > i[:, None]
    p, q = np.nonzero(near)
    return i[p], j[q]


def _keys(rows: pd.DataFrame, least: float) -> np.ndarray:
    """The keys of a bucket's vectors, whose label has one plan."""
    bits = int(rows["bits"].iloc[0])
    if not bits:
        return np.zeros((len(rows), 1), dtype=np.int64)
    return unpacked_keys(_bytes(rows["known"], np.uint8), bits, tables_of(bits, least))


def _screened(least: float):
    """Vectors of a bucket that have a pair to recompute, from their coarse bytes, whose sign bits
    are the codes, and factors."""

    def group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        size, table, low, high = int(key[1]), int(key[3]), int(key[4]), int(key[5])
        block, factors, steps = (rows[c].to_numpy() for c in ("block", "factor", "step"))
        middles, keys = _bytes(rows["middles"], np.int8), _keys(rows, least)
        signs, turned = middles >= 0, restored(middles, steps)
        slack = bounds(factors, size, least)
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        wanted = np.zeros(len(rows), dtype=bool)
        for a in range(0, len(left), 512):
            i = left[a:a + 512]
            u, v = _chosen(may_reach(signs, factors, slack, turned, steps, i, right, least), i, right, low == high)
            for b in range(0, len(u), 65_536):
                x, y = u[b:b + 65_536], v[b:b + 65_536]
                new = ~met_before(keys, table, x, y)
                wanted[x[new]] = wanted[y[new]] = True
        kept = rows[wanted]
        return pd.DataFrame({
            **dict(zip(["label", "size", "bucket", "table", "low", "high"], key, strict=True)),
            "place": kept["place"], "block": kept["block"]})

    return group


def _compared(least: float):
    """Links among the vectors of a bucket that were screened, from the vectors themselves."""

    def group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        table, low, high = int(key[3]), int(key[4]), int(key[5])
        rows = rows.sort_values(["block", "id"], ignore_index=True)
        block = rows["block"].to_numpy()
        x = unit(np.stack(rows["vector"].to_numpy()))
        size = x.shape[1]
        signs, factors = encode(x)
        copies, exact = rows["copies"].to_numpy(), np.zeros(len(rows))
        keys = _keys(rows, least)
        slack, turned = bounds(factors, size, least), x @ rotation(size, 0).T
        parent = np.arange(len(rows))
        count = np.zeros(len(rows), dtype=np.int64)
        left = np.flatnonzero(block == low)
        right = np.flatnonzero(block == high)
        for a in range(0, len(left), 512):
            i = left[a:a + 512]
            p, q = _chosen(may_reach(signs, factors, slack, turned, exact, i, right, least), i, right, low == high)
            for b in range(0, len(p), 65_536):
                u, v = p[b:b + 65_536], q[b:b + 65_536]
                linked = np.einsum("ij,ij->i", x[u], x[v]) >= least
                # a pair counts in the first table that brings it together
                linked &= ~met_before(keys, table, u, v)
                u, v = u[linked], v[linked]
                np.add.at(count, u, copies[v])
                np.add.at(count, v, copies[u])
                while True:  # roots of both ends, then the larger root joins the smaller
                    ru, rv = parent[u], parent[v]
                    while (parent[ru] != ru).any() or (parent[rv] != rv).any():
                        ru, rv = parent[ru], parent[rv]
                    open_ = ru != rv
                    if not open_.any():
                        break
                    np.minimum.at(parent, np.maximum(ru, rv)[open_], np.minimum(ru, rv)[open_])
        while (parent[parent] != parent).any():
            parent = parent[parent]
        hit = count > 0
        ids = rows["id"].to_numpy()
        return pd.DataFrame({"id": ids[hit], "root": ids[parent[hit]], "links": count[hit]})

    return group


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
    label: str = "label", least: float = 0.93,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per row of ``vectors``.

    Two vectors are linked if their labels are equal and not null, their sizes are equal, and
    their cosine in double precision is ``least`` or more.  Vectors that are null, empty, zero
    or hold null or non-finite components, and rows without an id, link with nothing.  Rows
    that share id, label and vector count as copies of each other; empty tables give none.

    Equal vectors are merged first and count with their number of copies.  A vector is dealt
    into one bucket per table by the signs of a few random projections; the number of bits
    follows the size of its label, the number of tables makes a pair at ``least`` meet with a
    probability of 1 - MISS (closer pairs more surely).  In a bucket, one-bit codes of rotated
    vectors with their correction factors estimate all inner products without bias, and only
    pairs whose confidence bounds, from both ends, reach ``least`` are recomputed from the
    vectors.  What is dealt once per table is a vector's factor, keys and its rotated components
    in a byte each, whose sign bits are the code and whose rounding widens the bounds; full vectors
    follow only to the buckets where they have a pair to recompute.  Large buckets are split into
    blocks that meet pairwise in tasks of their own.  Tasks return numbers of links and one local
    root per vector, never pairs.
    """
    finite = F.forall(F.col(embedding), lambda v: v.isNotNull() & ~F.isnan(v) & (
        F.abs(v) < float("inf")))
    usable = F.coalesce(
        F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(embedding).isNotNull()
        & (F.size(embedding) > 0) & finite & F.exists(F.col(embedding), lambda v: v != 0),
        F.lit(False))
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(label).alias("label"),
                          F.col(embedding).alias("vector"), usable.alias("usable"))
    classes = staged(rows.where("usable").groupBy("label", "vector").agg(
        F.min("id").alias("id"), F.count("*").alias("copies")
    ).select("label", "id", "copies", "vector", F.monotonically_increasing_id().alias("place")), "vectors")
    kinds = dict(classes.dtypes)
    # a label of few vectors has few tables; one that stands alone meets nothing
    labels = staged(classes.groupBy("label").agg(F.count("*").alias("n")).where("n > 1"), "labels")
    counted = classes.join(small(labels), "label").select(*classes.columns, "n")
    shape = ", ".join(f"{name} {kind}" for name, kind in counted.dtypes)
    coded = staged(counted.mapInArrow(
        _coded(least), f"{shape}, size bigint, bits int, factor double, step double, middles binary, "
        "known binary, keys array<bigint>"), "codes")
    met = ["label", "size", "bucket", "table", "low", "high"]
    dealt = coded.select("label", "size", "place", "bits", "factor", "step", "middles", "known",
                         F.posexplode("keys").alias("table", "bucket"))
    crowded = staged(dealt.groupBy("label", "size", "table", "bucket").count().where(
        F.col("count") > BLOCK).select(
        "label", "size", "table", "bucket", F.ceil(F.col("count") / BLOCK).alias("blocks")), "crowded")
    blocks = dealt.join(small(crowded), ["label", "size", "table", "bucket"], "left").fillna(1, "blocks")
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("place"), F.col("blocks")))
    meets = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1),
        lambda other: F.struct(F.least("block", other).alias("low"),
                               F.greatest("block", other).alias("high")))
    blocks = blocks.withColumn("meet", F.explode(meets)).select(
        "*", F.col("meet.low").alias("low"), F.col("meet.high").alias("high")).drop("meet", "blocks")
    # dealt by all six columns, or a crowded bucket's blocks would stay in one task
    screened = staged(blocks.repartition(*met).groupBy(*met).applyInPandas(
        _screened(least), f"label {kinds['label']}, size bigint, bucket bigint, table int, "
        "low bigint, high bigint, place bigint, block bigint"), "screened")
    full = coded.select("place", "id", "copies", "vector", "bits", "known")
    found = staged(screened.join(full, "place").repartition(*met).groupBy(*met).applyInPandas(
        _compared(least), f"id {kinds['id']}, root {kinds['id']}, links bigint"), "links")
    parts = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.join(links, "id", "left").join(parts, "id", "left").select(
        "label", "vector", F.col("id").alias("first"), F.lit(True).alias("usable"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"))
    named = rows.join(known, ["label", "vector", "usable"], "left")
    return named.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
