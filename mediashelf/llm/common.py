"""What several operators share: staging, document bytes, size-checked broadcasts, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from mediashelf.session import written

BATCH_ROWS = 1_000
BROADCAST_ROWS = 20_000  # a side is broadcast only if it was counted at no more rows than this


def staged(frame: DataFrame, label: str, rows: int = BATCH_ROWS) -> DataFrame:
    """``frame`` written once to the shared folder and read back, so that lost tasks re-read it.

    Texts and sets make wide rows, so Python workers get BATCH_ROWS of them at a time, or ``rows``.
    """
    conf, key = frame.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = conf.get(key)
    conf.set(key, str(min(int(usual), rows) if int(usual) > 0 else rows))
    try:
        return written(frame, label)
    finally:
        conf.set(key, usual)


def small(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``frame`` marked for broadcast if it is counted at ``rows`` rows or fewer, else as it is."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def lower_ascii(column):
    """A-Z lower-cased and nothing else; null stays null."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(column, parts: int):
    """crc32 of the id as text, modulo ``parts``; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def text_digest(column):
    """What a text is known by, as it is; null stays null."""
    return F.unhex(F.md5(column.cast("binary")))


def without_rows(docs: DataFrame, doc_id: str, text: str, gone: DataFrame, again: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``gone`` names by id and digest of the text, and with one only
    of the rows that ``again`` names; null ids and digests are names like others."""
    gone, again = staged(gone, "gone"), staged(again, "again")

    def same(rows: DataFrame, names: DataFrame):
        return rows[doc_id].eqNullSafe(names["id"]) & text_digest(rows[text]).eqNullSafe(names["digest"])

    left = docs.join(gone, same(docs, gone), "left_anti")
    if again.isEmpty():
        return left
    left = staged(left, "left")
    named = left.join(again, same(left, again), "left_semi")
    one = named.withColumn("_digest_of_text", text_digest(F.col(text))).dropDuplicates([doc_id, "_digest_of_text"])
    return left.join(again, same(left, again), "left_anti").unionByName(one.drop("_digest_of_text"))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every id on an edge: the smallest id reachable from it.

    Alternates the large-star and small-star steps on edge tables: every round links each
    vertex to the smallest of its neighbourhood, and ends when a round changes nothing.
    Minima are taken by partial aggregation and joined back, so a vertex with very many
    neighbours is never gathered in one place.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    links = staged(links.where("u <> v").distinct(), "links")
    before = None
    for _ in range(rounds):
        # large star: every larger neighbour of x points to the smallest of x's neighbourhood
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = staged(large.where("u <> v"), "links")
        # small star: the neighbours below x, and x itself, point to the smallest of them
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = (
            large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(below.select("u", F.col("m").alias("v")))
        )
        seen = Observation()
        links = staged(small_star.where("u <> v").distinct().observe(
            seen, F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark")), "links")
        if seen.get == before:
            break
        before = seen.get
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    members = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.unionByName(
        links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
