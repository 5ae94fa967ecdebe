"""Chat formatting by perspective rotation: one rendering of a dialogue for every participant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediashelf.llm.common import staged

BLOCK_TURNS = 64  # turns rendered into one row; longer dialogues go on in numbered parts


def rotate(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role",
    text: str = "text", narrators: tuple[str, ...] = ("system",),
) -> DataFrame:
    """``conv_id, perspective, part, n_turns, n_own, start, rendered, mask_starts, mask_ends``.

    Every participant of a dialogue (every distinct speaker but the ``narrators``) gets it
    rendered with itself as assistant, the others as users that carry their names, and
    narrators as system turns:

        <|assistant|>\\ntext<|end|>\\n    <|user:name|>\\ntext<|end|>\\n    <|system|>\\ntext<|end|>\\n

    The mask holds the character ranges that a loss counts: the text and ``<|end|>`` of the
    assistant's turns, as offsets into ``rendered``.  A part holds BLOCK_TURNS turns at most and
    ``start`` is its place in the whole rendering, so the parts in their order are the dialogue,
    whatever its length; a dialogue of BLOCK_TURNS turns or fewer has one part, 0.

    Turns stand in the order of ``turn`` (null first), then speaker, then text; equal rows are
    kept.  Null texts count as empty, null speakers as the name ``""``; rows with a null
    ``conv`` form a dialogue.  A ``<|`` inside a text or a name is written ``< |``, so that no
    text can end a turn.  Dialogues of narrators alone, and empty tables, give no rows.

    Ranks in a dialogue come from counts of coarse blocks of turn numbers, so that not even one
    dialogue with most of the rows is ordered in one task, unless all its turns share a number.
    """
    plain = lambda c: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"<\|", "< |")
    rows = turns.select(
        F.col(conv).alias("c"), F.col(turn).alias("t"), plain(F.col(speaker)).alias("s"),
        plain(F.col(text)).alias("x"))
    rows = rows.withColumn("coarse", F.floor(F.col("t") / BLOCK_TURNS))
    counts = rows.groupBy("c", "coarse").agg(F.count("*").alias("n"))
    before = Window.partitionBy("c").orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("skipped", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy("c", "coarse").orderBy("t", "s", "x")
    ranked = rows.join(counts.select(F.col("c").alias("c2"), F.col("coarse").alias("coarse2"), "skipped"),
                       rows["c"].eqNullSafe(F.col("c2")) & rows["coarse"].eqNullSafe(F.col("coarse2")))
    ranked = ranked.withColumn("rank", F.row_number().over(inside) + F.col("skipped") - 1)
    ranked = staged(ranked.select("c", "s", "x", "rank", F.floor(
        F.col("rank") / BLOCK_TURNS).cast("int").alias("part")), "turns")
    # where a part starts follows from counts and lengths alone; the texts stay where they are
    narrator = lambda s: s.isin(*narrators)
    as_other = F.when(narrator(F.col("s")), F.length(F.lit("<|system|>\n"))).otherwise(
        F.length("s") + F.length(F.lit("<|user:|>\n")))
    sizes = ranked.groupBy("c", "part", "s").agg(
        F.count("*").alias("own"),
        F.sum(F.length("x") + F.length(F.lit("<|end|>\n")) + as_other).alias("long"))
    whole = sizes.groupBy("c", "part").agg(F.sum("long").alias("long"))
    people = ranked.where(~F.col("s").isin(*narrators)).select(
        F.col("c").alias("c2"), F.col("s").alias("perspective")).distinct()
    own = sizes.select(F.col("c").alias("c3"), F.col("part").alias("part3"), "s", "own")
    frames = whole.join(people, F.col("c").eqNullSafe(F.col("c2"))).join(
        own, F.col("c").eqNullSafe(F.col("c3")) & (F.col("part") == F.col("part3"))
        & (F.col("perspective") == F.col("s")), "left")
    shorter = F.length("perspective") + F.length(F.lit("<|user:|>\n")) - F.length(
        F.lit("<|assistant|>\n"))
    onward = Window.partitionBy("c", "perspective").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    frames = frames.withColumn("length", F.col("long") - F.coalesce("own", F.lit(0)) * shorter)
    frames = frames.select(
        F.col("c").alias("c2"), F.col("part").alias("part2"), "perspective",
        F.coalesce(F.sum("length").over(onward), F.lit(0)).cast("bigint").alias("start"))
    spoken = ranked.groupBy("c", "part").agg(F.sort_array(F.collect_list(
        F.struct("rank", "s", "x"))).alias("turns"))  # at most BLOCK_TURNS of them
    head = lambda p: lambda v: F.when(narrator(v["s"]), F.lit("<|system|>\n")).when(
        v["s"] == p, F.lit("<|assistant|>\n")).otherwise(
            F.concat(F.lit("<|user:"), v["s"], F.lit("|>\n")))
    p = F.col("perspective")
    said = F.transform("turns", lambda v: F.struct(
        head(p)(v).alias("head"), F.concat(v["x"], F.lit("<|end|>")).alias("body"),
        (v["s"] == p).alias("own")))
    parts = spoken.join(
        frames, spoken["c"].eqNullSafe(F.col("c2")) & (F.col("part") == F.col("part2"))
    ).withColumn("said", said)
    piece = lambda v: F.length(v["head"]) + F.length(v["body"]) + 1
    # running places of the bodies, and at the end the length of the part
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("a"),
                    F.array().cast("array<int>").alias("b"))
    places = F.aggregate("said", zero, lambda acc, v: F.struct(
        (acc["at"] + piece(v)).alias("at"),
        F.when(v["own"], F.array_append(acc["a"], acc["at"] + F.length(v["head"])))
        .otherwise(acc["a"]).alias("a"),
        F.when(v["own"], F.array_append(
            acc["b"], acc["at"] + F.length(v["head"]) + F.length(v["body"])))
        .otherwise(acc["b"]).alias("b")))
    return parts.withColumn("places", places).select(
        F.col("c").alias("conv_id"), "perspective", "part", F.size("turns").alias("n_turns"),
        F.size("places.a").alias("n_own"), "start",
        F.array_join(F.transform("said", lambda v: F.concat(v["head"], v["body"], F.lit("\n"))), ""
                     ).alias("rendered"),
        F.col("places.a").alias("mask_starts"), F.col("places.b").alias("mask_ends"))
