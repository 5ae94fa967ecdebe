"""Mixing sources to target weights over a domain-language-source tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediashelf.llm.common import small, staged

LEVELS = ("domain", "language", "source")
SLICE_ROWS = 1_000  # rows of one leaf ordered together; a leaf of more rows has more slices


def key_of(seed: int, epoch: int, doc_id):
    """The place of a document in an epoch's seeded order, as 32 hexadecimal digits."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.lit(epoch),
                             F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def budgets(leaves: DataFrame, total, max_epochs: int) -> DataFrame:
    """Token budgets per leaf.

    ``leaves`` holds ``domain, language, source, tokens`` and integer weights ``w_domain,
    w_language, w_source`` of each node among its siblings.  A node's budget goes to its
    children in proportion to their weights, but no child gets more than its subtree can give
    (``tokens * max_epochs``); what a child cannot use goes to its siblings, and only what no
    sibling can use goes back to the ancestors' siblings.  Shares are whole tokens, rounded
    down.  Children of weight 0 get nothing.
    """
    dec = "decimal(38,0)"
    nodes = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast(dec))
    parents: list[str] = []
    budget = None
    for level in LEVELS:
        weight = f"w_{level}"
        children = nodes.where(F.col(weight) > 0).groupBy(*parents, level).agg(
            F.sum("cap").cast(dec).alias("cap"), F.max(weight).cast(dec).alias("w"))
        if budget is None:
            children = children.withColumn("budget", total.cast(dec))
        else:
            children = children.join(budget, parents)
        # children that run short come first: those with the least capacity per weight
        order = Window.partitionBy(*(parents or [F.lit(0)])).orderBy(
            (F.col("cap").cast("double") / F.col("w").cast("double")), level)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        shares = children.withColumns({
            "left": (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast(dec),
            "w_left": F.sum("w").over(onward).cast(dec),
        })
        full = F.col("cap") * F.col("w_left") <= F.col("left") * F.col("w")
        shares = shares.withColumn("full", full)
        # the first child that is not short fixes the level for all that follow it
        first = F.min(F.when(~F.col("full"), F.struct(
            (F.col("cap").cast("double") / F.col("w").cast("double")).alias("r"),
            F.col(level).alias("n"), "left", "w_left"))).over(
                Window.partitionBy(*(parents or [F.lit(0)])))
        shares = shares.withColumn("level", first)
        got = F.when(F.col("full"), F.col("cap")).otherwise(
            F.least("cap", F.expr("w * level.left div level.w_left").cast(dec)))
        parents = [*parents, level]
        budget = shares.select(*parents, got.cast(dec).alias("budget"))
    return budget


def mix(
    docs: DataFrame, weights: dict, total_share: tuple[int, int], tokens, domain, language,
    source, doc_id: str = "doc_id", seed: int = 0, max_epochs: int = 2,
) -> DataFrame:
    """``docs`` with ``mix_epoch`` and ``mix_tokens``: one row per time a document is taken.

    ``tokens``, ``domain``, ``language``, ``source`` are column expressions; null names count as
    the name ``""`` and null token counts as 0.  ``weights[level]`` maps names to integer
    weights, ``None`` being the weight of names not listed.  The total is the corpus' tokens
    times ``total_share`` (a fraction).  A leaf whose budget holds its documents k times over
    takes each k times (epochs 1 to k), and of the next epoch the longest prefix, in that
    epoch's seeded order, whose tokens fit into the rest; documents with the same id stand at
    the same place and are taken together or not at all.

    Only ``(leaf, key, tokens)`` is shuffled.  A leaf's order is cut into slices by key, so
    that running totals are taken over slice totals and then within the one slice in which the
    budget ends.  The texts stay where they are: each document compares its key with the
    leaf's last key.  Empty tables give an empty result.
    """
    leaf = list(LEVELS)
    blank = F.lit("")
    named = docs.withColumns({
        "mix_domain": F.coalesce(domain.cast("string"), blank),
        "mix_language": F.coalesce(language.cast("string"), blank),
        "mix_source": F.coalesce(source.cast("string"), blank),
        "mix_tokens": F.coalesce(tokens.cast("bigint"), F.lit(0).cast("bigint")),
    })
    rows = staged(named.select(
        *[F.col(f"mix_{n}").alias(n) for n in LEVELS], F.col(doc_id).alias("id"),
        F.col("mix_tokens").alias("tokens")), "mix-rows")
    leaves = rows.groupBy(*leaf).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    for level in LEVELS:
        table = weights.get(level, {})
        other = F.lit(table.get(None, 0))
        chosen = other
        for name, w in table.items():
            if name is not None:
                chosen = F.when(F.col(level) == name, F.lit(w)).otherwise(chosen)
        leaves = leaves.withColumn(f"w_{level}", chosen)
    leaves = staged(leaves, "mix-leaves")
    up, down = total_share
    # worked out here: as a literal the sum may be a 32-bit integer, which its share's product need not fit
    total = F.lit((leaves.agg(F.sum("tokens")).first()[0] or 0) * up // down)
    plan = leaves.join(
        budgets(leaves, total, max_epochs), leaf, "left"
    ).select(
        *leaf, "n", "tokens", F.coalesce(F.col("budget").cast("bigint"), F.lit(0)).alias("budget")
    ).withColumn(
        "whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).cast("int")
    ).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    plan = staged(plan.withColumn(
        "slices", F.ceil(F.col("n") / SLICE_ROWS).cast("bigint")), "mix-plan")
    # running totals of the epoch that is taken in part: over slices, then inside one slice
    next_key = F.lit(None).cast("string")
    for epoch in range(1, max_epochs + 1):
        next_key = F.when(F.col("whole") + 1 == epoch, key_of(seed, epoch, F.col("id"))
                          ).otherwise(next_key)
    slice_of = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint")
                       * F.col("slices") / F.lit(1 << 32))
    part = (
        rows.join(small(plan.where("rest > 0").select(*leaf, "whole", "rest", "slices")), leaf)
        .withColumn("key", next_key).withColumn("slice", slice_of)
    )
    totals = part.groupBy(*leaf, "rest", "slice").agg(F.sum("tokens").alias("slice_tokens"))
    upto = Window.partitionBy(*leaf).orderBy("slice").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    totals = totals.withColumn("done", F.sum("slice_tokens").over(upto))
    ends = totals.where("done > rest").groupBy(*leaf).agg(
        F.min(F.struct("slice", (F.col("done") - F.col("slice_tokens")).alias("before"))
              ).alias("end")).select(*leaf, F.col("end.slice").alias("slice"), "end.before")
    # a leaf whose rest holds a slice's start but no document of it ends just below that slice
    inside = part.join(small(ends), [*leaf, "slice"]).groupBy(
        *leaf, "slice", "before", "rest", "key").agg(F.sum("tokens").alias("tokens"))
    running = Window.partitionBy(*leaf, "slice").orderBy("key")
    inside = inside.withColumn("done", F.col("before") + F.sum("tokens").over(running))
    stops = staged(inside.where("done > rest").groupBy(*leaf).agg(F.min("key").alias("stop")),
                   "mix-stops")
    plan = staged(plan.join(stops, leaf, "left").select(
        *[F.col(n).alias(f"mix_{n}") for n in LEVELS], F.col("whole").alias("mix_whole"),
        F.col("rest").alias("mix_rest"), F.col("stop").alias("mix_stop")), "mix-leaf-plan")
    out = named.join(small(plan), [f"mix_{n}" for n in LEVELS])
    key = F.lit(None).cast("string")
    for epoch in range(1, max_epochs + 1):
        key = F.when(F.col("mix_whole") + 1 == epoch, key_of(seed, epoch, F.col(doc_id))
                     ).otherwise(key)
    partly = (F.col("mix_rest") > 0) & (F.col("mix_stop").isNull() | (key < F.col("mix_stop")))
    times = F.col("mix_whole") + F.when(partly, 1).otherwise(0)
    epochs = F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(
        F.array().cast("array<int>"))
    out = out.withColumn("mix_epoch", F.explode(epochs))
    return out.select(*docs.columns, "mix_domain", "mix_epoch", "mix_tokens")
