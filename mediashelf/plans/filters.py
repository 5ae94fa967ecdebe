"""Filters on results: typed request parameters, sets of names and spans of dates."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediashelf.functions.messages import REFRESH_KEY

# The parameters that filter results.  Of a set either any or all names must hold.
ANY_OF = ("format", "mediatype")
ALL_OF = ("genres", "tags")
DATES = {  # the date that is looked at, and on which side of the given day it must lie
    "startedAfter": ("date_start", "after"), "startedBefore": ("date_start", "before"),
    "endedAfter": ("date_end", "after"), "endedBefore": ("date_end", "before"),
}
ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def _texts(value: Column, kind: Column) -> Column:
    """A text, or a list of nothing but texts, as an array; else null."""
    items = F.try_variant_get(value, "$", "array<variant>")
    listed = F.when(F.forall(items, lambda v: F.schema_of_variant(v) == "STRING"),
                    F.transform(items, lambda v: F.try_variant_get(v, "$", "string")))
    return F.when(kind == "STRING", F.array(F.try_variant_get(value, "$", "string"))).when(
        kind.startswith("ARRAY<"), listed)


def typed_parameters(requests: DataFrame, request: str = "request_id", params: str = "params") -> DataFrame:
    """``request, key, name, day, reason``: one row per name of a set, per date, and per parameter
    that is turned down, with the reason.

    Parameters are one JSON object.  Sets are a text or a list of texts, dates are texts like
    2024-02-29.  What is no object or has a key twice is ``malformed`` (the key is null then);
    unknown keys, nulls, empty lists and values of another type are turned down one by one.  The
    refresh parameter filters nothing.  A name given twice counts once.
    """
    parsed = requests.select(F.col(request).alias("request"), F.try_parse_json(params).alias("_object"))
    is_object = F.coalesce(F.schema_of_variant("_object").startswith("OBJECT<"), F.lit(False))
    bad = parsed.where(~is_object).select(
        "request", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("date").alias("day"), F.lit("malformed").alias("reason"))
    tvf = requests.sparkSession.tvf
    members = parsed.where(is_object).lateralJoin(tvf.variant_explode(F.col("_object").outer())).where(
        F.col("key") != REFRESH_KEY).select("request", "key", "value", F.schema_of_variant("value").alias("kind"))
    names, text = _texts(F.col("value"), F.col("kind")), F.try_variant_get("value", "$", "string")
    is_set, is_date = F.col("key").isin(*ANY_OF, *ALL_OF), F.col("key").isin(*DATES)
    day = F.when(is_date & (F.col("kind") == "STRING") & text.rlike(ISO), F.try_to_date(text))
    reason = (
        F.when(~is_set & ~is_date, "unknown").when(F.col("kind") == "VOID", "null")
        .when(is_date & day.isNull(), "no date").when(is_set & names.isNull(), "no names")
        .when(is_set & (F.size(names) == 0), "empty"))
    rows = members.select("request", "key", reason.alias("reason"), day.alias("day"), F.explode(
        F.when(reason.isNull() & is_set, F.array_distinct(names)).otherwise(
            F.array(F.lit(None).cast("string")))).alias("name"))
    return rows.select("request", "key", "name", F.when(F.col("reason").isNull(), F.col("day")).alias("day"), "reason").unionByName(bad)


def turned_down(parameters: DataFrame) -> DataFrame:
    """Requests with a parameter that was turned down."""
    return parameters.where("reason IS NOT NULL").select("request").distinct()


def _wanted(parameters: DataFrame) -> DataFrame:
    """One row per request with parameters: whether one was turned down, ``names`` and a day per date."""
    good = F.col("reason").isNull()
    ends = [
        (F.max if side == "after" else F.min)(F.when(good & (F.col("key") == key), F.col("day"))).alias(key)
        for key, (_, side) in DATES.items()]
    return parameters.groupBy("request").agg(
        F.bool_or(~good).alias("bad"),
        F.collect_set(F.when(good & F.col("name").isNotNull(), F.struct("key", "name"))).alias("wanted"), *ends)


def _passes() -> Column:
    """How many of a media's spans, of one that has the names, a request's parameters let pass."""
    def held(pair: Column) -> Column:
        return F.exists("held", lambda x: (x["key"] == pair["key"]) & (x["name"] == pair["name"]))

    def any_of(key: str) -> Column:
        return ~F.exists("wanted", lambda x: x["key"] == key) | F.exists(
            "wanted", lambda x: (x["key"] == key) & held(x))

    named = reduce(and_, map(any_of, ANY_OF), F.forall("wanted", lambda x: x["key"].isin(*ANY_OF) | held(x)))

    def inside(span: Column) -> Column:
        holds = F.lit(True)
        for key, (column, side) in DATES.items():
            fits = span[column] > F.col(key) if side == "after" else span[column] < F.col(key)
            holds = holds & (F.col(key).isNull() | F.coalesce(fits, F.lit(False)))
        return holds

    return F.when(F.col("wanted").isNull() | named, F.size(F.filter("spans", inside))).otherwise(0)


def filtered(
    candidates: DataFrame, parameters: DataFrame, names: DataFrame, media: DataFrame,
    stored: DataFrame | None = None, by: str | None = None,
) -> DataFrame:
    """The ``request, media_id`` candidates that all parameters of their request let pass.

    ``names`` holds ``media_id, key, name`` (what a media has), ``media`` holds ``media_id,
    date_start, date_end``, one row each; both ends of a span are open.  Requests with a parameter
    turned down keep nothing, those without parameters keep all.  With ``stored`` (``by, media_id``),
    ``candidates`` are ``request, by``: every request's candidates are the media stored for its ``by``.

    One name that a request asks for under a key is enough for some keys, others need all.  What a
    request asks for comes as one row, and so does what a media has.  Both are joined to the sides of
    the candidates, so that requests with ``stored`` are judged where they meet their media and only
    pairs that pass are shuffled.
    """
    held = names.dropna(subset=["key", "name"]).groupBy("media_id").agg(
        F.collect_set(F.struct("key", "name")).alias("held"))
    spans = media.groupBy("media_id").agg(F.collect_list(F.struct("date_start", "date_end")).alias("spans"))
    # files say little of the size of either, so neither may be broadcast
    has = held.join(spans, "media_id", "full_outer").hint("merge")
    wanted = _wanted(parameters).hint("merge")

    def asked(rows: DataFrame) -> DataFrame:
        return rows.join(wanted, "request", "left").where(~F.coalesce("bad", F.lit(False)))

    if stored is None:
        met = asked(candidates.select("request", "media_id").distinct()).join(has, "media_id", "left")
    else:
        met = asked(candidates.select("request", by)).join(
            stored.select(by, "media_id").join(has, "media_id", "left"), by)
    nothing = F.array(F.struct(F.lit(None).cast("date").alias("date_start"), F.lit(None).cast("date").alias("date_end")))
    met = met.withColumns({
        "held": F.coalesce("held", F.array().cast("array<struct<key:string,name:string>>")),
        "spans": F.coalesce("spans", nothing)})
    kept = met.select("request", "media_id", _passes().alias("n")).where("n > 0").distinct()
    return kept.select("request", "media_id", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("_n")).drop("_n")
