"""Rules on whole messages: error placeholders, envelopes, ticks and request parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prefix of an error document, ticks per fetched id, and the refresh parameter.
ERROR_PREFIX = '{"errors":'
TICKS_PER_ID = 10
REFRESH_KEY = "refresh"


def is_due(tick: Column) -> Column:
    return tick % TICKS_PER_ID == 0


def tick_id(tick: Column) -> Column:
    """Id a non-negative tick belongs to."""
    return F.call_function("div", tick, F.lit(TICKS_PER_ID)).cast("int")


def due_or_error(tick: Column, document: Column) -> Column:
    """The document on a due tick, the error placeholder on any other."""
    return F.when(is_due(tick), document).otherwise(F.lit(ERROR_PREFIX))


def is_error(document: Column) -> Column:
    return document.startswith(ERROR_PREFIX)


def any_good(first: Column, second: Column) -> Column:
    return ~is_error(first) | ~is_error(second)


def list_envelope(anime: Column, manga: Column) -> Column:
    """One list document from its two branches; null if either is null."""
    return F.concat(F.lit('{"anime":'), anime, F.lit(',"manga": '), manga, F.lit("}"))


def _keys(params: Column) -> Column:
    """Top-level keys; null unless the text is a JSON object."""
    return F.json_object_keys(params)


def is_parameter_object(params: Column) -> Column:
    return F.coalesce(F.try_parse_json(params).isNotNull() & _keys(params).isNotNull(), F.lit(False))


def wants_refresh(params: Column) -> Column:
    """True only for the JSON string "true" under the refresh key, not for a boolean."""
    value = F.try_variant_get(F.try_parse_json(params), f"$.{REFRESH_KEY}", "variant")
    is_text = F.schema_of_variant(value) == "STRING"
    return F.coalesce(is_text & (F.try_variant_get(value, "$", "string") == "true"), F.lit(False))


def other_parameters(params: Column) -> Column:
    """How many keys there are besides the refresh key."""
    return F.size(F.array_except(_keys(params), F.array(F.lit(REFRESH_KEY))))
