"""Request documents for ids or names, and fetching them with a function the user supplies.

The fields asked for are generated from the document schema, so a request always matches
what the parser reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediashelf.functions.messages import any_good, due_or_error, is_error, list_envelope, tick_id
from mediashelf.schemas import ENTRY_FIELDS, MEDIA_FIELDS, requested

# The two list types a viewer has.
LIST_TYPES = ("ANIME", "MANGA")


# What is asked for of an entry's media, which is read as a whole.
INNER = {"media": "{ id type }"}


def _selection(fields: T.StructType) -> str:
    """A selection set that asks for every field of a schema."""
    parts = []
    for field in fields:
        inner = field.dataType
        if isinstance(inner, T.ArrayType):
            inner = inner.elementType
        nested = " " + _selection(inner) if isinstance(inner, T.StructType) else ""
        if isinstance(inner, T.VariantType) and field.name in INNER:
            nested = " " + INNER[field.name]
        parts.append(field.name + nested)
    return "{ " + " ".join(parts) + " }"


def media_query() -> str:
    fields = _selection(T.StructType.fromDDL(requested(MEDIA_FIELDS)))
    return f"query ($id: Int) {{ Media(id: $id, id_not: 0) {fields} }}"


def list_query(list_type: str) -> str:
    if list_type not in LIST_TYPES:
        raise ValueError(f"unknown list type {list_type}")
    entries = _selection(T.StructType.fromDDL(requested(ENTRY_FIELDS)))
    return (
        "query ($userId: Int) { MediaListCollection(userId: $userId, type: "
        f"{list_type}) {{ lists {{ entries {entries} }} }} }}"
    )


def user_query() -> str:
    return "query ($name: String) { User(name: $name) { id } }"


def _body(query: str, variable: str, value: Column) -> Column:
    return F.to_json(F.struct(
        F.lit(query).alias("query"), F.struct(value.alias(variable)).alias("variables")))


def media_request(ext_media_id: Column) -> Column:
    return _body(media_query(), "id", ext_media_id)


def list_request(ext_user_id: Column, list_type: str) -> Column:
    return _body(list_query(list_type), "userId", ext_user_id)


def user_request(name: Column) -> Column:
    return _body(user_query(), "name", name)


Fetch = Callable[[list], list]


def fetch_documents(ids: DataFrame, **fetches: Fetch) -> DataFrame:
    """Adds one text column per function, each called with the ids of an Arrow batch.

    The functions run in the tasks; the ids' partitioning is the degree of parallel fetching.
    """
    schema = T.StructType([ids.schema["id"], *[T.StructField(n, T.StringType()) for n in fetches]])

    def fetch_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch["id"].tolist()
            yield pd.DataFrame({"id": batch["id"], **{n: f(keys) for n, f in fetches.items()}})

    return ids.select("id").mapInPandas(fetch_batches, schema)


def from_table(documents: DataFrame, *columns: str) -> Callable[[DataFrame], DataFrame]:
    """A fetch step backed by a table of ``id`` and document columns instead of calls."""
    return lambda ids: ids.join(documents.select("id", *columns), "id", "left")


def media_messages(fetched: DataFrame) -> DataFrame:
    """Fetched ``id, data`` rows without error documents, as topic rows."""
    return fetched.filter(~is_error(F.col("data"))).select(
        F.col("id").cast("bigint").alias("seq"), F.col("data").alias("value"))


def list_messages(fetched: DataFrame) -> DataFrame:
    """Fetched ``id, anime, manga`` rows with at least one good side, in one envelope each."""
    anime, manga = F.col("anime"), F.col("manga")
    return fetched.filter(any_good(anime, manga)).select(
        F.col("id").cast("bigint").alias("seq"), list_envelope(anime, manga).alias("value"))


def ticked(ticks: DataFrame, document: Column) -> DataFrame:
    """Ticks as ``id, data``: the document on due ticks, the error placeholder on others."""
    value = F.col("value")
    return ticks.select(tick_id(value).alias("id"), due_or_error(value, document).alias("data"))
