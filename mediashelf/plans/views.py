"""Stored relations by natural keys instead of surrogates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediashelf.operators import lookups
from mediashelf.sources.tables import Store


def _by_media(store: Store, rows: DataFrame) -> DataFrame:
    ids = store.read("media").select("media_id", "ext_media_id")
    return lookups.lookup_join(rows, ids, ["media_id"]).drop("media_id")


def genres(store: Store) -> DataFrame:
    return _by_media(store, lookups.media_genres(store.read("genre_link"), store.read("name")))


def tags(store: Store) -> DataFrame:
    rows = lookups.media_tags(store.read("tag_link"), store.read("tag"), store.read("name"))
    return _by_media(store, rows)


def studios(store: Store) -> DataFrame:
    return _by_media(store, lookups.media_studios(store.read("studio_link"), store.read("studio")))


def staff(store: Store) -> DataFrame:
    return _by_media(store, lookups.media_staff(store.read("staff_link"), store.read("staff")))


def names(store: Store) -> DataFrame:
    return _by_media(store, lookups.media_names(store.read("media_name"), store.read("name")))


def media(store: Store) -> DataFrame:
    rows, name = store.read("media"), store.read("name")
    for kind, id_column, column in [
        ("format", "format_id", "format"), ("source", "source_id", "source"),
        ("status", "status_id", "status"), ("mediatype", "media_type_id", "media_type"),
    ]:
        rows = lookups.lookup_join(
            rows, lookups.names_of(name, kind, id_column, column), [id_column]).drop(id_column)
    return rows.drop("media_id")


def list_entries(store: Store) -> DataFrame:
    viewers = store.read("viewer")
    status = lookups.names_of(store.read("name"), "watchstatus", "status_id", "status")
    rows = lookups.lookup_join(store.read("list_entry"), viewers, ["viewer_id"])
    rows = lookups.lookup_join(rows, status, ["status_id"]).drop("viewer_id", "status_id")
    return _by_media(store, rows)


def relations(store: Store) -> DataFrame:
    """All five media relations in one long table of text columns."""

    def long(frame: DataFrame, relation: str, key, detail) -> DataFrame:
        return frame.select(
            "ext_media_id", F.lit(relation).alias("relation"),
            key.cast("string").alias("item"), detail.cast("string").alias("detail"))

    col = F.col
    return (
        long(genres(store), "genre", col("genre"), F.lit(""))
        .unionByName(long(tags(store), "tag", col("ext_tag_id"),
                          F.concat_ws("|", "name", "category")))
        .unionByName(long(studios(store), "studio", col("ext_studio_id"),
                          F.concat_ws("|", "name", col("is_main").cast("string"))))
        .unionByName(long(staff(store), "staff", F.concat_ws("|", "ext_staff_id", "role"),
                          F.concat_ws("|", "first_name", "last_name", "full_name", "native_name")))
        .unionByName(long(names(store), "name", col("name"), col("name_type")))
    )
