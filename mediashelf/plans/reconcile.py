"""Bringing the stored tables in line with a batch of documents.

Documents are parsed once into a written table, from which every later step reads only the
columns it needs.  Steps that do not depend on each other are submitted together.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediashelf.operators import documents as docs_op
from mediashelf.operators import flatten
from mediashelf.operators.diff import after_diff, changes, two_way_diff
from mediashelf.operators.dimensions import absent, first_seen, last_seen, overwrite
from mediashelf.operators.keys import assign_keys
from mediashelf.operators.lookups import lookup_join, missing_keys, names_of, plain_bytes
from mediashelf.schemas import TABLES
from mediashelf.sources.requests import media_messages
from mediashelf.sources.tables import Batch, Store

MEDIA_STREAM, LIST_STREAM = "media", "lists"
ENTRY_ATTRIBUTES = ["date_start", "date_end", "score", "status_id"]
STAFF_NAMES = ["first_name", "last_name", "full_name", "native_name"]


def _together(batch: Batch, *steps: Callable[[], None]) -> None:
    """Runs independent steps at the same time; the first failure is raised."""
    target = inheritable_thread_target(batch.spark)
    with ThreadPoolExecutor(len(steps)) as pool:
        for done in [pool.submit(target(step)) for step in steps]:
            done.result()


def _applied(store: Store, stream: str, batch_id: int | None, work: Callable[[Batch], None]) -> bool:
    """Applies one batch; false if it was applied before.

    A batch that fails is done again from the start: every step leaves what it finds done.
    """
    with store.turn():
        if batch_id is not None and store.last_batch(stream) >= batch_id:
            return False
        batch = Batch(store)
        try:
            work(batch)
        finally:
            batch.drop_stage()
        if batch_id is not None:
            store.batch_applied(stream, batch_id)
        return True


def _against(batch: Batch, name: str, incoming: DataFrame) -> tuple[DataFrame, list[int]]:
    """Incoming rows, written once, and the buckets of a table that they fall in."""
    incoming = batch.stage(incoming, f"incoming-{name}")
    return incoming, batch.touched(name, incoming)


def _absent(batch: Batch, name: str, incoming: DataFrame, key: list[str]) -> DataFrame:
    incoming, buckets = _against(batch, name, incoming)
    return batch.stage(absent(incoming, batch.read(name, buckets), key), f"new-{name}")


def _insert_absent(batch: Batch, name: str, incoming: DataFrame, key: list[str]) -> None:
    """Appends rows whose key is not stored, with new surrogate keys."""
    table = TABLES[name]
    new = _absent(batch, name, incoming, key)
    if not new.isEmpty():
        batch.append(name, assign_keys(new, key, table.surrogate, batch.max_id(name)))


def _overwrite(batch: Batch, name: str, incoming: DataFrame, key: str) -> None:
    """Overwrites rows whose attributes differ and adds new ones; surrogates stay."""
    table = TABLES[name]
    incoming, buckets = _against(batch, name, incoming)
    merged = overwrite(batch.read(name, buckets), incoming, key, table.surrogate)
    merged = batch.stage(merged, f"merged-{name}")
    if merged.filter("changed").isEmpty():
        return
    kept = merged.filter(F.col(table.surrogate).isNotNull())
    new = merged.filter(F.col(table.surrogate).isNull()).drop(table.surrogate)
    numbered = assign_keys(new, [key], table.surrogate, batch.max_id(name))
    batch.replace(name, kept.unionByName(numbered).drop("changed"), buckets)


@dataclass
class Scope:
    """The written keys a batch speaks for, how many, and the buckets they fall in."""

    keys: DataFrame
    rows: int
    buckets: list[int]


def _scope(batch: Batch, keys: DataFrame, key: str, label: str) -> Scope:
    keys = batch.stage(keys, label)
    return Scope(keys, keys.count(), batch.buckets_with(keys, key))


def _relink(batch: Batch, name: str, incoming: DataFrame, scope: Scope, keys: list[str],
            payload: list[str] = ()) -> None:
    """Makes the stored rows of the scope equal to the incoming ones."""
    table = TABLES[name]
    scope_key = table.bucket_by
    if batch.read(name).isEmpty():
        first_load = incoming.select(scope_key, *keys, *payload).distinct()
        _write_links(batch, name, first_load, keys, [])
        return
    retained = [table.surrogate] if table.surrogate else []
    diff = two_way_diff(
        batch.read(name, scope.buckets), incoming, scope.keys, scope_key, keys, payload,
        retained, scope.rows)
    diff = batch.stage(diff, f"diff-{name}")
    # equal sets need no write: only buckets with a row to insert, update or delete are replaced
    changed = batch.touched(name, changes(diff))
    if changed:
        inside = diff.filter(batch.row_bucket(name).isin(changed))
        _write_links(batch, name, after_diff(inside), keys, changed)


def _write_links(batch: Batch, name: str, rows: DataFrame, keys: list[str],
                 buckets: list[int]) -> None:
    table = TABLES[name]
    if table.surrogate:
        rows = batch.stage(rows, f"links-{name}")
        fresh = rows
        if buckets:
            kept = rows.filter(F.col(table.surrogate).isNotNull())
            fresh = rows.filter(F.col(table.surrogate).isNull()).drop(table.surrogate)
        numbered = assign_keys(
            fresh, [table.bucket_by, *keys], table.surrogate, batch.max_id(name))
        rows = kept.unionByName(numbered) if buckets else numbered
    batch.replace(name, rows, buckets)


def _insert_names(batch: Batch, pairs: DataFrame) -> None:
    _insert_absent(batch, "name", pairs.distinct(), ["kind", "name"])


def _resolve_name(batch: Batch, frame: DataFrame, kind: str, column: str,
                  id_column: str) -> DataFrame:
    """Replaces a name column by the id of that name."""
    names = names_of(batch.read("name"), kind, id_column, column)
    return lookup_join(frame, names, [column], dim_bytes=batch.size("name")).drop(column)


def _resolve_id(batch: Batch, frame: DataFrame, name: str, key: str, how: str = "inner",
                keep: bool = False) -> DataFrame:
    """Replaces an external id column by the surrogate key of a dimension.

    ``frame`` is written; only the buckets its keys fall in are read.
    """
    buckets = batch.touched(name, frame)
    ids = batch.read(name, buckets).select(key, TABLES[name].surrogate)
    size = plain_bytes(batch.rows(name, buckets), 2)
    joined = lookup_join(frame, ids, [key], how, size)
    return joined if keep else joined.drop(key)


# -- media -------------------------------------------------------------------------


def in_order(docs: DataFrame) -> DataFrame:
    """Documents with a ``seq`` that no two share: when they arrived, their number, and their
    place in the batch.  Written before anything compares it."""
    arrived = F.col("arrived") if "arrived" in docs.columns else F.lit(0).cast("bigint")
    return docs.select(
        F.struct(arrived.alias("arrived"), F.col("seq").alias("number"),
                 F.monotonically_increasing_id().alias("place")).alias("seq"),
        "value")


def reconcile_media(store: Store, docs: DataFrame, batch_id: int | None = None,
                    stream: str = MEDIA_STREAM) -> bool:
    """Applies ``(seq, value)`` media documents in order; false if the batch was applied before.

    ``arrived``, if there is such a column, comes before ``seq``; documents equal in both are
    taken in the order they stand in the batch.
    """
    return _applied(store, stream, batch_id, lambda batch: _apply_media(batch, docs))


def _apply_media(batch: Batch, docs: DataFrame) -> None:
    parsed = batch.stage(docs_op.parse_media(in_order(docs)), "media")
    valid = docs_op.valid_documents(parsed)
    scopes = []
    _together(
        batch,
        lambda: _quarantine(batch, parsed, MEDIA_STREAM),
        lambda: _studios(batch, valid),
        lambda: _staff(batch, valid),
        lambda: scopes.append(_named_media(batch, valid)),
    )
    scope = scopes[0]
    _media_links(batch, valid, scope)
    _link_pending(batch, scope)


def _quarantine(batch: Batch, parsed: DataFrame, stream: str) -> None:
    bad = docs_op.quarantined(parsed, stream)
    if not bad.isEmpty():
        bad = batch.stage(bad.withColumn("seq", F.col("seq.number")), "quarantine")
        stored = batch.read("quarantine", batch.touched("quarantine", bad)).alias("s")
        same = [F.col(f"b.{c}").eqNullSafe(F.col(f"s.{c}")) for c in bad.columns]
        new = bad.alias("b").join(stored, reduce(and_, same), "left_anti")
        batch.append("quarantine", new)


def _studios(batch: Batch, valid: DataFrame) -> None:
    rows = flatten.studio_rows(valid, ["seq"])
    _insert_absent(batch, "studio", first_seen(rows, "ext_studio_id", ["name"]), ["ext_studio_id"])


def _staff(batch: Batch, valid: DataFrame) -> None:
    rows = flatten.staff_rows(valid, ["seq"])
    _overwrite(batch, "staff", last_seen(rows, "ext_staff_id", STAFF_NAMES), "ext_staff_id")


def _named_media(batch: Batch, valid: DataFrame) -> Scope:
    """Names, then the tags and media that refer to them; returns the media of the batch."""
    new_tags = _new_tags(batch, valid)
    _media_names(batch, valid, new_tags)
    scopes = []

    def tags() -> None:
        if not new_tags.isEmpty():
            numbered = assign_keys(new_tags, ["ext_tag_id"], "tag_id", batch.max_id("tag"))
            batch.append(
                "tag", _resolve_name(batch, numbered, "tagcategory", "category", "category_id"))

    def media() -> None:
        marks = batch.stage(docs_op.latest_marks(valid, "ext_media_id"), "media-marks")
        _media_rows(batch, docs_op.latest_documents(valid, "ext_media_id", marks))
        keys = _resolve_id(batch, marks, "media", "ext_media_id", keep=True)
        scopes.append(_scope(batch, keys, "media_id", "media-scope"))

    _together(batch, tags, media)
    return scopes[0]


def _new_tags(batch: Batch, valid: DataFrame) -> DataFrame:
    rows = flatten.tag_rows(valid, ["seq"])
    tags = first_seen(rows, "ext_tag_id", ["name", "category"])
    return _absent(batch, "tag", tags, ["ext_tag_id"])


def _media_names(batch: Batch, valid: DataFrame, new_tags: DataFrame) -> None:
    """Names of every valid document, and categories of tags not known before."""
    own = [("mediatype", "media_type"), ("format", "format"), ("source", "source"),
           ("status", "status")]
    pairs = F.concat(
        F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in own]),
        F.transform("genres", lambda g: F.struct(F.lit("genre").alias("kind"), g.alias("name"))),
    )
    names = valid.select(F.explode(pairs).alias("pair")).select("pair.*")
    categories = new_tags.select(
        F.lit("tagcategory").alias("kind"), F.col("category").alias("name"))
    _insert_names(batch, names.unionByName(categories))


def _media_rows(batch: Batch, latest: DataFrame) -> None:
    rows = latest.select(
        "ext_media_id", "title", "date_start", "date_end", "episodes", "duration", "chapters",
        "volumes", "format", "source", "status", "media_type")
    for kind, column, id_column in [
        ("format", "format", "format_id"), ("source", "source", "source_id"),
        ("status", "status", "status_id"), ("mediatype", "media_type", "media_type_id"),
    ]:
        rows = _resolve_name(batch, rows, kind, column, id_column)
    _overwrite(batch, "media", rows, "ext_media_id")


def _media_links(batch: Batch, valid: DataFrame, scope: Scope) -> None:
    """The five relations of the last documents; the scope is documents, not their links."""

    columns = ["genres", "tags", "studios", "staff", "names"]
    last = batch.stage(
        valid.select("ext_media_id", "seq", *columns).join(scope.keys, ["ext_media_id", "seq"])
        .select("media_id", *columns), "last-documents")

    def linked(column: str) -> DataFrame:
        return last.select("media_id", column)

    def genres() -> None:
        rows = flatten.genre_rows(linked("genres"), ["media_id"])
        rows = _resolve_name(batch, rows, "genre", "genre", "genre_id")
        _relink(batch, "genre_link", rows, scope, ["genre_id"])

    def tags() -> None:
        rows = flatten.tag_rows(linked("tags"), ["media_id"]).select("media_id", "ext_tag_id")
        _relink(batch, "tag_link", _resolve_id(batch, rows, "tag", "ext_tag_id"), scope, ["tag_id"])

    def studios() -> None:
        rows = flatten.studio_rows(linked("studios"), ["media_id"]).drop("name")
        _relink(batch, "studio_link", _resolve_id(batch, rows, "studio", "ext_studio_id"),
                scope, ["studio_id"], ["is_main"])

    def staff() -> None:
        rows = flatten.staff_rows(linked("staff"), ["media_id"])
        rows = rows.select("media_id", "ext_staff_id", "role")
        _relink(batch, "staff_link", _resolve_id(batch, rows, "staff", "ext_staff_id"),
                scope, ["staff_id", "role"])

    def names() -> None:
        rows = flatten.title_name_rows(linked("names"), ["media_id"])
        rows = _resolve_name(batch, rows, "nametype", "kind", "name_type_id")
        _relink(batch, "media_name", rows, scope, ["name_type_id", "name"])

    _together(batch, genres, tags, studios, staff, names)


def _link_pending(batch: Batch, scope: Scope) -> None:
    """Moves list entries that waited for a media which has now arrived."""
    if batch.read("pending_entry").isEmpty():
        return
    arrived = scope.keys.select("ext_media_id", "media_id")
    found = lookup_join(
        batch.read("pending_entry"), arrived, ["ext_media_id"],
        dim_bytes=plain_bytes(scope.rows, 2))
    found = batch.stage(found, "found-pending")
    if found.isEmpty():
        return
    # a batch done again finds entries that it linked before it could take them off the waiting ones
    linked = batch.read("list_entry", batch.touched("list_entry", found))
    batch.append("list_entry", absent(found, linked, ["viewer_id", "media_id"]))
    buckets = batch.touched("pending_entry", found)
    left = batch.read("pending_entry", buckets).join(
        found.select("viewer_id", "ext_media_id"), ["viewer_id", "ext_media_id"], "left_anti")
    batch.replace("pending_entry", batch.stage(left, "left-pending"), buckets)


# -- lists -------------------------------------------------------------------------


def reconcile_lists(store: Store, docs: DataFrame, batch_id: int | None = None,
                    stream: str = LIST_STREAM,
                    fetch_media: Callable[[DataFrame], DataFrame] | None = None) -> bool:
    """Applies ``(seq, value)`` list documents in order; false if the batch was applied before.

    Entries of unknown media wait in ``pending_entry`` until a media batch brings them.
    With ``fetch_media`` (ids in, ``id, data`` out) they are fetched and reconciled first; a
    batch that was applied before is neither parsed nor fetched again, and what was fetched
    is written before it is used.
    """

    def work(batch: Batch) -> None:
        parsed = batch.stage(docs_op.parse_lists(in_order(docs)), "lists")
        if fetch_media is not None:
            _fetch_unknown(store, batch, parsed, fetch_media)
        _apply_lists(batch, parsed)

    return _applied(store, stream, batch_id, work)


def _fetch_unknown(store: Store, batch: Batch, parsed: DataFrame,
                   fetch_media: Callable[[DataFrame], DataFrame]) -> None:
    entries = flatten.entry_rows(docs_op.valid_documents(parsed), [])
    wanted = batch.stage(entries.select("ext_media_id").distinct(), "wanted")
    known = batch.read("media", batch.touched("media", wanted))
    unknown = missing_keys(wanted, known, ["ext_media_id"])
    fetched = fetch_media(unknown.select(F.col("ext_media_id").alias("id")))
    fetched = batch.stage(media_messages(fetched), "fetched")
    if not fetched.isEmpty():
        reconcile_media(store, fetched)


def _apply_lists(batch: Batch, parsed: DataFrame) -> None:
    valid = docs_op.valid_documents(parsed)
    scopes = []

    def viewers() -> None:
        _insert_absent(
            batch, "viewer", valid.select("ext_user_id").distinct(), ["ext_user_id"])
        marks = batch.stage(docs_op.latest_marks(valid, "ext_user_id"), "viewer-marks")
        keys = _resolve_id(batch, marks, "viewer", "ext_user_id", keep=True)
        scopes.append(_scope(batch, keys, "viewer_id", "list-scope"))

    def statuses() -> None:
        status = F.explode(F.array_distinct(F.transform("entries", lambda e: e["status"])))
        _insert_names(batch, valid.select(F.lit("watchstatus").alias("kind"), status.alias("name")))

    _together(batch, lambda: _quarantine(batch, parsed, LIST_STREAM), viewers, statuses)
    scope = scopes[0]
    latest = valid.join(scope.keys, ["ext_user_id", "seq"]).select("viewer_id", "entries")
    rows = _resolve_name(
        batch, flatten.entry_rows(latest, ["viewer_id"]), "watchstatus", "status", "status_id")
    entries = flatten.collapse_entries(
        rows, ["viewer_id", "ext_media_id"], ["pos"], ENTRY_ATTRIBUTES)
    entries = batch.stage(entries, "entries")
    entries = batch.stage(
        _resolve_id(batch, entries, "media", "ext_media_id", "left", keep=True), "entries-media")
    known = F.col("media_id").isNotNull()
    payload = [*ENTRY_ATTRIBUTES, "progress", "rewatched"]
    _together(
        batch,
        lambda: _relink(batch, "list_entry", entries.filter(known).drop("ext_media_id"),
                        scope, ["media_id"], payload),
        lambda: _relink(batch, "pending_entry", entries.filter(~known).drop("media_id"),
                        scope, ["ext_media_id"], payload),
    )


def media_requests(store: Store) -> DataFrame:
    """Ids of media that stored list entries wait for."""
    return store.read("pending_entry").select("ext_media_id").distinct()
