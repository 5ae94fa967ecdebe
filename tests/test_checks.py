import datetime

from conftest import entry, lists, media, staff, studio, tag

from mediashelf.plans import checks
from mediashelf.plans.reconcile import reconcile_lists, reconcile_media
from mediashelf.schemas import TABLES

ALL = (checks.uniqueness, checks.references, checks.required, checks.lengths)


def violations(store):
    found = [r for check in ALL for r in check(store).collect()]
    return {(r["check"], r.table, r.column): r.violations for r in found if r.violations}


def test_reconciled_store_is_sound(store, documents):
    reconcile_media(store, documents(
        media(1, genres=["A"], tags=[tag(1)], studios={"edges": [studio(2)]},
              staff={"edges": [staff(3)]}, synonyms=["s"]), media(2)))
    reconcile_lists(store, documents(lists([[entry(1), entry(2)]], [[entry(1)]])))
    assert violations(store) == {}


def test_violations_are_found(spark, store):
    def put(table, *rows):
        store.append(table, spark.createDataFrame(rows, TABLES[table].ddl))

    put("studio", (1, 5, "x" * 51), (1, 6, "b"), (2, 6, "c"))
    put("name", ("format", 9, "y" * 51), ("genre", 10, "y" * 51))
    day = datetime.date(2020, 1, 1)
    put("media", (1, 1, "t" * 501, day, day, 0, 0, 0, 0, 9, None, 77, None))
    put("genre_link", (1, 10), (1, 10), (2, 11))
    assert violations(store) == {
        ("unique", "studio", "studio_id"): 1,
        ("unique", "studio", "ext_studio_id"): 1,
        ("unique", "genre_link", "media_id, genre_id"): 1,
        ("reference", "media", "status_id"): 1,
        ("reference", "genre_link", "media_id"): 1,
        ("reference", "genre_link", "genre_id"): 1,
        ("required", "media", "media_type_id"): 1,
        ("length", "studio", "name"): 1,
        ("length", "name", "format"): 1,
        ("length", "media", "title"): 1,
    }
