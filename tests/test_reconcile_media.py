import datetime

import pytest
from conftest import date, media, staff, studio, tag

from mediashelf.plans import views
from mediashelf.plans.reconcile import reconcile_media
from mediashelf.schemas import FOREIGN_KEYS, TABLES, UNIQUE_KEYS
from mediashelf.operators.audit import duplicate_keys, orphans


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def snapshot(store):
    return {name: rows(store.read(name).drop("seq")) for name in TABLES}


def names_of_kind(store, kind):
    return sorted(r.name for r in store.read("name").filter(f"kind = '{kind}'").collect())


def assert_sound(store):
    for name, keys in UNIQUE_KEYS.items():
        for key in keys:
            assert duplicate_keys(store.read(name), key).isEmpty(), (name, key)
    for child, column, parent, key in FOREIGN_KEYS:
        assert orphans(store.read(child), column, store.read(parent), key).isEmpty(), (child, column)


def test_first_batch_fills_every_table(store, documents):
    doc = media(
        7, title={"romaji": "It's", "english": None, "native": "null"}, synonyms=["a", "a", "b"],
        format=None, startDate=date(2021, 2, 30), endDate=date(None, 5, 6), episodes=12.5, volumes=3,
        tags=[tag(1, "x", "c1"), tag(2, None, "c1")], genres=["Action", "Drama", "Action"],
        studios={"edges": [studio(5, "s5"), studio(6, "s6", False)]},
        staff={"edges": [staff(9, "Original Story"), staff(9, "art"), staff(8, None)]},
    )
    assert reconcile_media(store, documents(doc))
    assert rows(views.media(store)) == [(
        7, "It's", datetime.date(1900, 1, 1), datetime.date(1900, 5, 6), 0, 0, 0, 3,
        "null", "MANGA", "FINISHED", "ANIME")]
    assert rows(views.names(store)) == [
        ("romaji", "It's", 7), ("synonyms", "a", 7), ("synonyms", "b", 7)]
    assert rows(views.genres(store)) == [("Action", 7), ("Drama", 7)]
    assert rows(views.tags(store)) == [(1, "x", "c1", 7), (2, "null", "c1", 7)]
    assert rows(views.studios(store)) == [(5, "s5", True, 7), (6, "s6", False, 7)]
    assert [(r[0], r[5]) for r in rows(views.staff(store))] == [
        (8, "NULL"), (9, "ART"), (9, "ORIGINAL STORY")]
    assert names_of_kind(store, "format") == ["null"]
    assert names_of_kind(store, "nametype") == ["english", "native", "romaji", "synonyms"]
    assert_sound(store)


def test_bad_documents_change_nothing(store, documents):
    good = media(1, genres=["Action"])
    bad = [
        '{"errors":[{"message":"no"}],"data":null}',
        good[:40],
        media("x"),
        media(1.5),
        media(2, title=None),
        media(2, tags=None, genres=["Unseen"]),
        media(2, startDate=None),
        media(2, startDate=date("x")),
        media(2, tags=[tag(None)]),
        media(2, tags=[tag(1, "a"), tag(1, "b")]),
        media(2, studios={"edges": [studio(1, main="yes")]}),
        media(2, studios={"edges": [studio(1, main=True), studio(1, main=False)]}),
        media(2, studios=None),
        media(2, staff={"edges": [staff(1, "art", first="a"), staff(1, "ART", first="z")]}),
        media(2, staff={"edges": [{"role": "x", "node": {"id": 4, "name": None}}]}),
        None,
    ]
    reconcile_media(store, documents(*bad, good))
    assert rows(store.read("media").select("ext_media_id")) == [(1,)]
    assert names_of_kind(store, "genre") == ["Action"]
    reasons = dict(rows(store.read("quarantine").select("seq", "reason")))
    assert reasons == {
        0: "no media", 1: "malformed", 2: "malformed", 3: "malformed", 4: "missing section",
        5: "missing section", 6: "missing section", 7: "malformed", 8: "bad tag",
        9: "tag conflict", 10: "malformed", 11: "studio conflict", 12: "missing section",
        13: "staff conflict", 14: "bad staff", 15: "malformed",
    }


def test_update_keeps_surrogates_and_scope(store, documents):
    one = media(1, genres=["A", "B"], tags=[tag(1, "old", "c")], synonyms=["s"],
                staff={"edges": [staff(3, "Art", first="old")]},
                studios={"edges": [studio(2, "old", True)]})
    two = media(2, genres=["A"], tags=[tag(1, "old", "c")])
    reconcile_media(store, documents(one, two))
    before = {n: store.read(n).collect() for n in ("media", "staff", "media_name", "tag")}
    newer = media(1, title={"romaji": "renamed", "english": None, "native": None}, genres=[],
                  tags=[tag(1, "new", "other")], synonyms=["s"],
                  staff={"edges": [staff(3, "Story", first="new")]},
                  studios={"edges": [studio(2, "new", False)]})
    reconcile_media(store, documents(newer, start=10))
    assert rows(views.genres(store)) == [("A", 2)]
    assert rows(views.tags(store)) == [(1, "old", "c", 1), (1, "old", "c", 2)]
    assert names_of_kind(store, "tagcategory") == ["c"]
    assert rows(views.studios(store)) == [(2, "old", False, 1)]
    assert [(r.first_name, r.role) for r in views.staff(store).collect()] == [("new", "STORY")]
    ids = {r.ext_media_id: r.media_id for r in store.read("media").collect()}
    assert ids == {r.ext_media_id: r.media_id for r in before["media"]}
    assert store.read("staff").first().staff_id == before["staff"][0].staff_id
    kept = {(r.name, r.media_name_id) for r in before["media_name"] if r.name == "s"}
    assert kept <= {(r.name, r.media_name_id) for r in store.read("media_name").collect()}
    assert names_of_kind(store, "genre") == ["A", "B"]
    assert_sound(store)


def test_last_version_in_a_batch_wins(store, documents):
    reconcile_media(store, documents(
        media(1, genres=["Old"], title={"romaji": "v1", "english": None, "native": None},
              tags=[tag(5, "first", "c1")], staff={"edges": [staff(3, first="v1")]}),
        media(1, genres=["New"], title={"romaji": "v2", "english": None, "native": None},
              tags=[tag(5, "second", "c2")], staff={"edges": [staff(3, first="v2")]}),
    ))
    assert rows(views.genres(store)) == [("New", 1)]
    assert names_of_kind(store, "genre") == ["New", "Old"]
    assert store.read("media").first().title == "v2"
    assert rows(views.tags(store)) == [(5, "first", "c1", 1)]
    assert names_of_kind(store, "tagcategory") == ["c1"]
    assert store.read("staff").first().first_name == "v2"


def test_replay_is_a_no_op(store, documents):
    batch = documents(
        media(1, genres=["A"], synonyms=["s"], tags=[tag(1)], studios={"edges": [studio(2)]},
              staff={"edges": [staff(3)]}),
        media(2, genres=["B"]))
    reconcile_media(store, batch, batch_id=0)
    before = snapshot(store)
    assert not reconcile_media(store, batch, batch_id=0)
    assert snapshot(store) == before
    reconcile_media(store, batch)
    assert snapshot(store) == before


def test_one_batch_equals_many(spark, store, documents, tmp_path):
    from mediashelf.sources.tables import Store

    docs = [media(i % 3, genres=[f"g{i}", "A"], tags=[tag(i % 2, f"t{i}", f"c{i}")],
                  staff={"edges": [staff(1, f"r{i}", first=f"n{i}")]}, synonyms=[f"s{i}"])
            for i in range(5)]
    reconcile_media(store, documents(*docs))
    other = Store.create(spark, f"{tmp_path}/other", buckets=3)
    for i, doc in enumerate(docs):
        reconcile_media(other, documents(doc, start=i))
    for view in (views.media, views.relations):
        assert rows(view(store)) == rows(view(other))
    kinds = ["kind", "name"]
    assert rows(store.read("name").select(kinds)) == rows(other.read("name").select(kinds))
    assert_sound(other)
