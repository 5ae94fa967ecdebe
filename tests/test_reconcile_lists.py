import datetime
import json

from conftest import entry, lists, media

from mediashelf.plans import views
from mediashelf.plans.reconcile import media_requests, reconcile_lists, reconcile_media
from mediashelf.sources.requests import fetch_documents

START, NONE = datetime.date(2020, 1, 2), datetime.date(1900, 1, 1)


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def entries(store):
    columns = ["ext_user_id", "ext_media_id", "score", "progress", "rewatched", "status"]
    return rows(views.list_entries(store).select(columns))


def test_entries_collapse_in_document_order(store, documents):
    reconcile_media(store, documents(media(1), media(2)))
    doc = lists(
        anime=[[entry(1, score=8.75, progress=5), entry(2, score=0)],
               [entry(1, score=3, progress=7, repeat=2, status="COMPLETED")]],
        manga=[[entry(1, score=9, progress=1, status=None), entry(2, user=99, status=None)]])
    reconcile_lists(store, documents(doc))
    assert entries(store) == [(1, 1, 87, 13, 2, "CURRENT"), (1, 2, 0, 2, 0, "CURRENT")]
    dates = views.list_entries(store).select("date_start", "date_end").distinct()
    assert rows(dates) == [(START, NONE)]


def test_bad_lists_are_quarantined(store, documents):
    reconcile_media(store, documents(media(1)))
    reconcile_lists(store, documents(lists([[entry(1)]])))
    before = entries(store)
    error = '{"errors":[{"message":"Private"}],"data":null}'
    good_side = json.dumps(json.loads(lists([[entry(1, progress=9)]]))["anime"])
    bad = [
        lists(), lists([[]], [[]]),
        f'{{"anime":{good_side},"manga": {error}}}',
        f'{{"anime":{good_side},"manga": {{"errors":}}',
        lists([[entry(None)]]), lists([[entry(1, score=None)]]), lists([[entry(1, progress="x")]]),
        lists([[entry(1, startedAt=None)]]), lists([[entry(1, user=None)]]),
        lists([[entry(1, score="NaN")]]),
    ]
    reconcile_lists(store, documents(*bad, start=10))
    assert entries(store) == before
    reasons = [r.reason for r in store.read("quarantine").orderBy("seq").collect()]
    assert reasons == ["no viewer", "no viewer", "missing branch", "malformed", "bad entry",
                       "bad entry", "malformed", "bad entry", "no viewer", "bad entry"]


def test_scope_is_the_viewer_and_the_last_document_counts(store, documents):
    reconcile_media(store, documents(media(1), media(2), media(3)))
    reconcile_lists(store, documents(
        lists([[entry(1, user=1), entry(2, user=1)]]), lists([[entry(1, user=2)]])))
    reconcile_lists(store, documents(
        lists([[entry(1, user=1)]]), lists([[entry(2, user=1, progress=4), entry(3, user=1)]]),
        start=5))
    assert [e[:2] + e[3:4] for e in entries(store)] == [(1, 2, 4), (1, 3, 1), (2, 1, 1)]


def test_unknown_media_waits_for_its_document(store, documents):
    reconcile_media(store, documents(media(1)))
    reconcile_lists(store, documents(lists([[entry(1), entry(42), entry(43)]])))
    assert [e[1] for e in entries(store)] == [1]
    assert rows(media_requests(store)) == [(42,), (43,)]
    reconcile_media(store, documents(media(42), start=9))
    assert [e[1] for e in entries(store)] == [1, 42]
    assert rows(media_requests(store)) == [(43,)]
    reconcile_lists(store, documents(lists([[entry(42)]]), start=20))
    assert [e[1] for e in entries(store)] == [42]
    assert rows(media_requests(store)) == []


def test_unknown_media_can_be_fetched(store, documents):
    known = {k: media(k) for k in (1, 7)}

    def fetch(ids):
        return fetch_documents(ids, data=lambda keys: [known.get(k, '{"errors":[]}') for k in keys])

    doc = documents(lists([[entry(1), entry(7), entry(51)]]))
    reconcile_lists(store, doc, fetch_media=fetch)
    assert [e[1] for e in entries(store)] == [1, 7]
    assert rows(media_requests(store)) == [(51,)]


def test_list_replay_is_a_no_op(store, documents):
    reconcile_media(store, documents(media(1)))
    batch = documents(lists([[entry(1), entry(5)]]))
    assert reconcile_lists(store, batch, batch_id=3)
    tables = ("viewer", "list_entry", "pending_entry", "name")
    before = [rows(store.read(t)) for t in tables]
    assert not reconcile_lists(store, batch, batch_id=3)
    reconcile_lists(store, batch)
    assert [rows(store.read(t)) for t in tables] == before


def test_progress_wraps_like_an_integer(store, documents):
    reconcile_media(store, documents(media(1)))
    big = 2_000_000_000
    reconcile_lists(store, documents(lists([[entry(1, progress=big), entry(1, progress=big)]])))
    assert entries(store)[0][3] == 2 * big - 2**32
