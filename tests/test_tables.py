from pathlib import Path

import pytest
from conftest import entry, lists, media, staff, studio, tag
from pyspark.sql import functions as F

from mediashelf.plans import views
from mediashelf.plans.reconcile import reconcile_lists, reconcile_media
from mediashelf.schemas import TABLES
from mediashelf.sources.tables import Batch, Store
from test_operators import rows


def viewers(spark, start, end):
    return spark.range(start, end).select(
        F.col("id").alias("viewer_id"), F.col("id").cast("int").alias("ext_user_id"))


def test_seed_name_types(store):
    seed = sorted((r.name_id, r.name) for r in store.read("name").collect())
    assert seed == [(1, "romaji"), (2, "english"), (3, "native"), (4, "synonyms")]


def test_an_opened_store_has_its_buckets(spark, store):
    assert Store(spark, store.root).buckets == store.buckets == 4


def test_appended_rows_and_largest_id(spark, store):
    assert store.max_id("viewer") == 0 and store.read("viewer").isEmpty()
    store.append("viewer", viewers(spark, 1, 101))
    store.append("viewer", viewers(spark, 200, 210))
    assert store.read("viewer").count() == 110
    assert store.max_id("viewer") == 209


def test_replace_leaves_other_buckets(spark, store):
    store.append("viewer", viewers(spark, 1, 101))
    key = viewers(spark, 7, 8)
    buckets = store.touched("viewer", key)
    assert len(buckets) == 1
    kept = store.read("viewer").count() - store.read("viewer", buckets).count()
    store.replace("viewer", key, buckets)
    assert store.read("viewer").count() == kept + 1


def test_replace_empties_a_bucket(spark, store):
    store.append("viewer", viewers(spark, 1, 101))
    buckets = store.touched("viewer", viewers(spark, 7, 8))
    left = store.read("viewer").count() - store.read("viewer", buckets).count()
    store.replace("viewer", viewers(spark, 0, 0), buckets)
    assert store.read("viewer", buckets).isEmpty()
    assert store.read("viewer").count() == left


def test_only_touched_buckets_are_scanned(spark, store):
    store.append("viewer", viewers(spark, 1, 101))
    found = store.read("viewer", store.touched("viewer", viewers(spark, 7, 8)))
    scanned = found.select("*", F.col("viewer_id") + 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(bucket" in scanned or "PartitionFilters: [isnotnull(bucket" in scanned


def test_compact_keeps_rows(spark, store):
    for i in range(4):
        store.append("viewer", viewers(spark, i * 50 + 1, i * 50 + 51))
    before = sorted(store.read("viewer").collect())
    assert store.compact(files_per_bucket=2)
    assert not store.compact(files_per_bucket=2)
    assert sorted(store.read("viewer").collect()) == before


def test_streams_of_one_application_take_turns(spark, store, documents):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(2) as pool:
        batches = [documents(media(i, genres=["A", f"g{i}"])) for i in range(2)]
        done = [pool.submit(reconcile_media, store, batch) for batch in batches]
        assert all(d.result() for d in done)
    assert store.read("media").count() == 2
    assert store.read("name").filter("kind = 'genre'").count() == 3


def _failing_after(monkeypatch, writes):
    """Every write to a store fails once so many were made."""
    write, made = Store._write, []

    def failing(self, *args):
        if len(made) >= writes:
            raise OSError("lost")
        made.append(1)
        return write(self, *args)

    monkeypatch.setattr(Store, "_write", failing)


def _catalogue(i):
    return media(
        i, genres=["A", f"g{i}"], synonyms=["s"], tags=[tag(i)], studios={"edges": [studio(i)]},
        staff={"edges": [staff(i)]})


def _rows_by_name(store):
    quarantine = store.read("quarantine").drop("stream")
    entries = store.read("pending_entry").select("ext_media_id", "progress")
    return [rows(f) for f in (views.relations(store), views.list_entries(store), entries, quarantine)]


@pytest.mark.parametrize("writes", [3, 8, 12])
def test_a_batch_cut_off_anywhere_is_done_again(spark, store, documents, tmp_path, monkeypatch, writes):
    """Waiting entries, bad documents and all relations are as if nothing had failed."""
    waiting = documents(lists([[entry(1), entry(2), entry(9)]]))
    batch = documents(_catalogue(1), "{broken", _catalogue(2))
    undisturbed = Store.create(spark, f"{tmp_path}/undisturbed", buckets=4)
    for each in (undisturbed, store):
        reconcile_lists(each, waiting, batch_id=0)
    reconcile_media(undisturbed, batch, batch_id=0)
    with monkeypatch.context() as patch:
        _failing_after(patch, writes)
        with pytest.raises(OSError):
            reconcile_media(store, batch, batch_id=0)
    assert store.last_batch("media") == -1
    assert not list(Path(store.root, "_stage").iterdir())
    assert reconcile_media(store, batch, batch_id=0)
    assert not reconcile_media(store, batch, batch_id=0)
    assert _rows_by_name(store) == _rows_by_name(undisturbed)


def test_entries_linked_before_a_failure_are_linked_once(spark, store, documents, monkeypatch):
    reconcile_lists(store, documents(lists([[entry(1), entry(2)]])))
    replace = Batch.replace

    def failing(self, name, *args):
        if name == "pending_entry":
            raise OSError("lost")
        return replace(self, name, *args)

    with monkeypatch.context() as patch:
        patch.setattr(Batch, "replace", failing)
        with pytest.raises(OSError):
            reconcile_media(store, documents(media(1)), batch_id=0)
    assert store.read("list_entry").count() == 1 and store.read("pending_entry").count() == 2
    reconcile_media(store, documents(media(1)), batch_id=0)
    assert store.read("list_entry").count() == 1 and store.read("pending_entry").count() == 1


def test_every_table_can_be_read_before_it_is_written(store):
    assert all(store.read(name).columns == TABLES[name].columns for name in TABLES)
