import pytest
from conftest import entry, lists, media
from pyspark.sql import functions as F

from mediashelf.plans import serving, views
from mediashelf.plans.reconcile import reconcile_lists, reconcile_media
from mediashelf.sources import requests


@pytest.fixture
def served(spark, store, documents):
    reconcile_media(store, documents(media(1), media(2), media(3)))
    reconcile_lists(store, documents(lists([[entry(1, user=7)]]), lists([[entry(2, user=8)]])))
    ids = {r.ext_media_id: r.media_id for r in store.read("media").collect()}
    users = {r.ext_user_id: r.viewer_id for r in store.read("viewer").collect()}
    rows = [(users[7], ids[1], 90), (users[7], ids[2], 10), (users[7], ids[3], 50)]
    store.append("recommendation", spark.createDataFrame(
        rows, "viewer_id bigint, media_id bigint, score int"))
    return store


def asked(spark, *rows):
    return spark.createDataFrame(rows, "ext_user_id int, params string")


def test_lowest_score_first(spark, served):
    found = serving.recommendations_for(served, asked(spark, (7, "{}"), (8, "{}"))).collect()
    assert [(r.ext_user_id, r.ext_media_id, r.title, r.score) for r in found] == [
        (7, 2, "title 2", 10), (7, 3, "title 3", 50), (7, 1, "title 1", 90)]


def test_decisions(spark, served):
    cases = {
        (7, '{"format":["TV"]}'): "stored",
        (7, '{"refresh":"true","format":["TV"]}'): "recompute",
        (7, '{"refresh":true,"format":["TV"]}'): "stored",
        (7, "{}"): "recompute",
        (7, '{"refresh":true}'): "recompute",
        (8, '{"format":["TV"]}'): "recompute",
        (99, '{"format":["TV"]}'): "recompute",
        (7, "[]"): "rejected",
    }
    found = serving.refresh_decisions(
        asked(spark, *cases), served.read("viewer"), served.read("recommendation")).collect()
    assert {(r.ext_user_id, r.params): r.decision for r in found} == cases


def test_users_by_name(spark):
    directory = spark.createDataFrame([("ann", 4)], "name string, ext_user_id int")
    found = serving.resolve_users(spark.createDataFrame([("ann",), ("bob",)], "name string"), directory)
    assert sorted((r.name, r.ext_user_id, r.known) for r in found.collect()) == [
        ("ann", 4, True), ("bob", None, False)]


def test_serve_refreshes_lists_and_hands_over(spark, served):
    branch = '{"data":{"MediaListCollection":{"lists":%s}}}'
    fresh = lists([[entry(3, user=8, progress=4)]])
    anime = fresh[len('{"anime": '):fresh.index(', "manga"')]
    table = spark.createDataFrame([(8, anime, branch % "[]")], "id int, anime string, manga string")
    fetch = requests.from_table(table, "anime", "manga")
    requested = asked(spark, (7, '{"genres":["A"]}'), (8, "{}"))
    with pytest.raises(NotImplementedError):
        serving.serve(served, requested, fetch)

    def generate(users):
        return users.select(
            F.lit(0).cast("bigint").alias("viewer_id"), "ext_user_id",
            F.lit(0).cast("bigint").alias("media_id"), F.lit(1).alias("ext_media_id"),
            F.lit("t").alias("title"), F.lit(5).alias("score"))

    requested = requested.unionByName(asked(spark, (9, "[]")))
    answer = serving.serve(served, requested, fetch, generate).collect()
    assert sorted((r.ext_user_id, r.score) for r in answer if r.reason is None) == [
        (7, 10), (7, 50), (7, 90), (8, 5)]
    assert [(r.ext_user_id, r.reason) for r in answer if r.reason] == [(9, "bad parameters")]
    entries = views.list_entries(served).filter("ext_user_id = 8").collect()
    assert [(r.ext_media_id, r.progress) for r in entries] == [(3, 4)]


def test_serve_by_name_fetches_media_and_turns_unknown_names_down(spark, served):
    branch = '{"data":{"MediaListCollection":{"lists":%s}}}'
    fresh = lists([[entry(40, user=8)]])
    anime = fresh[len('{"anime": '):fresh.index(', "manga"')]
    table = spark.createDataFrame([(8, anime, branch % "[]")], "id int, anime string, manga string")
    parts = spark.createDataFrame([(40, media(40))], "id int, data string")
    directory = spark.createDataFrame([("ann", 7), ("bob", 8)], "name string, ext_user_id int")
    asked_names = spark.createDataFrame(
        [("ann", '{"genres":["A"]}'), ("bob", "{}"), ("cy", "{}")], "name string, params string")

    def generate(users):
        entries = views.list_entries(served).join(users, "ext_user_id")
        return entries.select(
            F.lit(0).cast("bigint").alias("viewer_id"), "ext_user_id",
            F.lit(0).cast("bigint").alias("media_id"), "ext_media_id", F.lit("t").alias("title"),
            F.lit(5).alias("score"))

    found = serving.serve_by_name(
        served, asked_names, directory, requests.from_table(table, "anime", "manga"), generate,
        requests.from_table(parts, "data")).collect()
    assert sorted((r.name, r.ext_media_id) for r in found if r.reason is None) == [
        ("ann", 1), ("ann", 2), ("ann", 3), ("bob", 40)]
    assert [(r.name, r.reason) for r in found if r.reason] == [("cy", "unknown name")]
    unknown = serving.refresh_lists_by_name(
        served, asked_names, directory, requests.from_table(table, "anime", "manga"))
    assert [r.name for r in unknown.collect()] == ["cy"]
