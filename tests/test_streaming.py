import shutil

from conftest import entry, lists, media
from pyspark.sql import functions as F

from mediashelf.plans import views
from mediashelf.plans.reconcile import reconcile_lists, reconcile_media
from mediashelf.schemas import TABLES
from mediashelf.sources import requests, topics
from mediashelf.streaming.consume import consume_lists, consume_media
from mediashelf.streaming.publish import publish_lists, publish_media


def run(writer):
    writer.start().awaitTermination()


def test_topics_into_tables_and_replay(spark, store, documents, tmp_path):
    topic, user_topic = f"{tmp_path}/media", f"{tmp_path}/lists"
    chk, user_chk = f"{tmp_path}/chk-media", f"{tmp_path}/chk-lists"
    topics.write_topic(documents(media(1, genres=["A"]), "{broken"), "parquet", {"path": topic})
    stream = topics.stream_topic(spark, "parquet", {"path": topic})
    run(consume_media(stream, store, chk, bounded=True))
    topics.write_topic(documents(lists([[entry(1), entry(2)]])), "parquet", {"path": user_topic})
    user_stream = topics.stream_topic(spark, "parquet", {"path": user_topic})
    run(consume_lists(user_stream, store, user_chk, bounded=True))
    assert [r.ext_media_id for r in views.list_entries(store).collect()] == [1]
    assert store.read("quarantine").count() == 1

    # a batch whose tables were written but whose checkpoint was not is skipped
    files = store.read("media").inputFiles()
    for part in ("0", ".0.crc"):
        shutil.os.replace(f"{chk}/commits/{part}", f"{tmp_path}/lost{part}")
    run(consume_media(stream, store, chk, bounded=True))
    assert store.read("media").inputFiles() == files

    topics.write_topic(documents(media(2, genres=["B"]), start=9), "parquet", {"path": topic})
    run(consume_media(stream, store, chk, bounded=True))
    assert sorted(r.genre for r in views.genres(store).collect()) == ["A", "B"]
    assert sorted(r.ext_media_id for r in views.list_entries(store).collect()) == [1, 2]


def ticks(spark, rows):
    return (
        spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows)
        .option("numPartitions", 1).load()
    )


def test_walk_publishes_ids_up_to_the_boundary(spark, tmp_path):
    docs = {i: f'{{"data":{i}}}' if i != 3 else '{"errors":[]}' for i in range(50)}

    def fetch(ids):
        return requests.fetch_documents(ids, data=lambda keys: [docs[k] for k in keys])

    topic = f"{tmp_path}/topic"
    publish_media(
        ticks(spark, 25), fetch, lambda f: topics.write_topic(f, "parquet", {"path": topic}),
        boundary=5, checkpoint=f"{tmp_path}/chk",
    )
    walk = publish_media(
        ticks(spark, 1000), fetch, lambda f: topics.write_topic(f, "parquet", {"path": topic}),
        boundary=5, checkpoint=f"{tmp_path}/chk")
    walk.run(poll_seconds=0.2)
    got = topics.read_topic(spark, "parquet", {"path": topic}).collect()
    assert sorted((r.seq, r.value) for r in got) == [
        (i, docs[i]) for i in (0, 1, 2, 4, 5)]


def test_walk_of_lists(spark, tmp_path):
    table = spark.range(10).select(
        F.col("id").cast("int"), F.lit("A").alias("anime"),
        F.when(F.col("id") == 2, '{"errors":').otherwise("M").alias("manga"))
    topic = f"{tmp_path}/topic"
    publish_lists(
        ticks(spark, 1000), requests.from_table(table, "anime", "manga"),
        lambda f: topics.write_topic(f, "parquet", {"path": topic}), 2, f"{tmp_path}/chk",
    ).run(poll_seconds=0.2)
    got = topics.read_topic(spark, "parquet", {"path": topic}).collect()
    assert sorted((r.seq, r.value) for r in got) == [
        (0, '{"anime":A,"manga": M}'), (1, '{"anime":A,"manga": M}'),
        (2, '{"anime":A,"manga": {"errors":}')]


def test_steady_ticks(spark):
    assert topics.tick_stream(spark).isStreaming


def test_later_version_of_an_equal_number_wins(spark, store, documents, tmp_path):
    """Two published versions of an id carry the same number; one row is left, the later one."""
    topic = f"{tmp_path}/topic"
    for episodes in (12, 24):
        topics.write_topic(documents(media(7, episodes=episodes), start=7), "parquet", {"path": topic})
    stream = topics.stream_topic(spark, "parquet", {"path": topic})
    run(consume_media(stream, store, f"{tmp_path}/chk", bounded=True))
    assert [r.episodes for r in store.read("media").collect()] == [24]


def test_equal_replay_writes_nothing(spark, store, documents, tmp_path):
    docs = documents(media(1, genres=["A", "B"]), media(2, genres=["B"]), media(1, genres=["A"]))
    reconcile_media(store, docs)
    before = {name: sorted(store.read(name).inputFiles()) for name in TABLES}
    reconcile_media(store, docs)
    assert {name: sorted(store.read(name).inputFiles()) for name in TABLES} == before


def test_replayed_batch_fetches_nothing(spark, store, documents):
    calls = []

    def fetch(ids):
        calls.append(ids.count())
        return ids.select("id", F.lit("{broken").alias("data"))

    docs = documents(lists([[entry(5)]]))
    assert reconcile_lists(store, docs, batch_id=3, fetch_media=fetch)
    assert not reconcile_lists(store, docs, batch_id=3, fetch_media=fetch)
    assert calls == [1]


def test_kafka_order_keeps_offset_and_partition(spark):
    rows = [(0, 4096, b"a"), (1, 0, b"b")]
    frame = spark.createDataFrame(rows, "offset bigint, partition int, value binary")
    found = topics._documents(frame, "kafka").collect()
    assert [(r.arrived, r.seq, r.value) for r in found] == [(0, 4096, "a"), (1, 0, "b")]
