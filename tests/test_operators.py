import random

import pytest
from pyspark.sql import functions as F

from mediashelf.operators import audit, dimensions, flatten, lookups
from mediashelf.operators import documents as documents_op
from mediashelf.operators.diff import changes, two_way_diff
from mediashelf.operators.keys import PARTS_PER_SCAN, assign_keys, dealt
from workload.queries import QUERIES


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot", [True, False])
def test_lookup_without_broadcast_is_whole(spark, monkeypatch, how, hot):
    key = F.when(F.col("id") < 2000, 7).otherwise(F.col("id") % 977) if hot else F.col("id")
    fact = spark.range(6000).select(key.cast("bigint").alias("k"), F.col("id").alias("v"))
    dim = spark.range(900).select(F.col("id").alias("k"), (F.col("id") * 3).alias("name"))
    want = rows(fact.join(dim, "k", how))
    monkeypatch.setattr(lookups, "BROADCAST_BYTES", 0)
    assert rows(lookups.lookup_join(fact, dim, ["k"], how)) == want


def test_size_counts_texts(spark):
    frame = spark.createDataFrame([(1, "abc"), (2, "é"), (3, None)], "id bigint, t string")
    assert lookups.size_of(frame) == lookups.plain_bytes(3, 2) + 5


def test_keys_are_dense_and_repeatable(spark):
    new = spark.range(5000).select((F.col("id") * 17).alias("ext"))
    first = assign_keys(new, ["ext"], "key", 100)
    again = assign_keys(new.repartition(13).orderBy(F.rand()), ["ext"], "key", 100)
    got = rows(first.select("ext", "key"))
    assert sorted(k for _, k in got) == list(range(101, 5101))
    assert got == rows(again.select("ext", "key"))


def brute_diff(existing, incoming, scope):
    actions = {}
    for media in {*[e[0] for e in existing], *[i[0] for i in incoming]}:
        old = {(m, g): p for m, g, p in existing if m == media}
        new = {(m, g): p for m, g, p in incoming if m == media}
        for pair in {*old, *new}:
            if pair not in old:
                actions[pair] = "insert"
            elif pair in new:
                actions[pair] = "keep" if old[pair] == new[pair] else "update"
            else:
                actions[pair] = "delete" if media in scope else "outside"
    return sorted((m, g, a) for (m, g), a in actions.items())


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("broadcast", [True, False])
def test_diff_matches_brute_force(spark, monkeypatch, seed, broadcast):
    if not broadcast:
        monkeypatch.setattr(lookups, "BROADCAST_BYTES", 0)
    pick = random.Random(seed)
    scope = set(pick.sample(range(12), 6))

    def links(media):
        return [(m, g, pick.choice([True, False, None])) for m in media for g in range(8)
                if pick.random() < 0.5]

    existing, incoming = links(range(12)), links(scope)
    schema = "media_id bigint, genre_id bigint, flag boolean"
    diff = two_way_diff(
        spark.createDataFrame(existing, schema), spark.createDataFrame(incoming, schema),
        spark.createDataFrame([(m,) for m in scope], "media_id bigint"),
        "media_id", ["genre_id"], ["flag"])
    got = sorted((r.media_id, r.genre_id, r.action) for r in diff.collect())
    assert got == brute_diff(existing, incoming, scope)
    flags = {(r.media_id, r.genre_id): r.flag for r in diff.collect()}
    assert flags == {**{(m, g): f for m, g, f in existing}, **{(m, g): f for m, g, f in incoming}}


def test_equal_sets_have_no_changes(spark):
    links = spark.range(50).select(F.col("id").alias("media_id"), F.lit(1).alias("genre_id"))
    diff = two_way_diff(links, links, links.select("media_id"), "media_id", ["genre_id"])
    assert changes(diff).isEmpty()


def test_collapse_matches_brute_force(spark):
    pick = random.Random(1)
    data = [(pick.randrange(5), pick.randrange(4), i, f"s{pick.randrange(9)}", pick.randrange(100),
             pick.randrange(3)) for i in range(300)]
    pick.shuffle(data)
    frame = spark.createDataFrame(
        data, "u int, m int, pos int, status string, progress int, repeat int")
    for order in (["pos"], ["u", "pos"]):
        got = rows(flatten.collapse_entries(frame, ["u", "m"], order, ["status"]))
        want = []
        for key in {d[:2] for d in data}:
            group = sorted((d for d in data if d[:2] == key), key=lambda d: d[2])
            want.append((*key, group[0][3], sum(d[4] for d in group), sum(d[5] for d in group)))
        assert got == sorted(want, key=repr)


def test_first_and_last_seen(spark):
    frame = spark.createDataFrame(
        [(1, "a", 5), (1, "b", 2), (1, "a", 9), (2, "z", 1), (2, None, 7)],
        "k int, name string, seq bigint")
    assert rows(dimensions.first_seen(frame, "k", ["name"])) == [(1, "b"), (2, "z")]
    assert rows(dimensions.last_seen(frame, "k", ["name"])) == [(1, "a"), (2, None)]


def test_overwrite_marks_changes(spark):
    old = spark.createDataFrame(
        [(10, 1, "a", None), (11, 2, "b", 2), (12, 3, "c", 3)], "id bigint, ext int, t string, n int")
    new = spark.createDataFrame([(1, "a", None), (2, "b", 9), (4, "d", 4)], "ext int, t string, n int")
    assert rows(dimensions.overwrite(old, new, "ext", "id")) == sorted([
        (10, 1, "a", None, False), (11, 2, "b", 9, True), (12, 3, "c", 3, False),
        (None, 4, "d", 4, True)], key=repr)


def test_audits(spark):
    child = spark.createDataFrame([(1, "ab"), (1, None), (5, "abcd"), (None, "x")], "k int, t string")
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    assert rows(audit.duplicate_keys(child, ["k"])) == [(1, 2)]
    assert rows(audit.orphans(child, "k", parent, "id")) == [(5, 1)]
    assert rows(audit.null_counts(child, ["k", "t"])) == [("k", 1), ("t", 1)]
    assert rows(audit.too_long(child, {"t": 2})) == [("t", 1, 4)]


def test_missing_null_number_and_text_are_told_apart(documents):
    import json

    from conftest import entry, lists, media

    def without(*path):
        doc = json.loads(media(1, tags=[{"id": 1, "name": "t", "category": "c"}]))
        part = doc["data"]["Media"]
        for key in path[:-1]:
            part = part[key]
        del part[path[-1]]
        return json.dumps(doc)

    docs = documents(
        media(1, format=None, episodes="7", duration=7, chapters=7.5, status=3), without("format"),
        without("title", "native"), without("tags", 0, "name"), without("episodes"))
    found = {r.seq: r for r in documents_op.parse_media(docs).collect()}
    assert [found[i].reason for i in range(5)] == [None, *["missing field"] * 3, None]
    first = found[0]
    assert (first.format, first.episodes, first.duration, first.chapters, first.status) == (
        "null", 0, 7, 0, "3")
    assert found[4].episodes == 0
    listed = documents(
        lists([[entry(1, user=5), entry(2, user="x")]]), lists([[entry(1, user="5")]]),
        lists([[entry(1, user=5), {k: v for k, v in entry(2).items() if k != "status"}]]))
    found = {r.seq: r for r in documents_op.parse_lists(listed).collect()}
    assert [found[i].reason for i in range(3)] == [None, "no viewer", "bad entry"]
    assert found[0].ext_user_id == 5 and len(found[0].entries) == 2


def test_dealt_parts_are_not_joined_again(spark):
    rows = spark.range(1000).select((F.col("id") % 700).alias("a"), (F.col("id") % 7).alias("b"))
    found = dealt(rows, 9, "a", "b").distinct()
    assert found.count() == 700 and found.rdd.getNumPartitions() == 9 * PARTS_PER_SCAN
    assert dealt(rows, 1, "a").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["equal_sets", "list_entry_diff"])
def test_diff_queries_keep_their_parts(spark, name):
    rows = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "REPARTITION_BY_NUM" in rows._jdf.queryExecution().executedPlan().toString()


def test_nulls_and_quoted_numbers_are_found_with_any_space(documents):
    import json

    from conftest import lists, media
    from conftest import entry as listed

    tags = [{"id": 1, "name": None, "category": 'a "name": null, "episodes": "7"'}] * 2
    doc = json.loads(media(1, format=None, tags=tags, chapters=None, duration=5))
    forms = [json.dumps(doc, separators=(",", colon)) for colon in (":", ": ", " : ", "   :", " :\n \t ", ":" + " " * 40)]
    named = json.dumps(doc).replace('"TV"', "null")
    found = documents_op.parse_media(documents(*forms, named)).drop("seq").distinct().collect()
    assert [(r.reason, r.format, r.duration, len(r.tags)) for r in found] == [(None, "null", 5, 1)]
    # a null inside another leaf is no null text
    inner = documents_op.parse_media(documents(media(1, format={"x": None}))).first()
    assert inner.format == '{"x":null}'
    asked = [lists([[listed(1, status=None)]]), lists([[listed(1, user="1")]])]
    asked += [text.replace('": ', '"' + " " * 9 + ":   ") for text in asked]
    found = {r.seq: r for r in documents_op.parse_lists(documents(*asked)).collect()}
    assert [found[i].reason for i in range(4)] == [None, "no viewer"] * 2
    assert found[0].entries == found[2].entries and found[0].entries[0].status == "null"


def test_conflicts_of_few_and_of_many_members(documents):
    from conftest import media, tag

    few = [tag(1), tag(1)]
    many = [*few, *[tag(i) for i in range(2, 3 * documents_op.FEW)]]
    cases = [few, [*few, tag(1, name="other")], many, [*many, tag(1, name="other")]]
    frame = documents_op.parse_media(documents(*[media(1, tags=tags) for tags in cases]))
    found = {r.seq: r.reason for r in frame.collect()}
    assert [found[i] for i in range(4)] == [None, "tag conflict"] * 2


def test_searches_of_whole_documents_begin_with_a_word(documents):
    """Those that begin with a quote or a class look at every character."""
    for parse in (documents_op.parse_media, documents_op.parse_lists):
        plan = parse(documents("{}"))._jdf.queryExecution().optimizedPlan().toString()
        assert "null(?=" in plan and '"(\\w+)"' not in plan and '"(?:episodes' not in plan


def test_documents_are_parsed_and_judged_in_compiled_steps(documents):
    """What stands inside a generator is not compiled, so it only passes on a column."""
    for parse in (documents_op.parse_media, documents_op.parse_lists):
        plan = parse(documents("{}"))._jdf.queryExecution().optimizedPlan().toString().splitlines()
        found = [line for line in plan if "Generate explode" in line]
        assert len(found) == 1 and "Generate explode(array(reason#" in found[0]


def test_viewers_are_whole_numbers_and_no_texts(documents):
    from conftest import entry, lists

    users = [5, -0, 2147483647, "5", 5.0, 2147483648, True, None, {"a": 1}]
    docs = documents(*[lists([[entry(1, user=u)]]) for u in users], lists([[entry(1, user=7), entry(2, user="8")]]))
    found = {r.seq: (r.reason, r.ext_user_id) for r in documents_op.parse_lists(docs).collect()}
    assert [found[i] for i in range(3)] == [(None, 5), (None, 0), (None, 2147483647)]
    assert [found[i] for i in range(3, len(users))] == [("no viewer", None)] * 6
    assert found[len(users)] == (None, 7)
