import random

import numpy as np
import pytest
from mediashelf.operators.lookups import COLUMN_BYTES, size_of
from mediashelf.plans import recommend
from mediashelf.session import new_scratch
from pyspark.sql import functions as F
from workload import inputs


@pytest.fixture(scope="module")
def scored(spark):
    """Scores of all customers and parts, a fifth of them held out."""
    lines = inputs.line_entries(spark, "/root/testdata/sf0.001").groupBy(
        F.col("ext_user_id").alias("user"), F.col("ext_media_id").alias("item")).agg(
        F.avg(F.col("discount") * 100).alias("score"))
    rows = [tuple(r) for r in lines.orderBy("user", "item").collect()]
    held = [i % 5 == 0 for i in range(len(rows))]
    return [r for r, h in zip(rows, held) if not h], [r for r, h in zip(rows, held) if h]


def test_factors_equal_plain_iterations_and_beat_item_means(spark, scored):
    train, test = scored
    entries = spark.createDataFrame(train, "user bigint, item bigint, score double")
    users, media, mean = recommend.factors(entries, rank=3, shrink=0.5, rounds=3)
    items = sorted({i for _, i, _ in train})
    begin = spark.createDataFrame([(i,) for i in items], "id bigint").select(
        "id", recommend.hashed_start(F.col("id"), 3).alias("factor")).collect()
    v = {r.id: np.array(r.factor) for r in begin}
    average = np.mean([s for *_, s in train])
    assert mean == pytest.approx(average)

    def solve(known, of, by):
        out = {}
        groups = {}
        for row in train:
            groups.setdefault(row[of], []).append((known[row[by]], row[2] - average))
        for key, parts in groups.items():
            a = sum(np.outer(f, f) for f, _ in parts) + 0.5 * len(parts) * np.eye(3)
            out[key] = np.linalg.solve(a, sum(f * r for f, r in parts))
        return out

    for _ in range(3):
        u = solve(v, 0, 1)
        v = solve(u, 1, 0)
    for frame, want in ((users, u), (media, v)):
        found = {r.id: r.factor for r in frame.collect()}
        assert found.keys() == want.keys()
        assert all(np.allclose(found[k], want[k], atol=1e-6) for k in want)
    users, media, mean = recommend.factors(entries)
    pairs = spark.createDataFrame(test, "user bigint, item bigint, score double")
    error = recommend.predicted(pairs, users, media, mean).agg(F.avg((F.col("score") - F.col("predicted")) ** 2)).first()[0]
    by_item = {}
    for _, i, s in train:
        by_item.setdefault(i, []).append(s)
    plain = np.mean([(s - (np.mean(by_item[i]) if i in by_item else average)) ** 2 for _, i, s in test])
    assert error < plain


def test_nulls_strangers_and_no_entries(spark):
    shape = "user bigint, item bigint, score double"
    rows = [(1, 1, 5.0), (1, 2, 3.0), (2, 1, None), (None, 1, 2.0), (3, None, 1.0)]
    users, media, mean = recommend.factors(spark.createDataFrame(rows, shape), rank=2, rounds=1)
    assert [r.id for r in users.collect()] == [1] and sorted(r.id for r in media.collect()) == [1, 2] and mean == 4.0
    told = recommend.predicted(spark.createDataFrame([(9, 1), (1, 9)], "user bigint, item bigint"), users, media, mean)
    assert [r.predicted for r in told.collect()] == [4.0, 4.0]
    users, media, mean = recommend.factors(spark.createDataFrame([], shape), rank=2, rounds=1)
    assert (users.count(), media.count(), mean) == (0, 0, 0.0)


@pytest.mark.parametrize("n_users,n_items", [(1_024, 4_096), (7, 11)])
def test_best_unseen_with_ties(spark, monkeypatch, n_users, n_items):
    monkeypatch.setattr(recommend, "USERS", n_users)
    monkeypatch.setattr(recommend, "ITEMS", n_items)
    rng = random.Random(1)
    users = {i: [float(rng.randint(-2, 2)) for _ in range(3)] for i in range(40)}
    items = {i: [float(rng.randint(-2, 2)) for _ in range(3)] for i in range(60)}
    seen = {(rng.randrange(45), rng.randrange(65)) for _ in range(900)} | {(0, i) for i in range(60)}
    frames = [spark.createDataFrame(list(side.items()), "id bigint, factor array<double>") for side in (users, items)]
    found = recommend.best_unseen(*frames, spark.createDataFrame(sorted(seen), "user bigint, item bigint"), 4)
    want = []
    for u, f in users.items():
        best = sorted((-sum(a * b for a, b in zip(f, g)), i) for i, g in items.items() if (u, i) not in seen)[:4]
        want += [(u, i, -s, r + 1) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, found.collect())) == sorted(want)


@pytest.mark.parametrize("scale", [1.0, 0.0])
def test_best_unseen_in_bands_equals_all_pairs(spark, monkeypatch, scale):
    for name, value in {"USERS": 13, "ITEMS": 9, "HEAD": 20, "SCORES": 40, "LANES": 2}.items():
        monkeypatch.setattr(recommend, name, value)
    rng = random.Random(2)
    # whole numbers of very different lengths, so that many users are done after the first band
    users = {i: [float(rng.randint(-3, 3)) for _ in range(2)] for i in range(60)}
    items = {i: [float(rng.randint(-3, 3)) * scale * rng.choice([1, 1, 9]) for _ in range(2)] for i in range(300)}
    seen = {(rng.randrange(70), rng.randrange(310)) for _ in range(1500)} | {(0, i) for i in range(300)}
    frames = [spark.createDataFrame(list(side.items()), "id bigint, factor array<double>") for side in (users, items)]
    found = recommend.best_unseen(*frames, spark.createDataFrame(sorted(seen), "user bigint, item bigint"), 4)
    want = []
    for u, f in users.items():
        best = sorted((-sum(a * b for a, b in zip(f, g)), i) for i, g in items.items() if (u, i) not in seen)[:4]
        want += [(u, i, -s, r + 1) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_factors_keep_two_tables_and_parts_change_nothing(spark, monkeypatch, tmp_path, scored):
    entries = spark.createDataFrame(scored[0], "user bigint, item bigint, score double")
    found = []
    for k, sizes in enumerate(({}, {"PART": 1 << 10, "HOT": 8})):
        for name, value in sizes.items():
            monkeypatch.setattr(recommend, name, value)
        monkeypatch.setattr("mediashelf.session.scratch_root", lambda spark: f"{tmp_path}/{k}")
        users, media, mean = recommend.factors(entries, rank=3, rounds=2)
        found.append([mean, *({r.id: r.factor for r in side.collect()} for side in (users, media))])
        left = [p.name.rsplit("-", 1)[0] for p in (tmp_path / str(k)).iterdir()]
        assert sorted(n for n in left if n != "hot") == ["factors-item", "factors-user"]
    one, parts = found
    assert one[0] == parts[0]
    for a, b in zip(one[1:], parts[1:]):
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-9) for k in a)


@pytest.mark.parametrize("n_users", [8, 500])
def test_best_unseen_moves_few_rows(spark, monkeypatch, n_users):
    """Users travel once a stripe and media once a group, whatever the number of blocks."""
    for name, value in {"USERS": 64, "ITEMS": 8, "HEAD": 100}.items():
        monkeypatch.setattr(recommend, name, value)
    rng, moved = random.Random(4), []
    of_frame = type(spark.range(0))
    monkeypatch.setattr(of_frame, "mapInArrow", lambda self, *a, f=of_frame.mapInArrow: (
        moved.append(sum(r["n"] for r in self.select(sum(
            F.coalesce(F.size(c), F.lit(0)) for c in ("users", "items")).alias("n")).collect())), f(self, *a))[1])
    users = {i: [rng.gauss(0, 1) for _ in range(3)] for i in range(n_users)}
    items = {i: [rng.gauss(0, 1) for _ in range(3)] for i in range(1_000)}
    frames = [spark.createDataFrame(list(side.items()), "id bigint, factor array<double>") for side in (users, items)]
    found = recommend.best_unseen(*frames, spark.createDataFrame([(0, 0)], "user bigint, item bigint"), 3)
    want = {(u, i) for u, f in users.items() for i in sorted(
        (i for i in items if (u, i) != (0, 0)), key=lambda i: -sum(a * b for a, b in zip(f, items[i])))[:3]}
    assert {(r.user, r.item) for r in found.collect()} == want
    assert sum(moved) <= 9 * n_users + 16 * len(items)


def test_groups_of_users_come_one_after_the_other(spark, monkeypatch):
    for name, value in {"USERS": 10, "ITEMS": 9, "HEAD": 20, "SCORES": 40, "MEETING": 1, "STRIPE": 2}.items():
        monkeypatch.setattr(recommend, name, value)
    rng = random.Random(5)
    users = {i: [float(rng.randint(-3, 3)) for _ in range(2)] for i in range(50)}
    items = {i: [float(rng.randint(-3, 3)) * rng.choice([1, 9]) for _ in range(2)] for i in range(100)}
    seen = {(rng.randrange(50), rng.randrange(100)) for _ in range(600)}
    frames = [spark.createDataFrame(list(side.items()), "id bigint, factor array<double>") for side in (users, items)]
    found = recommend.best_unseen(*frames, spark.createDataFrame(sorted(seen), "user bigint, item bigint"), 4)
    want = []
    for u, f in users.items():
        best = sorted((-sum(a * b for a, b in zip(f, g)), i) for i, g in items.items() if (u, i) not in seen)[:4]
        want += [(u, i, -s, r + 1) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_factors_without_a_number_meet_nothing(spark):
    shape = "id bigint, factor array<double>"
    users = spark.createDataFrame([(1, [1.0, 2.0]), (2, [None, 1.0]), (3, None)], shape)
    media = spark.createDataFrame([(i, [float(i), None if i > 5 else 1.0]) for i in range(12)], shape)
    found = recommend.best_unseen(users, media, spark.createDataFrame([(1, 5), (None, 4)], "user bigint, item bigint"), 2)
    assert sorted(map(tuple, found.collect())) == [(1, 3, 5.0, 2), (1, 4, 6.0, 1)]


def test_sizes_count_array_elements(spark):
    one = spark.createDataFrame([(1, [1.0]), (2, None)], "id bigint, factor array<double>")
    many = spark.createDataFrame([(1, [1.0] * 101), (2, None)], "id bigint, factor array<double>")
    assert size_of(many) - size_of(one) == 100 * COLUMN_BYTES


def test_replacing_keeps_others_and_can_be_repeated(spark):
    path = new_scratch(spark, "stored")
    shape = "viewer_id bigint, media_id bigint, score int"
    old = [(v, m, v + m) for v in range(20) for m in range(3)]
    recommend.store_recommendations(spark.createDataFrame(old, shape), path, 4)
    viewers = spark.createDataFrame([(v,) for v in (1, 2, 3, 99, None)], "viewer_id bigint")
    made = [(1, 7, 70), (2, 8, 80), (99, 9, 90), (5, 5, 55)]
    want = sorted([r for r in old if r[0] not in (1, 2, 3)] + made[:3])
    for _ in range(2):
        recommend.replace_recommendations(path, viewers, spark.createDataFrame(made, shape), 4)
        assert sorted(map(tuple, recommend.read_recommendations(spark, path).collect())) == want
    everyone = spark.createDataFrame([(v,) for v in range(100)], "viewer_id bigint")
    recommend.replace_recommendations(path, everyone, spark.createDataFrame([], shape), 4)
    assert recommend.read_recommendations(spark, path).count() == 0
