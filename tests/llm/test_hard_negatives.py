import math
import random

import numpy as np
import pytest
from mediashelf.llm import hard_negatives as hard
from pyspark.sql import functions as F


def brute(rows, most=5, percent=80, every=10):
    kept = []
    for at, (key, vector, label) in enumerate(rows):
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(256 * x) for x in vector]
        if sum((abs(256 * x) + 1) ** 2 for x in vector) < hard.LONGEST:
            kept.append((key, whole, label, at))
    out = []
    for key, v, label, _ in kept:
        if key % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), k, lab == label) for k, w, lab, _ in kept if len(w) == len(v) and k != key]
        for p, positive, _ in sorted(s for s in scored if s[2])[:most]:
            near = sorted(s for s in scored if not s[2] and 80 * -p <= 100 * -s[0] <= 100 * -p)[:most]
            out += [(key, positive, r + 1, k, -p, -s) for r, (s, k, _) in enumerate(near)]
    return sorted(out)


def clustered(rng, n, size):
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(6)]
    for i in range(n):
        c = rng.choice(centres)
        yield i, [x / 4 + rng.gauss(0, 0.05) for x in c], rng.randrange(4)


ODD = [(None, [1.0, 1.0], 1), (1_000, None, 1), (1_001, [1.0, None], 1), (1_002, [float("nan"), 1.0], 1),
       (1_003, [float("inf"), 1.0], 1), (1_004, [1.0, 1.0], None), (1_010, [], 1), (1_011, [], 2), (1_012, [], 1),
       (1_020, [0.0, 0.0], 1), (1_021, [0.0, 0.0], 1), (1_022, [0.0, 0.0], 2), (1_030, [1e30, 1.0], 1),
       (1_040, [1e5, 1.0], 1), (1_041, [1e5, 2.0], 1), (1_042, [9e4, 1.0], 2)]


@pytest.mark.parametrize("block,batch,page", [(1_024, 256, 256), (7, 3, 2)])
def test_equals_brute_force(spark, monkeypatch, block, batch, page):
    for name, value in (("BLOCK", block), ("BATCH", batch), ("PAGE", page)):
        monkeypatch.setattr(hard, name, value)
    rng = random.Random(3)
    rows = [*clustered(rng, 300, 6), *ODD]
    rows += [(300 + i, list(rows[20][1]), i % 3) for i in range(40)]  # one vector many times
    rows += [rows[20], rows[21], (20, rows[22][1], 2)]  # repeated rows and ids
    data = [(k, v, lab, "x") for k, v, lab in rows]
    vectors = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label int, key string")
    found = hard.hard_negatives(vectors, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_empty_table_and_no_anchor(spark):
    shape = "vec_id bigint, embedding array<float>, label int"
    for rows in ([], [(1, [1.0], 1), (2, [1.0], 2)]):
        assert hard.hard_negatives(spark.createDataFrame(rows, shape), F.col("vec_id") % 10 == 0).count() == 0


def test_curve_visits_neighbours():
    cells = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    keys = hard.hilbert_keys(cells, 3)
    assert len(set(keys)) == len(cells)
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_all_products():
    rng = np.random.default_rng(5)
    a, x = rng.integers(-300, 300, (50, 8)), rng.integers(-300, 300, (40, 8))
    least, greatest = hard.reach(a, x.min(axis=0)[None], x.max(axis=0)[None])
    scores = hard.products(a, x)
    assert (scores >= least).all() and (scores <= greatest).all()


def test_least_share(spark):
    values = [0, 1, 5, 99, 100, 101, 4 * 10**18, -1, -100, -101]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", hard._share(F.col("v"), 80).alias("s")).collect()
    assert {r.v: r.s for r in rows} == {v: -((-80 * v) // 100) for v in values}
