import numpy as np
import pytest
from mediashelf.llm import vector_dedup


def brute(rows, least=0.93):
    root = {r[0]: r[0] for r in rows}
    links = dict.fromkeys(root, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def usable(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    fine = [(i, np.array(v, float), lab) for i, v, lab in rows if usable(v) and lab is not None]
    for i, v, lab in fine:
        for j, w, other in fine:
            if i < j and lab == other and len(v) == len(w):
                if v @ w / np.sqrt((v @ v) * (w @ w)) >= least:
                    links[i] += 1
                    links[j] += 1
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return sorted((i, links[i], find(i), find(i) == i) for i in root)


@pytest.mark.parametrize("bucket,block", [(1024, 2048), (16, 2048), (16, 7)])
def test_links_and_components(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(vector_dedup, "BUCKET", bucket)
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rng, vectors = np.random.default_rng(7), []
    for spread in (0.02, 0.03, 0.04, 0.05):
        centre = rng.standard_normal(32)
        centre /= np.linalg.norm(centre)
        vectors += [(centre + spread * rng.standard_normal(32)).tolist() for _ in range(25)]
    vectors += [rng.standard_normal(32).tolist() for _ in range(60)]
    vectors += [vectors[0]] * 5 + [(np.array(vectors[1]) * 3).tolist()]
    rows = [(i + 10, v, int(i % 10 == 0)) for i, v in enumerate(vectors)]
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 32, 1), (503, [None] + [1.0] * 31, 1), (508, vectors[2], None),
             (504, [float("nan")] * 32, 1), (505, [float("inf")] * 32, 1), (506, [1.0, 2.0], 1), (507, [1.0, 2.1], 1)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, label int, size int")
    found = vector_dedup.near_vectors(frame)
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_missing_ids_and_empty_table(spark):
    frame = spark.createDataFrame([(None, [1.0], 1), (1, [1.0], 1)], "vec_id bigint, embedding array<float>, label int")
    assert sorted(map(tuple, vector_dedup.near_vectors(frame).collect()), key=repr) == [
        (1, 0, 1, True), (None, 0, None, True)]
    assert vector_dedup.near_vectors(frame.where("label = 9")).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = vector_dedup.unit(rng.standard_normal((400, 64)))
    y = vector_dedup.unit(x + 0.2 * vector_dedup.unit(rng.standard_normal((400, 64))))
    signs, factors = vector_dedup.encode(x)
    turned = y @ vector_dedup.rotation(64, 0).T
    found = np.diag(vector_dedup.estimates(signs, factors, turned))
    true = (x * y).sum(axis=1)
    assert abs((found - true).mean()) < 0.01
    assert (found + vector_dedup.bounds(factors, 64, 0.93) >= 0.93)[true >= 0.93].all()


def test_coarse_vectors_lose_no_pair_that_whole_ones_bring():
    rng = np.random.default_rng(2)
    x = vector_dedup.unit(rng.standard_normal((300, 64)))
    x = np.concatenate([x, vector_dedup.unit(x + 0.35 * vector_dedup.unit(rng.standard_normal((300, 64))))])
    signs, factors = vector_dedup.encode(x)
    turned = x @ vector_dedup.rotation(64, 0).T
    middles, steps = vector_dedup.coarse(turned)
    rough = vector_dedup.restored(middles, steps)
    assert (np.abs(rough - turned) <= steps[:, None] / 2 * (1 + 1e-9)).all()
    assert ((rough >= 0) == signs).all()
    every, slack = np.arange(len(x)), vector_dedup.bounds(factors, 64, 0.93)
    whole = vector_dedup.may_reach(signs, factors, slack, turned, steps * 0, every, every, 0.93)
    found = vector_dedup.may_reach(signs, factors, slack, rough, steps, every, every, 0.93)
    assert (found | ~whole).all()
    assert found[np.arange(300), np.arange(300, 600)][(x[:300] * x[300:]).sum(axis=1) >= 0.93].all()


@pytest.mark.parametrize("bits,tables", [(0, 1), (3, 13), (9, 41)])
def test_keys_are_packed(bits, tables):
    keys = np.random.default_rng(3).integers(0, 1 << bits, (50, tables))
    packed = vector_dedup.packed_keys(keys, bits)
    assert packed.shape[1] == -(-bits * tables // 8)
    if bits:
        assert (vector_dedup.unpacked_keys(packed, bits, tables) == keys).all()
    assert len(vector_dedup.packed_keys(keys[:0], bits)) == 0


def test_rows_that_repeat(spark):
    """Rows equal in id, label and vector are copies of each other; an id may have two vectors."""
    rows = [(1, [1.0, 0.0], 1)] * 2 + [(2, [0.0, 1.0], 1), (1, [0.0, 1.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found = sorted(map(tuple, vector_dedup.near_vectors(frame).collect()))
    assert found == [(1, 1, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_more_tables_for_larger_labels():
    assert vector_dedup.plan(500, 0.93) == (0, 1)
    bits, tables = vector_dedup.plan(10**6, 0.93)
    assert bits == 10 and (1 - 0.88 ** 10) ** tables < 1e-5
