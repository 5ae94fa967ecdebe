import hashlib

import numpy as np
from mediashelf.llm import exact_dedup


def plain(data, lane):
    value = 0
    for byte in bytes(data):
        value = (value * exact_dedup.BASES[lane] + byte) % exact_dedup.MODULI[lane]
    return value


def test_fingerprints_are_polynomials_and_compose():
    data = np.random.default_rng(1).integers(0, 256, 9000, dtype=np.uint8)
    starts, ends = np.array([0, 0, 7, 100, 256, 0, 40]), np.array([0, 1, 300, 612, 768, 9000, 40])
    found = exact_dedup.fingerprints(data, starts, ends)
    for lane in (0, 1):
        assert found[lane].tolist() == [plain(data[a:b], lane) for a, b in zip(starts, ends)]
        left, right = plain(data[:5000], lane), plain(data[5000:], lane)
        assert exact_dedup.combine([left], [right], [4000], lane).tolist() == [plain(data, lane)]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[lowered(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 200_000),
        (8, "X" * 200_000), (9, "x" * 199_999 + "y"), (10, "ba"), (10, "ba"), (None, "lone")]


def test_groups_with_nulls_ties_long_texts_and_other_columns(spark):
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in ROWS],
                                 "doc_id bigint, text string, fp int, keep_id string")
    assert sorted(map(tuple, exact_dedup.duplicate_groups(docs).collect()), key=repr) == brute(ROWS)
    left = exact_dedup.without_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id) == [2, 4, 5, 6, 8, 9, 10]


def test_one_row_of_each_text_with_repeated_and_missing_ids(spark):
    rows = [(5, "a"), (5, "b"), (9, "a"), (9, "a"), (9, "A"), (None, "a"), (None, "c"), (None, "C"), (None, "c"), (7, None), (7, ""), (7, None)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, id string, digest string")
    left = [(r.doc_id, r.text) for r in exact_dedup.without_copies(docs).collect()]
    assert sorted((i or 0, lowered(t)) for i, t in left) == [(0, "c"), (5, "b"), (7, ""), (9, "a")]


def test_many_missing_ids_and_very_long_texts(spark):
    """What is compared is found by its text, and chunks are cut in one pass."""
    many = spark.range(40_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat('t', id % 9) AS text")
    long = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "doc_id bigint, n int").selectExpr(
        "doc_id", "concat(repeat('lorem ipsum ', 1500000), n) AS text")
    found = exact_dedup.duplicate_groups(many.unionByName(long)).groupBy("keep_id", "group_size").count().collect()
    sizes = [40_000 // 9 + (i < 40_000 % 9) for i in range(9)]
    want = {(None, n): n * sizes.count(n) for n in sizes} | {(2, 2): 2, (3, 1): 1}
    assert {(r.keep_id, r.group_size): r["count"] for r in found} == want


def test_colliding_fingerprints_are_told_apart(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    found = exact_dedup.duplicate_groups(docs, keep_bits=1)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(ROWS)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert exact_dedup.duplicate_groups(docs).count() == 0
