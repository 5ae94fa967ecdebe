import random
import re

import numpy as np
import pytest
from mediashelf.llm import near_dedup
from mediashelf.llm.common import components


def shingles(text, words):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return frozenset(tuple(found[i:i + words]) for i in range(max(1, len(found) - words + 1))) if found else frozenset()


def brute(rows, words, percent=80):
    sets = {i: shingles(t, words) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def family(rng, size, n, edits):
    base = [f"w{rng.randint(0, 4000)}" for _ in range(size)]
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(size)] = f"v{rng.randint(0, 10**6)}"
        yield " ".join(text)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one\xa0two"), (7, "a b c"), (8, "a b c")]


@pytest.mark.parametrize("words,limit,shingles", [(4, 2_048, 2_000_000), (5, 8, 2_000), (5, 2, 200)])
def test_components(spark, monkeypatch, words, limit, shingles):
    """Whole nodes, and crowded nodes in blocks and branches with sets cut into parts."""
    monkeypatch.setattr(near_dedup, "NODE_LIMIT", limit)
    monkeypatch.setattr(near_dedup, "NODE_SHINGLES", shingles)
    rng, rows = random.Random(5), list(ODD)
    for size, n, edits in [(200, 25, 12), (80, 30, 3), (60, 12, 9), (30, 8, 1), (400, 6, 30)]:
        rows += list(enumerate(family(rng, size, n, edits), len(rows) + 1))
    rows += [(len(rows) + 1, rows[20][1].upper()), (len(rows) + 2, "common line here now " + rows[30][1])]
    docs = spark.createDataFrame([(i, t, "n", 3) for i, t in rows], "doc_id bigint, text string, node string, a int")
    found = near_dedup.near_duplicates(docs, words=words)
    assert sorted(map(tuple, found.collect())) == brute(rows, words)


def test_repeated_ids_are_judged_by_their_own_texts(spark):
    rows = [(5, "a b c d e f"), (5, "g h i j k l"), (9, "A b c d e f"), (9, "A b c d e f"), (None, "g h i j k l")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = near_dedup.near_duplicates(docs).select("doc_id", "component_id", "kept").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(
        [(5, 5, True), (5, 5, True), (9, 5, False), (9, 5, False), (None, None, True)], key=repr)
    left = near_dedup.one_of_each(docs).collect()
    assert sorted(map(tuple, left), key=repr) == sorted([(5, "a b c d e f"), (5, "g h i j k l"), (None, "g h i j k l")], key=repr)


def test_one_of_rows_that_share_the_smallest_id(spark):
    rows = [(1, "a b c d e f"), (1, "A b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = near_dedup.one_of_each(docs).collect()
    assert len(left) == 1 and left[0].doc_id == 1


def test_one_of_each_keeps_columns_and_rows_without_id(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (3, "other words stand here now ok"),
            (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, id string, digest string")
    left = near_dedup.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=repr) == [1, 3, 4, 4, 5, None]


def test_links_join_what_all_links_join():
    rng = np.random.default_rng(2)
    base = rng.integers(1, 1 << 60, 100, dtype=np.uint64)
    sets = []
    for i in range(120):
        edited = base.copy()
        edited[rng.integers(0, 100, rng.integers(0, 25))] = rng.integers(1, 1 << 60)
        sets.append(np.unique(edited))
    root = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = len(np.intersect1d(x, y))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                root = [root[j] if r == root[i] else r for r in root]
    links = near_dedup.linked(sets, 80)
    assert len(links) == len(sets) - len(set(root)) and all(root[i] == root[j] for i, j in links)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_dedup.near_duplicates(docs).count() == 0


def test_tokens_estimate_similarity():
    x, y = np.arange(1, 1001, dtype=np.uint64), np.arange(101, 1101, dtype=np.uint64)
    mixed = [near_dedup._mixed(v * near_dedup._GOLDEN) for v in (x, y)]
    tokens = near_dedup.tokens_of(mixed)
    assert abs((tokens[0] == tokens[1]).mean() - 900 / 1100) < 0.2


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)]
    edges += [(200, 201), (201, 202), (202, 200), (300, 300)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    found = dict(map(tuple, components(frame).collect()))
    want = {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 140)} | {i: 200 for i in (200, 201, 202)}
    assert found == want


def test_chance_to_miss_a_pair():
    assert near_dedup.missed(0.8, 0) == pytest.approx(0.2 ** near_dedup.TREES)
    assert near_dedup.missed(0.8, 2) < 0.00001 and near_dedup.missed(0.8, 6) < 0.0025
    for similarity in (0.85, 0.9, 0.95):
        assert all(near_dedup.missed(similarity, k) < 0.01 for k in range(17))


def planted(rng, n, crowd):
    """Pairs at 0.80 to 0.85 among documents that all share a passage, so that nodes are crowded."""
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for pair in range(n):
        own = [f"w{rng.randrange(10**9)}" for _ in range(60)]
        rows.append((2 * pair, " ".join(passage + own)))
        rows.append((2 * pair + 1, " ".join(passage + own[:-12] + [f"x{rng.randrange(10**9)}" for _ in range(12)])))
    rows += [(2 * n + i, " ".join(passage + [f"c{rng.randrange(10**9)}" for _ in range(60)])) for i in range(crowd)]
    return rows


def test_recall_of_planted_pairs_in_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "NODE_LIMIT", 32)
    rows = planted(random.Random(9), 400, 1_200)
    x, y = (shingles(t, 5) for _, t in rows[:2])
    assert 0.80 <= len(x & y) / len(x | y) <= 0.85
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    component = {r.doc_id: r.component_id for r in found.collect()}
    assert sum(component[2 * i + 1] == 2 * i for i in range(400)) >= 396
    assert all(component[2 * i] == 2 * i for i in range(400)) and all(component[i] == i for i in range(800, 2_000))
