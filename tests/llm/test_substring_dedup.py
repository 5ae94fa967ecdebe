import hashlib
import random
import tempfile
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from mediashelf.llm import anchors, induced, substring_dedup


@pytest.mark.parametrize("memory,base", [(64, 0), (64, 3), (1 << 20, 0), (1 << 20, 1 << 20)])
def test_suffix_order(memory, base):
    rng = random.Random(memory + base)
    for case in range(150):
        top = rng.choice([2, 3, 5, 50, 3000])
        text = [rng.randint(1, top) for _ in range(rng.randint(1, 60))]
        text = (text * 2 if case % 3 else [text[0]] * 20 + text) + [0]
        with tempfile.TemporaryDirectory() as folder:
            found = induced.suffix_order(np.array(text), top, 10**6, induced.Space(folder, memory), base)
        assert found.tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def brute_marks(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    return [[i + length <= len(t) and seen[t[i:i + length]] > 1 for i in range(len(t))] for t in texts]


def texts_of(rng):
    alphabet, texts = rng.choice([b"a", b"ab", b"abcd", bytes(range(256))]), []
    for _ in range(rng.randint(0, 8)):
        if texts and rng.random() < 0.5:
            old = rng.choice(texts)
            cut = rng.randint(0, len(old))
            texts.append(old[cut:] + bytes(rng.choices(alphabet, k=rng.randint(0, 9))) + old[:cut])
        else:
            texts.append(bytes(rng.choices(alphabet, k=rng.randint(0, 80))))
    return texts


@pytest.mark.parametrize("memory,base", [(100, 0), (100, 5), (1 << 20, 1 << 20)])
def test_repeated_strings(memory, base):
    rng = random.Random(memory + base)
    for _ in range(100):
        texts, length = texts_of(rng), rng.choice([1, 2, 5, 17, 40])
        found = [m.tolist() for m in induced.repeated_in(iter(texts), length, memory, base)]
        assert found == brute_marks(texts, length)


def test_anchors_cover_every_string_and_depend_on_it_alone():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 5000, dtype=np.uint8)
    data[3000:3700] = data[100:800]
    found, first, last = anchors.contexts(data, 100)
    chosen = np.repeat(found, last - first + 1)
    assert len(chosen) == len(data) - 99
    assert (chosen[100:701] == chosen[3000:3601]).all()
    assert anchors.contexts(data[:99], 100)[0].size == 0


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    marks = brute_marks([t for _, t in data], length)
    out = []
    for (i, t), starts in zip(data, marks):
        gone = [any(starts[max(0, k - length + 1):k + 1]) for k in range(len(t))]
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limits", [{}, {"crowd": 1}, {"memory": 500, "base": 5, "shard_bytes": 300}])
def test_summary(spark, limits):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 7)))
    shared = [" ".join(word() for _ in range(30)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "short"), (4, "z" * 300), (5, "y" * 60), (None, shared[0])]
    for i in range(10, 60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 20))), rng.choice(shared),
                 " ".join(word() for _ in range(rng.randint(0, 20)))]
        rows.append((i, " ".join(parts)))
    rows += [(70, rows[10][1]), (70, rows[10][1]), (71, rows[11][1] + "!")]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id bigint, text string, h int, spans int")
    found = substring_dedup.summary(docs, length=50, **limits)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, 50)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert substring_dedup.summary(docs).count() == 0


def test_spans_are_merged_where_they_touch():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(7)
    for _ in range(50):
        spans = [(int(a), int(a + n)) for a, n in zip(rng.integers(0, 200, 20), rng.integers(1, 20, 20))]
        batch = pa.RecordBatch.from_pylist([{"id": 1, "d": 2, "spans": [{"a": a, "b": b} for a, b in spans]}])
        (found,) = substring_dedup._merged(iter([batch]))
        held, ends = set(), set()
        for s in found.column(2)[0].as_py():
            held |= set(range(s["begin"], s["end"]))
            assert s["begin"] not in ends
            ends.add(s["end"])
        assert held == {i for a, b in spans for i in range(a, b)}


def test_a_shard_takes_little_memory():
    rng = np.random.default_rng(5)
    pieces = [rng.integers(97, 123, 672).astype(np.uint8).tobytes() for _ in range(substring_dedup.SHARD_BYTES // 672)]
    tracemalloc.start()
    try:
        assert not any(marks.any() for marks in induced.repeated_in(iter(pieces), 400))
        assert tracemalloc.get_traced_memory()[1] < 128 << 20
    finally:
        tracemalloc.stop()
