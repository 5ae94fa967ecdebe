import random

import numpy as np
import pytest
from mediashelf.llm import fill_in_middle as fim

ODD = [(1, None), (2, ""), (3, "a"), (4, "has <P> in it"), (5, "has <M"), (6, "é日😀" * 70_000), (7, "same"), (7, "same"),
       (None, "no id"), (8, "<"), (9, "<S>"), (10, "\x00\n\t")]


def plainly(doc_id, text):
    text = text or ""
    h1, h2, h3, h4 = fim.draws(doc_id)
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_rows_equal_slicing_and_are_restored(spark):
    rng, rows = random.Random(4), list(ODD)
    rows += [(i, "".join(rng.choices("ab<PSM>é日😀 ", k=rng.randint(0, 60)))) for i in range(100, 1_100)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, output string, n string")
    found = fim.with_restored(fim.fill_in_middle(docs)).collect()
    got = sorted([(r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found], key=repr)
    assert got == sorted([(i, *plainly(i, t)) for i, t in rows], key=repr)
    assert sorted((repr(r.id), r.restored) for r in found) == sorted((repr(i), t or "") for i, t in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert fim.with_restored(fim.fill_in_middle(docs)).count() == 0


@pytest.mark.parametrize("scratch", [1, 3, 1 << 16])
def test_rotation_exchanges_neighbours_in_place(monkeypatch, scratch):
    monkeypatch.setattr(fim, "SCRATCH", scratch)
    rng = np.random.default_rng(1)
    for _ in range(300):
        data = rng.integers(0, 256, rng.integers(0, 40)).astype(np.uint8).tobytes()
        a, m, b = sorted(rng.integers(0, len(data) + 1, 3).tolist())
        buffer = bytearray(data)
        fim.rotate(buffer, a, m, b)
        assert bytes(buffer) == data[:a] + data[m:b] + data[a:m] + data[b:]
        fim.rotate(buffer, a, a + b - m, b)
        assert bytes(buffer) == data
