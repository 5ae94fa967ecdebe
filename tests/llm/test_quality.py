import math
import zlib

import numpy as np
import pytest
import zstandard
from mediashelf.llm import quality
from mediashelf.llm.queries import QUERIES, quality_model
from pyspark.sql import functions as F


def test_held_out_documents_are_told_apart(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = QUERIES["op3_quality"](spark, sf).where("held_out").join(labels, "doc_id").toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    wins = (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None, :]).mean()
    assert wins > 0.9
    assert (good.predicted == 1).mean() > 0.95 and (bad.predicted == 0).mean() > 0.7


WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru") for b in ("no", "te", "sa", "vi")]
GOOD = " ".join(np.random.default_rng(9).choice(WORDS, 80))


@pytest.fixture(scope="module")
def learned(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(WORDS, 80)) if i % 3 else f"{rng.choice(WORDS)}!! " * 80, int(i % 3 > 0))
            for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    return quality.fit(frame, frame.select("doc_id", "quality"))


def test_scores_with_nulls_empty_and_long_texts(spark, learned):
    rows = [(1, None, 1), (2, "", 1), (None, GOOD, 0), (3, "vi!! " * 50_000, 1), (3, "vi!! " * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    found = sorted(quality.score(docs, learned).collect(), key=lambda r: r.id or 0)
    assert len(found) == 5 and all(0 <= r.score <= 1 for r in found)
    assert found[1].score == found[2].score == pytest.approx(learned.prior)
    assert found[0].score > 0.5 > found[3].score == found[4].score
    kept = quality.keep_good(docs, learned)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 2, None]


def test_without_labels_or_with_one_class(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r.score for r in quality.score(docs, quality.fit(docs, none)).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1), (2, 1), (3, None), (None, 0)], "doc_id bigint, quality int")
    assert [r.score for r in quality.score(docs, quality.fit(docs, one)).collect()] == [1.0, 1.0]
    assert quality.score(docs.where(F.lit(False)), quality.fit(docs, none)).count() == 0


def test_scores_mean_the_same_at_every_length(learned):
    rng = np.random.default_rng(4)
    good = " ".join(rng.choice(WORDS, 2_000)).encode() + b" "
    bad = b"".join(f"{w}!! ".encode() * 80 for w in rng.choice(WORDS, 30))
    one, *more = quality.scores_of([good * n for n in (1, 2, 5, 20)], learned)
    assert one > 0.5 and more == pytest.approx([one] * 3, abs=0.02)
    one, *more = quality.scores_of([bad * n for n in (1, 2, 5, 20)], learned)
    assert one < 0.5 and more == pytest.approx([one] * 3, abs=0.02)
    x, y = quality.features([good + bad, bad + good], learned.good, learned.bad)
    assert x == pytest.approx(y, abs=0.01)


@pytest.mark.parametrize("letter", ["a", "é", "日", "𠀀"])
def test_pieces_are_the_whole_text_cut_between_characters(letter):
    for n in (0, 1, 1_999, 2_000, 2_001, 9_000):
        cut = list(quality._pieces((letter * n).encode()))
        assert [len(p.decode()) for p in cut] == [2_000] * (n // 2_000) + [n % 2_000] * (n % 2_000 > 0)
    odd = b"\x80" * 30_000 + b"\xff" * 30_000
    assert b"".join(quality._pieces(odd)) == odd


def test_very_long_labelled_texts_leave_room_for_the_others(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_PIECES", 120)
    rng, learnt = np.random.default_rng(6), []
    monkeypatch.setattr(quality, "_dictionary", lambda texts: learnt.append(texts) or b"")
    rows = [(i, f"short{i} " * 20, i % 2) for i in range(160)]
    rows += [(1_000 + i, " ".join(rng.choice(WORDS, 160_000)), i % 2) for i in range(8)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    quality.fit(frame, frame.select("doc_id", "quality"))
    assert len(learnt) == 2
    for texts in learnt:
        short = {t.split()[0] for t in texts if t.startswith(b"short")}
        assert len(texts) <= 120 and len(short) >= 36 and len(texts) - len(short) <= 4 * 8


def plain_score(text, model):
    """A score worked out one step after the other, with the compressor that was learned for."""
    if not text:
        return model.prior
    cut = [text[i:i + 2_000].encode() for i in range(0, len(text), 2_000)]
    sizes = []
    for dictionary in (model.good, model.bad):
        known = zstandard.ZstdCompressionDict(dictionary)
        known.precompute_compress(level=3)
        press = zstandard.ZstdCompressor(dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)
        sizes.append(sum(len(press.compress(c)) for c in cut))
    a, b, n = *sizes, len(text.encode())
    z = model.offset
    for value, weight, centre, scale in zip(
            [(b - a) / (a + b), (b - a) / n, math.log(min(a, b) / n)], model.weights, model.centre, model.scale):
        z += weight * (value - centre) / scale
    return 1 / (1 + math.exp(-min(30, max(-30, z))))


def test_query_equals_plain_scores(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality_model(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = QUERIES["op3_quality"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_score(texts[r.doc_id], model)
        assert r.score == pytest.approx(want, abs=1e-9) and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
