import corpus_pipeline as pipeline
import pytest
import sentencepiece
from mediashelf.llm import pieces, quality
from mediashelf.llm.queries import quality_model
from test_near_dedup import brute as near_brute


@pytest.fixture
def sf():
    return "/root/testdata/sf0.001"

ODD = [(900_001, None), (900_002, ""), (900_003, "word"), (900_004, "WORD"), (900_005, "lorem ipsum " * 40_000), (None, "no id here")]


def test_every_stage_on_what_its_predecessor_kept(spark, sf):
    """Each stage against a plain version of itself, on the given documents and odd ones."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], docs.schema)
    docs = docs.unionByName(odd)
    columns, kept = docs.columns, [docs]
    for _, stage in pipeline.STAGES:
        kept.append(pipeline.staged(stage(spark, kept[-1], sf), "stage"))
    rows = [k.collect() for k in kept]
    assert all(k.columns == columns for k in kept[:-1])
    model = quality_model(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = quality.scores_of([(r.text or "").encode() for r in rows[0]], model) >= 0.5
    assert sorted(map(repr, rows[1])) == sorted(repr(r) for r, g in zip(rows[0], good) if g)
    last = {}
    for r in rows[1]:
        last[(r.text or "").lower()] = max(last.get((r.text or "").lower(), -1), r.doc_id or -1)
    assert {r.doc_id or -1 for r in rows[2]} == set(last.values())
    near = near_brute([(r.doc_id, r.text) for r in rows[2] if r.doc_id is not None], 5)
    assert {r.doc_id for r in rows[3]} - {None} == {i for i, _, _, keep in near if keep}
    assert {r.doc_id for r in rows[4]} <= {r.doc_id for r in rows[3]} and len(rows[4]) > len(rows[3]) // 3
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    assert len(rows[5]) == len(rows[4])
    for r in rows[5]:
        assert (r.ids, r.decoded) == ((None, None) if r.text is None else (library.encode(r.text), r.text))


def test_run(spark, sf):
    out = pipeline.run(spark, sf)
    assert out.columns[-2:] == ["ids", "decoded"] and out.count() > 50
