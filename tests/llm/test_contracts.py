"""Every registered query of the subpackage on a small scale: against its SQL, or its columns."""

import check
import pytest
from mediashelf.llm.oracles import ORACLES
from mediashelf.llm.queries import QUERIES


@pytest.fixture
def sf():
    return "/root/testdata/sf0.001"

COLUMNS = {
    "op1_sentencepiece": ["doc_id", "n_ids", "ids_sha256", "round_trip"],
    "op2_substring_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op3_quality": ["doc_id", "held_out", "score", "predicted"],
    "op5_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op12_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    assert check.differences(QUERIES[name](spark, sf), check.connect(sf), ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_columns(spark, sf, name):
    assert QUERIES[name](spark, sf).columns == COLUMNS[name]


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(ORACLES) | set(COLUMNS) == set(QUERIES)
