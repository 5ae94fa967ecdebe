import pytest

import check
from __spark_entry__ import FLAGSHIP_DIR, entry, oracle_sql
from workload.queries import QUERIES, _scores


@pytest.fixture(scope="module")
def connection():
    return check.connect(FLAGSHIP_DIR)


# iterations over factors; test_recommend.py compares them with plain ones
WITHOUT_SQL = {"computed_recommendations"}


def test_every_query_has_a_check():
    assert set(QUERIES) - WITHOUT_SQL == set(QUERIES) & set(oracle_sql())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in WITHOUT_SQL])
def test_query_equals_its_sql(spark, connection, name):
    frame = QUERIES[name](spark, FLAGSHIP_DIR)
    assert check.differences(frame, connection, oracle_sql()[name]) is None


def test_computed_recommendations(spark):
    rows = QUERIES["computed_recommendations"](spark, FLAGSHIP_DIR).collect()
    seen = {(r.user, r.item) for r in _scores(spark, FLAGSHIP_DIR).collect()}
    assert rows and not seen & {(r.user, r.item) for r in rows}
    assert {r["rank"] for r in rows} == set(range(1, 11))


def test_entry(spark):
    frame = entry(spark)
    assert frame.columns[:2] == ["ext_user_id", "ext_media_id"]
    assert frame.count() > 0
