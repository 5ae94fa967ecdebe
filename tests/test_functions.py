import datetime
import json

import pytest
from pyspark.sql import functions as F

from mediashelf.functions import messages as M
from mediashelf.functions import text as X
from mediashelf.sources import options, requests, topics


def values(spark, column, rows, schema):
    frame = spark.createDataFrame(rows, schema)
    return [r[0] for r in frame.select(column).collect()]


def expected_date(y, m, d):
    try:
        return datetime.date(1900 if y is None else y, m or (1 if m is None else 0),
                             d if d is not None else 1)
    except ValueError:
        return datetime.date(1900, 1, 1)


def test_partial_dates_match_the_calendar(spark):
    rows = [(y, m, d) for y in (None, 0, 1900, 2000, 2021, 2024, 9999, 10000, -5)
            for m in (None, 0, 1, 2, 4, 12, 13, -1) for d in (None, 0, 1, 28, 29, 30, 31, 32, -3)]
    got = values(spark, X.partial_date(F.col("y"), F.col("m"), F.col("d")), rows,
                 "y int, m int, d int")
    assert got == [expected_date(*r) for r in rows]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_integers(spark, ansi):
    texts = ["12", "-3", "+4", "12.5", "12.0", "x", "", " 7", "7 ", "7\n", "99999999999", "null", None]
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        rows = [(t,) for t in texts]
        strict = values(spark, X.strict_int(F.col("t")), rows, "t string")
        lenient = values(spark, X.lenient_int(F.col("t")), rows, "t string")
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
    assert strict == [12, -3, 4] + [None] * 10
    assert lenient == [12, -3, 4] + [0] * 10


def test_clean_title(spark):
    rows = [('"a"',), ('"a',), ('a"',), ('""',), ('"',), ("null",), ('"it\'s "x" "',), ("",),
            ('"line\n',), ('"a"\n',)]
    got = values(spark, X.clean_title(F.col("t")), rows, "t string")
    assert got == ["a", "a", "a", "", "", "null", 'it\'s "x" ', None, "line\n", 'a"\n']
    assert values(spark, X.escape_quotes(F.col("t")), [("it's",)], "t string") == ["it''s"]


def test_booleans_and_scores(spark):
    flags = values(spark, X.strict_bool(F.col("t")), [("true",), ("FALSE",), ("yes",), (None,)], "t string")
    assert flags == [True, False, None, None]
    scores = [8.75, 8.7, 0.0, -1.27, 1e12, -1e12] + [i / 10 for i in range(101)]
    got = values(spark, X.score_points(F.col("s")), [(s,) for s in scores], "s double")
    assert got[:6] == [87, 87, 0, -12, 2147483647, -2147483648]
    assert got[6:] == list(range(101))


def test_refresh_parameter(spark):
    cases = {
        '{"refresh":"true","a":1}': (True, True, 1),
        '{"refresh":true,"a":1,"b":[1]}': (True, False, 2),
        '{"refresh":"true"}': (True, True, 0),
        '{"refresh":"yes"}': (True, False, 0),
        "{}": (True, False, 0),
        "[1]": (False, False, None),
        "{oops": (False, False, None),
        "7": (False, False, None),
    }
    frame = spark.createDataFrame([(k,) for k in cases], "p string")
    p = F.col("p")
    got = frame.select(M.is_parameter_object(p), M.wants_refresh(p),
                       F.when(M.is_parameter_object(p), M.other_parameters(p))).collect()
    assert [tuple(r) for r in got] == list(cases.values())


def test_ticks_and_envelopes(spark):
    ticks = spark.range(60).select(F.col("id").alias("value"))
    rows = requests.ticked(ticks, F.lit("{}")).collect()
    assert [r.id for r in rows if r.data == "{}"] == [0, 1, 2, 3, 4, 5]
    assert len([r for r in rows if r.data == '{"errors":']) == 54
    assert [r.id for r in topics.id_range(spark, 5).collect()] == [0, 1, 2, 3, 4, 5]
    fetched = spark.createDataFrame(
        [(1, "A", "B"), (2, '{"errors":1', "B"), (3, '{"errors":', '{"errors":'), (4, None, "B")],
        "id int, anime string, manga string")
    got = requests.list_messages(fetched).collect()
    assert [tuple(r) for r in got][:2] == [
        (1, '{"anime":A,"manga": B}'), (2, '{"anime":{"errors":1,"manga": B}')]
    assert 3 not in [r.seq for r in got]


def test_option_files(spark, tmp_path):
    path = tmp_path / "get.conf"
    path.write_text("kafka.bootstrap.servers\tlocalhost:9092\nsubscribe  films\nstartingOffsets 42\n")
    read = options.read_options(spark, str(path))
    assert read["kafka.bootstrap.servers"] == "localhost:9092"
    assert options.with_starting_offsets(read)["startingOffsets"] == '{"films":{"0":42}}'
    for word in ("earliest", "latest"):
        assert options.with_starting_offsets({"startingOffsets": word})["startingOffsets"] == word
    assert options.with_starting_offsets({"subscribe": "x"})["startingOffsets"] == "earliest"
    path.write_text("subscribe\n")
    with pytest.raises(ValueError):
        options.read_options(spark, str(path))
    with pytest.raises(ValueError):
        options.read_options(spark, str(tmp_path / "none.conf"))


def test_config_values(spark):
    counters = spark.createDataFrame(
        [(1, "media", None, "a"), (2, "media", 50, None), (3, "media", 60, None), (4, "user", None, None)],
        "counter_id bigint, counter_name string, value_int int, value_str string")
    assert options.config_value(counters, "media", "int", "5") == "50"
    assert options.config_value(counters, "media", "str", "5") == "a"
    assert options.config_value(counters, "user", "int", "5") == "5"
    assert options.config_value(counters, "none", "int", "5") == "5"
    with pytest.raises(ValueError):
        options.config_value(counters, "media", "bool", "5")


def test_requests_ask_for_what_is_parsed(spark):
    body = spark.range(704, 705).select(requests.media_request(F.col("id"))).first()[0]
    request = json.loads(body)
    assert request["variables"] == {"id": 704}
    assert "Media(id: $id, id_not: 0) { id type title { romaji english native }" in request["query"]
    assert request["query"].count("{") == request["query"].count("}")
    named = spark.createDataFrame([('o"k',)], "n string").select(requests.user_request(F.col("n")))
    assert json.loads(named.first()[0])["variables"] == {"name": 'o"k'}
    with pytest.raises(ValueError):
        requests.list_query("BOOKS")
