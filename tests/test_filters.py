import datetime
import random

from mediashelf.operators.ranges import in_interval, interval_bins
from mediashelf.plans import filters
from pyspark.sql import functions as F

D = datetime.date


def test_typed_parameters_of_odd_requests(spark):
    rows = {
        1: '{"genres":["a","a","b"],"refresh":"true"}', 2: "{}", 3: None, 4: "text", 5: "[]", 6: "null", 7: '{"genres":{"a":1}}',
        8: '{"startedAfter":"2024-02-29","endedBefore":"2023-02-29"}', 9: '{"format":"","mediatype":[null]}', 10: '{"tags":true,"tags":1}',
        11: '{"startedBefore":["2024-01-01"],"x":null}',
    }
    frame = spark.createDataFrame(list(rows.items()), "request_id int, params string")
    found = sorted(map(tuple, filters.typed_parameters(frame).collect()), key=repr)
    want = [(1, "genres", "a", None, None), (1, "genres", "b", None, None)]
    want += [(i, None, None, None, "malformed") for i in (3, 4, 5, 6, 10)]
    want += [(7, "genres", None, None, "no names"), (8, "startedAfter", None, D(2024, 2, 29), None),
             (8, "endedBefore", None, None, "no date"), (9, "format", "", None, None), (9, "mediatype", None, None, "no names"),
             (11, "startedBefore", None, None, "no date"), (11, "x", None, None, "unknown")]
    assert found == sorted(want, key=repr)
    assert {r.request for r in filters.turned_down(filters.typed_parameters(frame)).collect()} == {3, 4, 5, 6, 7, 8, 9, 10, 11}


def test_filtered_by_sets_and_spans(spark):
    asked = {1: "{}", 2: '{"genres":["a","b"]}', 3: '{"format":["x","y"],"genres":"a"}', 4: '{"startedAfter":"2020-01-01"}',
             5: '{"genres":[]}', 6: '{"endedBefore":"2020-01-05","startedAfter":"2019-12-31"}', 7: '{"format":"z"}'}
    parameters = filters.typed_parameters(spark.createDataFrame(list(asked.items()), "request_id int, params string"))
    names = [(10, "genres", "a"), (10, "genres", "a"), (10, "genres", "b"), (11, "genres", "a"), (11, "format", "y"), (12, "format", "x")]
    media = [(10, D(2020, 1, 1), D(2020, 1, 4)), (11, D(2020, 1, 2), None), (12, None, None)]
    candidates = [(r, m) for r in asked for m in (10, 11, 12, 13)] + [(1, 10)]
    found = filters.filtered(
        spark.createDataFrame(candidates, "request int, media_id int"), parameters,
        spark.createDataFrame(names, "media_id int, key string, name string"),
        spark.createDataFrame(media, "media_id int, date_start date, date_end date"))
    assert sorted(map(tuple, found.collect())) == [(1, 10), (1, 11), (1, 12), (1, 13), (2, 10), (3, 11), (4, 11), (6, 10)]


def test_filtered_where_requests_meet_what_is_stored(spark):
    asked = {1: "{}", 2: '{"genres":["a","b"]}', 3: '{"format":["x","y"],"genres":"a"}', 4: '{"startedAfter":"2020-01-01"}',
             5: '{"genres":[]}', 6: '{"tags":"t"}'}
    parameters = filters.typed_parameters(spark.createDataFrame(list(asked.items()), "request_id int, params string"))
    names = [(10, "genres", "a"), (10, "genres", "b"), (11, "genres", "a"), (11, "format", "y"), (12, None, "x"), (12, "tags", None)]
    media = [(10, D(2020, 1, 1), D(2020, 1, 4)), (11, D(2020, 1, 2), None), (11, D(2020, 1, 3), None)]
    requests = [(r, u) for r in asked for u in (7, 8)] + [(1, 7), (1, None)]
    stored = [(7, 10), (7, 11), (8, 11), (8, 12), (8, None), (9, 13), (None, 10)]
    frames = (parameters, spark.createDataFrame(names, "media_id int, key string, name string"),
              spark.createDataFrame(media, "media_id int, date_start date, date_end date"))
    left = spark.createDataFrame(requests, "request int, user int")
    right = spark.createDataFrame(stored, "user int, media_id int")
    found = filters.filtered(left, *frames, right, "user")
    whole = filters.filtered(left.join(right, "user").select("request", "media_id"), *frames)
    want = [(1, 10), (1, 11), (1, 11), (1, 12), (1, None), (2, 10), (3, 11), (3, 11), (4, 11), (4, 11)]
    for frame in (found, whole):
        assert sorted(map(tuple, frame.collect()), key=repr) == sorted(want, key=repr)


def test_bins_make_up_intervals_exactly(spark):
    rng = random.Random(3)
    day = lambda: D(1, 1, 1) + datetime.timedelta(days=rng.choice([rng.randrange(60), rng.randrange(3_652_059)]))
    spans = [(i, day(), day()) for i in range(150)] + [(900, None, D(2000, 1, 1)), (901, D(1, 1, 1), D(9999, 12, 31))]
    points = [(i, day()) for i in range(200)] + [(900, None), (901, D(1, 1, 1)), (902, D(9999, 12, 31))]
    found = in_interval(spark.createDataFrame(points, "p int, at date"), "at", spark.createDataFrame(spans, "s int, low date, high date"), "low", "high")
    assert found.columns == ["p", "at", "s", "low", "high"]
    want = sorted((p, s) for p, at in points for s, low, high in spans if at and low and low <= at <= high)
    assert sorted((r.p, r.s) for r in found.collect()) == want
    bins = spark.createDataFrame(spans, "s int, low date, high date").select(F.size(interval_bins(F.col("low"), F.col("high"))).alias("n"))
    assert max(r.n for r in bins.collect()) <= 46


def test_points_folded_before_they_meet(spark):
    rng = random.Random(4)
    day = lambda: D(1995, 1, 1) + datetime.timedelta(days=rng.randrange(900))
    spans = [(i % 60, day(), day()) for i in range(80)] + [(900, None, D(2000, 1, 1)), (901, D(1, 1, 1), D(9999, 12, 31))]
    points = [(rng.choice([None, i]), day()) for i in range(5000)] + [(900, None)]
    frames = spark.createDataFrame(points, "p long, at date"), spark.createDataFrame(spans, "s int, low date, high date")
    met = in_interval(frames[0], "at", frames[1], "low", "high", [F.count("*").alias("n"), F.sum("p").alias("keys")])
    assert met.columns == ["n", "keys", "s", "low", "high"]
    assert met.count() <= 46 * len(spans)  # not a row per pair
    found = met.groupBy("s").agg(F.sum("n"), F.sum("keys"))
    want = {}
    for s, low, high in spans:
        for p, at in points:
            if at and low and low <= at <= high:
                n, keys = want.get(s, (0, None))
                want[s] = n + 1, keys if p is None else (keys or 0) + p
    assert {r[0]: (r[1], r[2]) for r in found.collect()} == want


def test_no_intervals(spark):
    points = spark.createDataFrame([(1, D(2020, 1, 1))], "p int, at date")
    spans = spark.createDataFrame([], "s int, low date, high date")
    assert in_interval(points, "at", spans, "low", "high").count() == 0
    assert in_interval(points, "at", spans, "low", "high", [F.count("*").alias("n")]).count() == 0
