import json

import pytest
from helpers import REQUEST_A, REQUEST_B, REQUEST_C
from pyspark.sql import functions as F

from quarry.functions import features, times, vectors
from quarry.schemas import DIM, Q
from quarry.sources import requests

#: By hand, times 10,000. small: 250 of 10,000; 3 of 12; half the average, of ten; hour 23 of 23; a Monday; no last one twice;
#: 12.5 of 1000 km; 1 of 20; online; no card; known; the risk of 5912; 125 of 10,000. large: all at the top, a Sunday at hour 0
#: (day 6 of 6), no average, and an unknown merchant. after: 188 whole minutes (3 h 8 min 1 s) of 1440 are 1305.55, 62.5 km are 625.
GOLDEN = {
    "small": [250, 2500, 500, 10000, 0, -10000, -10000, 125, 500, 10000, 0, 0, 2000, 125],
    "large": [10000, 10000, 10000, 0, 10000, -10000, -10000, 10000, 10000, 0, 10000, 10000, 8500, 10000],
    "after": [250, 2500, 500, 10000, 0, 1306, 625, 125, 500, 10000, 0, 0, 2000, 125],
}


def bodies(spark, *values):
    return spark.createDataFrame([(i, v if isinstance(v, str | None) else json.dumps(v)) for i, v in enumerate(values)], "request_key long, body string")


def test_golden_vectors(spark):
    out = features.vectorize(requests.decode(bodies(spark, REQUEST_A, REQUEST_B, REQUEST_C))).select("id", "status", *Q).collect()
    assert {r["id"]: list(r[2:]) for r in out} == GOLDEN
    assert {r["status"] for r in out} == {200}


def test_golden_distance(spark):
    """Two vectors that differ by 3, 4 and, negatively, 12 in three dimensions, and by the whole range in one."""
    a, b = [0] * 11 + [10000, 5, 7], [3, 4, -12] + [0] * 8 + [-10000, 5, 7]
    df = spark.createDataFrame([(*a, *b)], [*(f"a{i}" for i in range(DIM)), *(f"b{i}" for i in range(DIM))])
    d = vectors.int_distance([F.col(f"a{i}") for i in range(DIM)], [F.col(f"b{i}") for i in range(DIM)])
    assert df.select(d.cast("long").alias("d")).first()["d"] == 9 + 16 + 144 + 400_000_000


@pytest.mark.parametrize(
    ("change", "status"),
    [
        ({}, 200),
        ({"customer": None}, 200),
        ({"terminal": {}}, 200),
        ({"extra": [1, 2]}, 200),
        ({"transaction": None}, 400),
        ({"transaction": {"requested_at": "   "}}, 400),
        ({"last_transaction": {"timestamp": ""}}, 400),
        ({"last_transaction": {}}, 400),
        ({"customer": {"tx_count_24h": 1.0}}, 400),
        ({"customer": {"tx_count_24h": 4294967296}}, 400),
        ({"customer": {"known_merchants": ["x", None]}}, 200),
        ({"customer": {"known_merchants": "x"}}, 400),
        ({"merchant": {"avg_amount": 1e39}}, 400),
        ({"merchant": {"avg_amount": True}}, 400),
        ({"merchant": {"mcc": 5411}}, 400),
        ({"terminal": {"is_online": "yes"}}, 400),
    ],
)
def test_status(spark, change, status):
    for usual in (True, False):
        assert requests.decode(bodies(spark, REQUEST_A | change), usual=usual).first()["status"] == status


def test_bodies_of_the_usual_form_give_what_the_parser_gives(spark):
    """The pattern decides nothing that a parse of every body would not, with fields of every kind in bodies near the usual form."""
    import random
    import re

    draw = random.Random(4)
    values = ['""', '"a\\u00e9\\n"', '"a\\q"', '"é€\U0001f600"', '"\\ud800"', "0", "-0", "1.5", "01", "1e2", "-7", "4294967295", "4294967296", "9" * 31, "3.5e38", "true", "null", "[]", '["x",null]', '["x",]', "{}", '"\t"', ".5", "1."]
    whole = json.dumps(REQUEST_C)
    given = [whole, whole.replace(" ", ""), f" \n{whole}\r\t", whole + "\u00a0", whole + "\n}", whole.replace('"id"', '"ID"'), json.dumps(REQUEST_A, ensure_ascii=False)]
    places = [m.span(1) for m in re.finditer(r': ("[^"]*"|-?[0-9.]+|true|false|null|\[[^]]*\])', whole)]
    for a, z in places:
        given += [whole[:a] + v + whole[z:] for v in values]
    for _ in range(300):
        at = draw.randrange(len(whole))
        given.append(whole[:at] + draw.choice(["", "x", '"', ",", " ", "{", "}", "1"]) + whole[at + draw.randrange(2) :])
    df = bodies(spark, *given)
    columns = ["request_key", "status", "transaction", "customer", "merchant", "terminal", "last_transaction", "id"]
    fast, slow = (sorted(map(str, requests.decode(df, usual=x).select(columns).collect())) for x in (True, False))
    assert fast == slow
    assert sum("status=200" in x for x in fast) > 50
    assert df.filter(F.col("body").rlike(requests.USUAL)).count() > 50


def test_bodies(spark):
    whole = json.dumps(REQUEST_A)
    given = [whole, '{"id":', "a" * 65_537, "{}", None, "", whole + " {}", whole + " \n", "[1]", "null", '{"id": NaN}', whole.ljust(65_536), whole.replace('"id"', '"ID"'), "[" * 5000]
    got = [r["status"] for r in requests.decode(bodies(spark, *given)).orderBy("request_key").collect()]
    assert got == [200, 400, 413, 400, 400, 400, 400, 200, 400, 400, 400, 200, 200, 400]


def test_null_elements_and_lists(spark):
    df = spark.createDataFrame([("", ["x", None]), ("y", ["x", None]), ("", None), (None, [""]), ("x", ["x"])], "m string, k array<string>")
    assert [r[0] for r in df.select(features.is_known(F.col("m"), F.col("k"))).collect()] == [True, False, False, True, True]


@pytest.mark.parametrize("n", [0, 1, 8, 32, 64, 65, 128, 512, 1024, 1025, 4096])
def test_known_merchant_sizes(spark, n):
    df = spark.createDataFrame([([f"M{i}" for i in range(n)], f"M{n - 1}"), ([f"M{i}" for i in range(n)], "none")], "k array<string>, m string")
    assert [r[0] for r in df.select(features.is_known(F.col("m"), F.col("k"))).collect()] == [n > 0, False]


def test_times(spark):
    good = ["2026-03-11T18:45:53Z", "2026-03-11T18:45:53+03:00", "2026-03-11T18:45:53x", "2026-02-31T00:00:00Z", "0000-01-01T00:00:00Z"]
    bad = ["invalid", "bad", "", "  ", None, "2026-03-11T18:45:53", "2026-00-11T00:00:00Z", "2026-13-11T00:00:00Z", "2026-03-00T00:00:00Z", "2026-03-32T00:00:00Z", "2026-03-11T24:00:00Z", "2026-03-11T00:60:00Z", "2026-03-11T00:00:60Z", "2026-03-11 18:45:53Z", "２026-03-11T18:45:53Z"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(good + bad)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(times.is_time(F.col("t"))).collect()] == [True] * len(good) + [False] * len(bad)
    got = spark.createDataFrame([("2026-02-31T00:00:00Z",), ("2026-03-11T00:00:00Z",), ("2026-03-14T00:00:00Z",)], "t string")
    assert [tuple(r) for r in got.select(times.weekday(F.col("t")), times.civil_date(F.col("t")).cast("string")).collect()] == [(1, "2026-03-03"), (2, "2026-03-11"), (5, "2026-03-14")]


def test_minutes_either_way(spark):
    df = spark.createDataFrame([("2026-03-14T05:15:12Z", "2026-03-14T02:05:13Z"), ("2026-03-14T02:05:13Z", "2026-03-14T05:15:12Z"), ("2024-02-29T23:59:59Z", "2024-03-01T00:00:58Z")], "a string, b string")
    assert [r[0] for r in df.select(times.minutes_between(F.col("a"), F.col("b"))).collect()] == [189, 189, 0]


def test_quantize(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (-1.0,), (2.0,), (-7.0,), (0.13125,), (-0.00005,), (0.00004,)], "x float")
    assert [r[0] for r in df.select(vectors.quantize(F.col("x"))).collect()] == [0, 10000, -10000, 10000, -10000, 1313, -1, 0]


def test_pad(spark):
    df = spark.createDataFrame([(None,), ([],), ([1.0, None],), ([0.5] * 20,)], "v array<float>")
    got = [list(r) for r in df.select(*vectors.pad(F.col("v"))).collect()]
    assert got == [[0.0] * 14, [0.0] * 14, [1.0] + [0.0] * 13, [0.5] * 14]


def test_box_bound_inside_is_zero(spark):
    df = spark.createDataFrame([(5, 0, 10), (-3, 0, 10), (12, 0, 10)], "q int, lo int, hi int")
    assert [r[0] for r in df.select(vectors.box_bound([F.col("q")], [F.col("lo")], [F.col("hi")])).collect()] == [0, 9, 4]


def test_mcc_risk(spark):
    df = spark.createDataFrame([("5411",), ("7995",), ("0",), ("",), (None,)], "m string")
    assert [round(r[0], 2) for r in df.select(features.mcc_risk(F.col("m"))).collect()] == [0.15, 0.85, 0.5, 0.5, 0.5]
