from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsgraph.functions import text
from newsgraph.operators import articles

TONE = "1.5,3,1.5,4.5,20,0,400"


def one(spark, column, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "value, expected",
    [("a;b", ["a", "b"]), (";;a;", ["a"]), ("", []), (None, []), (" a; b", [" a", " b"])],
)
def test_split_list(spark, value, expected):
    assert one(spark, text.split_list, value) == expected


@pytest.mark.parametrize(
    "themes, expected",
    [
        ("ENV_OIL;ECON_STOCKMARKET;", True),
        ("ENVX_A", False),
        ("XENV", False),
        ("WB_ENV_B", True),
        ("A;B_ENV", True),
        ("A;ENV", True),
        ("env_oil", False),
        ("", False),
        (None, False),
    ],
)
def test_has_token(spark, themes, expected):
    assert one(spark, lambda c: text.has_token(c, "ENV"), themes) is expected


def test_flags_overlap(spark):
    row = spark.createDataFrame([("ENV_A;UNGP_B;ECON_C",)], "t string").select(*text.flag_columns(F.col("t"))).first()
    assert row.asDict() == {"E": True, "S": True, "G": True}


@pytest.mark.parametrize(
    "value, expected",
    [
        (TONE, [1.5, 3.0, 1.5, 4.5, 20.0, 0.0, 400.0]),
        ("1.5,2", [1.5, 2.0, None, None, None, None, None]),
        ("1,2,3,4,5,6,7,8", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]),
        ("x,1,2,3,4,5,6", [None, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0]),
        ("", [None] * 7),
        (None, [None] * 7),
    ],
)
def test_tone_columns(spark, value, expected):
    df = spark.createDataFrame([(value,)], "t string").select(*text.tone_columns(F.col("t")))
    assert list(df.first()) == expected


def test_feed_timestamp(spark):
    parsed = one(spark, text.feed_timestamp, "20201201093015")
    assert parsed == datetime(2020, 12, 1, 9, 30, 15)
    assert one(spark, lambda c: text.feed_timestamp(c, strict=False), "junk") is None
    with pytest.raises(Exception):
        one(spark, text.feed_timestamp, "junk")


def test_parse_locations(spark):
    def place(c):
        return text.parse_locations(c, ["loc_type", "name", "country"])

    found = one(spark, place, "1#France#FR;9#Nowhere#XX;3#Boston;")
    assert [tuple(r) for r in found] == [
        ("COUNTRY", "France", "FR"),
        ("9", "Nowhere", "XX"),
        ("USCITY", "Boston", None),
    ]


def test_explode_gcam(spark, rows):
    df = spark.createDataFrame([(1, "wc:125,c2.21:4,v10.1:-3.25,x1.1:2"), (2, "wc:3"), (3, None)], "id int, GCAM string")
    assert rows(articles.explode_gcam(df)) == [
        (1, "scored_value", 10, 1, -3.25),
        (1, "word_count", 2, 21, 4.0),
    ]


def test_stringify_nested(spark):
    df = spark.createDataFrame([(1, ["a", "b"], {"k": 1.5})], "id int, l array<string>, m map<string,double>")
    assert tuple(articles.stringify_nested(df).first()) == (1, '["a","b"]', '{"k":1.5}')
