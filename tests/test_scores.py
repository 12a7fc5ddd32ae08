from datetime import date, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsgraph.operators import calendar, reshape, scores

D = [None] + [date(2024, 1, i) for i in range(1, 32)]
SCHEMA = "DATE timestamp, Organization string, E boolean, S boolean, G boolean, Tone double, WordCount double"


def t(day, hour=0):
    return datetime(2024, 1, day, hour)


@pytest.fixture(scope="module")
def facts(spark):
    data = [
        (t(1, 1), "a", True, False, False, 2.0, 100.0),
        (t(1, 5), "a", True, True, False, 4.0, 300.0),
        (t(1, 9), "b's", False, False, False, -6.0, 200.0),
        (t(3), "a", False, False, True, 1.0, 0.0),
        (t(3), "b's", True, False, True, 3.0, 50.0),
        (t(4), "c", True, False, False, None, 10.0),
        (None, "c", True, True, True, 1.0, 1.0),
    ]
    return spark.createDataFrame(data, SCHEMA)


def pandas_scores(facts):
    """The definition, spelled out in pandas."""
    pdf = facts.toPandas()
    pdf = pdf[pdf.DATE.notna()].assign(date=lambda p: p.DATE.dt.date)
    out = {}
    for segment in "TESG":
        part = pdf if segment == "T" else pdf[pdf[segment]]
        industry = part.groupby("date")[["Tone", "WordCount"]].sum(min_count=1)
        for (org, day), sums in part.groupby(["Organization", "date"])[["Tone", "WordCount"]].sum(min_count=1).iterrows():
            def ratio(s):
                return None if pd.isna(s.Tone) or not s.WordCount else s.Tone / s.WordCount
            own, all_ = ratio(sums), ratio(industry.loc[day])
            out[(segment, day, org)] = None if own is None or all_ is None else own - all_
    return out


def test_daily_tone_is_ratio_of_sums(facts):
    found = {(r.segment, r.date, r.org): r.tone for r in scores.daily_tone(facts).collect()}
    assert found[("T", D[1], "a")] == pytest.approx(6.0 / 400.0)
    assert found[("S", D[1], "a")] == pytest.approx(4.0 / 300.0)
    assert found[("T", D[3], "a")] is None
    assert ("E", D[3], "a") not in found
    assert all(day is not None for _, day, _ in found)


def test_daily_diff_matches_definition(facts):
    found = {(r.segment, r.date, r.org): r["diff"] for r in scores.daily_diff(facts).collect()}
    expected = pandas_scores(facts)
    assert found.keys() == expected.keys()
    for key, value in expected.items():
        assert found[key] == (None if value is None else pytest.approx(value, abs=1e-12)), key


def test_average_skips_nulls(spark, rows):
    diffs = spark.createDataFrame(
        [("E", D[1], "a", 1.0), ("E", D[2], "a", None), ("E", D[3], "a", 2.0), ("E", D[1], "b", None)],
        "segment string, date date, org string, diff double",
    )
    assert rows(scores.average_scores(diffs)) == [("E", "a", 1.5), ("E", "b", None)]


def test_column_averages_and_scale(spark):
    df = spark.createDataFrame([(D[1], "x", 1, 2.0), (D[2], "y", 3, None)], "d date, s string, i int, v double")
    assert scores.column_averages(df).first().asDict() == {"i": 2.0, "v": 2.0}
    scaled = scores.scale_numeric(df, 10000).orderBy("i").collect()
    assert (scaled[0]["s"], scaled[0]["i"], scaled[0]["v"], scaled[1]["v"]) == ("x", 10000, 20000.0, None)


SERIES = "k string, date date, v double"


def test_two_fills_differ(spark, rows):
    df = spark.createDataFrame([("a", D[1], 5.0), ("a", D[2], None), ("a", D[4], 7.0)], SERIES)
    gaps = [r[2] for r in rows(calendar.fill_gaps_rows(df, ["k"]))]
    full = [r[2] for r in rows(calendar.fill_full(df, ["k"], "2024-01-01", "2024-01-04"))]
    assert gaps == [5.0, None, None, 7.0]
    assert full == [5.0, 5.0, 5.0, 7.0]


def test_fill_full_against_pandas(spark, rows):
    data = [
        ("a", D[2], 1.0), ("a", D[5], None), ("a", D[9], 3.0), ("a", D[20], 9.0),
        ("b", D[4], None), ("b", D[6], 2.0),
        ("early", D[1], 4.0), ("late", D[30], 4.0), ("late", D[31], 5.0),
        ("edge", D[3], 1.0), ("edge", D[12], 2.0),
    ]
    found = rows(calendar.fill_full(spark.createDataFrame(data, SERIES), ["k"], "2024-01-03", "2024-01-12"))
    expected = []
    days = pd.date_range("2024-01-03", "2024-01-12").date
    for k in {r[0] for r in data}:
        own = pd.Series({d: v for key, d, v in data if key == k}, dtype="float64").reindex(days).ffill()
        expected += [(k, d, None if pd.isna(v) else v) for d, v in own.items()]
    assert found == sorted(expected, key=repr)


def test_fill_full_is_idempotent(spark, rows):
    df = spark.createDataFrame([("a", D[2], 1.0), ("a", D[4], None)], SERIES)
    once = calendar.fill_full(df, ["k"], "2024-01-01", "2024-01-06")
    assert rows(calendar.fill_full(once, ["k"], "2024-01-01", "2024-01-06")) == rows(once)


def test_forward_fill(spark, rows):
    df = spark.createDataFrame([("a", D[1], None), ("a", D[2], 1.0), ("a", D[3], None), ("b", D[4], None)], SERIES)
    assert [r[2] for r in rows(calendar.forward_fill(df, ["v"], ["k"]))] == [None, 1.0, 1.0, None]


def test_fill_gaps_is_asfreq_of_the_wide_table(spark):
    data = [
        ("E", D[2], "a", 1.0), ("E", D[2], "b", 2.0), ("E", D[3], "b", 3.0),
        ("E", D[7], "a", None), ("E", D[7], "c", 4.0), ("E", D[9], "b", 5.0),
        ("T", D[5], "a", 6.0),
    ]
    diffs = spark.createDataFrame(data, "segment string, date date, org string, diff double")
    found = {(r.segment, r.date, r.org): r["diff"] for r in calendar.fill_gaps(diffs).collect()}
    expected = {}
    for segment in "ET":
        pdf = pd.DataFrame([r[1:] for r in data if r[0] == segment], columns=["date", "org", "diff"])
        wide = pdf.pivot(index="date", columns="org", values="diff")
        wide.index = pd.to_datetime(wide.index)
        for day, row in wide.asfreq("D", method="ffill").iterrows():
            for org, value in row.items():
                expected[(segment, day.date(), org)] = None if pd.isna(value) else value
    assert found == expected


def test_wide_and_back(spark, rows):
    diffs = spark.createDataFrame(
        [(D[1], "a b", 1.0), (D[2], "c", 2.0)], "date date, org string, diff double"
    )
    industry = spark.createDataFrame([(D[1], 0.5), (D[2], 0.25), (D[3], 0.0)], "date date, industry_tone double")
    wide = reshape.scores_wide(diffs, industry)
    assert wide.columns == ["date", "industry_tone", "a_b_diff", "c_diff"]
    assert rows(wide)[2] == (D[3], 0.0, None, None)
    long = reshape.scores_long(wide, "E").filter(F.col("diff").isNotNull())
    assert rows(long, "date", "org", "diff") == rows(diffs)


def test_averages_wide_and_back(spark, rows):
    long = spark.createDataFrame([("E", "a", 1.0), ("S", "b", 2.0)], "segment string, org string, score double")
    wide = reshape.averages_wide(long)
    assert wide.columns == ["Type", "a", "b"]
    assert rows(reshape.averages_long(wide).filter("score is not null")) == rows(long)


def test_connections_wide_and_back(spark, rows):
    long = spark.createDataFrame(
        [("a", 0, "b", 0.9), ("a", 1, "c", 0.5), ("b", 0, "a", 0.9)],
        "company string, rank int, neighbor string, confidence double",
    )
    wide = reshape.connections_wide(long, 3)
    assert wide.columns == ["company", "n0_rec", "n0_conf", "n1_rec", "n1_conf", "n2_rec", "n2_conf"]
    assert rows(wide)[1] == ("b", "a", 0.9, None, None, None, None)
    assert rows(reshape.connections_long(wide, 3)) == rows(long)


def test_score_plan_reads_the_facts_once_per_branch(spark, facts):
    plan = scores.daily_diff(facts)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan
