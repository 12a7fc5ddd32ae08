from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsgraph.operators import density, explore

SCHEMA = (
    "DATE timestamp, SourceCommonName string, URL string, E boolean, S boolean, G boolean, Organization string, "
    "Tone double, Polarity double, ActivityDensity double, SelfDensity double"
)


def row(day, site, org, flags, tone, hour=3):
    return (
        datetime(2024, 1, day, hour), site, f"{site}/{day}/{org}", "E" in flags, "S" in flags, "G" in flags,
        org, tone, 1.0, 2.0, 3.0,
    )


@pytest.fixture(scope="module")
def news(spark):
    data = [
        row(1, "p", "acme", "ESG", 1.0),
        row(1, "q", "acme", "E", 5.0),
        row(2, "p", "acme", "", 9.0),
        row(3, "p", "acme", "G", None),
        row(3, "p", "o'neil", "S", 2.0, hour=23),
        row(4, None, "acme", "S", 4.0),
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_filters(news):
    assert explore.any_flag(news).count() == 5
    assert explore.with_flag(news, "G").count() == 2
    assert explore.of_company(news, "o'neil").count() == 1
    assert explore.of_publisher(news, "p").count() == 4
    assert explore.of_publisher(news).count() == 6
    assert explore.date_range(news, "2024-01-02", "2024-01-03").count() == 3


def test_category_modes(news):
    assert explore.category_articles(news, ["E", "S", "G"]).count() == 7
    assert explore.category_articles(news, ["E", "S", "G"], "any").count() == 5
    assert explore.category_articles(news, ["G"]).count() == 2
    with pytest.raises(ValueError):
        explore.category_articles(news, ["E"], "all")


def test_company_view_and_listing(news, rows):
    view = explore.company_view(news, "acme", ["E", "G"], "2024-01-01", "2024-01-02", "p")
    listing = explore.article_listing(view)
    assert listing.columns[:3] == ["DATE", "SourceCommonName", "URL"] and len(listing.columns) == 7
    assert rows(listing, "URL") == [("p/1/acme",), ("p/1/acme",)]


def test_counts_bounds_distinct(news, rows):
    assert rows(explore.publisher_articles(news)) == [("p", 4), ("q", 1)]
    assert rows(explore.date_bounds(news)) == [(date(2024, 1, 1), date(2024, 1, 4))]
    found = [r[0] for r in explore.distinct_sorted(news, "SourceCommonName").collect()]
    assert found == ["p", "q"]


@pytest.mark.parametrize("mode", ["bag", "any"])
@pytest.mark.parametrize("publisher", ["all", "p"])
def test_metric_over_time_against_two_selections(news, mode, publisher):
    start, end = "2024-01-01", "2024-01-03"
    found = {
        (r.WHO, r.DATE): r.value
        for r in explore.metric_over_time(news, "acme", "Tone", start, end, publisher=publisher, mode=mode).collect()
    }
    chosen = explore.company_view(news, "acme", ["E", "S", "G"], start, end, publisher, mode).toPandas()
    whole = explore.date_range(news, start, end).toPandas()
    expected = {}
    for who, part in [("Acme", chosen), ("Industry Average", whole)]:
        for day, value in part.groupby(part.DATE.dt.date).Tone.mean().items():
            expected[(who, day)] = None if pd.isna(value) else pytest.approx(value)
    assert found == expected


DIFFS = "segment string, date date, org string, diff double"


def test_series_fill_within_their_own_segment(spark, rows):
    d = [date(2024, 1, i) for i in range(1, 4)]
    diffs = spark.createDataFrame(
        [("E", d[0], "a", 1.0), ("S", d[0], "b", 5.0), ("S", d[1], "a", 2.0), ("E", d[2], "b", 3.0), ("T", d[2], "a", 9.0)],
        DIFFS,
    )
    assert rows(explore.segment_series(diffs, "a", ["E", "S"]), "ESG", "DATE", "Score") == [
        ("E", d[0], 1.0), ("E", d[1], 1.0), ("E", d[2], 1.0),
        ("S", d[0], None), ("S", d[1], 2.0), ("S", d[2], 2.0),
    ]
    assert rows(explore.industry_series(diffs, ["E"]), "DATE", "Score") == [(d[0], 1.0), (d[2], 3.0)]
    lines = explore.score_over_time(diffs, "a", ["E", "S"], "2024-01-02", "2024-01-03")
    assert rows(lines.groupBy("WHO", "ESG").count()) == [
        ("A", "Environment", 2), ("A", "Social", 2), ("Industry Average", "Environment", 2), ("Industry Average", "Social", 2),
    ]


def test_radar(spark, rows):
    averages = spark.createDataFrame(
        [("E", "a", 1.0), ("E", "b", 3.0), ("T", "b", 4.0), ("T", "a", None)], "segment string, org string, score double"
    )
    assert rows(explore.radar_scores(averages, "a")) == [
        ("Environment", "Industry Average", 2.0), ("Environment", "a", 1.0),
        ("Overall", "Industry Average", 4.0), ("Overall", "a", None),
    ]


def test_format_columns(spark):
    df = spark.createDataFrame([(date(2024, 1, 2), "x", 12345, 1234.56789)], "d date, s string, i int, v double")
    assert tuple(explore.format_columns(df).first()) == ("2024-01-02", "x", "12,345", "1,234.5679")
    assert tuple(explore.format_columns(df, places=1).first())[3] == "1,234.6"
    assert explore.format_columns(df.union(df), rows=1).count() == 1


def test_density_against_numpy(spark):
    values = np.random.default_rng(3).normal(2, 5, 700).round(3)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "Tone double")
    found = density.tone_density(df, points=50).orderBy("point").toPandas()
    q1, q3 = np.percentile(values, [25, 75])
    h = 1.06 * min(values.std(ddof=1), (q3 - q1) / 1.34) * len(values) ** -0.2
    x = np.linspace(values.min(), values.max(), 50)
    y = np.exp(-0.5 * ((x[:, None] - values) / h) ** 2).sum(1) / (len(values) * h * np.sqrt(2 * np.pi))
    np.testing.assert_allclose(found.Tone, x, atol=1e-12)
    np.testing.assert_allclose(found.density, y, rtol=1e-9)


def test_density_of_one_value_and_far_outlier(spark):
    one = spark.createDataFrame([(2.0,), (2.0,)], "Tone double")
    assert density.tone_density(one).count() == 1
    far = spark.createDataFrame([(float(i % 5),) for i in range(50)] + [(1e6,)], "Tone double")
    found = density.tone_density(far, points=100).toPandas()
    assert len(found) == 100 and (found.density >= 0).all() and (found.density == 0).sum() > 90


@pytest.mark.parametrize("kind", ["normal", "hot", "two", "constant"])
def test_order_statistics(spark, kind):
    rng = np.random.default_rng(1)
    n = 3001
    values = {
        "normal": rng.normal(size=n),
        "hot": np.where(rng.random(n) < 0.4, 0.25, rng.normal(size=n)),
        "two": rng.integers(0, 2, n).astype(float),
        "constant": np.ones(n),
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    ranks = [0, 1, 750, 751, 1500, 2250, n - 2, n - 1]
    assert density.order_statistics(df, "v", ranks) == [pytest.approx(v) for v in np.sort(values)[ranks]]
