import os
import random
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsgraph.constants import BUNDLE_FILES
from newsgraph.operators import ranges
from newsgraph.operators.articles import union_days
from newsgraph.operators.graph import comention_edges
from newsgraph.operators.scores import daily_sums
from newsgraph.operators.universe import company_universe
from newsgraph.plans import jobs
from newsgraph.schemas import GKG_FILE
from newsgraph.sources import bundle, sinks
from newsgraph.sources.daystore import DayStore, changed_days, missing_days
from newsgraph.sources.feed import (
    bad_records,
    good_records,
    landed_days,
    landed_files,
    read_feed,
    read_landed_days,
    read_landed_records,
    stream_feed,
)
from newsgraph.sources.edgestore import EdgeStore
from newsgraph.sources.holdings import numbered_lines, read_holdings
from newsgraph.sources.scoreblocks import ScoreBlocks
from newsgraph.operators.articles import reformat_articles
from newsgraph.operators.universe import alias_table
from newsgraph.streaming.daily import compact_sums, stream_articles, stream_daily_sums, streamed_sums

NAMES = [f.name for f in GKG_FILE.fields]


def record(day, time, site, url, themes, orgs, tone):
    values = dict.fromkeys(NAMES, "")
    values |= {
        "GKGRECORDID": url, "DATE": day.replace("-", "") + time, "SourceCommonName": site, "DocumentIdentifier": url,
        "Themes": themes, "Organizations": orgs, "V2Tone": tone, "Quotations": 'said "so',
    }
    return "\t".join(values[n] for n in NAMES)


DAYS = {
    "2020-12-01": [
        ("010203", "p.com", "u1", "ENV_OIL;ECON_X;", "apple inc;nike", "1.5,3,1.5,4.5,20,0,400"),
        ("050607", "q.com", "u2", ";;UNGP_X;", "nike;;visa", "-2,1,3,4,20,0,100"),
    ],
    "2020-12-02": [("000000", "p.com", "u3", "ENV_A", "nobody ltd;visa;apple", "2,2,0,2,9,1,50")],
    "2020-12-04": [
        ("235959", "p.com", "u4", "WB_ENV_B", "apple;apple inc;nike;visa", "4,5,1,6,9,1,200"),
        ("110000", "p.com", "u5", "TAX", "nobody ltd", "1,1"),
    ],
    "2020-12-05": [("110000", "p.com", "u6", "TAX", "visa", "1,1,1,1,1,1,30")],
}


def land(folder, days):
    for day in days:
        os.makedirs(f"{folder}/day={day}", exist_ok=True)
        with open(f"{folder}/day={day}/part.csv", "w") as file:
            file.writelines(record(day, *fields) + "\n" for fields in DAYS[day])


@pytest.fixture
def universe(spark):
    data = [("APPLE INC", "Tech", 1), ("NIKE INC CLASS B", "Goods", 2), ("VISA INC CLASS A", "Finance", 3)]
    return company_universe(spark.createDataFrame(data, "Name string, Sector string, rank int"))


def test_read_feed_and_reformat(spark, tmp_path, rows, universe):
    land(tmp_path, list(DAYS)[:3])
    feed = read_feed(spark, f"{tmp_path}/day=*")
    assert feed.columns[0] == "DATE" and feed.count() == 5
    out = reformat_articles(feed, alias_table(universe))
    assert rows(out, "URL", "Organization", "E", "S", "G", "Tone", "WordCount") == sorted(
        [
            ("u1", "apple", True, False, True, 1.5, 400.0),
            ("u1", "nike", True, False, True, 1.5, 400.0),
            ("u2", "nike", False, True, False, -2.0, 100.0),
            ("u2", "visa", False, True, False, -2.0, 100.0),
            ("u3", "apple", True, False, False, 2.0, 50.0),
            ("u3", "visa", True, False, False, 2.0, 50.0),
            ("u4", "apple", True, False, False, 4.0, 200.0),
            ("u4", "apple", True, False, False, 4.0, 200.0),
            ("u4", "nike", True, False, False, 4.0, 200.0),
            ("u4", "visa", True, False, False, 4.0, 200.0),
        ],
        key=repr,
    )
    first = out.filter("URL = 'u2'").first()
    assert first["Themes"] == ["UNGP_X"] and first["Organizations"] == ["nike", "visa"]


def test_read_holdings(spark, tmp_path, rows):
    lines = [f"preamble {i}" for i in range(9)]
    lines += ["Ticker,Name,Sector,Weight", 'A,"ACME, INC CLASS A",Tech,"1,000"', "B,BOLT CORP,Energy,2", "C,,Cash,3", "disclaimer"]
    (tmp_path / "h.csv").write_text("\n".join(lines) + "\n")
    found = rows(read_holdings(spark, str(tmp_path / "h.csv")))
    assert found == [("ACME, INC CLASS A", "Tech", 1), ("BOLT CORP", "Energy", 2)]


def test_missing_days(spark, rows):
    stored = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 3),), (date(2024, 1, 3),)], "day date")
    assert rows(missing_days(stored, "2024-01-01", "2024-01-04", "2024-02-01")) == [(date(2024, 1, 2),), (date(2024, 1, 4),)]
    assert len(rows(missing_days(stored, "2024-01-01", "2024-01-04", "2024-01-03"))) == 3
    assert len(rows(missing_days(stored, "2024-01-01", "2024-01-04", override=True))) == 4


def test_day_store_builds_only_what_is_missing(spark, tmp_path, rows):
    land(tmp_path / "in", ["2020-12-01", "2020-12-02"])
    store = DayStore(spark, str(tmp_path / "store"))
    built = []

    def build(mark):
        def keep(days):
            built.append(sorted(str(r["day"]) for r in days.select("day").distinct().collect()))
            return days.select("day", F.lit(mark).alias("mark"), F.col("DocumentIdentifier").alias("URL"))

        return keep

    landed = read_landed_days(spark, str(tmp_path / "in"))
    with pytest.raises(ValueError, match="2020-12-03"):
        store.update(landed, build(0), "2020-12-01", "2020-12-03", "2021-01-01")
    skipped = store.update(landed, build(1), "2020-12-01", "2020-12-03", "2021-01-01", on_error="skip")
    assert rows(skipped) == [(date(2020, 12, 3),)]
    assert store.update(landed, build(2), "2020-12-01", "2020-12-02", "2021-01-01").count() == 0
    store.update(landed, build(3), "2020-12-01", "2020-12-02", "2020-12-02")
    assert built == [["2020-12-01", "2020-12-02"], ["2020-12-02"]]
    assert rows(store.read("2020-12-01", "2020-12-31"), "URL", "mark") == [("u1", 1), ("u2", 1), ("u3", 3)]
    assert rows(store.read("2020-12-02", "2020-12-31"), "URL") == [("u3",)]

    def empty(days):
        return build(4)(days).filter(F.lit(False))

    store.update(landed, empty, "2020-12-01", "2020-12-01", "2021-01-01", override=True)
    assert rows(store.read("2020-12-01", "2020-12-31"), "URL") == [("u3",)]
    assert rows(missing_days(store.built_days(), "2020-12-01", "2020-12-02", "2021-01-01")) == []


def test_make_products(spark, tmp_path, rows, universe):
    land(tmp_path / "in", list(DAYS)[:3])
    landed = read_landed_days(spark, str(tmp_path / "in"))
    options = dict(walk_length=5, walks_per_vertex=6, dimensions=4, neighbors=2)
    days = landed_days(spark, str(tmp_path / "in"))
    assert rows(days) == [(date(2020, 12, d),) for d in (1, 2, 4)]
    with pytest.raises(ValueError, match="2020-12-03"):
        jobs.make_products(landed, universe, str(tmp_path / "out"), "2020-12-01", "2020-12-04", **options)
    made = jobs.make_products(
        landed, universe, str(tmp_path / "out"), "2020-12-01", "2020-12-04", on_error="skip", days=days, **options
    )
    edges = rows(spark.read.parquet(made.edges))
    assert edges == [("apple", "apple", 1), ("apple", "nike", 3), ("apple", "visa", 3), ("nike", "visa", 2)]
    daily = made.files["E_score"]
    wide = pd.concat(pd.read_csv(f"{daily}/{f}") for f in os.listdir(daily) if f.endswith(".csv"))
    assert wide.date.tolist() == ["2020-12-01", "2020-12-02", "2020-12-03", "2020-12-04"]
    assert wide.loc[2].drop("date").equals(wide.loc[1].drop("date"))
    assert sorted(c for c in wide if c.endswith("_diff")) == ["apple_diff", "nike_diff", "visa_diff"]
    assert pd.isna(wide.nike_diff[1]) and wide.apple_diff[0] == 0.0
    social = spark.read.option("header", True).csv(made.files["S_score"])
    assert social.columns == ["date", "industry_tone", "apple_diff", "nike_diff", "visa_diff"]
    assert spark.read.parquet(made.points).count() == 3
    assert spark.read.parquet(made.connections).count() == 6
    assert spark.read.option("header", True).csv(made.files["data"]).count() == 10
    got = bundle.read_bundle(spark, made.bundle, neighbors=2)
    assert rows(got.connections.select("company", "rank", "neighbor")) == rows(
        spark.read.parquet(made.connections).select("company", "rank", "neighbor")
    )
    stored = {(r.segment, r.org): r.score for r in spark.read.parquet(made.averages).collect()}
    assert {(r.segment, r.org): pytest.approx(r.score / 10000) for r in got.scores.filter("score is not null").collect()} == stored
    assert got.diffs.filter("segment = 'T' and org = 'nike'").count() == 4
    assert got.articles.count() == 10 and sorted(r.company for r in got.points.collect()) == ["apple", "nike", "visa"]
    before = sorted(os.listdir(made.averages))
    jobs.make_products(landed, universe, str(tmp_path / "out"), "2020-12-01", "2020-12-04", on_error="skip", **options)
    assert sorted(os.listdir(made.averages)) == before


def landed_with(spark, tmp_path, extra):
    """The first two days, with records of other times in their files."""
    land(tmp_path / "in", ["2020-12-01", "2020-12-02"])
    with open(tmp_path / "in" / "day=2020-12-02" / "more.csv", "w") as file:
        file.writelines(line + "\n" for line in extra)
    return read_landed_days(spark, str(tmp_path / "in"), strict=False)


def test_records_stay_with_the_day_they_landed_under(spark, tmp_path, rows, universe):
    stray = record("2020-12-01", "235959", "p.com", "u8", "ENV_A", "visa", "1,1,1,1,1,1,10")
    undated = record("2020-12-02", "", "p.com", "u9", "ENV_A", "visa", "1,1,1,1,1,1,10")
    made = jobs.Products(str(tmp_path / "out"), "2020-12-01", "2020-12-02", jobs.universe_tag(universe))
    land(tmp_path / "in", ["2020-12-01"])
    early = read_landed_days(spark, str(tmp_path / "in"), strict=False)
    jobs.build_articles(early, universe, made, "2020-12-01", "2020-12-02", on_error="skip", today="2021-01-01")
    landed = landed_with(spark, tmp_path, [stray, undated])
    stored = jobs.build_articles(landed, universe, made, "2020-12-01", "2020-12-02", today="2021-01-01")
    found = rows(stored.select("day", "URL").distinct())
    assert found == [(date(2020, 12, 1), "u1"), (date(2020, 12, 1), "u2"), (date(2020, 12, 2), "u3"), (date(2020, 12, 2), "u8"), (date(2020, 12, 2), "u9")]


def test_a_crash_between_rows_and_list_loses_nothing(spark, tmp_path, rows, monkeypatch):
    land(tmp_path / "in", ["2020-12-01"])
    landed = read_landed_days(spark, str(tmp_path / "in"))
    store = DayStore(spark, str(tmp_path / "store"))
    build = lambda days: days.select("day", F.col("DocumentIdentifier").alias("URL"))
    store.update(landed, build, "2020-12-01", "2020-12-01", "2021-01-01")

    def die(*_):
        raise RuntimeError("died")

    with monkeypatch.context() as patch:
        patch.setattr(store, "_publish", die)
        with pytest.raises(RuntimeError):
            store.update(landed, build, "2020-12-01", "2020-12-01", override=True)
    assert rows(store.read("2020-12-01", "2020-12-01"), "URL") == [("u1",), ("u2",)]
    store.update(landed, build, "2020-12-01", "2020-12-01", override=True)
    assert store.drop_old_runs() == 2 and store.drop_old_runs() == 0
    assert rows(store.read("2020-12-01", "2020-12-01"), "URL") == [("u1",), ("u2",)]


def test_scores_follow_the_store(spark, tmp_path, rows, universe, monkeypatch):
    monkeypatch.setattr(jobs, "build_graph", lambda *_, **__: None)
    land(tmp_path / "in", ["2020-12-01"])

    def run():
        landed = read_landed_days(spark, str(tmp_path / "in"))
        return jobs.make_products(landed, universe, str(tmp_path / "out"), "2020-12-01", "2020-12-02", on_error="skip")

    def scored(made):
        return rows(spark.read.parquet(made.diffs).select("date").distinct())

    assert scored(run()) == [(date(2020, 12, 1),)]
    land(tmp_path / "in", ["2020-12-02"])
    whole = jobs.write_csv

    def die(df, path, **options):
        if "ESG" in path:
            raise RuntimeError("died")
        return whole(df, path, **options)

    with monkeypatch.context() as patch:
        patch.setattr(jobs, "write_csv", die)
        with pytest.raises(RuntimeError):
            run()
    made = run()
    assert scored(made) == [(date(2020, 12, 1),), (date(2020, 12, 2),)]
    assert spark.read.option("header", True).csv(made.files["E_score"]).count() == 2
    fewer = universe.filter("rank < 3")
    assert jobs.universe_tag(fewer) != jobs.universe_tag(universe)


def test_stream_equals_batch(spark, tmp_path, rows, universe):
    aliases = alias_table(universe)
    land(tmp_path / "in", ["2020-12-01", "2020-12-02"])
    folder = str(tmp_path / "stream")

    def run():
        feed = stream_feed(spark, f"{tmp_path}/in/*")
        stream_daily_sums(reformat_articles(feed, aliases), folder).awaitTermination()

    run()
    land(tmp_path / "in", ["2020-12-04"])
    run()
    compact_sums(spark, folder)
    run()
    land(tmp_path / "in", ["2020-12-05"])
    run()
    compact_sums(spark, folder)
    compact_sums(spark, folder)
    assert len([n for n in os.listdir(f"{folder}/sums") if n.startswith("batch=")]) == 1
    assert len(os.listdir(f"{folder}/compacted")) == 1
    batch = daily_sums(reformat_articles(read_feed(spark, f"{tmp_path}/in/*"), aliases))
    columns = ["segment", "date", "org", "tone_sum", "word_sum"]
    assert rows(streamed_sums(spark, folder), *columns) == rows(batch, *columns)


def test_nan_is_null(spark, rows):
    from newsgraph.functions.text import tone_columns

    df = spark.createDataFrame([("NaN,1,nan,2,3,4,5",)], "t string").select(*tone_columns(F.col("t")))
    assert rows(df) == [(None, 1.0, None, 2.0, 3.0, 4.0, 5.0)]


def test_wide_labels_name_their_company(spark, rows):
    from newsgraph.operators.reshape import scores_long, scores_wide

    diffs = spark.createDataFrame([(date(2024, 1, 1), "a_b", 0.5), (date(2024, 1, 1), "c d", 1.5)], "date date, org string, diff double")
    industry = spark.createDataFrame([(date(2024, 1, 1), 0.1)], "date date, industry_tone double")
    orgs = ["a_b", "c d"]
    long = scores_long(scores_wide(diffs, industry, orgs), "E", orgs)
    assert rows(long) == [("E", date(2024, 1, 1), "a_b", 0.5), ("E", date(2024, 1, 1), "c d", 1.5)]
    with pytest.raises(ValueError, match="share the column"):
        scores_wide(diffs, industry, ["a_b", "a b"])


def test_union_days_matches_names(spark, rows):
    one = spark.createDataFrame([(1, "x")], "a int, b string")
    two = spark.createDataFrame([("y", 2)], "b string, a int")
    assert rows(union_days([one, two])) == [(1, "x"), (2, "y")]


def test_bundle(spark, tmp_path, rows):
    os.makedirs(tmp_path / "ESG")
    wide = "date,industry_tone,a_b_diff,c_diff\n2020-12-01,0.1,0.0005,\n2020-12-02,0.2,,-0.0002\n"
    texts = {
        "conn": ",company,n0_rec,n0_conf,n1_rec,n1_conf\n0,a b,c,0.9,,\n",
        "data": "DATE,SourceCommonName,URL,E,S,G,Organization,Tone,PositiveTone,NegativeTone,Polarity,ActivityDensity,"
        "SelfDensity,WordCount\n2020-12-01 10:00:00,p,u,True,False,False,a b,1,2,3,4,5,6,7\n",
        "embed": "0,1,2,company\n0.5,-0.5,1.0,a b\n",
        "ESG": ",a b,c\nE,0.0005,\nT,,0.25\n",
    }
    for name, file in BUNDLE_FILES.items():
        (tmp_path / file).write_text(texts.get(name, wide))
    got = bundle.read_bundle(spark, str(tmp_path), neighbors=2)
    assert rows(got.diffs.filter("segment = 'G'"), "date", "org", "diff") == [
        (date(2020, 12, 1), "a b", 5.0), (date(2020, 12, 1), "c", None),
        (date(2020, 12, 2), "a b", None), (date(2020, 12, 2), "c", -2.0),
    ]
    assert got.diffs.select("segment").distinct().count() == 4
    assert rows(got.scores.filter("score is not null")) == [("E", "a b", 5.0), ("T", "c", 2500.0)]
    assert rows(got.connections) == [("a b", 0, "c", 0.9)]
    assert rows(got.articles, "DATE", "E", "WordCount") == [(date(2020, 12, 1), True, 7.0)]
    assert rows(got.points) == [(0.5, -0.5, 1.0, "a b")]
    assert bundle.in_period(got.articles, "ten_days", "DATE").count() == 1
    with pytest.raises(ValueError):
        bundle.period_bounds("ten_years")


def test_write_csv_of_nested(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "id int, l array<string>")
    sinks.write_csv(df, str(tmp_path / "c"), single_file=True)
    assert tuple(spark.read.option("header", True).option("escape", '\\').csv(str(tmp_path / "c")).first()) == ("1", '["a","b"]')


def urls(df):
    return df.select("day", F.col("DocumentIdentifier").alias("URL"))


def test_days_with_changed_files_are_built_again(spark, tmp_path, rows):
    folder, store = str(tmp_path / "landing"), DayStore(spark, str(tmp_path / "store"))
    land(folder, ["2020-12-01", "2020-12-02", "2020-12-04"])

    def update(**more):
        landed = read_landed_days(spark, folder)
        return store.update(landed, urls, "2020-12-01", "2020-12-04", "2021-01-01", on_error="skip", files=landed_files(spark, folder), **more)

    assert rows(update()) == [(date(2020, 12, 3),)]
    runs = {r["day"]: r["run"] for r in store.built_days().collect()}
    assert store.changed_days(landed_files(spark, folder)).collect() == []
    update()
    assert {r["day"]: r["run"] for r in store.built_days().collect()} == runs
    with open(f"{folder}/day=2020-12-02/late.csv", "w") as file:
        file.write(record("2020-12-02", "120000", "p.com", "u9", "ENV_A", "visa", "1,1,1,1,1,1,10") + "\n")
    os.utime(f"{folder}/day=2020-12-04/part.csv", (1_700_000_000, 1_700_000_000))
    changed = [(date(2020, 12, 2),), (date(2020, 12, 4),)]
    assert rows(store.changed_days(landed_files(spark, folder))) == changed
    update()
    after = {r["day"]: r["run"] for r in store.built_days().collect()}
    assert [day for day in runs if after[day] != runs[day]] and {day for day in runs if after[day] != runs[day]} == {c[0] for c in changed}
    assert rows(store.read("2020-12-01", "2020-12-04"), "URL") == [("u1",), ("u2",), ("u3",), ("u4",), ("u5",), ("u9",)]
    assert store.changed_days(landed_files(spark, folder)).collect() == []
    os.remove(f"{folder}/day=2020-12-02/late.csv")
    assert rows(store.changed_days(landed_files(spark, folder))) == changed[:1]


def test_changed_days_of_lists(spark, rows):
    schema = "day date, file string, bytes long, modified timestamp"
    at = pd.Timestamp("2021-01-01").to_pydatetime()
    d = [date(2020, 12, k) for k in range(1, 6)]
    before = spark.createDataFrame([(d[0], "a", 1, at), (d[1], "b", 1, at), (d[2], "c", 1, at), (d[4], "gone", 1, at)], schema)
    now = spark.createDataFrame([(d[0], "a", 1, at), (d[0], "a", 1, at), (d[1], "b", 2, at), (d[2], "c", 1, at), (d[2], "x", 1, at), (d[3], "new", 0, at)], schema)
    assert rows(changed_days(before, now)) == [(d[1],), (d[2],), (d[3],)]


def test_bad_lines_stop_neither_their_day_nor_others(spark, tmp_path, rows):
    folder, store = str(tmp_path / "landing"), DayStore(spark, str(tmp_path / "store"))
    land(folder, ["2020-12-01", "2020-12-02"])
    wrong = record("2020-12-02", "120000", "p.com", "u8", "ENV_A", "visa", "1,1")
    with open(f"{folder}/day=2020-12-02/bad.csv", "w") as file:
        file.write("only\tthree\tcells\n\n" + wrong.replace("20201202120000", "someday") + "\n" + wrong + "\textra\n")
    os.makedirs(f"{folder}/day=2020-12-03")
    with open(f"{folder}/day=2020-12-03/bad.csv", "w") as file:
        file.write("\x00\xff nothing\n")
    records = read_landed_records(spark, folder)
    good = read_landed_days(spark, folder, strict=False).filter("DocumentIdentifier like 'u%' and DATE is not null and DocumentIdentifier <> 'u8'")
    assert rows(good_records(records)) == rows(good.select(good_records(records).columns))

    def update(frame):
        return store.update(
            good_records(frame), urls, "2020-12-01", "2020-12-03", "2021-01-01", files=landed_files(spark, folder), bad=bad_records(frame)
        )

    assert update(records).collect() == []
    assert rows(store.read("2020-12-01", "2020-12-03"), "URL") == [("u1",), ("u2",), ("u3",)]
    reasons = rows(store.quarantined(), "day", "reason")
    assert reasons == sorted([(date(2020, 12, 2), r) for r in ("columns", "columns", "columns", "date")] + [(date(2020, 12, 3), "columns")], key=repr)
    # A mended file is taken in, and its lines leave the quarantine.
    with open(f"{folder}/day=2020-12-02/bad.csv", "w") as file:
        file.write(wrong + "\n")
    update(read_landed_records(spark, folder))
    assert rows(store.read("2020-12-01", "2020-12-03"), "URL") == [("u1",), ("u2",), ("u3",), ("u8",)]
    assert rows(store.quarantined(), "day", "reason") == [(date(2020, 12, 3), "columns")]


def test_streamed_feed_takes_a_record_once(spark, tmp_path, rows, universe):
    folder, progress = str(tmp_path / "landing"), str(tmp_path / "progress")
    aliases = alias_table(universe).cache()
    land(folder, ["2020-12-02", "2020-12-04"])

    def run():
        articles = stream_articles(stream_feed(spark, folder, files=1), aliases)
        stream_daily_sums(articles, progress).awaitTermination()

    run()
    # A late day, and one that landed before under another name.
    land(folder, ["2020-12-01"])
    with open(f"{folder}/day=2020-12-04/again.csv", "w") as file:
        file.writelines(record("2020-12-04", *fields) + "\n" for fields in DAYS["2020-12-04"])
    run()
    os.remove(f"{folder}/day=2020-12-04/again.csv")
    batch = daily_sums(reformat_articles(read_landed_days(spark, folder), aliases))
    assert rows(streamed_sums(spark, progress).select(batch.columns)) == rows(batch)


def test_holdings_lines_are_numbered_over_blocks_and_files(spark, tmp_path, rows):
    folder = tmp_path / "holdings"
    folder.mkdir()
    lines = [f"preamble {k}" for k in range(9)] + ["Ticker,Name,Sector"] + [f't{k},"NAME {k}, INC",S{k % 3}' for k in range(400)]
    for part, (i, j) in enumerate([(0, 3), (3, 200), (200, 201), (201, 410)]):
        (folder / f"part-{part}.csv").write_text("\n".join(lines[i:j]) + "\n")
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("256", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = rows(numbered_lines(spark, str(folder)).select("number", "value"))
            assert sorted(got) == list(enumerate(lines, 1))
            held = read_holdings(spark, str(folder)).orderBy("rank").collect()
            assert [tuple(r) for r in held] == [(f"NAME {k}, INC", f"S{k % 3}", k + 1) for k in range(400)]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_ordered_rows_come_back_in_their_order(spark, tmp_path):
    path = str(tmp_path / "ordered")
    data = [(k * 7919 % 500, str(k % 3)) for k in range(500)] + [(None, "n")]
    sinks.write_ordered(spark.createDataFrame(data, "a int, b string").repartition(5), path, "b", "a")
    got = sorted((r["position"], r["b"], r["a"]) for r in sinks.read_ordered(spark, path).collect())
    wanted = sorted(data, key=lambda r: (r[1], r[0] is not None, r[0] or 0))
    assert got == [(k, b, a) for k, (a, b) in enumerate(wanted)]
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) > 1


@pytest.mark.parametrize("columns", [1, 4, 50])
def test_score_blocks(spark, tmp_path, rows, columns):
    data = [(s, date(2021, 1, d), f"org {k}", float(k * d) if (k + d) % 4 else None) for s in "TE" for d in (1, 2, 5) for k in range(11)]
    diffs = spark.createDataFrame(data, "segment string, date date, org string, diff double")
    blocks = ScoreBlocks(spark, str(tmp_path / "blocks"), columns)
    blocks.write(diffs)
    assert rows(blocks.read()) == sorted([r for r in data if r[3] is not None], key=repr)
    assert rows(blocks.manifest().groupBy("block").count().agg(F.max("count"))) == [(min(columns, 11),)]


def test_range_averages_are_those_of_a_scan(spark, tmp_path, rows):
    data = [(s, date(2021, 1, d), f"org {k}", float(k * d % 7)) for s in "TE" for d in (1, 2, 5, 6, 9) for k in range(5) if (k + d) % 3]
    data += [("T", date(2021, 1, 3), "late", 5.0), ("T", date(2021, 1, 4), "late", None)]
    diffs = spark.createDataFrame(data, "segment string, date date, org string, diff double")
    path = str(tmp_path / "sums")
    ranges.write_running_sums(ranges.running_sums(diffs, "2021-01-01", "2021-01-12"), path)
    sums = spark.read.parquet(path)
    for a, b in [(1, 12), (1, 1), (3, 4), (7, 8), (5, 9), (10, 12), (2, 6)]:
        bounds = f"2021-01-{a:02d}", f"2021-01-{b:02d}"
        scan = diffs.filter(F.col("date").between(*[F.lit(x).cast("date") for x in bounds]) & F.col("diff").isNotNull())
        wanted = scan.groupBy("segment", "org").agg(F.avg("diff").alias("score"))
        got = ranges.range_average(sums, *bounds)
        assert rows(got.withColumn("score", F.round("score", 9))) == rows(wanted.withColumn("score", F.round("score", 9)))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("PartitionFilters: [isnotnull(date") == 2


def test_edges_of_a_range_are_sums_of_days(spark, tmp_path, rows):
    rng = random.Random(3)
    data = [(date(2021, 1, rng.randint(1, 5)), "r0", f"u{rng.randint(0, 12)}", rng.choice("abcdef")) for _ in range(150)]
    mentions = spark.createDataFrame([*data, (date(2021, 1, 1), "r0", None, "a")], "day date, run string, URL string, Organization string")
    store = EdgeStore(spark, str(tmp_path / "edges"))
    some = mentions.filter("day <= '2021-01-03'")
    days = lambda df: df.select("day", "run").distinct()
    assert store.update(some, days(some)) == 3
    assert rows(store.edges(days(some), some)) == rows(comention_edges(some))
    assert store.update(mentions, days(mentions)) == 2
    assert store.update(mentions, days(mentions)) == 0
    assert rows(store.edges(days(mentions), mentions)) == rows(comention_edges(mentions))
    # One day is built again, with other rows.
    again = mentions.filter("day <> '2021-01-02'").unionByName(
        spark.createDataFrame([(date(2021, 1, 2), "r1", "u1", "a"), (date(2021, 1, 2), "r1", "u1", "z")], mentions.schema)
    )
    assert store.update(again, days(again)) == 1
    assert rows(store.edges(days(again), again)) == rows(comention_edges(again))


def test_the_graph_is_built_again_only_when_days_or_settings_change(spark, tmp_path, rows, universe, monkeypatch):
    built = []
    plain = jobs.build_graph
    monkeypatch.setattr(jobs, "build_graph", lambda *a, **k: (built.append(1), plain(*a, **k)))
    options = dict(walk_length=4, walks_per_vertex=3, dimensions=3, neighbors=2, save_csv=False, wide=False, vectors="factors")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    land(folder, ["2020-12-01", "2020-12-02"])

    def make(**more):
        landed, files = read_landed_days(spark, folder), landed_files(spark, folder)
        return jobs.make_products(landed, universe, out, "2020-12-01", "2020-12-04", on_error="skip", files=files, **{**options, **more})

    made = make()
    make()
    assert len(built) == 1
    make(walk_length=5)
    assert len(built) == 2
    land(folder, ["2020-12-04"])
    make(walk_length=5)
    assert len(built) == 3
    edges = rows(spark.read.parquet(made.edges))
    assert edges == [("apple", "apple", 1), ("apple", "nike", 3), ("apple", "visa", 3), ("nike", "visa", 2)]
    assert EdgeStore(spark, made.day_edges).summed_days().count() == 3
