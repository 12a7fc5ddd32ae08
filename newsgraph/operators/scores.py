"""Daily tones, scores against the industry, and their averages.

Everything is long: one row per segment, date and organization. Segments
overlap (an article may carry several flags, and all articles are in ``T``), so
an article feeds several of them; the sums of all four are taken side by side
in one aggregate and only the result, one row per date and organization, is
split into segment rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENTS = ["T", "E", "S", "G"]


def _when(segment: str, value: Column) -> Column:
    return value if segment == "T" else F.when(F.col(segment), value)


def daily_sums(articles: DataFrame, by_org: bool = True) -> DataFrame:
    """``(segment, date[, org], tone_sum, word_sum)``.

    The sums, unlike the ratio, can be added up over parts of a day.
    """
    keys = [F.to_date("DATE").alias("date")]
    if by_org:
        keys.append(F.col("Organization").alias("org"))
    parts = []
    for segment in SEGMENTS:
        parts += [
            F.count(_when(segment, F.lit(1))).alias(f"{segment}_rows"),
            F.sum(_when(segment, F.col("Tone"))).alias(f"{segment}_tone"),
            F.sum(_when(segment, F.col("WordCount"))).alias(f"{segment}_words"),
        ]
    wide = articles.filter(F.to_date("DATE").isNotNull()).groupBy(*keys).agg(*parts)
    rows = F.array(
        *[
            F.struct(
                F.lit(segment).alias("segment"),
                F.col(f"{segment}_rows").alias("rows"),
                F.col(f"{segment}_tone").alias("tone_sum"),
                F.col(f"{segment}_words").alias("word_sum"),
            )
            for segment in SEGMENTS
        ]
    )
    names = ["date", "org"] if by_org else ["date"]
    present = F.filter(rows, lambda row: row["rows"] > 0)
    return wide.select(*names, F.explode(present).alias("r")).select(
        "r.segment", *names, "r.tone_sum", "r.word_sum"
    )


def tone_ratio() -> Column:
    """Sum of tone over sum of words; null where no word was counted."""
    return F.try_divide(F.sum("tone_sum"), F.sum("word_sum"))


def daily_tone(articles: DataFrame) -> DataFrame:
    """``(segment, date, org, tone)`` of every organization."""
    return daily_sums(articles).select(
        "segment", "date", "org", F.try_divide("tone_sum", "word_sum").alias("tone")
    )


def industry_tone(sums: DataFrame) -> DataFrame:
    """``(segment, date, industry_tone)`` over all organizations."""
    return sums.groupBy("segment", "date").agg(tone_ratio().alias("industry_tone"))


def daily_diff(articles: DataFrame) -> DataFrame:
    """``(segment, date, org, diff)``: company tone minus industry tone.

    The fact table is aggregated once; the industry line adds up the company
    sums. Its side of the join is broadcast because it holds at most one row
    per segment and calendar day.
    """
    return diff_of_sums(daily_sums(articles))


def diff_of_sums(sums: DataFrame) -> DataFrame:
    """`daily_diff` from sums that are already daily."""
    joined = sums.join(F.broadcast(industry_tone(sums)), ["segment", "date"])
    own = F.try_divide("tone_sum", "word_sum")
    return joined.select("segment", "date", "org", (own - F.col("industry_tone")).alias("diff"))


def average_scores(diffs: DataFrame) -> DataFrame:
    """``(segment, org, score)``: mean of the daily diffs, before any fill."""
    return diffs.groupBy("segment", "org").agg(F.avg("diff").alias("score"))


def column_averages(df: DataFrame) -> DataFrame:
    """One row with the mean of every numeric column."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return df.agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in numeric])


def industry_average_series(diffs: DataFrame) -> DataFrame:
    """``(segment, date, score)``: mean over companies of each day's diffs."""
    return diffs.groupBy("segment", "date").agg(F.avg("diff").alias("score"))


def scale_numeric(df: DataFrame, factor: float) -> DataFrame:
    """Multiply every numeric column by ``factor``."""
    return df.select(
        *[
            (F.col(f"`{f.name}`") * F.lit(factor)).alias(f.name)
            if isinstance(f.dataType, T.NumericType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
