"""Averages over any range of days from two rows a series.

Sums and counts that run over the days are stored once, a row per series and
calendar day, in one partition per day. A range is the difference of the day it
ends on and the day before it starts: two partitions are read, however long the
range is.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["segment", "org"]


def running_sums(diffs: DataFrame, start: str, end: str) -> DataFrame:
    """``(segment, org, date, total, days)``: sum and number of a series' scores up to each day.

    ``diffs`` is ``(segment, date, org, diff)``; days are those of an inclusive
    range, and a series has a row from its first score on. Its own rows are added
    up in one window, and each holds until the next one.
    """
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    own = diffs.filter(F.col("date").between(first, last) & F.col("diff").isNotNull())
    daily = own.groupBy(*SERIES, "date").agg(F.sum("diff").alias("sum"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*SERIES).orderBy("date")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = daily.select(
        *SERIES,
        "date",
        F.sum("sum").over(upto).alias("total"),
        F.sum("n").over(upto).alias("days"),
        F.coalesce(F.date_sub(F.lead("date").over(order), 1), last).alias("until"),
    )
    return held.select(*SERIES, F.explode(F.sequence("date", "until")).alias("date"), "total", "days")


def write_running_sums(sums: DataFrame, path: str) -> None:
    """One partition per day."""
    sums.hint("rebalance", F.col("date")).write.mode("overwrite").partitionBy("date").parquet(path)


def range_average(sums: DataFrame, start: str, end: str) -> DataFrame:
    """``(segment, org, score)``: mean score of the days of an inclusive range, of series that have some.

    ``sums`` is what `write_running_sums` stored, and must reach to ``end``.
    """
    before = (date.fromisoformat(start) - timedelta(days=1)).isoformat()
    at = lambda day: sums.filter(F.col("date") == F.lit(day).cast("date"))
    old = at(before).select(*SERIES, F.col("total").alias("old_total"), F.col("days").alias("old_days"))
    joined = at(end).join(old, SERIES, "left")
    days = F.col("days") - F.coalesce("old_days", F.lit(0))
    total = F.col("total") - F.coalesce("old_total", F.lit(0.0))
    return joined.filter(days > 0).select(*SERIES, (total / days).alias("score"))
