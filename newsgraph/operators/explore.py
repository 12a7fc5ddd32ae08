"""Queries of the exploration view: filters, listings, series, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgraph.constants import (
    INDUSTRY_LABEL,
    LISTING_COLUMNS,
    SCATTER_COLUMNS,
    SEGMENT_LABELS,
)

FLAGS = ["E", "S", "G"]


# Filters ------------------------------------------------------------------


def any_flag(articles: DataFrame) -> DataFrame:
    """Articles with at least one of the three flags."""
    return articles.filter(F.col("E") | F.col("S") | F.col("G"))


def with_flag(articles: DataFrame, flag: str) -> DataFrame:
    """Articles with one flag."""
    return articles.filter(F.col(flag))


def of_company(articles: DataFrame, company: str, column: str = "Organization") -> DataFrame:
    """Rows of one company."""
    return articles.filter(F.col(column) == F.lit(company))


def date_range(
    df: DataFrame, start: str, end: str, column: str = "DATE"
) -> DataFrame:
    """Rows whose calendar day lies in ``[start, end]``.

    Written as bounds on the column itself, so it is pushed to the scan and
    prunes date partitions.
    """
    dtype = df.schema[column].dataType
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    if isinstance(dtype, T.DateType):
        return df.filter(F.col(column).between(first, last))
    return df.filter(
        (F.col(column) >= first.cast(dtype)) & (F.col(column) < F.date_add(last, 1).cast(dtype))
    )


def of_publisher(articles: DataFrame, publisher: str = "all") -> DataFrame:
    """Rows of one publisher; ``all`` keeps every row."""
    if publisher == "all":
        return articles
    return articles.filter(F.col("SourceCommonName") == publisher)


def matched_categories(categories: list[str]) -> Column:
    """How many of the chosen categories an article has."""
    return reduce(
        Column.__add__, [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in categories], F.lit(0)
    )


def category_articles(
    articles: DataFrame, categories: list[str], mode: str = "bag"
) -> DataFrame:
    """Articles of the chosen categories.

    ``bag`` repeats an article once per category it matches, which is what
    putting one selection per category end to end gives and what counts and
    means of the view rest on; ``any`` keeps it once.
    """
    if mode == "any":
        return articles.filter(matched_categories(categories) > 0)
    if mode != "bag":
        raise ValueError(f"unknown mode {mode!r}")
    hits = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in categories]))
    return articles.withColumn("category", F.explode(hits))


def company_view(
    articles: DataFrame,
    company: str,
    categories: list[str],
    start: str,
    end: str,
    publisher: str = "all",
    mode: str = "bag",
) -> DataFrame:
    """All filters of the view on one company."""
    rows = of_publisher(date_range(of_company(articles, company), start, end), publisher)
    return category_articles(rows, categories, mode)


# Listings and counts --------------------------------------------------------


def article_listing(articles: DataFrame) -> DataFrame:
    """The columns of the article table."""
    return articles.select(*LISTING_COLUMNS)


def article_scatter(articles: DataFrame) -> DataFrame:
    """The columns of the positive-against-negative scatter."""
    return articles.select(*SCATTER_COLUMNS)


def publisher_articles(articles: DataFrame) -> DataFrame:
    """``(SourceCommonName, articles)``: row count per publisher."""
    named = articles.filter(F.col("SourceCommonName").isNotNull())
    return named.groupBy("SourceCommonName").agg(F.count(F.lit(1)).alias("articles"))


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-null values of a column."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def date_bounds(articles: DataFrame) -> DataFrame:
    """``(first_date, last_date)`` in one row."""
    day = F.to_date("DATE")
    return articles.agg(F.min(day).alias("first_date"), F.max(day).alias("last_date"))


# Series and profiles ----------------------------------------------------------


def metric_over_time(
    articles: DataFrame,
    company: str,
    metric: str,
    start: str,
    end: str,
    categories: list[str] | None = None,
    publisher: str = "all",
    mode: str = "bag",
) -> DataFrame:
    """``(WHO, DATE, value)``: daily mean of a metric, company and industry.

    The company line covers the filtered articles, the industry line all
    articles of the dates. Both come from one scan and one aggregate: an
    article that a bag selection repeats counts with that weight in the company
    mean.
    """
    hits = matched_categories(categories or FLAGS)
    weight = hits if mode == "bag" else F.least(hits, F.lit(1))
    chosen = F.col("Organization") == F.lit(company)
    if publisher != "all":
        chosen = chosen & (F.col("SourceCommonName") == publisher)
    value = F.col(metric)
    weight = F.when(chosen, weight).otherwise(F.lit(0))
    days = (
        date_range(articles, start, end)
        .select(F.to_date("DATE").alias("DATE"), value.alias("v"), weight.alias("w"))
        .groupBy("DATE")
        .agg(
            F.avg("v").alias("industry"),
            F.sum("w").alias("company_rows"),
            F.try_divide(
                F.sum(F.col("v") * F.col("w")), F.sum(F.when(F.col("v").isNotNull(), F.col("w")))
            ).alias("company"),
        )
    )
    lines = F.array(
        F.struct(
            F.lit(company.title()).alias("WHO"),
            F.col("company").alias("value"),
            (F.col("company_rows") > 0).alias("shown"),
        ),
        F.struct(
            F.lit(INDUSTRY_LABEL).alias("WHO"),
            F.col("industry").alias("value"),
            F.lit(True).alias("shown"),
        ),
    )
    return (
        days.select("DATE", F.inline(lines)).filter("shown").select("WHO", "DATE", "value")
    )


def segment_series(diffs: DataFrame, company: str, segments: list[str]) -> DataFrame:
    """``(DATE, ESG, Score)`` of one company, one series per segment.

    Each series has a row for every date any chosen segment has, and a missing
    score takes the last one before it in the same series.
    """
    chosen = diffs.filter(F.col("segment").isin(segments))
    own = F.col("org") == F.lit(company)
    cells = chosen.groupBy("date").agg(
        *[
            F.max(F.when(own & (F.col("segment") == s), F.col("diff"))).alias(s)
            for s in segments
        ]
    )
    return _melt_and_fill(cells, segments)


def industry_series(diffs: DataFrame, segments: list[str]) -> DataFrame:
    """``(DATE, ESG, Score)`` of the mean over companies."""
    chosen = diffs.filter(F.col("segment").isin(segments))
    cells = chosen.groupBy("date").agg(
        *[F.avg(F.when(F.col("segment") == s, F.col("diff"))).alias(s) for s in segments]
    )
    return _melt_and_fill(cells, segments)


def _melt_and_fill(cells: DataFrame, segments: list[str]) -> DataFrame:
    long = cells.unpivot("date", segments, "ESG", "Score")
    upto = (
        Window.partitionBy("ESG")
        .orderBy("date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return long.select(
        F.col("date").alias("DATE"), "ESG", F.last("Score", ignorenulls=True).over(upto).alias("Score")
    )


def score_over_time(
    diffs: DataFrame, company: str, segments: list[str], start: str, end: str
) -> DataFrame:
    """``(WHO, ESG, DATE, Score)``: company and industry score lines."""
    company_line = segment_series(diffs, company, segments).withColumn("WHO", F.lit(company.title()))
    industry_line = industry_series(diffs, segments).withColumn("WHO", F.lit(INDUSTRY_LABEL))
    lines = date_range(company_line.unionByName(industry_line), start, end)
    return lines.select("WHO", segment_label(F.col("ESG")).alias("ESG"), "DATE", "Score")


def segment_label(segment: Column) -> Column:
    """Display name of a segment."""
    names = F.create_map(*[F.lit(v) for pair in SEGMENT_LABELS.items() for v in pair])
    return F.coalesce(F.try_element_at(names, segment), segment)


def radar_scores(scores: DataFrame, company: str) -> DataFrame:
    """``(Type, entity, score)``: a company's averages beside the industry's.

    One aggregate over the average scores gives both.
    """
    own = F.when(F.col("org") == F.lit(company), F.col("score"))
    pairs = F.array(
        F.struct(F.lit(company).alias("entity"), F.col("own").alias("score")),
        F.struct(F.lit(INDUSTRY_LABEL).alias("entity"), F.col("all").alias("score")),
    )
    return (
        scores.groupBy("segment")
        .agg(F.max(own).alias("own"), F.avg("score").alias("all"))
        .select(segment_label(F.col("segment")).alias("Type"), F.inline(pairs))
    )


# Formatting -------------------------------------------------------------------


def format_columns(df: DataFrame, places: int = 4, rows: int | None = None) -> DataFrame:
    """Every column as display text, by its type; ``rows`` limits the display."""

    def shown(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.date_format(column, "y-MM-dd")
        if isinstance(field.dataType, T.IntegralType):
            return F.format_number(column, 0)
        if isinstance(field.dataType, T.NumericType):
            return F.format_number(column, places)
        return column

    text = df.select(*[shown(f).alias(f.name) for f in df.schema.fields])
    return text if rows is None else text.limit(rows)
