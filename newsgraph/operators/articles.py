"""From raw feed records to the article-by-company table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.constants import EXPORT_COLUMNS, FEED_COLUMNS
from newsgraph.functions.text import (
    flag_columns,
    gcam_columns,
    gcam_entries,
    nested_to_text,
    split_list,
    tone_columns,
)
from newsgraph.operators.universe import clean_organization


def decode_articles(feed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per article: lists split, flags and tone metrics as columns.

    ``keep`` names further columns of the feed to carry along.
    """
    kept = feed.select(*FEED_COLUMNS, *keep).withColumnRenamed("DocumentIdentifier", "URL")
    return kept.select(
        *keep,
        "DATE",
        "SourceCommonName",
        "URL",
        split_list(F.col("Themes")).alias("Themes"),
        split_list(F.col("Organizations")).alias("Organizations"),
        *flag_columns(F.col("Themes")),
        *tone_columns(F.col("V2Tone")),
    )


def explode_organizations(articles: DataFrame) -> DataFrame:
    """One row per organization an article names, repeats included."""
    return articles.withColumn("Organization", F.explode("Organizations"))


def explode_gcam(df: DataFrame, column: str = "GCAM") -> DataFrame:
    """One row per content-analysis entry: ``kind, dictionary_id, dimension_id, value``.

    Entries of an unknown kind are left out.
    """
    others = [c for c in df.columns if c != column]
    rows = df.select(*others, F.explode(gcam_entries(F.col(column))).alias("_entry"))
    return rows.select(*others, *gcam_columns(F.col("_entry"))).filter(F.col("kind").isNotNull())


def reformat_articles(feed: DataFrame, aliases: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The article-by-company table of a raw feed, with the further columns ``keep``.

    Flags and metrics are worked out once per article, before the explode.
    """
    exploded = decode_articles(feed, keep).transform(explode_organizations)
    lead = ["DATE", "SourceCommonName", "URL", "Themes", "Organizations", "E", "S", "G", "Organization"]
    tail = [c for c in exploded.columns if c not in lead]
    return clean_organization(exploded, aliases).select(*lead, *tail)


def export_columns(articles: DataFrame) -> DataFrame:
    """The flat columns of the article export."""
    return articles.select(*EXPORT_COLUMNS)


def union_days(days: list[DataFrame]) -> DataFrame:
    """All rows of several day tables, matched by column name."""
    return reduce(DataFrame.unionByName, days)


def stringify_nested(df: DataFrame) -> DataFrame:
    """Array and map columns as JSON text, ready for a flat file."""
    return df.select(
        *[nested_to_text(f.dataType, F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields]
    )
