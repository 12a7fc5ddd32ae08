"""Expressions that decode the text fields of a feed record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgraph.constants import FLAG_TOKENS, LOCATION_TYPES, TONE_COLUMNS


def split_list(text: Column, sep: str = ";") -> Column:
    """Array of the non-empty items of a delimited list; null gives ``[]``."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), sep), "")


def has_token(text: Column, token: str) -> Column:
    """True if any item of a ``;`` list, cut at ``_``, holds exactly ``token``.

    Items and their parts end at either mark, so one search of the whole text
    decides it and the list need not be taken apart.
    """
    marked = F.concat(F.lit(";"), F.replace(F.coalesce(text, F.lit("")), F.lit("_"), F.lit(";")), F.lit(";"))
    return F.contains(marked, F.lit(f";{token};"))


def flag_columns(themes: Column) -> list[Column]:
    """The E, S and G flags of an article's theme text."""
    return [has_token(themes, token).alias(flag) for flag, token in FLAG_TOKENS.items()]


def without_nan(number: Column) -> Column:
    """The number, or null where it is NaN."""
    return F.nanvl(number, F.lit(None).cast("double"))


def tone_columns(text: Column) -> list[Column]:
    """The seven tone metrics of a comma list.

    Missing or non-numeric entries, NaN among them, are null and entries past
    the seventh are ignored, so one malformed record never fails a whole load.
    """
    parts = F.split(text, ",")
    return [
        without_nan(F.try_element_at(parts, F.lit(position)).try_cast("double")).alias(name)
        for position, name in enumerate(TONE_COLUMNS, start=1)
    ]


def feed_timestamp(text: Column, strict: bool = True) -> Column:
    """Timestamp of a ``yyyyMMddHHmmss`` text; lenient mode gives null on junk."""
    parse = F.to_timestamp if strict else F.try_to_timestamp
    pattern = "yyyyMMddHHmmss"
    return parse(text, pattern) if strict else parse(text, F.lit(pattern))


def parse_locations(text: Column, fields: list[str]) -> Column:
    """Array of structs from a ``;`` list of ``#``-separated locations.

    The first field is the location type and is replaced by its name when the
    code is known.
    """
    names = F.create_map(*[F.lit(v) for pair in LOCATION_TYPES.items() for v in pair])

    def one(item: Column) -> Column:
        parts = F.split(item, "#")
        code = F.get(parts, F.lit(0))
        first = F.coalesce(F.try_element_at(names, code), code).alias(fields[0])
        rest = [
            F.get(parts, F.lit(i)).alias(name)
            for i, name in enumerate(fields[1:], start=1)
        ]
        return F.struct(first, *rest)

    return F.transform(split_list(text), one)


# Kinds of content-analysis entry by their first letter.
GCAM_KINDS = {"c": "word_count", "v": "scored_value"}


def gcam_entries(text: Column) -> Column:
    """Array of the dictionary entries of a content-analysis list.

    The first entry is the article's total word count and carries no
    dictionary, so it is left out.
    """
    entries = F.split(text, ",")
    return F.slice(entries, F.lit(2), F.greatest(F.size(entries) - 1, F.lit(0)))


def gcam_columns(entry: Column) -> list[Column]:
    """Kind, dictionary, dimension and value of one entry, such as ``c2.21:4``."""
    letter = F.substring(entry, 1, 1)
    kind = F.lit(None).cast("string")
    for mark, name in GCAM_KINDS.items():
        kind = F.when(letter == mark, F.lit(name)).otherwise(kind)
    key = F.substring_index(entry, ":", 1)
    return [
        kind.alias("kind"),
        F.substring_index(F.substr(key, F.lit(2)), ".", 1).try_cast("int").alias("dictionary_id"),
        F.substring_index(key, ".", -1).try_cast("int").alias("dimension_id"),
        F.substring_index(entry, ":", -1).try_cast("double").alias("value"),
    ]


def nested_to_text(dtype: T.DataType, column: Column) -> Column:
    """JSON text of an array or map column; other columns pass through."""
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return F.to_json(column)
    return column


def wide_label(org: Column, suffix: str = "_diff") -> Column:
    """Column label of an organization in a wide table."""
    return F.concat(F.replace(org, F.lit(" "), F.lit("_")), F.lit(suffix))
