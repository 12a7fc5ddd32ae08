"""Index holdings file: the company universe in index order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsgraph.constants import HOLDINGS_PREAMBLE_LINES


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, number)``: the lines of a text file, or of files in the order of their names, from 1.

    Lines are numbered within each block that a task reads; where a block starts
    is the sum of the blocks before it, of which there are few.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    block = ["_file", "_block"]
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    counts = lines.groupBy(*block).agg(F.count(F.lit(1)).alias("_lines"))
    starts = counts.select(*block, F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(*block).orderBy("_line"))
    placed = lines.withColumn("_within", within).join(starts, block)
    return placed.select("value", (F.col("_start") + F.col("_within")).alias("number"))


def read_holdings(
    spark: SparkSession, path: str, preamble: int = HOLDINGS_PREAMBLE_LINES
) -> DataFrame:
    """``(Name, Sector, rank)`` of a holdings CSV with preamble lines; the line number is the rank."""
    lines = numbered_lines(spark, path)
    header = lines.filter(F.col("number") == preamble + 1).select("value").first()["value"]
    names = [name.strip().strip('"') for name in header.lstrip("\ufeff").split(",")]
    ddl = ", ".join(f"`{name}` STRING" for name in names)
    row = F.from_csv(F.col("value"), ddl, {"sep": ","})
    return (
        lines.filter(F.col("number") > preamble + 1)
        .select(row.alias("row"), (F.col("number") - preamble - 1).alias("rank"))
        .filter(F.col("row.Name").isNotNull())
        .select("row.Name", "row.Sector", "rank")
    )
