"""Reading the given tables, numbering rows of groups without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salt_count(spark: SparkSession) -> int:
    """Parts a group is dealt over: as many as shuffles have partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, group: str, order: list[Column], name: str, salts: int) -> DataFrame:
    """``df`` with each row's number in its group, gapless from 0.

    Rows of a group are dealt over ``salts`` parts by a hash of ``order``; a part
    starts where the parts before it end. No task holds a whole group, unless
    all of its rows agree in ``order``.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = Window.partitionBy(group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy(group, "_salt").agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.select(group, "_salt", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    part = Window.partitionBy(group, "_salt").orderBy(*order)
    numbered = salted.join(starts, [group, "_salt"]).withColumn(name, F.col("_start") + F.row_number().over(part) - 1)
    return numbered.drop("_salt", "_start")
