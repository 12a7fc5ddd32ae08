"""Smooth distribution of one metric."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.session import Scratch

# Values whose kernels are added up at a time.
_AT_ONCE = 8192


def order_statistics(values: DataFrame, column: str, ranks: list[int]) -> list[float]:
    """The exact values at 0-based ``ranks`` of a column of numbers.

    The column is sorted once by ranges and stored; the sizes of the ranges, one
    per shuffle partition, say in which a rank lies, and it is read from that
    range alone.
    """
    spark = values.sparkSession
    v = F.col(column)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = values.select(v).filter(v.isNotNull()).repartitionByRange(parts, v)
    with Scratch(spark) as scratch:
        held = scratch.store(ranges.select(v, F.spark_partition_id().alias("part")), "ranges")
        sizes = {r["part"]: r["count"] for r in held.groupBy("part").count().collect()}
        found = {}
        for rank in set(ranks):
            left = rank
            for part in sorted(sizes):
                if left < sizes[part]:
                    found[rank] = held.filter(F.col("part") == part).orderBy(v).offset(left).limit(1).first()[0]
                    break
                left -= sizes[part]
    return [found[rank] for rank in ranks]


def quartiles(values: DataFrame, column: str, rows: int) -> tuple[float, float]:
    """Exact first and third quartile, linear between neighbouring ranks."""
    places = [0.25 * (rows - 1), 0.75 * (rows - 1)]
    ranks = [r for place in places for r in (int(place), min(int(place) + 1, rows - 1))]
    a, b, c, d = order_statistics(values, column, ranks)
    low, high = (place - int(place) for place in places)
    return a + (b - a) * low, c + (d - c) * high


def bandwidth(spread: float, q1: float, q3: float, rows: int) -> float:
    """Normal reference rule: ``1.06 * min(sd, IQR / 1.34) * n ** -0.2``."""
    scale = min(spread, (q3 - q1) / 1.34) or spread or abs(q1) or 1.0
    return 1.06 * scale * rows**-0.2


def tone_density(
    values: DataFrame, column: str = "Tone", points: int = 200, width: float | None = None
) -> DataFrame:
    """``(point, Tone, density)``: Gaussian kernel density on an even grid.

    The grid runs from the smallest to the largest value. A task adds the kernels
    of all its values to one array over the grid, so the exchange carries one row
    per point and task.
    """
    v = F.col(column)
    values = values.select(v.cast("double").alias(column))
    stats = values.agg(
        F.count(v).alias("rows"),
        F.min(v).alias("lo"),
        F.max(v).alias("hi"),
        F.stddev_samp(v).alias("spread"),
    ).first()
    rows, lo, hi = stats["rows"], stats["lo"], stats["hi"]
    if rows == 0:
        return values.limit(0).select(
            F.lit(0).alias("point"), v.alias("Tone"), v.alias("density")
        )
    if width is None:
        q1, q3 = quartiles(values, column, rows)
        width = bandwidth(stats["spread"] or 0.0, q1, q3, rows)
    step = (hi - lo) / (points - 1) if hi > lo else 1.0
    last = points - 1 if hi > lo else 0

    grid_points = lo + step * np.arange(last + 1)
    peak = 1.0 / (rows * width * (2.0 * np.pi) ** 0.5)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(grid_points))
        for batch in batches:
            held = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(held), _AT_ONCE):
                z = (grid_points - held[at : at + _AT_ONCE, None]) / width
                total += np.exp(-0.5 * z * z).sum(axis=0)
        numbers = pa.array(np.arange(len(total)), pa.int32())
        yield pa.RecordBatch.from_arrays([numbers, pa.array(total)], names=["point", "kernels"])

    summed = values.filter(v.isNotNull()).mapInArrow(add_up, "point int, kernels double")
    sums = summed.groupBy("point").agg((F.sum("kernels") * F.lit(peak)).alias("density"))
    grid = values.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("point"))
    return grid.join(sums, "point", "left").select(
        "point",
        (F.lit(lo) + F.col("point") * F.lit(step)).alias("Tone"),
        F.coalesce("density", F.lit(0.0)).alias("density"),
    )
