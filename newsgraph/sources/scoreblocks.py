"""Wide score tables in blocks of companies, for any number of companies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgraph.sources.sinks import read_ordered, write_ordered

BLOCK_COLUMNS = 200


class ScoreBlocks:
    """Daily scores with a column per company, in parts of at most ``columns`` companies.

    ``manifest`` lists ``org, position`` in the order of names: the company at a
    position is column ``position % columns`` of part ``position // columns``. The
    parts have a row per segment and day. All parts are pivoted in one job whose
    rows are no wider than a part, and no list of companies is on the driver.
    """

    def __init__(self, spark: SparkSession, path: str, columns: int = BLOCK_COLUMNS):
        self.spark, self.columns = spark, columns
        self.manifest_path, self.blocks_path = f"{path}/manifest", f"{path}/blocks"

    def manifest(self) -> DataFrame:
        """``(org, block, slot)`` of every company."""
        place = F.col("position")
        block = F.floor(place / F.lit(self.columns)).cast("int")
        return read_ordered(self.spark, self.manifest_path).select(
            "org", block.alias("block"), (place % self.columns).cast("int").alias("slot")
        )

    def write(self, diffs: DataFrame) -> None:
        """Replace the parts by those of ``(segment, date, org, diff)``, read twice."""
        write_ordered(diffs.select("org").distinct(), self.manifest_path, "org")
        placed = diffs.join(self.manifest(), "org")
        slots = list(range(self.columns))
        wide = placed.groupBy("segment", "date", "block").pivot("slot", slots).agg(F.first("diff", ignorenulls=True))
        named = wide.select("segment", "date", "block", *[F.col(f"`{k}`").alias(f"c{k}") for k in slots])
        parts = named.repartition("segment", "block").sortWithinPartitions("segment", "block", "date")
        parts.write.mode("overwrite").partitionBy("segment", "block").parquet(self.blocks_path)

    def read(self) -> DataFrame:
        """``(segment, date, org, diff)`` of the scores that are not null."""
        wide = self.spark.read.parquet(self.blocks_path)
        cells = F.posexplode(F.array(*[F.col(f"c{k}") for k in range(self.columns)])).alias("slot", "diff")
        rows = wide.select("segment", "date", "block", cells).filter(F.col("diff").isNotNull())
        return rows.join(self.manifest(), ["block", "slot"]).select("segment", "date", "org", "diff")
