"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table of up to so many rows of a few numbers is sent to every task that looks things up in it: some 50 MB.
LOOK_UP_ROWS = 500_000


def local_session(cpus: str | int = "*", name: str = "newsgraph", memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    partitions = 8 if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which every executor can reach.

    A local session without the setting gets a temporary folder. A cluster
    without it is refused: a folder on one machine is lost with that machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
        if folder:
            return folder
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="newsgraph-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    For results used several times: nothing above is run again, also when an
    executor is lost, and later plans know the size from the files.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def look_up(table: DataFrame, rows: int) -> DataFrame:
    """A narrow ``table`` of so many rows as the other side of a join: few are broadcast, so that what is joined stays where it is."""
    return F.broadcast(table) if rows <= LOOK_UP_ROWS else table


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system Spark knows; a missing one is fine."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Within, a scan of buckets of one file each, as `Scratch.store_buckets` writes them, counts as sorted by its keys."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    held = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, held)


class Scratch:
    """Tables in the shared folder that go away together.

    What ``store`` wrote is removed at the end of the ``with`` block, also after
    an error; what ``keep`` wrote stays.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/scratch-{uuid4().hex}"
        self.tables: list[str] = []

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def store_buckets(self, df: DataFrame, name: str, buckets: int, *keys: str) -> DataFrame:
        """`store` with rows bucketed and sorted by ``keys``: a join on them moves the other side only."""
        table = f"{name}_{uuid4().hex}"
        writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
        writer.option("path", f"{self.folder}/{table}").saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return stored(df, name)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove(self.spark, self.folder)
