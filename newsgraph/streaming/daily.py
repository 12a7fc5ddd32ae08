"""Daily tone kept up to date by a stream of articles.

Each micro-batch is reduced to the daily sums of its own rows and written as
one partition of the sums table. Sums add up over batches, so late articles
count on their own day, no row is held in state or dropped behind a watermark,
and a batch that is run again replaces its own partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from newsgraph.operators.articles import reformat_articles
from newsgraph.operators.scores import daily_sums
from newsgraph.session import remove

# How long after its time a record may land or be repeated.
DELAY = "40 days"

BATCH_SUMS = T.StructType(
    [
        T.StructField("segment", T.StringType(), True),
        T.StructField("date", T.DateType(), True),
        T.StructField("org", T.StringType(), True),
        T.StructField("tone_sum", T.DoubleType(), True),
        T.StructField("word_sum", T.DoubleType(), True),
        T.StructField("batch", T.LongType(), True),
    ]
)


def stream_articles(feed: DataFrame, aliases: DataFrame, delay: str = DELAY) -> DataFrame:
    """The article-by-company rows of a stream of feed records.

    A record comes once, whichever files repeat it: its URL and time are kept as
    state until ``delay`` has passed on the stream's clock, and a record that
    comes later than that is dropped. The aliases are a table that is read anew
    with every batch.
    """
    timed = feed.filter(F.col("DATE").isNotNull()).withWatermark("DATE", delay)
    once = timed.dropDuplicatesWithinWatermark(["DocumentIdentifier", "DATE"])
    return reformat_articles(once, aliases)


def stream_daily_sums(articles: DataFrame, folder: str, continuous: bool = False) -> StreamingQuery:
    """Start writing daily sums; by default take what has landed and stop.

    Sums and progress are in one folder, as batch numbers mean the same to both.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (
            daily_sums(batch)
            .withColumn("batch", F.lit(batch_id).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(f"{folder}/sums")
        )

    writer = articles.writeStream.foreachBatch(write_batch).option("checkpointLocation", f"{folder}/progress")
    trigger = {"processingTime": "1 minute"} if continuous else {"availableNow": True}
    return writer.trigger(**trigger).start()


def _compacted(spark: SparkSession, folder: str) -> int:
    """The last batch of the newest finished compaction, or -1."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/compacted")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return -1
    done = [-1]
    for status in system.listStatus(place):
        if system.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            done.append(int(status.getPath().getName().removeprefix("upto-")))
    return max(done)


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    """All sums: the newest compaction, and the batches after it."""
    upto = _compacted(spark, folder)
    later = spark.read.schema(BATCH_SUMS).parquet(f"{folder}/sums").filter(F.col("batch") > upto).drop("batch")
    if upto < 0:
        return later
    return later.unionByName(spark.read.schema(later.schema).parquet(f"{folder}/compacted/upto-{upto}"))


def _merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy("segment", "date", "org").agg(
        F.sum("tone_sum").alias("tone_sum"), F.sum("word_sum").alias("word_sum")
    )


def compact_sums(spark: SparkSession, folder: str) -> None:
    """Merge the batches so far into one table and remove them.

    Only between runs of the stream: the last batch may be repeated after a
    crash, so it stays as it is. The new table counts once it is complete, and
    what it replaces goes after that; a crash on the way loses nothing.
    """
    before = _compacted(spark, folder)
    batches = spark.read.schema(BATCH_SUMS).parquet(f"{folder}/sums").select("batch").distinct()
    closed = sorted(r["batch"] for r in batches.filter(F.col("batch") > before).collect())[:-1]
    if not closed:
        return
    upto = closed[-1]
    parts = spark.read.schema(BATCH_SUMS).parquet(f"{folder}/sums")
    fresh = parts.filter((F.col("batch") > before) & (F.col("batch") <= upto)).drop("batch")
    if before >= 0:
        fresh = fresh.unionByName(spark.read.schema(fresh.schema).parquet(f"{folder}/compacted/upto-{before}"))
    _merged(fresh).write.mode("overwrite").parquet(f"{folder}/compacted/upto-{upto}")
    for batch in closed:
        remove(spark, f"{folder}/sums/batch={batch}")
    if before >= 0:
        remove(spark, f"{folder}/compacted/upto-{before}")


def streamed_sums(spark: SparkSession, folder: str) -> DataFrame:
    """`daily_sums` of everything streamed so far."""
    return _merged(_parts(spark, folder))
