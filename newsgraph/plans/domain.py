"""The test tables in the shapes of the news domain.

Each mapping is row by row over a whole table, so what follows grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_articles_of(events: DataFrame) -> DataFrame:
    """Events as articles: a user is a company, the type sets the flags."""
    k = F.get_json_object("props", "$.k")
    number = k.cast("double")
    kind = F.col("event_type")
    return events.select(
        F.col("ts").alias("DATE"),
        F.concat(F.lit("site_"), k).alias("SourceCommonName"),
        F.concat(F.lit("https://news.example/"), F.col("event_id").cast("string")).alias("URL"),
        kind.isin("click", "view").alias("E"),
        kind.isin("view", "signup").alias("S"),
        kind.isin("purchase", "view").alias("G"),
        F.concat(F.lit("org "), F.col("user_id").cast("string")).alias("Organization"),
        (F.col("value") - 40).alias("Tone"),
        F.col("value").alias("PositiveTone"),
        (number / 10).alias("NegativeTone"),
        (F.col("value") + number / 10).alias("Polarity"),
        (number / 5).alias("ActivityDensity"),
        (number / 100).alias("SelfDensity"),
        number.alias("WordCount"),
    )


def event_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_articles_of(table(spark, sf_dir, "events"))


def order_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as articles of few companies over years, with days missing."""
    priority = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("DATE"),
        F.concat_ws(" ", "o_orderstatus", priority).alias("Organization"),
        priority.isin("1-URGENT", "2-HIGH").alias("E"),
        priority.isin("2-HIGH", "3-MEDIUM").alias("S"),
        (priority == "5-LOW").alias("G"),
        (F.col("o_totalprice") / 1000 - 250).alias("Tone"),
        F.col("o_custkey").cast("double").alias("WordCount"),
    )


# The companies of `order_articles`.
ORDER_ORGS = [
    f"{status} {priority}"
    for status in ["F", "O", "P"]
    for priority in ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
]


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as mentions: an order is an article, a supplier a company."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("URL"), F.col("l_suppkey").alias("Organization")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("features")
    )


def _swap(column, old: str, new: str):
    return F.replace(column, F.lit(old), F.lit(new))


def event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw feed records of December 2020 on; a user is a company."""
    k = F.get_json_object("props", "$.k")
    number = k.cast("double")
    kind = F.col("event_type")
    themes = F.concat_ws(
        ";",
        F.when(kind.isin("click", "view"), F.lit("ENV_OIL")),
        F.when(kind.isin("view", "signup"), F.lit("UNGP_FORESTS")),
        F.when(kind.isin("purchase", "view"), F.lit("ECON_STOCK")),
        F.lit("TAX"),
    )
    value = F.col("value")
    tone = [value - 40, value, number / 10, value + number / 10, number / 5, number / 100, number]
    return table(spark, sf_dir, "events").select(
        F.date_format(F.col("ts") - F.make_dt_interval(days=F.lit(EVENT_SHIFT_DAYS)), "yyyyMMddHHmmss").alias("DATE"),
        F.concat(F.lit("site_"), k).alias("SourceCommonName"),
        F.concat(F.lit("https://news.example/"), F.col("event_id").cast("string")).alias("DocumentIdentifier"),
        themes.alias("Themes"),
        F.concat(F.lit("company"), F.col("user_id").cast("string")).alias("Organizations"),
        F.concat_ws(",", *[part.cast("string") for part in tone]).alias("V2Tone"),
    )


def order_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw feed records of a month: the suppliers of an order's lines are the companies it names."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("l_suppkey")), lambda k: F.concat(F.lit("company"), k.cast("string"))), ";").alias("orgs")
    )
    priority, key = F.col("o_orderpriority"), F.col("o_orderkey")
    themes = F.concat_ws(
        ";",
        F.when(priority.isin("1-URGENT", "2-HIGH"), F.lit("ENV_OIL")),
        F.when(priority.isin("2-HIGH", "3-MEDIUM"), F.lit("UNGP_FORESTS")),
        F.when(priority == "5-LOW", F.lit("ECON_STOCK")),
        F.lit("TAX"),
    )
    moment = F.lit("2020-12-01").cast("timestamp_ntz") + F.make_dt_interval(
        days=(key % 30).cast("int"), secs=(key % 86400).cast("decimal(18,6)")
    )
    tone = F.concat_ws(",", (F.col("o_totalprice") / 1000 - 250).cast("string"), *[F.lit("1")] * 5, F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.date_format(moment, "yyyyMMddHHmmss").alias("DATE"),
        F.col("o_orderstatus").alias("SourceCommonName"),
        F.concat(F.lit("https://news.example/"), key.cast("string")).alias("DocumentIdentifier"),
        themes.alias("Themes"),
        F.col("orgs").alias("Organizations"),
        tone.alias("V2Tone"),
    )


def supplier_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the holdings of an index."""
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("COMPANY"), F.col("s_suppkey").cast("string"), F.lit(" INC")).alias("Name"),
        F.lit("Suppliers").alias("Sector"),
        F.col("s_suppkey").alias("rank"),
    )


# Fixed value: days between the events and the period of the stored products.
EVENT_SHIFT_DAYS = 1126


def customer_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the holdings of an index."""
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("COMPANY"), F.col("c_custkey").cast("string"), F.lit(" INC")).alias("Name"),
        F.col("c_mktsegment").alias("Sector"),
        F.col("c_custkey").alias("rank"),
    )


def document_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw feed records, a minute apart: their words are the lists."""
    one_line = _swap(F.col("text"), "\n", " ")
    themes = _swap(one_line, " the ", ";WB_ENV_CLIMATE;")
    themes = _swap(themes, " of ", ";UNGP_FORESTS;")
    themes = _swap(themes, " is ", ";ECON_STOCK;")
    tone = F.concat_ws(
        ",",
        *[
            part.cast("string")
            for part in [
                F.col("n_chars") % 21 - 10,
                F.col("n_chars") % 7,
                F.col("n_chars") % 5,
                F.col("n_chars") % 13,
                F.col("doc_id") % 17,
                F.col("doc_id") % 3,
                F.col("n_chars"),
            ]
        ],
    )
    kind = F.col("doc_id") % 11
    tone = (
        F.when(kind == 0, F.lit(""))
        .when(kind == 1, F.lit("1,2"))
        .when(kind == 2, F.concat(F.lit("x,"), tone))
        .otherwise(tone)
    )
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    moment = start + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.date_format(moment, "yyyyMMddHHmmss").alias("DATE"),
        F.col("source").alias("SourceCommonName"),
        F.concat(F.lit("https://news.example/"), F.col("doc_id").cast("string")).alias("DocumentIdentifier"),
        _swap(themes, " ", ";").alias("Themes"),
        _swap(one_line, " ", ";").alias("Organizations"),
        tone.alias("V2Tone"),
    )


def word_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the benchmark texts as the holdings of an index."""
    words = table(spark, sf_dir, "benchmark").select(
        "item_id", F.posexplode(F.split(_swap(F.col("text"), "\n", " "), " ")).alias("place", "word")
    )
    return words.filter(F.col("word") != "").select(
        F.concat("word", F.lit(" INC CLASS A")).alias("Name"),
        F.lit("Words").alias("Sector"),
        (F.col("item_id") * 100000 + F.col("place")).alias("rank"),
    )


# Name endings given to the parts by their key.
PART_ENDINGS = [
    "INC CLASS A",
    "CORP",
    "PLC SERIES C",
    "CO",
    "GROUP INC",
    "TRUST REIT SHS B",
    "OF AMERICA CORP",
    "TEC-WORKS INC",
    "ONLINE.COM",
    "& SONS",
    "B",
    "INTERNATIONAL ENERGY CO",
]


def part_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as holdings: a company-like name, the brand as sector."""
    endings = F.array(*[F.lit(e) for e in PART_ENDINGS])
    ending = F.element_at(endings, (F.col("p_partkey") % len(PART_ENDINGS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.concat_ws(" ", "p_name", F.lower("p_type"), ending).alias("Name"),
        F.col("p_brand").alias("Sector"),
        F.col("p_partkey").alias("rank"),
    )
