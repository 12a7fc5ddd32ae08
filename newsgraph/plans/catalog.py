"""Registered queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgraph.constants import HOLDINGS_PREAMBLE_LINES, SCORE_SCALE, STORED_NEIGHBORS, UNIVERSE_SIZE
from newsgraph.functions import text
from newsgraph.functions.names import strip_share_class
from newsgraph.operators import (
    articles,
    calendar,
    density,
    embedding,
    explore,
    factors,
    graph,
    neighbors,
    pruned,
    ranges,
    reshape,
    scores,
    universe,
    walks,
)
from newsgraph.plans import domain, jobs
from newsgraph.schemas import GKG_FILE
from newsgraph.session import shared_folder, stored
from newsgraph.sources.bundle import SEGMENT_FILES, in_period, read_averages, read_connections, read_daily
from newsgraph.sources.daystore import DayStore, missing_days
from newsgraph.sources.edgestore import EdgeStore
from newsgraph.sources.feed import (
    bad_records,
    good_records,
    landed_days,
    landed_files,
    read_landed_days,
    read_landed_records,
    stream_feed,
)
from newsgraph.sources.holdings import read_holdings
from newsgraph.sources.scoreblocks import ScoreBlocks
from newsgraph.sources.sinks import read_ordered, write_ordered
from newsgraph.streaming.daily import compact_sums, stream_articles, stream_daily_sums, streamed_sums

# What the queries ask for.
COMPANY = "org 7"
VERTEX = 7
PERIOD = ("2024-01-05", "2024-01-24")
WALKS_PER_VERTEX = 20
WALK_LENGTH = 30
DIMENSIONS = 32
# The period that the stored products cover, and what the jobs are asked for.
PRODUCT_DAYS = ("2020-12-01", "2020-12-31")
PRODUCT_PERIOD = "ten_days"
PRODUCT_WALKS = (10, 10)
# Ranges whose averages are asked for, as first and last day after the start.
RANGE_START = date(2024, 1, 1)
RANGES = [(0, 29), (0, 0), (3, 9), (7, 20), (10, 10), (12, 28), (20, 40), (1, 2), (15, 59), (5, 25)]
# Years whose edges are summed one run after the other.
EDGE_YEARS = ((1994, 1995), (1995, 1997))

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    """Doubles to a fixed number of places, for comparison between engines."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), places) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


# Ingest -------------------------------------------------------------------


def split_list(spark, sf_dir):
    feed = domain.document_feed(spark, sf_dir)
    items = text.split_list(F.col("Organizations"))
    return feed.select(
        F.col("DocumentIdentifier").alias("url"),
        F.size(items).cast("long").alias("items"),
        F.array_join(items, "|").alias("joined"),
    )


def tone_columns(spark, sf_dir):
    lines = domain.table(spark, sf_dir, "lineitem")
    numbers = F.concat_ws(
        ",",
        *[
            F.col(c).cast("string")
            for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey"]
        ],
    )
    return lines.select("l_orderkey", "l_linenumber", numbers.alias("V2Tone")).select(
        "l_orderkey", "l_linenumber", *text.tone_columns(F.col("V2Tone"))
    )


def theme_flags(spark, sf_dir):
    feed = domain.document_feed(spark, sf_dir)
    return feed.select(F.col("DocumentIdentifier").alias("url"), *text.flag_columns(F.col("Themes")))


def parse_timestamp(spark, sf_dir):
    orders = domain.table(spark, sf_dir, "orders")
    moment = F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey") % 86400)
    stamped = orders.select("o_orderkey", F.date_format(moment, "yyyyMMddHHmmss").alias("DATE"))
    return stamped.select(
        "o_orderkey", F.date_format(text.feed_timestamp(F.col("DATE")), "yyyy-MM-dd HH:mm:ss").alias("moment")
    )


def explode_organizations(spark, sf_dir):
    rows = articles.decode_articles(domain.document_feed(spark, sf_dir)).transform(articles.explode_organizations)
    return rows.groupBy("Organization").agg(F.count(F.lit(1)).alias("mentions"))


def clean_organization(spark, sf_dir):
    aliases = universe.alias_table(universe.company_universe(domain.word_holdings(spark, sf_dir)))
    rows = articles.decode_articles(domain.document_feed(spark, sf_dir)).transform(articles.explode_organizations)
    named = universe.clean_organization(rows.select("URL", "Organization"), aliases, known_only=False)
    return named.groupBy("Organization").agg(F.count(F.lit(1)).alias("mentions"))


def strip_class(spark, sf_dir):
    return domain.part_holdings(spark, sf_dir).select("rank", strip_share_class(F.col("Name")).alias("name"))


def company_aliases(spark, sf_dir):
    return universe.alias_table(universe.company_universe(domain.part_holdings(spark, sf_dir), n=None))


def company_universe(spark, sf_dir):
    return universe.company_universe(domain.part_holdings(spark, sf_dir), n=UNIVERSE_SIZE)


def sector_universe(spark, sf_dir):
    return universe.company_universe(domain.part_holdings(spark, sf_dir), n=20, sector="Brand#2")


def reformat_articles(spark, sf_dir):
    aliases = universe.alias_table(universe.company_universe(domain.word_holdings(spark, sf_dir)))
    feed = domain.document_feed(spark, sf_dir).withColumn("DATE", text.feed_timestamp(F.col("DATE")))
    rows = articles.export_columns(articles.reformat_articles(feed, aliases))
    return rows.withColumn("DATE", F.date_format("DATE", "yyyy-MM-dd HH:mm:ss"))


def union_days(spark, sf_dir):
    rows = domain.event_articles(spark, sf_dir)
    early = explore.date_range(rows, "2024-01-01", "2024-01-10")
    middle = explore.date_range(rows, "2024-01-11", "2024-01-20")
    late = explore.date_range(rows, "2024-01-21", "2024-01-31")
    whole = articles.union_days([early, middle, late])
    return rounded(
        whole.groupBy(F.to_date("DATE").alias("day")).agg(
            F.count(F.lit(1)).alias("articles"), F.avg("Tone").alias("tone")
        )
    )


def days_to_build(spark, sf_dir):
    stored = domain.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    return missing_days(stored, "1994-12-01", "2002-01-31", today="1999-03-14")


def stringify_nested(spark, sf_dir):
    words = domain.table(spark, sf_dir, "documents").select(
        "doc_id", F.split("text", " ").alias("words"), F.create_map("lang", "source").alias("origin")
    )
    return articles.stringify_nested(words)


def parse_locations(spark, sf_dir):
    customers = domain.table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    home = F.concat_ws("#", (F.col("c_custkey") % 7).cast("string"), F.translate("c_name", "#", "-"), "c_mktsegment")
    listed = F.concat_ws(";", home, F.concat(F.lit("3#city "), key), F.lit(""))
    places = text.parse_locations(listed, ["loc_type", "name", "region"])
    return customers.select("c_custkey", F.inline(places))


def parse_gcam(spark, sf_dir):
    lines = domain.table(spark, sf_dir, "lineitem")
    entries = F.concat(
        F.lit("wc:"), F.col("l_partkey").cast("string"),
        F.lit(",c"), (F.col("l_suppkey") % 20).cast("string"), F.lit("."), F.col("l_linenumber").cast("string"),
        F.lit(":"), F.col("l_quantity").cast("string"),
        F.lit(",v"), (F.col("l_suppkey") % 9).cast("string"), F.lit("."), F.col("l_linenumber").cast("string"),
        F.lit(":"), F.col("l_discount").cast("string"),
    )
    return articles.explode_gcam(lines.select("l_orderkey", entries.alias("GCAM")))


# Scores ---------------------------------------------------------------------


def _event_diffs(spark, sf_dir):
    return scores.daily_diff(domain.event_articles(spark, sf_dir))


def _order_diffs(spark, sf_dir):
    return scores.daily_diff(domain.order_articles(spark, sf_dir))


def daily_tone(spark, sf_dir):
    return rounded(scores.daily_tone(domain.event_articles(spark, sf_dir)))


def industry_tone(spark, sf_dir):
    return rounded(scores.industry_tone(scores.daily_sums(domain.event_articles(spark, sf_dir))))


def daily_diff(spark, sf_dir):
    return rounded(_event_diffs(spark, sf_dir))


def average_scores(spark, sf_dir):
    return rounded(scores.average_scores(_event_diffs(spark, sf_dir)))


def column_averages(spark, sf_dir):
    return rounded(scores.column_averages(domain.table(spark, sf_dir, "lineitem")))


def fill_full(spark, sf_dir):
    return rounded(calendar.fill_full(_event_diffs(spark, sf_dir), ["segment", "org"], "2023-12-28", "2024-02-03"))


def fill_gaps(spark, sf_dir):
    return rounded(calendar.fill_gaps(_order_diffs(spark, sf_dir)))


def fill_industry_gaps(spark, sf_dir):
    sums = scores.daily_sums(domain.order_articles(spark, sf_dir))
    return rounded(calendar.fill_gaps_rows(scores.industry_tone(sums), ["segment"]))


def _wide_segments(spark, sf_dir):
    sums = scores.daily_sums(domain.order_articles(spark, sf_dir))
    diffs, industry = scores.diff_of_sums(sums), scores.industry_tone(sums)
    for segment in SEGMENT_FILES:
        flagged = F.col("segment") == segment
        own, line = diffs.filter(flagged).drop("segment"), industry.filter(flagged).drop("segment")
        yield segment, rounded(reshape.scores_wide(own, line, domain.ORDER_ORGS))


def scores_wide(spark, sf_dir):
    return articles.union_days([w.withColumn("segment", F.lit(s)) for s, w in _wide_segments(spark, sf_dir)])


def scores_long(spark, sf_dir):
    wide = _wide_segments(spark, sf_dir)
    return articles.union_days([reshape.scores_long(w, s, domain.ORDER_ORGS) for s, w in wide])


def averages_wide(spark, sf_dir):
    return rounded(reshape.averages_wide(scores.average_scores(_order_diffs(spark, sf_dir)), domain.ORDER_ORGS))


def industry_average_series(spark, sf_dir):
    return rounded(scores.industry_average_series(_event_diffs(spark, sf_dir)))


def segment_series(spark, sf_dir):
    return rounded(explore.segment_series(_event_diffs(spark, sf_dir), COMPANY, ["E", "S", "G"]))


def score_over_time(spark, sf_dir):
    return rounded(explore.score_over_time(_event_diffs(spark, sf_dir), COMPANY, ["T", "E", "S", "G"], *PERIOD))


def scale_numeric(spark, sf_dir):
    return rounded(scores.scale_numeric(scores.average_scores(_event_diffs(spark, sf_dir)), SCORE_SCALE), 5)


def streamed_daily_tone(spark, sf_dir):
    folder = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    schema = domain.table(spark, sf_dir, "events").schema
    landed = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream_daily_sums(domain.event_articles_of(landed), folder).awaitTermination()
    compact_sums(spark, folder)
    sums = streamed_sums(spark, folder)
    return rounded(sums.select("segment", "date", "org", F.try_divide("tone_sum", "word_sum").alias("tone")))


# Exploration ------------------------------------------------------------------


def any_flag(spark, sf_dir):
    return explore.any_flag(domain.event_articles(spark, sf_dir)).select("URL", "E", "S", "G")


def category_bag(spark, sf_dir):
    rows = explore.date_range(domain.event_articles(spark, sf_dir), *PERIOD)
    bag = explore.category_articles(rows, ["E", "S", "G"])
    return rounded(
        bag.groupBy("category", "SourceCommonName").agg(
            F.count(F.lit(1)).alias("articles"), F.avg("Tone").alias("tone")
        )
    )


def date_range(spark, sf_dir):
    orders = domain.table(spark, sf_dir, "orders")
    return explore.date_range(orders, "1996-02-01", "1997-03-31", "o_orderdate").select(
        "o_orderkey", F.to_date("o_orderdate").alias("day")
    )


def publisher_articles(spark, sf_dir):
    return explore.publisher_articles(domain.event_articles(spark, sf_dir))


def publisher_filter(spark, sf_dir):
    rows = explore.of_publisher(domain.event_articles(spark, sf_dir), "site_42")
    return rows.select("URL", "SourceCommonName", "Organization")


def article_listing(spark, sf_dir):
    rows = explore.company_view(domain.event_articles(spark, sf_dir), COMPANY, ["E", "S", "G"], *PERIOD)
    return rounded(explore.article_listing(rows.withColumn("DATE", F.to_date("DATE"))))


def article_scatter(spark, sf_dir):
    rows = explore.company_view(domain.event_articles(spark, sf_dir), COMPANY, ["E", "G"], *PERIOD, mode="any")
    return rounded(explore.article_scatter(rows.withColumn("DATE", F.to_date("DATE"))))


def metric_over_time(spark, sf_dir):
    rows = domain.event_articles(spark, sf_dir)
    return rounded(explore.metric_over_time(rows, COMPANY, "Polarity", *PERIOD))


def radar_scores(spark, sf_dir):
    return rounded(explore.radar_scores(scores.average_scores(_event_diffs(spark, sf_dir)), COMPANY))


def tone_density(spark, sf_dir):
    return rounded(density.tone_density(domain.event_articles(spark, sf_dir)), 10)


def date_bounds(spark, sf_dir):
    return explore.date_bounds(explore.of_company(domain.event_articles(spark, sf_dir), COMPANY))


def distinct_sorted(spark, sf_dir):
    return explore.distinct_sorted(domain.event_articles(spark, sf_dir), "Organization")


def format_columns(spark, sf_dir):
    return explore.format_columns(domain.table(spark, sf_dir, "orders"))


# Graph --------------------------------------------------------------------------


def comention_edges(spark, sf_dir):
    return graph.comention_edges(domain.mentions(spark, sf_dir))


def comention_edges_distinct(spark, sf_dir):
    return graph.comention_edges(domain.mentions(spark, sf_dir), mode="distinct")


def graph_vertices(spark, sf_dir):
    return graph.mention_vertices(domain.mentions(spark, sf_dir))


def ego_edges(spark, sf_dir):
    return graph.mention_ego_edges(domain.mentions(spark, sf_dir), VERTEX)


def connections_topk(spark, sf_dir):
    return rounded(neighbors.connections_topk(domain.vectors(spark, sf_dir)))


def connections_pruned(spark, sf_dir):
    return rounded(pruned.pruned_topk(domain.vectors(spark, sf_dir)).nearest)


def connections_wide(spark, sf_dir):
    near = neighbors.connections_topk(domain.vectors(spark, sf_dir))
    return rounded(reshape.connections_wide(near, STORED_NEIGHBORS))


def neighbor_confidence(spark, sf_dir):
    near = neighbors.nearest_to(domain.vectors(spark, sf_dir), VERTEX)
    return rounded(neighbors.neighbor_confidence(near, VERTEX))


def embedding_labels(spark, sf_dir):
    points = domain.vectors(spark, sf_dir)
    near = neighbors.nearest_to(points, VERTEX)
    return neighbors.embedding_labels(points.select(F.col("id").alias("company")), near, VERTEX)


def _stored_edges(spark, sf_dir):
    return stored(graph.comention_edges(domain.mentions(spark, sf_dir)), "edges")


def _walks(edges):
    return walks.random_walks(edges, WALK_LENGTH, WALKS_PER_VERTEX)


def random_walks(spark, sf_dir):
    paths = _walks(_stored_edges(spark, sf_dir))
    return paths.select("start", "walk", F.concat_ws(" ", F.col("path").cast("array<string>")).alias("path"))


def random_walk_check(spark, sf_dir):
    edges = _stored_edges(spark, sf_dir)
    return walks.walk_check(_walks(edges), edges)


def _vectors(spark, sf_dir):
    return embedding.node_embeddings(_walks(_stored_edges(spark, sf_dir)), dimensions=DIMENSIONS)


def node_embeddings(spark, sf_dir):
    return _vectors(spark, sf_dir).select("id", *[F.col("features")[i].alias(f"f{i}") for i in range(DIMENSIONS)])


def embedding_check(spark, sf_dir):
    return embedding.embedding_check(_vectors(spark, sf_dir), DIMENSIONS)


def pair_information(spark, sf_dir):
    counts = stored(factors.pair_counts(_walks(_stored_edges(spark, sf_dir))), "counts")
    return rounded(factors.pair_information(counts))


def distributed_embeddings(spark, sf_dir):
    """Whether every vertex has a vector of the factors."""
    vectors = factors.distributed_embeddings(_walks(_stored_edges(spark, sf_dir)), DIMENSIONS)
    return embedding.embedding_check(vectors, DIMENSIONS)


def pca_projection(spark, sf_dir):
    return rounded(embedding.pca_projection(domain.vectors(spark, sf_dir)))


def pca_check(spark, sf_dir):
    """Lengths of all components together, per vector, and what centred components add up to."""
    points = domain.vectors(spark, sf_dir)
    width = points.select(F.size("features")).first()[0]
    projected = embedding.pca_projection(points, width)
    length = sum((F.col(f"pc{i}") * F.col(f"pc{i}") for i in range(width)), F.lit(0.0))
    own = projected.select(F.col("id").cast("long"), F.round(length, 6).alias("squared"))
    sums = [F.sum(f"pc{i}").alias(f"s{i}") for i in range(3)]
    products = [F.sum(F.col(f"pc{i}") * F.col(f"pc{j}")).alias(f"p{i}{j}") for i, j in ((0, 1), (0, 2), (1, 2))]
    flat = F.greatest(*[F.abs(c) for c in ("s0", "s1", "s2", "p01", "p02", "p12")])
    whole = projected.agg(*sums, *products).select(F.lit(-1).cast("long").alias("id"), (F.round(flat, 6) + 0.0).alias("squared"))
    return own.union(whole)


# Jobs -------------------------------------------------------------------------


def _feed_lines(feed):
    """Feed records as lines of day files: ``value, day``."""
    cells = [F.col(n) if n in feed.columns else F.lit("") for n in GKG_FILE.names]
    day = F.to_date(text.feed_timestamp(F.col("DATE"))).alias("day")
    return feed.select(F.concat_ws("\t", *[F.translate(c, "\t\r", "  ") for c in cells]).alias("value"), day)


def _land(lines, folder=None):
    """Lines written, or added, to a landing folder; returns it."""
    folder = folder or f"{shared_folder(lines.sparkSession)}/landed-{uuid4().hex}"
    lines.write.mode("append").partitionBy("day").text(folder)
    return folder


def _land_feed(spark, sf_dir):
    """The events as landed day files; returns the folder."""
    return _land(_event_lines(spark, sf_dir))


def _event_lines(spark, sf_dir):
    return _feed_lines(domain.event_feed(spark, sf_dir))


def changed_days(spark, sf_dir):
    """Days to build again after some got one more file."""
    lines = _event_lines(spark, sf_dir)
    folder = _land(lines)
    store = DayStore(spark, f"{shared_folder(spark)}/store-{uuid4().hex}")
    landed, files = read_landed_days(spark, folder), landed_files(spark, folder)
    counted = lambda rows: rows.groupBy("day").agg(F.count(F.lit(1)).alias("records"))
    store.update(landed, counted, *PRODUCT_DAYS, today="2021-01-01", on_error="skip", files=files)
    _land(lines.filter(F.dayofmonth("day") % 7 == 0), folder)
    return store.changed_days(landed_files(spark, folder))


def _with_faults(lines):
    """Some lines cut short, some with a time that is none."""
    k = F.regexp_extract("value", "news.example/([0-9]+)", 1).cast("long") % 50
    cut = F.substring_index("value", "\t", 9)
    timeless = F.regexp_replace("value", "^\t[0-9]{14}", "\tyesterday")
    return lines.select(F.when(k == 0, cut).when(k == 1, timeless).otherwise(F.col("value")).alias("value"), "day")


def quarantined_records(spark, sf_dir):
    """Lines left out and records stored, per day and reason."""
    folder = _land(_with_faults(_event_lines(spark, sf_dir)))
    records = read_landed_records(spark, folder)
    store = DayStore(spark, f"{shared_folder(spark)}/store-{uuid4().hex}")
    stored_columns = lambda rows: rows.select("day", F.col("DocumentIdentifier").alias("URL"))
    store.update(
        good_records(records), stored_columns, *PRODUCT_DAYS, today="2021-01-01", on_error="skip",
        files=landed_files(spark, folder), bad=bad_records(records),
    )
    bad = store.quarantined().groupBy("day", "reason").agg(F.count(F.lit(1)).alias("records"))
    good = store.read(*PRODUCT_DAYS).groupBy("day").agg(F.count(F.lit(1)).alias("records"))
    return bad.unionByName(good.withColumn("reason", F.lit("stored")))


def streamed_feed_tone(spark, sf_dir):
    """Daily tone of landed files as a stream; files of some days come twice, long after."""
    lines = _event_lines(spark, sf_dir)
    folder, progress = _land(lines), f"{shared_folder(spark)}/stream-{uuid4().hex}"
    aliases = stored(universe.alias_table(universe.company_universe(domain.customer_holdings(spark, sf_dir))), "aliases")
    for again in (False, True):
        if again:
            _land(lines.filter(F.dayofmonth("day") % 5 == 0), folder)
        rows = stream_articles(stream_feed(spark, folder, files=20), aliases)
        stream_daily_sums(rows, progress).awaitTermination()
    compact_sums(spark, progress)
    sums = streamed_sums(spark, progress)
    return rounded(sums.select("segment", "date", "org", F.try_divide("tone_sum", "word_sum").alias("tone")))


def _products(spark, sf_dir, n=None):
    """Stored articles of the landed events, and where their products go.

    The universe is every customer, or the first ``n``.
    """
    landing, base = _land_feed(spark, sf_dir), f"{shared_folder(spark)}/products-{uuid4().hex}"
    companies = universe.company_universe(domain.customer_holdings(spark, sf_dir), n=n)
    made = jobs.Products(base, *PRODUCT_DAYS, jobs.universe_tag(companies))
    landed = read_landed_days(spark, landing)
    rows = jobs.build_articles(
        landed, companies, made, *PRODUCT_DAYS, save_csv=False, on_error="skip", days=landed_days(spark, landing), today="2021-01-01"
    )
    return made, rows


def holdings_scan(spark, sf_dir):
    """Customers landed as a holdings file of several parts, read back with their places."""
    folder = f"{shared_folder(spark)}/holdings-{uuid4().hex}"
    head = [f"preamble {k}" for k in range(HOLDINGS_PREAMBLE_LINES)] + ["Ticker,Name,Sector"]
    top = spark.createDataFrame([(k - len(head), line) for k, line in enumerate(head)], "place long, value string")
    line = F.concat_ws(",", F.lit("T"), F.concat(F.lit('"'), "Name", F.lit(', THE"')), "Sector")
    rows = domain.customer_holdings(spark, sf_dir).select(F.col("rank").cast("long").alias("place"), line.alias("value"))
    ordered = top.unionByName(rows).repartitionByRange(4, "place").sortWithinPartitions("place")
    ordered.select("value").write.text(folder)
    return read_holdings(spark, folder).select("Name", "Sector", F.col("rank").cast("long").alias("rank"))


def ordered_scores(spark, sf_dir):
    """Scores stored in order by many tasks, read back with their places."""
    path = f"{shared_folder(spark)}/ordered-{uuid4().hex}"
    write_ordered(_event_diffs(spark, sf_dir), path, "date", "segment", "org")
    return rounded(read_ordered(spark, path))


def scores_blocks(spark, sf_dir):
    """Filled scores of all companies through wide tables in blocks."""
    folder = f"{shared_folder(spark)}/blocks-{uuid4().hex}"
    blocks = ScoreBlocks(spark, folder, 100)
    blocks.write(stored(calendar.fill_gaps(_event_diffs(spark, sf_dir)), "filled"))
    return rounded(blocks.read())


def range_average(spark, sf_dir):
    """Averages of ten ranges from running sums."""
    path = f"{shared_folder(spark)}/running-{uuid4().hex}"
    days = f"{RANGE_START}", f"{RANGE_START + timedelta(days=59)}"
    ranges.write_running_sums(ranges.running_sums(_event_diffs(spark, sf_dir), *days), path)
    sums = spark.read.parquet(path)
    asked = [(str(RANGE_START + timedelta(days=a)), str(RANGE_START + timedelta(days=b))) for a, b in RANGES]
    parts = [
        ranges.range_average(sums, *bounds).select(F.lit(bounds[0]).alias("first"), F.lit(bounds[1]).alias("last"), "segment", "org", "score")
        for bounds in asked
    ]
    return rounded(articles.union_days(parts), 6)


def make_products(spark, sf_dir):
    """The whole job over landed orders, twice; what each product has in it."""
    landing, base = _land(_feed_lines(domain.order_feed(spark, sf_dir))), f"{shared_folder(spark)}/products-{uuid4().hex}"
    landed, files = read_landed_days(spark, landing), landed_files(spark, landing)
    companies = universe.company_universe(domain.supplier_holdings(spark, sf_dir))
    for _ in range(2):
        # The second time everything is up to date.
        made = jobs.make_products(
            landed, companies, base, *PRODUCT_DAYS, save_csv=False, on_error="skip", files=files, wide=False,
            walk_length=PRODUCT_WALKS[0], walks_per_vertex=PRODUCT_WALKS[1],
        )
    articles = jobs.DayStore(spark, made.store).read(*PRODUCT_DAYS)
    read = spark.read.parquet
    counted = lambda df, name, total: df.agg(
        F.lit(name).alias("product"), F.count(F.lit(1)).alias("rows"), F.round(F.sum(total), 6).alias("total")
    )
    none = F.lit(0.0)
    return _stacked(
        counted(articles, "articles", F.col("Tone")),
        counted(read(made.sums), "sums", F.col("tone_sum")),
        counted(read(made.diffs), "diffs", none),
        counted(read(made.averages), "averages", none),
        counted(read(made.edges), "edges", F.col("weight").cast("double")),
        counted(read(made.vectors), "vectors", none),
        counted(read(made.points), "points", none),
        counted(read(made.connections), "connections", F.col("rank").cast("double")),
    )


def _stacked(*parts):
    return rounded(articles.union_days(list(parts)), 4)


def range_edges(spark, sf_dir):
    """Edges of some years as sums of the years, an order's lines lying in several of them."""
    lines = domain.table(spark, sf_dir, "lineitem")
    mentions = stored(
        lines.select(
            F.trunc("l_shipdate", "year").alias("day"), F.lit("0").alias("run"),
            F.col("l_orderkey").alias("URL"), F.col("l_suppkey").alias("Organization"),
        ),
        "mentions",
    )
    store = EdgeStore(spark, f"{shared_folder(spark)}/edges-{uuid4().hex}")
    within = lambda first, last: mentions.filter(F.year("day").between(first, last))
    for years in EDGE_YEARS:
        some = within(*years)
        store.update(some, some.select("day", "run").distinct())
    whole = within(EDGE_YEARS[0][0], EDGE_YEARS[-1][1])
    return store.edges(whole.select("day", "run").distinct(), whole)


def range_articles(spark, sf_dir):
    rows = articles.export_columns(_products(spark, sf_dir)[1])
    return rows.withColumn("DATE", F.date_format("DATE", "yyyy-MM-dd HH:mm:ss"))


def period_articles(spark, sf_dir):
    rows = in_period(_products(spark, sf_dir)[1], PRODUCT_PERIOD)
    return rows.groupBy("day", "Organization").agg(F.count(F.lit(1)).alias("articles"))


def range_scores(spark, sf_dir):
    made, rows = _products(spark, sf_dir)
    jobs.build_scores(rows, made, wide=False)
    return rounded(spark.read.parquet(made.diffs))


def _wide_products(spark, sf_dir):
    """Stored scores of the companies that get a column in wide files."""
    made, rows = _products(spark, sf_dir, UNIVERSE_SIZE)
    jobs.build_scores(rows, made, wide=False)
    return made


def bundle_scores(spark, sf_dir):
    made = _wide_products(spark, sf_dir)
    jobs.write_average_file(spark, made)
    return rounded(read_averages(spark, made.bundle), 5)


def bundle_daily(spark, sf_dir):
    made = _wide_products(spark, sf_dir)
    jobs.write_daily_files(spark, made)
    return rounded(read_daily(spark, made.bundle), 5)


def bundle_connections(spark, sf_dir):
    points = domain.vectors(spark, sf_dir)
    made = jobs.Products(f"{shared_folder(spark)}/products-{uuid4().hex}", *PRODUCT_DAYS, "vectors")
    near = neighbors.connections_topk(points.withColumn("id", F.col("id").cast("string")))
    jobs.export_graph(near, embedding.pca_projection(points), made, STORED_NEIGHBORS)
    return rounded(read_connections(spark, made.bundle))


QUERIES: dict[str, Query] = {
    "split_list": split_list,
    "tone_columns": tone_columns,
    "theme_flags": theme_flags,
    "parse_timestamp": parse_timestamp,
    "explode_organizations": explode_organizations,
    "clean_organization": clean_organization,
    "strip_share_class": strip_class,
    "company_aliases": company_aliases,
    "universe": company_universe,
    "sector_universe": sector_universe,
    "reformat_articles": reformat_articles,
    "union_days": union_days,
    "missing_days": days_to_build,
    "stringify_nested": stringify_nested,
    "parse_locations": parse_locations,
    "parse_gcam": parse_gcam,
    "daily_tone": daily_tone,
    "industry_tone": industry_tone,
    "daily_diff": daily_diff,
    "average_scores": average_scores,
    "column_averages": column_averages,
    "fill_full": fill_full,
    "fill_gaps": fill_gaps,
    "fill_industry_gaps": fill_industry_gaps,
    "scores_wide": scores_wide,
    "scores_long": scores_long,
    "averages_wide": averages_wide,
    "industry_average_series": industry_average_series,
    "segment_series": segment_series,
    "score_over_time": score_over_time,
    "scale_numeric": scale_numeric,
    "streamed_daily_tone": streamed_daily_tone,
    "any_flag": any_flag,
    "category_bag": category_bag,
    "date_range": date_range,
    "publisher_articles": publisher_articles,
    "publisher_filter": publisher_filter,
    "article_listing": article_listing,
    "article_scatter": article_scatter,
    "metric_over_time": metric_over_time,
    "radar_scores": radar_scores,
    "tone_density": tone_density,
    "date_bounds": date_bounds,
    "distinct_sorted": distinct_sorted,
    "format_columns": format_columns,
    "comention_edges": comention_edges,
    "comention_edges_distinct": comention_edges_distinct,
    "graph_vertices": graph_vertices,
    "ego_edges": ego_edges,
    "connections_topk": connections_topk,
    "connections_pruned": connections_pruned,
    "connections_wide": connections_wide,
    "neighbor_confidence": neighbor_confidence,
    "embedding_labels": embedding_labels,
    "random_walks": random_walks,
    "random_walk_check": random_walk_check,
    "node_embeddings": node_embeddings,
    "embedding_check": embedding_check,
    "pair_information": pair_information,
    "distributed_embeddings": distributed_embeddings,
    "pca_projection": pca_projection,
    "pca_check": pca_check,
    "holdings_scan": holdings_scan,
    "ordered_scores": ordered_scores,
    "scores_blocks": scores_blocks,
    "range_average": range_average,
    "make_products": make_products,
    "range_edges": range_edges,
    "changed_days": changed_days,
    "quarantined_records": quarantined_records,
    "streamed_feed_tone": streamed_feed_tone,
    "range_articles": range_articles,
    "period_articles": period_articles,
    "range_scores": range_scores,
    "bundle_scores": bundle_scores,
    "bundle_daily": bundle_daily,
    "bundle_connections": bundle_connections,
}
