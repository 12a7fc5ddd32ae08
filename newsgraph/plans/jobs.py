"""Range jobs: from landed files to stored products."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgraph.constants import STORED_NEIGHBORS
from newsgraph.operators.articles import export_columns, reformat_articles
from newsgraph.operators.calendar import fill_gaps, fill_gaps_rows
from newsgraph.operators.embedding import node_embeddings, pca_projection
from newsgraph.operators.explore import any_flag
from newsgraph.operators.factors import distributed_embeddings
from newsgraph.operators.graph import comention_edges
from newsgraph.operators.neighbors import connections_topk
from newsgraph.operators.reshape import averages_wide, connections_wide, scores_wide
from newsgraph.operators.scores import average_scores, daily_sums, diff_of_sums, industry_tone
from newsgraph.operators.universe import alias_table
from newsgraph.operators.walks import random_walks
from newsgraph.session import Scratch
from newsgraph.sources.bundle import SEGMENT_FILES, bundle_paths
from newsgraph.sources.daystore import DayStore
from newsgraph.sources.edgestore import EdgeStore
from newsgraph.sources.sinks import write_csv, write_table


class Products:
    """Where the products of one universe and date range are stored."""

    def __init__(self, base: str, start: str, end: str, universe: str):
        self.store = f"{base}/{universe}/daily_data"
        self.aliases = f"{base}/{universe}/aliases"
        self.day_edges = f"{base}/{universe}/day_edges"
        folder = f"{base}/{universe}/{start}__to__{end}"
        self.scored_runs = f"{folder}/scored_runs"
        self.graph_runs = f"{folder}/graph_runs"
        self.sums = f"{folder}/daily_sums"
        self.diffs = f"{folder}/daily_scores"
        self.averages = f"{folder}/average_scores"
        self.edges = f"{folder}/edges"
        self.vectors = f"{folder}/vectors"
        self.points = f"{folder}/points"
        self.connections = f"{folder}/connections"
        self.bundle = f"{folder}/bundle"
        self.files = bundle_paths(self.bundle)


def universe_tag(universe: DataFrame) -> str:
    """A name that universes with the same companies and ranks share."""
    row = universe.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("Name", "rank")).alias("names")
    ).first()
    return f"universe-{row['n']}-{(row['names'] or 0) & (1 << 64) - 1:016x}"


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished Parquet table is at ``path``."""
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
    return True


def store_aliases(universe: DataFrame, products: Products) -> DataFrame:
    """Write the alias table, so that joins know its size from its files."""
    write_table(alias_table(universe), products.aliases)
    return universe.sparkSession.read.parquet(products.aliases)


def build_articles(
    landed: DataFrame,
    universe: DataFrame,
    products: Products,
    start: str,
    end: str,
    save_csv: bool = True,
    **update,
) -> DataFrame:
    """Bring the day store up to date and return the range's articles.

    The range is a set of day partitions of the store, not a second copy.
    """
    aliases = store_aliases(universe, products)
    store = DayStore(landed.sparkSession, products.store)

    def build(days: DataFrame) -> DataFrame:
        return reformat_articles(days, aliases, keep=("day",))

    store.update(landed, build, start, end, **update)
    articles = store.read(start, end)
    if save_csv:
        write_csv(export_columns(articles), products.files["data"])
    return articles


def build_scores(articles: DataFrame, products: Products, wide: bool = True) -> None:
    """Daily and average scores, and the wide files of the bundle, gaps filled.

    The articles are read once, for the daily sums; everything after works on
    the stored sums.
    """
    spark = articles.sparkSession
    write_table(daily_sums(articles), products.sums)
    sums = spark.read.parquet(products.sums)
    write_table(diff_of_sums(sums), products.diffs)
    diffs = spark.read.parquet(products.diffs)
    write_table(average_scores(diffs), products.averages)
    if wide:
        write_daily_files(spark, products)
        write_average_file(spark, products)


def _organizations(diffs: DataFrame) -> list[str]:
    """Every company gets a column in every wide file, so their names are fetched."""
    return [row["org"] for row in diffs.select("org").distinct().orderBy("org").collect()]


def write_daily_files(spark: SparkSession, products: Products) -> None:
    """The four wide files of daily scores. Gaps are filled once for all of them."""
    sums, diffs = spark.read.parquet(products.sums), spark.read.parquet(products.diffs)
    orgs = _organizations(diffs)
    with Scratch(spark) as scratch:
        filled = scratch.store(fill_gaps(diffs), "filled")
        industry = scratch.store(fill_gaps_rows(industry_tone(sums), ["segment"]), "industry")
        for segment, file in SEGMENT_FILES.items():
            of_segment = F.col("segment") == segment
            table = scores_wide(filled.filter(of_segment).drop("segment"), industry.filter(of_segment).drop("segment"), orgs)
            write_csv(table.orderBy("date"), products.files[file], single_file=True)


def write_average_file(spark: SparkSession, products: Products) -> None:
    """The wide file of average scores."""
    orgs = _organizations(spark.read.parquet(products.diffs))
    write_csv(averages_wide(spark.read.parquet(products.averages), orgs), products.files["ESG"], single_file=True)


def range_edges(spark: SparkSession, products: Products, start: str, end: str) -> DataFrame:
    """Edges of the flagged articles of a range, as sums of days; days without sums get them."""
    articles = DayStore(spark, products.store)
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    runs = articles.built_days().filter(F.col("day").between(first, last))
    mentions = any_flag(articles.read_runs(start, end)).select("day", "run", "URL", "Organization")
    edges = EdgeStore(spark, products.day_edges)
    edges.update(mentions, runs)
    return edges.edges(runs, mentions)


def build_graph(
    articles: DataFrame,
    products: Products,
    neighbors: int = STORED_NEIGHBORS,
    walk_length: int = 30,
    walks_per_vertex: int = 20,
    dimensions: int = 32,
    seed: int = 42,
    vectors: str = "skipgram",
    edges: DataFrame | None = None,
) -> None:
    """Edges, vectors, projection and connections of the flagged articles.

    ``edges`` are those of the articles, where they are known. ``vectors`` come
    from ``skipgram`` training, whose model a task must hold, or are the
    ``factors`` of the walks' pair information, which have no such bound.
    """
    if vectors not in ("skipgram", "factors"):
        raise ValueError(f"unknown vectors {vectors!r}")
    spark = articles.sparkSession
    write_table(comention_edges(any_flag(articles)) if edges is None else edges, products.edges)
    stored_edges = spark.read.parquet(products.edges)
    walks = random_walks(stored_edges, walk_length, walks_per_vertex, seed)
    if vectors == "factors":
        made = distributed_embeddings(walks, dimensions, seed=seed)
    else:
        made = node_embeddings(walks, dimensions, seed=seed)
    write_table(made, products.vectors)
    found = spark.read.parquet(products.vectors)
    write_table(pca_projection(found), products.points)
    write_table(connections_topk(found, neighbors), products.connections)
    export_graph(spark.read.parquet(products.connections), spark.read.parquet(products.points), products, neighbors)


def export_graph(connections: DataFrame, points: DataFrame, products: Products, neighbors: int) -> None:
    """The flat files of connections and projection."""
    numbered = F.monotonically_increasing_id().alias("index")
    write_csv(connections_wide(connections, neighbors).select(numbered, "*"), products.files["conn"])
    named = [F.col(f"pc{i}").alias(str(i)) for i in range(3)]
    write_csv(points.select(*named, F.col("id").alias("company")), products.files["embed"])


def range_runs(spark: SparkSession, products: Products, start: str, end: str) -> set:
    """Which run built each day of a range; one entry per calendar day."""
    days = DayStore(spark, products.store).built_days()
    within = days.filter(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return {(row["day"], row["run"]) for row in within.collect()}


def _is_current(spark: SparkSession, path: str, runs: set, settings: str = "") -> bool:
    """Whether the record at ``path`` names these runs and settings."""
    if not table_exists(spark, path):
        return False
    rows = spark.read.parquet(path).collect()
    return {(r["day"], r["run"]) for r in rows} == runs and {r["settings"] for r in rows} <= {settings}


def _record(spark: SparkSession, path: str, runs: set, settings: str = "") -> None:
    rows = [(day, run, settings) for day, run in sorted(runs)]
    write_table(spark.createDataFrame(rows, "day date, run string, settings string").coalesce(1), path)


def make_products(
    landed: DataFrame,
    universe: DataFrame,
    base: str,
    start: str,
    end: str,
    save_csv: bool = True,
    on_error: str = "fail",
    days: DataFrame | None = None,
    files: DataFrame | None = None,
    bad: DataFrame | None = None,
    wide: bool = True,
    **graph,
) -> Products:
    """Everything of one range; days, scores and graph that are up to date are not built again.

    The runs of the range's days are recorded after its scores, and after its
    graph with the graph's settings. When a day landed late or was built again
    since, or a build died half-way, a record differs from the store and what
    it stands for is built again; only the changed days' edges are. ``files`` and
    ``bad`` are as in `DayStore.update`, ``wide`` as in `build_scores`.
    """
    spark = landed.sparkSession
    products = Products(base, start, end, universe_tag(universe))
    articles = build_articles(
        landed, universe, products, start, end, save_csv, on_error=on_error, days=days, files=files, bad=bad
    )
    runs = range_runs(spark, products, start, end)
    if not _is_current(spark, products.scored_runs, runs):
        build_scores(articles, products, wide)
        _record(spark, products.scored_runs, runs)
    settings = repr(sorted(graph.items()))
    if not _is_current(spark, products.graph_runs, runs, settings):
        build_graph(articles, products, edges=range_edges(spark, products, start, end), **graph)
        _record(spark, products.graph_runs, runs, settings)
    return products
