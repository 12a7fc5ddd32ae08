"""The physical plans are the ones meant for large tables."""

import os
import re
import subprocess
import sys
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from newsgraph.operators import explore, graph, neighbors, scores
from newsgraph.plans import catalog, domain
from newsgraph.session import shared_folder

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def final_plan(df):
    """The plan as adaptive execution ran it."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def formatted(df):
    """The plan with what every scan pushes down and reads."""
    execution = df._jdf.queryExecution()
    return df.sparkSession._jvm.PythonSQLUtils.explainString(execution, "formatted")


@pytest.fixture
def no_broadcast_by_size(spark):
    """Plans as for tables too big to be broadcast."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {name: spark.conf.get(name, None) for name in names}
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name, value in before.items():
        spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


LAZY = sorted(
    set(catalog.QUERIES)
    - {
        "random_walks", "random_walk_check", "node_embeddings", "embedding_check", "streamed_daily_tone", "pca_projection", "pca_check",
        "tone_density", "range_articles", "period_articles", "range_scores", "bundle_scores", "bundle_connections",
    }
)


@pytest.mark.parametrize("name", LAZY)
def test_no_row_udf_and_no_product(spark, no_broadcast_by_size, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize(
    "name",
    ["daily_diff", "average_scores", "fill_full", "fill_gaps", "scores_wide", "segment_series", "score_over_time",
     "radar_scores", "metric_over_time", "comention_edges", "graph_vertices"],
)
def test_facts_are_read_once(spark, no_broadcast_by_size, name):
    assert len(re.findall("FileScan", final_plan(catalog.QUERIES[name](spark, SF)))) == 1


def test_date_range_reaches_the_scan(spark):
    plan = formatted(catalog.date_range(spark, SF))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan)[1]
    assert "GreaterThanOrEqual(o_orderdate" in pushed and "LessThan(o_orderdate" in pushed
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>", plan)


def test_days_prune_partitions(spark, tmp_path):
    rows = domain.event_articles(spark, SF).withColumn("day", F.to_date("DATE"))
    rows.write.partitionBy("day").parquet(str(tmp_path / "days"))
    stored = spark.read.parquet(str(tmp_path / "days"))
    plan = explore.date_range(stored, "2024-01-02", "2024-01-03", "day")
    plan = formatted(plan)
    assert re.search(r"PartitionFilters: \[.*day#\d+ >= 2024-01-02", plan)


def test_metrics_read_only_their_columns(spark):
    articles = domain.event_articles(spark, SF)
    plan = formatted(scores.average_scores(scores.daily_diff(articles)))
    assert "event_id" not in plan


def test_edges_shuffle_the_mentions_once(spark, no_broadcast_by_size):
    plan = final_plan(graph.comention_edges(domain.mentions(spark, SF)))
    assert plan.count("ReusedExchange") >= 1
    assert "partial_count" in plan and "partial_sum" in plan


def test_topk_limits_before_the_exchange(spark):
    plan = neighbors.connections_topk(domain.vectors(spark, SF), 5)
    plan = formatted(plan)
    assert "WindowGroupLimit" in plan and "FlatMapCoGroupsInPandas" in plan


class FakeContext:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def session_with(setting, context):
    conf = SimpleNamespace(get=lambda name, default: setting or default)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_shared_folder_follows_the_setting():
    context = FakeContext("spark://head:7077")
    assert shared_folder(session_with("hdfs:///shared", context)) == "hdfs:///shared"
    assert context.folder == "hdfs:///shared"
    already = FakeContext("spark://head:7077", "hdfs:///set")
    assert shared_folder(session_with("hdfs:///shared", already)) == "hdfs:///shared"
    assert already.folder == "hdfs:///set"


def test_shared_folder_is_never_local_to_a_cluster_machine():
    with pytest.raises(ValueError):
        shared_folder(session_with(None, FakeContext("yarn")))


def test_shared_folder_of_a_local_session(spark):
    assert os.path.isdir(shared_folder(spark).removeprefix("file:"))
    assert shared_folder(spark) == shared_folder(spark)


def test_workers_need_no_copy_of_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from newsgraph.session import local_session\n"
        "from newsgraph.operators.neighbors import connections_topk\n"
        "spark = local_session(2, 'elsewhere', '1g')\n"
        "df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], 'id long, features array<double>')\n"
        "assert connections_topk(df, 1).count() == 2\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
