import importlib.util
import os

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def load(name):
    spec = importlib.util.spec_from_file_location(name, f"{HERE}/{name}.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


entry = load("__spark_entry__")
check = load("check")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    earlier = entry.queries().keys() - getattr(entry, "LLM_QUERIES", {}).keys() - {"pipeline"}
    assert earlier - entry.oracle_sql().keys() == {"node_embeddings", "pca_projection"}


@pytest.mark.parametrize("name", sorted(entry.queries().keys() - {"pipeline"}))
def test_query_equals_sql(spark, name):
    ours = entry.queries()[name](spark, SF).toPandas()
    assert len(ours)
    if name in entry.oracle_sql():
        assert check.differences(ours, check.oracle_frame(SF, entry.oracle_sql()[name])) is None
