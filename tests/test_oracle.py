"""Every query with an SQL counterpart gives the same rows; every other query runs."""

import oracle
import pytest

import __spark_entry__ as entry
from topicweave.plans.catalog import ORACLE
from topicweave.plans.catalog import QUERIES as CATALOG

SF = "/root/testdata/sf0.001"
# training-data operators have their own tests in tests/llm
QUERIES, SQL = dict(CATALOG), dict(ORACLE)
# trained on the test tables: run by their own tests on small inputs, and by the benchmark
SLOW = {"neighbour_map", "neighbour_graph", "cuckoo_search", "grid_search", "learning_curve", "calibrate", "rank_topics", "rank_topics_raw", "train_rff", "clean_chain_segmented"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert oracle.compare(QUERIES[name](spark, SF), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
