import sys
import os

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from check_oracle import SAME, compare, connect  # noqa: E402
from helpers import SF  # noqa: E402

import __spark_entry__ as contract  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, name):
    rows, same, note = compare(spark, con, SF, contract.queries()[name], contract.oracle_sql().get(name))
    assert rows > 0
    assert same in (True, None), note
    if same:
        ours, theirs = note
        assert all(SAME.get(kind) == theirs[column] for column, kind in ours.items())


def test_entry(spark):
    assert contract.entry(spark).count() == 5000


def test_only_bounded_sides_are_cross_joined(spark):
    for name in ("search_topk", "knn_graph", "keyword_index", "enrich_hits", "expand_hops"):
        plan = contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
