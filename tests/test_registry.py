import os
import sys

import pytest

from conftest import SF_SMALL, plan

import __spark_entry__ as entry
from wattframe.plans.oracles import ORACLES
from wattframe.plans.queries import QUERIES

sys.path.insert(0, os.path.join(os.path.dirname(entry.__file__), "tools"))

from check import compare_result, connect  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="no test tables")

# Python workers and joins without keys have no place in any query.
UNWANTED = (
    "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct",
    "BroadcastNestedLoopJoin",
)


@pytest.fixture(scope="module")
def db():
    return connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, db, name):
    result = entry.queries()[name](spark, SF_SMALL)
    assert compare_result(result, db, name) == []
    assert [node for node in UNWANTED if node in plan(result)] == []


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 24
