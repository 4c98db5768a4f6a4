"""Every registered query against its SQL, on whole tables of the smallest scale.

The queries are small and mostly planning, so several run at a time.
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from oracle import connect, difference, duck_table, spark_table
from registry import ORACLE, QUERIES

SF_DIR = os.environ.get("WEARLOG_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.fixture(scope="module")
def results(spark, request):
    chosen = [item.callspec.params["name"] for item in request.session.items if item.fspath == request.fspath and hasattr(item, "callspec")]
    with ThreadPoolExecutor(max_workers=8) as pool:
        yield {name: pool.submit(run, spark, name) for name in chosen}


def run(spark, name):
    """Result of a query and the plan it ran with."""
    df = QUERIES[name](spark, SF_DIR)
    return spark_table(df), df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(results, duck, name):
    assert name in ORACLE
    found, plan = results[name].result()
    assert difference(found, duck_table(duck, ORACLE[name])) is None
    # Rows meet only on keys, and never pass through Python.
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert node not in plan
