"""The registered queries: names, and SQL where there is some."""

from __future__ import annotations

import os
import sys

import cases
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import connect, difference, duck_table, spark_table  # noqa: E402

from wearlog.llm.queries import ORACLE, QUERIES  # noqa: E402


def test_entry_registers_all_queries():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(ORACLE) <= set(__spark_entry__.oracle_sql())


@pytest.mark.skipif(not cases.have_tables(), reason="no driver tables")
@pytest.mark.parametrize("name", ORACLE)
def test_query_matches_sql(spark, name):
    duck = connect(cases.MIDDLE)
    assert difference(spark_table(QUERIES[name](spark, cases.MIDDLE)), duck_table(duck, ORACLE[name])) is None
