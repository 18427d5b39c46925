"""Every query of the subpackage that SQL can express, against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from lodestone.llm import queries
from tests.conftest import DATA
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert_same(spark, name, queries.queries()[name], queries.oracle_sql()[name], DATA)


def test_entry_lists_all_eleven():
    known = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {k[: k.index("_") + 1] for k in known if k.startswith("op")} and "pipeline" in known
    assert set(entry.oracle_sql()) <= known
