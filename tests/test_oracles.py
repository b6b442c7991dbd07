"""Every core query that has SQL gives the rows that DuckDB gives."""

import pytest

from corpusloom.plans import registry
from tests.oracle import connect, spark_rows, sql_rows

MAY_BE_EMPTY = {"retrieval_metrics", "run_comparison", "rerank_selection", "one_hop", "ungrounded_purposes", "renamed_files"}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, data, con, name):
    got, want = spark_rows(registry.queries()[name](spark, data)), sql_rows(con, registry.oracle_sql()[name])
    assert got == want
    assert got[1] or name in MAY_BE_EMPTY
