"""Every llm query over empty tables and over rows of nulls and repeats."""

import pytest
from edges import write_edge_tables

from tracemill.llm import queries as Q


@pytest.fixture(scope="module", params=["empty", "nulls"])
def tables(request, spark, small, tmp_path_factory):
    return write_edge_tables(spark, small, str(tmp_path_factory.mktemp(request.param)), request.param == "nulls")


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_runs(spark, tables, name):
    Q.queries()[name](spark, tables).write.format("noop").mode("overwrite").save()
