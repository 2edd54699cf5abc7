"""Every query of the core over empty tables and over rows of nulls and repeats."""

import pytest
from edges import write_edge_tables

from tracemill.plans import checks, drawings, evaluation, evidence, further, lines, records, training

QUERIES = {n: f for part in (training, evaluation, drawings, evidence, records, further, checks, lines) for n, f in part.queries().items()}


@pytest.fixture(scope="module", params=["empty", "nulls"])
def tables(request, spark, small, tmp_path_factory):
    return write_edge_tables(spark, small, str(tmp_path_factory.mktemp(request.param)), request.param == "nulls")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"stream_tumbling"}))
def test_runs(spark, tables, name):
    QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
