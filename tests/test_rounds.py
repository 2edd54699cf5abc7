"""Loops that run out of rounds say so, and by default go on until nothing is left."""

import pytest

from tracemill.operators import graph, matching


def test_suppression_is_whole_or_an_error(spark):
    boxes = spark.createDataFrame([("p", k) for k in range(8)], "page string, id int")
    pairs = spark.createDataFrame([("p", k, k + 1) for k in range(7)], "page string, better int, worse int")
    with pytest.raises(RuntimeError):
        matching.kept_of_pairs(boxes, pairs, ["page"], most_rounds=2)
    assert {r["id"]: r["kept"] for r in matching.kept_of_pairs(boxes, pairs, ["page"]).collect()} == {k: k % 2 == 0 for k in range(8)}


def test_graph_rounds(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}", 1.0) for k in range(6)], "from_node string, to_node string, w double")
    source = spark.createDataFrame([("n0",)], "source string")
    for run in (
        lambda: graph.reachable(edges, source, most_rounds=3),
        lambda: graph.shortest_distances(edges, source, "w", most_rounds=3),
        lambda: graph.topological_levels(edges, most_rounds=3),
        lambda: graph.k_core(edges, most_rounds=1),
        lambda: graph.components(edges, most_rounds=1),
    ):
        with pytest.raises(RuntimeError):
            run()
    assert graph.reachable(edges, source).count() == 7
