"""Graph algorithms as rounds over edge tables, with the lineage cut each few rounds."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count as numbers

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.session import discard, materialise


def rounds(most: int | None, first: int = 0) -> Iterator[int]:
    """Numbers of rounds, without end or `most` of them; an error where those don't suffice."""
    yield from numbers(first) if most is None else range(first, first + most)
    raise RuntimeError(f"not finished after {most} rounds")


def undirected(edges: DataFrame, a: str = "from_node", b: str = "to_node") -> DataFrame:
    """src, dst both ways, each once, without loops and nulls."""
    e = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).filter("src is not null and dst is not null and src <> dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def components(edges: DataFrame, nodes: DataFrame | None = None, most_rounds: int | None = None) -> DataFrame:
    """node, component (the least node of it), by alternating star contractions.

    Large stars link every larger neighbour to the least one around a node,
    small stars the node and its smaller neighbours to the least of them; the
    number of rounds grows with the logarithm of the nodes, so that long chains
    take no more. Each round keeps a node's edges to one other node, and only
    minima are gathered. nodes: further nodes, alone where no edge has them.
    Stops when a round changes nothing.
    """
    held = materialise(undirected(edges).filter("src > dst"), "links")
    before = None
    for _ in rounds(most_rounds):
        both = held.unionByName(held.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("least"))
        large = both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).filter("src <> dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("least"))
        small = large.join(low, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).unionByName(low.toDF("src", "dst")).filter("src <> dst").distinct()
        last, held = held, materialise(small, "links")
        discard(last)
        mark = held.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
    out = held.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = held.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    out = out.unionByName(roots)
    if nodes is not None:
        alone = nodes.filter("node is not null").select("node").distinct().join(out, "node", "left_anti")
        out = out.unionByName(alone.select("node", F.col("node").alias("component")))
    return out


def reachable(edges: DataFrame, sources: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """source, node, hops: breadth-first over undirected edges; a source without edges reaches itself.

    sources: column source, and node where a source is a set of nodes. Visited nodes are left out of each frontier, so
    cycles end; stops at an empty frontier.
    """
    links = materialise(undirected(edges), "links")
    start = F.col("node") if "node" in sources.columns else F.col("source").alias("node")
    frontier = sources.select("source", start, F.lit(0).alias("hops")).filter("source is not null and node is not null").distinct()
    visited = frontier
    for hop in rounds(most_rounds, 1):
        step = frontier.join(links, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node")).distinct()
        last, frontier = frontier, materialise(step.join(visited, ["source", "node"], "left_anti").withColumn("hops", F.lit(hop)), "frontier")
        discard(last)
        if frontier.isEmpty():
            return visited
        last, visited = visited, materialise(visited.unionByName(frontier), "visited")
        discard(last)


def k_core(edges: DataFrame, k: int = 2, most_rounds: int | None = None) -> DataFrame:
    """node, degree within the k-core: nodes of a degree below k are dropped until none is left."""
    before = links = materialise(undirected(edges), "links")
    count = links.count()
    for _ in rounds(most_rounds):
        keep = links.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select("src")
        links = links.join(keep, "src", "left_semi").join(keep.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst")
        last, links = before, materialise(links, "core")
        discard(last)
        before = links
        now = links.count()
        if now == count:
            break
        count = now
    return links.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).cast("bigint").alias("degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """node, outgoing, incoming: counts and sorted distinct neighbours of each end."""
    e = edges.filter("from_node is not null and to_node is not null")
    out = e.select(F.col("from_node").alias("node"), F.col("to_node").alias("o"), F.lit(None).cast("string").alias("i"))
    into = e.select(F.col("to_node").alias("node"), F.lit(None).cast("string").alias("o"), F.col("from_node").alias("i"))
    return out.unionByName(into).groupBy("node").agg(F.array_sort(F.collect_set("o")).alias("outgoing"), F.array_sort(F.collect_set("i")).alias("incoming"))


def shortest_distances(edges: DataFrame, sources: DataFrame, weight: str, stops: DataFrame | None = None, most_rounds: int | None = None) -> DataFrame:
    """source, node, distance over undirected weighted edges (weights >= 0); stop nodes are reached but not passed.

    Relaxation round by round: only distances that fell go on, minima are taken
    per source and node. Stops when nothing falls.
    """
    e = edges.select(F.col("from_node").alias("src"), F.col("to_node").alias("dst"), F.col(weight).cast("double").alias("w")).filter("src is not null and dst is not null and w >= 0")
    both = materialise(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.min("w").alias("w")), "weights")
    start = F.col("node") if "node" in sources.columns else F.col("source").alias("node")
    known = sources.select("source", start, F.lit(0.0).alias("distance")).filter("source is not null and node is not null").distinct()
    fallen = known
    for _ in rounds(most_rounds):
        go = fallen
        if stops is not None:
            blocked = stops.select(F.col("node").alias("b"))
            go = go.join(blocked, (F.col("node") == F.col("b")), "left").filter(F.col("b").isNull() | (F.col("distance") == 0)).drop("b")
        step = go.join(both, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node"), (F.col("distance") + F.col("w")).alias("d")).groupBy("source", "node").agg(F.min("d").alias("d"))
        last, fallen = fallen, materialise(
            step.join(known, ["source", "node"], "left").filter(F.col("distance").isNull() | (F.col("d") < F.col("distance") - 1e-12)).select("source", "node", F.col("d").alias("distance")), "fallen"
        )
        discard(last)
        if fallen.isEmpty():
            return known
        last, known = known, materialise(known.unionByName(fallen).groupBy("source", "node").agg(F.min("distance").alias("distance")), "distances")
        discard(last)


def topological_levels(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """node, level of a directed graph: 0 without predecessors, else one more than the greatest before it; nodes on cycles come with null."""
    e = materialise(edges.select(F.col("from_node").alias("src"), F.col("to_node").alias("dst")).filter("src is not null and dst is not null").distinct(), "links")
    nodes = materialise(e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct(), "nodes")
    done, rest = None, e
    open_ = nodes
    for level in rounds(most_rounds):
        ready = open_.join(rest.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(level))
        ready = materialise(ready, "level")
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        last = open_, rest
        open_ = materialise(open_.join(ready.select("node"), "node", "left_anti"), "open")
        rest = materialise(rest.join(ready.select(F.col("node").alias("src")), "src", "left_anti"), "rest")
        discard(*last)
    left = open_.withColumn("level", F.lit(None).cast("int"))
    return left if done is None else done.unionByName(left)


def spanning_forest(edges: DataFrame, weight: str, name: str, most_rounds: int | None = None) -> DataFrame:
    """Rows of edges (from_node, to_node, name, weight) that make a least spanning forest; ties by name.

    Each round every tree takes its cheapest edge to another tree, and the trees
    that these edges join become one; the trees at least halve in number.
    """
    e = edges.select("from_node", "to_node", F.col(name).alias("name"), F.col(weight).cast("double").alias("w")).filter(
        "from_node is not null and to_node is not null and from_node <> to_node and w is not null and name is not null"
    )
    e = materialise(e, "weighted")
    tree = None  # node -> tree, the node itself at first
    taken = None
    for _ in rounds(most_rounds):
        if tree is None:
            open_ = e.withColumn("a", F.col("from_node")).withColumn("b", F.col("to_node"))
        else:
            of = lambda end, c: tree.select(F.col("node").alias(end), F.col("component").alias(c))
            open_ = e.join(of("from_node", "a"), "from_node").join(of("to_node", "b"), "to_node").filter("a <> b")
        ends = open_.select(F.explode(F.array("a", "b")).alias("t"), F.struct("w", "name", "from_node", "to_node").alias("e"))
        best = materialise(ends.groupBy("t").agg(F.min("e").alias("e")).select("e.*").distinct(), "cheapest")
        if best.isEmpty():
            break
        taken = best if taken is None else materialise(taken.unionByName(best).distinct(), "forest")
        tree = materialise(components(taken, e.select(F.explode(F.array("from_node", "to_node")).alias("node"))), "trees")
    empty = e.limit(0).select("w", "name", "from_node", "to_node")
    return (empty if taken is None else taken).select("name", "from_node", "to_node", "w")


def path_tree(distances: DataFrame, edges: DataFrame, weight: str) -> DataFrame:
    """source, node, distance, via: the neighbour that a least path comes from (the least of several), null at the source."""
    e = edges.select(F.col("from_node").alias("src"), F.col("to_node").alias("dst"), F.col(weight).cast("double").alias("w")).filter("src is not null and dst is not null and w >= 0 and src <> dst")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    back = distances.select("source", F.col("node").alias("src"), F.col("distance").alias("before")).join(both, "src")
    fit = distances.filter("distance > 0").join(back.withColumnRenamed("dst", "node"), ["source", "node"]).filter(F.abs(F.col("before") + F.col("w") - F.col("distance")) < 1e-9)
    via = fit.groupBy("source", "node").agg(F.min("src").alias("via"))
    return distances.join(via, ["source", "node"], "left").select("source", "node", "distance", "via")
