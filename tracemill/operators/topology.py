"""Lines as a graph: planar arcs, crossings, chains of segments, point and column clusters, hulls and crop plans.

What depends on an order runs per page, drawing or line group, streamed out of
sorted partitions one group at a time; these groups are as large as a drawing
is, not as the data are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions import geometry as G

#: Cosine below which two arms of a crossing count as one straight line.
STRAIGHT = -0.98


def per_sorted_group(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """fold over the rows (tuples of df's columns) of every group in order, its rows behind the group's keys."""
    names, kinds = df.columns, dict(df.dtypes)
    at = [names.index(k) for k in keys]
    columns = [*keys, *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, group = None, []
        for b in batches:
            out = []
            for r in zip(*[b[c].tolist() for c in names]):
                key = tuple(r[i] for i in at)
                if key != now:
                    if group:
                        out += [(*now, *x) for x in fold(group)]
                    now, group = key, []
                group.append(r)
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame([(*now, *x) for x in fold(group)] if group else [], columns=columns)

    full = ", ".join([f"{k} {kinds[k]}" for k in keys] + [schema])
    held = df.filter(" and ".join(f"{k} is not null" for k in keys))
    return held.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, full)


def polyline_segments(edges: DataFrame, keys: list[str], name: str, polyline: str) -> DataFrame:
    """keys, seg, ax, ay, bx, by: every step of every polyline (array of [x, y]), named <edge>#<number>; steps without length and nulls give none."""
    steps = F.transform(F.sequence(F.lit(1), F.size(polyline) - 1), lambda i: F.struct(i.alias("i"), F.get(polyline, i - 1).alias("a"), F.get(polyline, i).alias("b")))
    s = edges.filter(F.col(name).isNotNull() & (F.size(polyline) > 1)).select(*keys, name, F.inline(steps))
    at = lambda p, k: F.get(p, F.lit(k)).cast("bigint")
    out = s.select(*keys, F.concat_ws("#", name, F.col("i").cast("string")).alias("seg"), at("a", 0).alias("ax"), at("a", 1).alias("ay"), at("b", 0).alias("bx"), at("b", 1).alias("by"))
    return out.filter("ax is not null and ay is not null and bx is not null and by is not null and (ax <> bx or ay <> by)").distinct()


def planar_arcs(segments: DataFrame, keys: list[str], size: int = 1000, tolerance: float = 1.0) -> DataFrame:
    """keys, seg, k, ax, ay, bx, by: segments parted where another one ends on them (tees), in order along the segment.

    Vertices are points; an end within `tolerance` of a segment's inside is a
    vertex on it, at the end's own place. Candidates meet by grid cells.
    """
    box = F.struct(F.least("ax", "bx").alias("x"), F.least("ay", "by").alias("y"), F.abs(F.col("ax") - F.col("bx")).alias("w"), F.abs(F.col("ay") - F.col("by")).alias("h"))
    ends = segments.select(*keys, F.col("seg").alias("other"), F.inline(F.array(F.struct(F.col("ax").alias("px"), F.col("ay").alias("py")), F.struct(F.col("bx").alias("px"), F.col("by").alias("py")))))
    cell = F.struct(F.floor(F.col("px") / size).cast("int").alias("cx"), F.floor(F.col("py") / size).cast("int").alias("cy"))
    near = segments.withColumn("cell", F.explode(G.cells(box, size, math.ceil(tolerance)))).join(ends.select(*keys, "px", "py").distinct().withColumn("cell", cell), [*keys, "cell"])
    t = G.projection(*[F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")])
    far = G.point_segment_distance(*[F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")])
    inside = ~((F.col("px") == F.col("ax")) & (F.col("py") == F.col("ay"))) & ~((F.col("px") == F.col("bx")) & (F.col("py") == F.col("by")))
    tees = near.filter((far <= tolerance) & inside).select(*keys, "seg", t.alias("t"), "px", "py").filter("t > 0 and t < 1").distinct()
    own = segments.select(*keys, "seg", F.inline(F.array(F.struct(F.lit(0.0).alias("t"), F.col("ax").alias("px"), F.col("ay").alias("py")), F.struct(F.lit(1.0).alias("t"), F.col("bx").alias("px"), F.col("by").alias("py")))))
    w = W.partitionBy(*keys, "seg").orderBy("t", "px", "py")
    lined = own.unionByName(tees).withColumn("k", F.row_number().over(w)).withColumn("bx", F.lead("px").over(w)).withColumn("by", F.lead("py").over(w))
    return lined.filter("bx is not null").select(*keys, "seg", "k", F.col("px").alias("ax"), F.col("py").alias("ay"), "bx", "by")


def crossing_routes(arcs: DataFrame, keys: list[str], dots: DataFrame | None = None) -> DataFrame:
    """keys, x, y, route, first, second: the two through routes of every vertex of four arms that make two straight lines.

    Such a crossing stays parted unless a junction dot (dots: keys, x, y, r)
    covers it. An arm is its arc's seg and k.
    """
    arm = lambda p, q: F.struct(F.concat_ws("#", "seg", F.col("k").cast("string")).alias("arm"), F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y"), (F.col(f"{q}x") - F.col(f"{p}x")).cast("double").alias("dx"), (F.col(f"{q}y") - F.col(f"{p}y")).cast("double").alias("dy"))
    arms = arcs.select(*keys, F.inline(F.array(arm("a", "b"), arm("b", "a"))))
    place = [*keys, "x", "y"]
    four = arms.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).filter("n = 4").drop("n")
    if dots is not None:
        d = dots.select(*keys, F.col("x").alias("dot_x"), F.col("y").alias("dot_y"), "r")
        near = four.join(d, keys).filter(F.hypot(F.col("x") - F.col("dot_x"), F.col("y") - F.col("dot_y")) <= F.col("r")).select(*place).distinct()
        four = four.join(near, place, "left_anti")
    held = arms.join(four, place)
    left, right = (held.select(*place, *[F.col(c).alias(f"{p}_{c}") for c in ("arm", "dx", "dy")]) for p in ("l", "r"))
    cosine = (F.col("l_dx") * F.col("r_dx") + F.col("l_dy") * F.col("r_dy")) / F.greatest(F.hypot("l_dx", "l_dy") * F.hypot("r_dx", "r_dy"), F.lit(1e-9))
    pairs = left.join(right, place).filter((F.col("l_arm") < F.col("r_arm")) & (cosine < STRAIGHT))
    both = pairs.withColumn("routes", F.count(F.lit(1)).over(W.partitionBy(*place))).filter("routes = 2")
    return both.select(*place, F.row_number().over(W.partitionBy(*place).orderBy("l_arm")).alias("route"), F.col("l_arm").alias("first"), F.col("r_arm").alias("second"))


def order_chain(segments: list[tuple[str, tuple, tuple]], radius: float) -> tuple[list[tuple[str, bool]], str]:
    """([(name, reversed)], fault) of segments (name, head, tail) as one chain from source to target.

    The walk begins at the first segment with a free head, else at one with a
    free tail, and then the chain is turned; the next segment is the one whose
    end lies nearest within `radius`. Without a free end the order stays
    ('unresolved'); what can't be reached follows as it is ('break').
    """
    if len(segments) < 2:
        return [(s[0], False) for s in segments], ""
    near = lambda p, q: math.dist(p, q) <= radius
    free = lambda k, end: not any(near(segments[k][end], o[e]) for j, o in enumerate(segments) if j != k for e in (1, 2))
    starts = [(k, end) for end in (1, 2) for k in range(len(segments)) if free(k, end)]
    if not starts:
        return [(s[0], False) for s in segments], "unresolved"
    k, end = starts[0]
    out, left, fault = [(segments[k][0], False)], [s for j, s in enumerate(segments) if j != k], ""
    here = segments[k][3 - end]
    while left:
        reach = [(math.dist(here, s[e]), j, e == 2) for j, s in enumerate(left) for e in (1, 2) if near(here, s[e])]
        if not reach:
            out, fault = out + [(s[0], False) for s in left], "break"
            break
        _, j, turned = min(reach)
        s = left.pop(j)
        out.append((s[0], turned))
        here = s[1] if turned else s[2]
    return ([(n, not r) for n, r in reversed(out)] if end == 2 else out), fault


def line_chains(segments: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """keys, place, seg, reversed, fault: segments (keys, seg, ax, ay, bx, by) of each line group chained end to end, in the order of seg."""

    def fold(rows):
        chain, fault = order_chain([(r[-5], (r[-4], r[-3]), (r[-2], r[-1])) for r in rows], radius)
        return [(k + 1, name, turned, fault) for k, (name, turned) in enumerate(chain)]

    picked = segments.select(*keys, "seg", *[F.col(c).cast("double").alias(c) for c in ("ax", "ay", "bx", "by")])
    return per_sorted_group(picked, keys, ["seg"], fold, "place int, seg string, reversed boolean, fault string")


def x_clusters(spans: list[tuple[str, float]], tolerance: float) -> list[tuple[str, int]]:
    """(name, cluster) of spans (name, x) from left to right: each joins the first cluster whose median x lies within `tolerance`."""
    clusters: list[list[float]] = []
    out = []
    for name, x in spans:
        k = next((k for k, c in enumerate(clusters) if abs(median(c) - x) <= tolerance), len(clusters))
        if k == len(clusters):
            clusters.append([])
        clusters[k].append(x)
        out.append((name, k))
    return out


def column_clusters(spans: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """keys, id, cluster of spans (keys, id, x)."""
    picked = spans.filter("x is not null and id is not null").select(*keys, "id", F.col("x").cast("double").alias("x"))
    return per_sorted_group(picked, keys, ["x", "id"], lambda rows: x_clusters([(r[-2], r[-1]) for r in rows], tolerance), "id string, cluster int")


def near_roots(points: list[tuple[float, float]], radius: float) -> list[int]:
    """The root of each point in order: it joins a near earlier point only if it is also within `radius` of that one's root, so that chains don't bridge."""
    parent: list[int] = []
    cells: dict[tuple[int, int], list[int]] = {}
    side = max(radius, 1.0)

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for k, p in enumerate(points):
        parent.append(k)
        cx, cy = math.floor(p[0] / side), math.floor(p[1] / side)
        for x in (cx - 1, cx, cx + 1):
            for y in (cy - 1, cy, cy + 1):
                for j in cells.get((x, y), ()):
                    r = root(j)
                    if math.dist(p, points[j]) <= radius and math.dist(p, points[r]) <= radius:
                        own = root(k)
                        parent[max(own, r)] = min(own, r)
        cells.setdefault((cx, cy), []).append(k)
    return [root(k) for k in range(len(points))]


def point_clusters(points: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """keys, id, root (the id of the cluster's first point) of points (keys, id, x, y), in the order of id."""

    def fold(rows):
        roots = near_roots([(r[-2], r[-1]) for r in rows], radius)
        return [(r[-3], rows[k][-3]) for r, k in zip(rows, roots)]

    picked = points.filter("id is not null and x is not null and y is not null").select(*keys, "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return per_sorted_group(picked, keys, ["id", "x", "y"], fold, "id string, root string")


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise from the least point; points on its sides are none."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def side(ordered):
        out: list[tuple[float, float]] = []
        for p in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return side(points) + side(points[::-1])


def convex_hulls(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, corner, x, y of the convex hull of points (keys, x, y) per group; hulls of parts are taken before the shuffle, so that groups of any size stay small."""
    names, kinds = [*keys, "x", "y"], dict(points.dtypes)

    def parts(batches):
        for b in batches:
            rows = [(*((k,) if len(keys) == 1 else k), *p) for k, g in b.groupby(keys if len(keys) > 1 else keys[0], sort=False) for p in hull(list(zip(g["x"].tolist(), g["y"].tolist())))]
            yield pd.DataFrame(rows, columns=names)

    held = points.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    part = held.mapInPandas(parts, ", ".join([f"{k} {kinds[k]}" for k in keys] + ["x double", "y double"]))
    return per_sorted_group(part, keys, ["x", "y"], lambda rows: [(n, x, y) for n, (x, y) in enumerate(hull([(r[-2], r[-1]) for r in rows]))], "corner int, x double, y double")


def crop_plan(symbols: list[tuple[str, str, tuple[float, float, float, float]]], size: int) -> list[tuple[str, list[str]]]:
    """[(anchor, covered ids)] for symbols (id, class, (x, y, w, h)): rare classes first, a crop around each one not yet covered.

    A crop is `size` wide and high around its anchor's centre, or as large as
    the anchor; it covers the symbols that lie within it whole.
    """
    counts: dict[str, int] = {}
    for _, c, _ in symbols:
        counts[c] = counts.get(c, 0) + 1
    covered: set[str] = set()
    out = []
    for name, _, (x, y, w, h) in sorted(symbols, key=lambda s: (counts[s[1]], s[1], s[0])):
        if name in covered:
            continue
        side = max(size, w, h)
        x0, y0 = x + w / 2 - side / 2, y + h / 2 - side / 2
        inside = sorted({name, *(i for i, _, (u, v, m, n) in symbols if u >= x0 and v >= y0 and u + m <= x0 + side and v + n <= y0 + side)})
        covered.update(inside)
        out.append((name, inside))
    return out


def crop_plans(symbols: DataFrame, keys: list[str], size: int) -> DataFrame:
    """keys, anchor, covered (how many symbols its crop holds) of symbols (keys, id, class, box), a greedy cover of each drawing."""
    picked = symbols.filter("id is not null and class is not null and box is not null").select(*keys, "id", "class", *[F.col(f"box.{c}").cast("double").alias(c) for c in ("x", "y", "w", "h")])
    fold = lambda rows: [(a, len(held)) for a, held in crop_plan([(r[-6], r[-5], r[-4:]) for r in rows], size)]
    return per_sorted_group(picked, keys, ["id"], fold, "anchor string, covered int")
