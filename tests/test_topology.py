"""Arcs, crossings, chains, clusters, hulls and crops on small drawings, against brute force where there is one."""

import math
import random

from pyspark.sql import functions as F

from tracemill.functions import geometry as G
from tracemill.operators import topology as T

SEGMENTS = "page int, seg string, ax bigint, ay bigint, bx bigint, by bigint, x string"


def test_tees_part_lines(spark):
    rows = [(0, "main", 0, 0, 100, 0, None), (0, "tee", 40, 0, 40, 50, None), (0, "near", 70, 1, 70, -30, None), (0, "far", 20, 5, 20, 60, None), (1, "other", 50, 0, 50, 9, None), (None, "lost", 0, 0, 1, 1, None)]
    arcs = T.planar_arcs(spark.createDataFrame(rows, SEGMENTS), ["page"])
    got = {(r["seg"], r["k"]): (r["ax"], r["ay"], r["bx"], r["by"]) for r in arcs.filter("page = 0").collect()}
    assert [got["main", k] for k in (1, 2, 3)] == [(0, 0, 40, 0), (40, 0, 70, 1), (70, 1, 100, 0)] and ("main", 4) not in got and ("tee", 2) not in got
    assert arcs.limit(0).count() == 0


def test_crossings_keep_their_routes(spark):
    rows = [(0, "w", 0, 50, 50, 50, None), (0, "e", 50, 50, 100, 50, None), (0, "n", 50, 0, 50, 50, None), (0, "s", 50, 50, 50, 100, None), (0, "a", 300, 300, 350, 300, None), (0, "b", 350, 300, 350, 350, None), (0, "c", 350, 300, 400, 310, None), (0, "d", 350, 300, 320, 200, None)]
    arcs = T.planar_arcs(spark.createDataFrame(rows, SEGMENTS), ["page"])
    got = {frozenset((r["first"], r["second"])) for r in T.crossing_routes(arcs, ["page"]).collect()}
    assert got == {frozenset(("w#1", "e#1")), frozenset(("n#1", "s#1"))}
    dots = spark.createDataFrame([(0, 51.0, 50.0, 3.0)], "page int, x double, y double, r double")
    assert T.crossing_routes(arcs, ["page"], dots).count() == 0


def test_chains():
    a, b, c = ("a", (0, 0), (10, 0)), ("b", (30, 0), (11, 0)), ("c", (31, 0), (50, 0))
    assert T.order_chain([c, a, b], 3) == ([("a", False), ("b", True), ("c", False)], "")
    assert T.order_chain([a, ("z", (500, 0), (600, 0))], 3) == ([("a", False), ("z", False)], "break")
    loop = [("p", (0, 0), (10, 0)), ("q", (10, 0), (0, 0))]
    assert T.order_chain(loop, 3) == ([("p", False), ("q", False)], "unresolved")
    assert T.order_chain([("t", (10, 0), (0, 0)), ("u", (10, 1), (20, 0)), ("v", (20, 1), (10, 2))], 3)[1] == "" and T.order_chain([], 3) == ([], "")


def test_columns_and_points():
    assert T.x_clusters([("a", 0), ("b", 10), ("c", 21), ("d", 100)], 15) == [("a", 0), ("b", 0), ("c", 1), ("d", 2)]
    # a row of points each near the next: they don't become one
    assert T.near_roots([(0, 0), (8, 0), (16, 0), (24, 0)], 10) == [0, 0, 2, 2]
    rng = random.Random(1)
    points = [(rng.random() * 100, rng.random() * 100) for _ in range(150)]
    roots = T.near_roots(points, 12)
    assert all(roots[r] == r and r <= k for k, r in enumerate(roots))


def test_hull_against_brute_force(spark):
    rng = random.Random(3)
    for _ in range(20):
        points = [(rng.randrange(12), rng.randrange(12)) for _ in range(rng.randrange(1, 25))]
        got, every = T.hull(points), sorted(set(points))
        corners = {p for p in every if len(every) < 3 or any(all((q[0] - p[0]) * math.cos(t) + (q[1] - p[1]) * math.sin(t) < -1e-12 for q in every if q != p) for t in [k * math.pi / 720 for k in range(1440)])}
        assert set(got) == corners
    df = spark.createDataFrame([(1, float(x), float(y)) for x in range(9) for y in range(9)] + [(None, 1.0, 1.0), (2, 5.0, 5.0)], "k int, x double, y double").repartition(5)
    assert {(r["k"], r["x"], r["y"]) for r in T.convex_hulls(df, ["k"]).collect()} == {(1, 0.0, 0.0), (1, 8.0, 0.0), (1, 8.0, 8.0), (1, 0.0, 8.0), (2, 5.0, 5.0)}


def test_crops_cover_all():
    rng = random.Random(4)
    symbols = [(f"s{k}", rng.choice("aab"), (rng.randrange(3000), rng.randrange(3000), 40, 40)) for k in range(80)]
    plan = T.crop_plan(symbols, 768)
    assert {i for _, held in plan for i in held} == {s[0] for s in symbols} and len(plan) < 40
    assert T.crop_plan([("x", "a", (0, 0, 5000, 9))], 768) == [("x", ["x"])]


def test_geometry(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    n = lambda *x: tuple(F.lit(float(v)) for v in x)
    assert one(G.collinear_overlap(n(0, 0, 10, 0), n(5, 0, 20, 0))) and not one(G.collinear_overlap(n(0, 0, 10, 0), n(10, 0, 20, 0)))
    assert not one(G.collinear_overlap(n(0, 0, 10, 0), n(5, 0, 5, 9))) and not one(G.collinear_overlap(n(3, 3, 3, 3), n(3, 3, 9, 9)))
    box = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(10).alias("w"), F.lit(4).alias("h"))
    assert one(G.clip_places(*n(-10, 2, 30, 2), G.box_polygon(box))) == [0.25, 0.5] and one(G.clip_places(*n(1, 1, 2, 2), G.box_polygon(box))) == []
    assert tuple(one(G.ray_exit(box, *n(100, 2)))) == (10, 2) and tuple(one(G.ray_exit(box, *n(5, 2)))) == (5, 2) and tuple(one(G.ray_exit(box, *n(5, -90)))) == (5, 0)
    rate = lambda k: one(G.learning_rate(F.lit(k), 1000, 0.005))
    assert rate(50) == 0.0025 and abs(rate(1000) - 0.0001) < 1e-12 and abs(rate(100) - 0.005) < 1e-12


def test_groups_one_at_a_time(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, None), (None, 9, "z")], "k string, n int, v string")
    got = T.per_sorted_group(df, ["k"], ["n"], lambda rows: [(len(rows), "".join(r[2] or "-" for r in rows))], "size int, text string")
    assert sorted(tuple(r) for r in got.collect()) == [("a", 2, "xy"), ("b", 1, "-")]
    assert T.per_sorted_group(df.limit(0), ["k"], ["n"], lambda rows: [], "size int").count() == 0
