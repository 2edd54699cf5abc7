"""Spatial joins over grid cells: every theta join is an equi join on the cells that both sides touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions import geometry as G


def _celled(df: DataFrame, box: str, size: int, reach: int = 0) -> DataFrame:
    return df.filter(F.col(box).isNotNull() & (F.col(f"{box}.w") >= 0) & (F.col(f"{box}.h") >= 0)).withColumn("cell", F.explode(G.cells(F.col(box), size, reach)))


def _first_shared(a: Column, b: Column, size: int, reach: int) -> Column:
    """The lowest cell that two boxes share, so that a pair that meets in many cells comes out of one."""
    lo = lambda v, r: F.floor((v - r) / size).cast("int")
    return F.struct(F.greatest(lo(a["x"], reach), lo(b["x"], 0)).alias("cx"), F.greatest(lo(a["y"], reach), lo(b["y"], 0)).alias("cy"))


def near_pairs(left: DataFrame, right: DataFrame, keys: list[str], size: int, reach: int = 0) -> DataFrame:
    """Pairs of rows of one key whose boxes' cells meet, `left` grown by `reach`.

    left: keys, l_id, l_box and more; right: keys, r_id, r_box and more. Each
    pair comes once. Null boxes and those of negative size meet nothing.
    """
    a, b = _celled(left, "l_box", size, reach), _celled(right, "r_box", size)
    return a.join(b, [*keys, "cell"]).filter(F.col("cell") == _first_shared(F.col("l_box"), F.col("r_box"), size, reach)).drop("cell")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], size: int, least: float) -> DataFrame:
    """Pairs with IoU of at least `least` > 0."""
    return near_pairs(left, right, keys, size).withColumn("iou", G.iou(F.col("l_box"), F.col("r_box"))).filter(F.col("iou") >= least)


def within(left: DataFrame, right: DataFrame, keys: list[str], size: int, radius: int) -> DataFrame:
    """Pairs whose boxes are at most `radius` apart, with their gap."""
    return near_pairs(left, right, keys, size, radius).withColumn("gap", G.gap(F.col("l_box"), F.col("r_box"))).filter(F.col("gap") <= radius)


def nearest(left: DataFrame, right: DataFrame, keys: list[str], size: int, radius: int, order: list[str]) -> DataFrame:
    """Each left row's nearest right row within radius; ties go to the first in `order` (columns of right)."""
    best = W.partitionBy(*keys, "l_id").orderBy("gap", *order)
    return within(left, right, keys, size, radius).withColumn("place", F.row_number().over(best)).filter("place = 1").drop("place")


def snapped(ends: DataFrame, nodes: DataFrame, keys: list[str], size: int, radius: int, loose: int) -> DataFrame:
    """Edges by their snapped ends: each end to its nearest node within radius, the other within `loose` only if exactly one end snapped.

    ends: keys, edge, side ('from' or 'to'), l_box. Result: keys, edge,
    from_node, to_node, loosened.
    """
    left = ends.withColumn("l_id", F.concat_ws("|", "edge", "side"))
    far = within(left, nodes, keys, size, max(radius, loose))
    order = W.partitionBy(*keys, "l_id").orderBy("gap", "r_id")
    far = far.withColumn("place", F.row_number().over(order)).filter("place = 1")
    pick = lambda side, most: F.max(F.when((F.col("side") == side) & (F.col("gap") <= most), F.col("r_id")))
    per = ends.select(*keys, "edge").distinct().join(
        far.groupBy(*keys, "edge").agg(*[pick(s, m).alias(f"{s}_{n}") for s in ("from", "to") for n, m in (("tight", radius), ("loose", loose))]), [*keys, "edge"], "left"
    )
    one = F.col("from_tight").isNull() != F.col("to_tight").isNull()
    return per.select(
        *keys,
        "edge",
        F.when(one, F.coalesce("from_tight", "from_loose")).otherwise(F.col("from_tight")).alias("from_node"),
        F.when(one, F.coalesce("to_tight", "to_loose")).otherwise(F.col("to_tight")).alias("to_node"),
        (one & F.coalesce(F.col("from_loose").isNotNull() & F.col("to_loose").isNotNull(), F.lit(False))).alias("loosened"),
    )


def mutual_best(pairs: DataFrame, keys: list[str], score: str, most: float) -> DataFrame:
    """Pairs that are each other's lowest score (ties by the other's id), with score <= most."""
    by_l = W.partitionBy(*keys, "l_id").orderBy(score, "r_id")
    by_r = W.partitionBy(*keys, "r_id").orderBy(score, "l_id")
    return pairs.withColumn("pl", F.row_number().over(by_l)).withColumn("pr", F.row_number().over(by_r)).filter((F.col("pl") == 1) & (F.col("pr") == 1) & (F.col(score) <= most)).drop("pl", "pr")


def containers(inner: DataFrame, outer: DataFrame, keys: list[str], size: int, share: float) -> DataFrame:
    """Each inner (left) box with the smallest outer (right) box that holds `share` of it and is larger."""
    pairs = near_pairs(inner, outer, keys, size).filter((G.inside(F.col("r_box"), F.col("l_box")) >= share) & (G.area(F.col("r_box")) > G.area(F.col("l_box"))))
    best = W.partitionBy(*keys, "l_id").orderBy(G.area(F.col("r_box")), "r_id")
    return pairs.withColumn("place", F.row_number().over(best)).filter("place = 1").drop("place")


def crossings(segments: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Pairs a < b of segments that properly cross. segments: keys, seg, ax, ay, bx, by (int)."""
    box = F.struct(
        F.least("ax", "bx").alias("x"), F.least("ay", "by").alias("y"), F.abs(F.col("ax") - F.col("bx")).alias("w"), F.abs(F.col("ay") - F.col("by")).alias("h")
    )
    named = lambda p: segments.select(
        *keys, F.col("seg").alias(f"{p}_id"), box.alias(f"{p}_box"), *[F.col(c).cast("bigint").alias(f"{p}_{c}") for c in ("ax", "ay", "bx", "by")]
    )
    pairs = near_pairs(named("l"), named("r"), keys, size).filter("l_id < r_id")
    ends = lambda p: tuple(F.col(f"{p}_{c}") for c in ("ax", "ay", "bx", "by"))
    return pairs.filter(G.properly_cross(ends("l"), ends("r"))).select(*keys, F.col("l_id").alias("a"), F.col("r_id").alias("b"))
