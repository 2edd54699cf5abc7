"""Boxes, points and segments as Column expressions. Boxes are struct(x, y, w, h), y downwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def right(b: Column) -> Column:
    return b["x"] + b["w"]


def bottom(b: Column) -> Column:
    return b["y"] + b["h"]


def centre_x(b: Column) -> Column:
    return b["x"] + b["w"] / 2


def centre_y(b: Column) -> Column:
    return b["y"] + b["h"] / 2


def area(b: Column) -> Column:
    return b["w"].cast("bigint") * b["h"].cast("bigint")


def intersection(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0), F.least(right(a), right(b)) - F.greatest(a["x"], b["x"])).cast("bigint")
    h = F.greatest(F.lit(0), F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"])).cast("bigint")
    return w * h


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0 where disjoint or empty."""
    i = intersection(a, b)
    u = area(a) + area(b) - i
    return F.when(u > 0, i / u).otherwise(F.lit(0.0))


def gap(a: Column, b: Column) -> Column:
    """Distance between two boxes, 0 where they touch or overlap."""
    dx = F.greatest(F.lit(0), a["x"] - right(b), b["x"] - right(a))
    dy = F.greatest(F.lit(0), a["y"] - bottom(b), b["y"] - bottom(a))
    return F.hypot(dx.cast("double"), dy.cast("double"))


def centre_distance(a: Column, b: Column) -> Column:
    return F.hypot(centre_x(a) - centre_x(b), centre_y(a) - centre_y(b))


def point_box_distance(x: Column, y: Column, b: Column) -> Column:
    dx = F.greatest(F.lit(0), b["x"] - x, x - right(b))
    dy = F.greatest(F.lit(0), b["y"] - y, y - bottom(b))
    return F.hypot(dx.cast("double"), dy.cast("double"))


def inside(outer: Column, inner: Column) -> Column:
    """Share of the inner box that lies in the outer one."""
    return F.when(area(inner) > 0, intersection(outer, inner) / area(inner)).otherwise(F.lit(0.0))


def projection(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Place of a point's projection on a segment, from 0 to 1; 0 on a segment without length."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    return F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / n))).otherwise(F.lit(0.0))


def point_segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = projection(px, py, ax, ay, bx, by)
    return F.hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))


def cross(ox: Column, oy: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - ox) * (by - oy) - (ay - oy) * (bx - ox)


def properly_cross(p: tuple[Column, ...], q: tuple[Column, ...]) -> Column:
    """Whether two segments (ax, ay, bx, by) cross inside both; touching ends and collinear ones don't."""
    d1, d2 = cross(*q[:2], *q[2:], *p[:2]), cross(*q[:2], *q[2:], *p[2:])
    d3, d4 = cross(*p[:2], *p[2:], *q[:2]), cross(*p[:2], *p[2:], *q[2:])
    return (F.signum(d1.cast("double")) * F.signum(d2.cast("double")) < 0) & (F.signum(d3.cast("double")) * F.signum(d4.cast("double")) < 0)


def point_in_polygon(px: Column, py: Column, polygon: Column) -> Column:
    """Ray casting against an array of struct(x, y); points on an edge may fall either side."""
    turned = F.concat(F.slice(polygon, F.lit(2), F.size(polygon)), F.slice(polygon, F.lit(1), F.lit(1)))
    hits = F.zip_with(
        polygon,
        turned,
        lambda a, b: F.when(((a["y"] > py) != (b["y"] > py)) & (px < (b["x"] - a["x"]) * (py - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0),
    )
    return F.aggregate(hits, F.lit(0), lambda s, v: s + v) % 2 == 1


def cells(b: Column, size: int, reach: int = 0) -> Column:
    """struct(cx, cy) of every grid cell that a box, grown by `reach`, touches."""
    lo = lambda v: F.floor((v - reach) / size).cast("int")
    hi = lambda v: F.floor((v + reach) / size).cast("int")
    xs, ys = F.sequence(lo(b["x"]), hi(right(b))), F.sequence(lo(b["y"]), hi(bottom(b)))
    return F.flatten(F.transform(xs, lambda cx: F.transform(ys, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def page_zone(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A1 to D4: row letter and column number of a point in a page's envelope."""
    part = lambda v, a, b: F.least(F.lit(3), F.greatest(F.lit(0), F.floor((v - a) * 4 / F.greatest(b - a, F.lit(1))))).cast("int")
    return F.concat(F.element_at(F.array(*[F.lit(c) for c in "ABCD"]), part(y, y0, y1) + 1), (part(x, x0, x1) + 1).cast("string"))


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.78, "high").when(score >= 0.52, "medium").otherwise("low")


def confidence_rank(confidence: Column) -> Column:
    return F.when(confidence == "high", 3).when(confidence == "medium", 2).when(confidence == "low", 1).otherwise(0)


def fitting_dpi(width_pt: Column, height_pt: Column, dpi: float, most_px: int) -> Column:
    """The dpi asked for, or the one at which the longer side has most_px."""
    return F.least(F.lit(dpi), F.lit(72.0 * most_px) / F.greatest(width_pt, height_pt))


def image_tokens(width: Column, height: Column) -> Column:
    """Tokens of an image by 512-pixel tiles after fitting into 2048 and a shorter side of 768."""
    s1 = F.least(F.lit(1.0), F.lit(2048.0) / F.greatest(width, height))
    s2 = F.least(F.lit(1.0), F.lit(768.0) / F.least(width * s1, height * s1))
    w, h = F.floor(width * s1 * s2), F.floor(height * s1 * s2)
    return (85 + 170 * F.ceil(w / 512) * F.ceil(h / 512)).cast("bigint")


def token_cost(inputs: Column, outputs: Column, cache_reads: Column, cache_writes: Column, prices: tuple[float, float, float, float]) -> Column:
    """Cost of tokens by prices per million; nulls count 0."""
    parts = [F.coalesce(t, F.lit(0)) * p for t, p in zip((inputs, outputs, cache_reads, cache_writes), prices)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total / 1_000_000


def to_page(b: Column, origin_x: Column, origin_y: Column, scale: Column) -> Column:
    """A box of a view in page pixels."""
    at = lambda v, o: F.floor(v * scale + o + F.lit(0.5)).cast("int")
    size = lambda v: F.floor(v * scale + F.lit(0.5)).cast("int")
    return F.struct(at(b["x"], origin_x).alias("x"), at(b["y"], origin_y).alias("y"), size(b["w"]).alias("w"), size(b["h"]).alias("h"))


def collinear_overlap(p: tuple[Column, ...], q: tuple[Column, ...], tolerance: float = 1.0) -> Column:
    """Whether two segments (ax, ay, bx, by) run along each other for more than `tolerance`; a crossing or a touch doesn't count."""
    ax, ay, bx, by = p
    n = F.hypot((bx - ax).cast("double"), (by - ay).cast("double"))
    ux, uy = (bx - ax) / n, (by - ay) / n
    off = lambda x, y: F.abs((x - ax) * uy - (y - ay) * ux)
    along = lambda x, y: (x - ax) * ux + (y - ay) * uy
    s, t = along(q[0], q[1]), along(q[2], q[3])
    shared = F.least(n, F.greatest(s, t)) - F.greatest(F.lit(0.0), F.least(s, t))
    return F.coalesce((n > tolerance) & (off(q[0], q[1]) <= tolerance) & (off(q[2], q[3]) <= tolerance) & (shared > tolerance), F.lit(False))


def clip_places(ax: Column, ay: Column, bx: Column, by: Column, polygon: Column) -> Column:
    """Places, from 0 to 1 along a segment, where it meets the sides of a polygon (array of struct(x, y)), sorted, each once; parallel sides give none."""
    turned = F.concat(F.slice(polygon, F.lit(2), F.size(polygon)), F.slice(polygon, F.lit(1), F.lit(1)))
    dx, dy = (bx - ax).cast("double"), (by - ay).cast("double")

    def place(c: Column, d: Column) -> Column:
        ex, ey = (d["x"] - c["x"]).cast("double"), (d["y"] - c["y"]).cast("double")
        det = dx * ey - dy * ex
        along = F.try_divide((c["x"] - ax) * ey - (c["y"] - ay) * ex, det)
        across = F.try_divide((c["x"] - ax) * dy - (c["y"] - ay) * dx, det)
        return F.when((F.abs(det) >= 1e-9) & along.between(-1e-7, 1 + 1e-7) & across.between(-1e-7, 1 + 1e-7), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)), 8))

    return F.array_sort(F.array_distinct(F.array_compact(F.zip_with(polygon, turned, place))))


def box_polygon(b: Column) -> Column:
    """The corners of a box in order."""
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(b["x"], b["y"]), corner(right(b), b["y"]), corner(right(b), bottom(b)), corner(b["x"], bottom(b)))


def ray_exit(b: Column, x: Column, y: Column) -> Column:
    """struct(x, y) where the ray from a box's centre to a point leaves the box, rounded to even halves; the centre if the point is there."""
    cx, cy = centre_x(b), centre_y(b)
    dx, dy = x - cx, y - cy
    tx, ty = F.try_divide(b["w"] / 2, F.abs(dx)), F.try_divide(b["h"] / 2, F.abs(dy))
    # infinitely far away along an axis without movement
    t = F.when((dx == 0) & (dy == 0), F.lit(0.0)).otherwise(F.least(F.coalesce(tx, F.lit(float("inf"))), F.coalesce(ty, F.lit(float("inf")))))
    return F.struct(F.bround(cx + t * dx).cast("int").alias("x"), F.bround(cy + t * dy).cast("int").alias("y"))


def learning_rate(step: Column, total: int, initial: float, warm: int = 100, last: float = 0.0001) -> Column:
    """Rate of a training step: linear over the first `warm` steps, then along a cosine down to `last`."""
    progress = F.least(F.lit(1.0), (step - warm) / F.lit(float(max(1, total - warm))))
    return F.when(step <= warm, F.lit(initial) * step / warm).otherwise(F.lit(last) + F.lit(initial - last) * (1 + F.cos(F.lit(3.141592653589793) * progress)) / 2)


def overridden(value: Column, path: str, to: Column) -> Column:
    """A struct with the field at a dotted path set."""
    return value.withField(path, to)
