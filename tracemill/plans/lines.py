"""Lines as a graph, clusters, hulls, schedules and retained files, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import geometry as G
from tracemill.operators import graph, similarity, topology
from tracemill.plans.drawings import NODES, PAGE, SQL as DRAWING_SQL, nodes, tile_generator
from tracemill.plans.further import SQL as FURTHER_SQL
from tracemill.session import shared_dir, table
from tracemill.sources import files, writers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


EDGE_LINES = "l AS (SELECT DISTINCT fixture, edge_id, line_type, from_node, to_node, polyline_global AS p FROM graph_edges WHERE edge_id IS NOT NULL AND fixture IS NOT NULL AND len(polyline_global) > 1)"
STEPS = """s AS (SELECT DISTINCT fixture, edge_id || '#' || i AS seg, p[i][1]::BIGINT AS ax, p[i][2]::BIGINT AS ay, p[i + 1][1]::BIGINT AS bx, p[i + 1][2]::BIGINT AS by_ FROM (SELECT *, unnest(range(1, len(p))) AS i FROM l) WHERE p[i] <> p[i + 1])"""


def _segments(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "graph_edges").filter("edge_id is not null and fixture is not null").select("fixture", "edge_id", "polyline_global").distinct()
    return topology.polyline_segments(e, ["fixture"], "edge_id", "polyline_global")


@query(f"""WITH {EDGE_LINES}, {STEPS}, v AS (SELECT DISTINCT fixture, x, y FROM (SELECT fixture, ax AS x, ay AS y FROM s UNION ALL SELECT fixture, bx, by_ FROM s)),
m AS (SELECT s.*, v.x, v.y, greatest(0.0, least(1.0, ((v.x - ax) * (bx - ax) + (v.y - ay) * (by_ - ay))::DOUBLE / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t FROM s JOIN v ON v.fixture = s.fixture AND v.x BETWEEN least(ax, bx) - 1 AND greatest(ax, bx) + 1 AND v.y BETWEEN least(ay, by_) - 1 AND greatest(ay, by_) + 1),
c AS (SELECT fixture, seg, t, x, y FROM m WHERE NOT (x = ax AND y = ay) AND NOT (x = bx AND y = by_) AND t > 0 AND t < 1 AND sqrt(pow(x - (ax + t * (bx - ax)), 2) + pow(y - (ay + t * (by_ - ay)), 2)) <= 1
  UNION ALL SELECT fixture, seg, 0.0, ax, ay FROM s UNION ALL SELECT fixture, seg, 1.0, bx, by_ FROM s),
w AS (SELECT *, CAST(row_number() OVER q AS INT) AS k, lead(x) OVER q AS nx, lead(y) OVER q AS ny FROM c WINDOW q AS (PARTITION BY fixture, seg ORDER BY t, x, y))
SELECT fixture, seg, k, x AS ax, y AS ay, nx AS bx, ny AS by FROM w WHERE nx IS NOT NULL""")
def planar_arcs(spark: SparkSession, d: str) -> DataFrame:
    """The arcs of each drawing's lines, parted at the ends of other lines."""
    return topology.planar_arcs(_segments(spark, d), ["fixture"])


@query()
def crossing_routes(spark: SparkSession, d: str) -> DataFrame:
    """Through routes of four-armed vertices that make two straight lines; kept apart."""
    return topology.crossing_routes(topology.planar_arcs(_segments(spark, d), ["fixture"]), ["fixture"])


@query()
def line_chains(spark: SparkSession, d: str) -> DataFrame:
    """Lines of one type into one node of a drawing, chained end to end."""
    e = table(spark, d, "graph_edges").filter("edge_id is not null and fixture is not null and coalesce(to_node, '') <> '' and line_type is not null and size(polyline_global) > 1")
    at = lambda i, k: F.get(F.element_at("polyline_global", i), F.lit(k)).alias
    ends = e.select("fixture", "to_node", "line_type", F.col("edge_id").alias("seg"), at(1, 0)("ax"), at(1, 1)("ay"), at(-1, 0)("bx"), at(-1, 1)("by")).dropna().distinct()
    return topology.line_chains(ends, ["fixture", "to_node", "line_type"], 60.0)


@query()
def column_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Labelled boxes of each page in columns of text, by their left sides."""
    n = nodes(spark, d).filter("label is not null and bbox_global is not null").select(*PAGE, F.col("node_id").alias("id"), F.col("bbox_global.x").alias("x"))
    return topology.column_clusters(n, PAGE, 40.0)


@query()
def point_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Ends of a drawing's lines of one type within 25 pixels of the first of their cluster."""
    e = table(spark, d, "graph_edges").filter("edge_id is not null and size(polyline_global) > 1").select("fixture", "line_type", "edge_id", "polyline_global").distinct()
    at = lambda i, k: F.get(F.element_at("polyline_global", i), F.lit(k))
    ends = e.select("fixture", "line_type", F.inline(F.array(*[F.struct(F.concat_ws("@", "edge_id", F.lit(s)).alias("id"), at(i, 0).alias("x"), at(i, 1).alias("y")) for s, i in (("from", 1), ("to", -1))])))
    return topology.point_clusters(ends.distinct(), ["fixture", "line_type"], 25.0)


@query(f"""WITH {NODES}, p AS (SELECT DISTINCT fixture, page_index, unnest([{{'x': bbox_global.x, 'y': bbox_global.y}}, {{'x': bbox_global.x + bbox_global.w, 'y': bbox_global.y}}, {{'x': bbox_global.x, 'y': bbox_global.y + bbox_global.h}}, {{'x': bbox_global.x + bbox_global.w, 'y': bbox_global.y + bbox_global.h}}]) AS c FROM n WHERE bbox_global IS NOT NULL AND fixture IS NOT NULL AND page_index IS NOT NULL),
q AS (SELECT fixture, page_index, c.x::DOUBLE AS x, c.y::DOUBLE AS y FROM p WHERE c.x IS NOT NULL AND c.y IS NOT NULL),
a AS (SELECT a.fixture, a.page_index, a.x, a.y, atan2(b.y - a.y, b.x - a.x) AS t FROM q a JOIN q b ON a.fixture = b.fixture AND a.page_index = b.page_index AND (a.x <> b.x OR a.y <> b.y)),
g AS (SELECT *, coalesce(lead(t) OVER w - t, first_value(t) OVER (PARTITION BY fixture, page_index, x, y ORDER BY t) + 2 * pi() - t) AS gap FROM (SELECT DISTINCT fixture, page_index, x, y, t FROM a) WINDOW w AS (PARTITION BY fixture, page_index, x, y ORDER BY t))
SELECT fixture, page_index, x, y FROM g GROUP BY ALL HAVING max(gap) > pi() + 1e-9""")
def page_hulls(spark: SparkSession, d: str) -> DataFrame:
    """Corners of the convex hull of each page's boxes."""
    n = nodes(spark, d).filter("bbox_global is not null")
    corners = n.select(*PAGE, F.inline(G.box_polygon(F.col("bbox_global"))))
    return topology.convex_hulls(corners, PAGE).select(*PAGE, "x", "y")


@query()
def crop_plans(spark: SparkSession, d: str) -> DataFrame:
    """Crops that cover the symbols of each page, rare kinds first."""
    n = nodes(spark, d).filter("bbox_global is not null").select(*PAGE, F.col("node_id").alias("id"), F.col("kind").alias("class"), F.col("bbox_global").alias("box"))
    return topology.crop_plans(n, PAGE, 768)


@query(f"""WITH {NODES}, {EDGE_LINES}, x AS (SELECT DISTINCT l.edge_id, p[1][1]::DOUBLE AS ax, p[1][2]::DOUBLE AS ay, p[-1][1]::DOUBLE AS bx, p[-1][2]::DOUBLE AS by_, bbox_global AS b FROM l JOIN n ON n.node_id = l.from_node WHERE bbox_global IS NOT NULL),
c AS (SELECT *, unnest([[b.x, b.y, b.w, 0], [b.x + b.w, b.y, 0, b.h], [b.x + b.w, b.y + b.h, -b.w, 0], [b.x, b.y + b.h, 0, -b.h]]) AS q FROM x),
d AS (SELECT *, (bx - ax) * q[4] - (by_ - ay) * q[3] AS det FROM c),
t AS (SELECT edge_id, ax, ay, bx, by_, ((q[1] - ax) * q[4] - (q[2] - ay) * q[3]) / det AS t, ((q[1] - ax) * (by_ - ay) - (q[2] - ay) * (bx - ax)) / det AS u FROM d WHERE abs(det) >= 1e-9)
SELECT edge_id, ax, ay, bx, by_ AS by, array_to_string(list_transform(list_sort(list_distinct(list(round(greatest(0.0, least(1.0, t)), 8)) FILTER (t BETWEEN -1e-7 AND 1 + 1e-7 AND u BETWEEN -1e-7 AND 1 + 1e-7))), lambda v: printf('%.8f', v)), ',') AS places FROM t GROUP BY ALL""")
def clip_places(spark: SparkSession, d: str) -> DataFrame:
    """Where each line, taken straight, meets the sides of the box that it comes from."""
    e = table(spark, d, "graph_edges").filter("edge_id is not null and fixture is not null and size(polyline_global) > 1").select("edge_id", "from_node", "polyline_global").distinct()
    at = lambda i, k, c: F.get(F.element_at("polyline_global", i), F.lit(k)).cast("double").alias(c)
    n = nodes(spark, d).filter("bbox_global is not null").select(F.col("node_id").alias("from_node"), "bbox_global")
    x = e.join(n, "from_node").select("edge_id", at(1, 0, "ax"), at(1, 1, "ay"), at(-1, 0, "bx"), at(-1, 1, "by"), "bbox_global").filter("ax <> bx or ay <> by").distinct()
    places = G.clip_places(*[F.col(c) for c in ("ax", "ay", "bx", "by")], G.box_polygon(F.col("bbox_global")))
    text = F.array_join(F.transform(places, lambda v: F.format_string("%.8f", v)), ",")
    return x.filter("bbox_global.w <> 0 or bbox_global.h <> 0").select("edge_id", "ax", "ay", "bx", "by", F.nullif(text, F.lit("")).alias("places"))


@query(f"""WITH {NODES}, x AS (SELECT DISTINCT e.edge_id, a.bbox_global AS b, c.bbox_global.x + c.bbox_global.w / 2.0 AS tx, c.bbox_global.y + c.bbox_global.h / 2.0 AS ty FROM graph_edges e JOIN n a ON a.node_id = e.from_node JOIN n c ON c.node_id = e.to_node WHERE e.edge_id IS NOT NULL AND a.bbox_global IS NOT NULL AND c.bbox_global IS NOT NULL),
y AS (SELECT edge_id, b.x + b.w / 2.0 AS cx, b.y + b.h / 2.0 AS cy, b.w / 2.0 AS hw, b.h / 2.0 AS hh, tx - (b.x + b.w / 2.0) AS dx, ty - (b.y + b.h / 2.0) AS dy FROM x),
z AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0.0 WHEN dx = 0 THEN hh / abs(dy) WHEN dy = 0 THEN hw / abs(dx) ELSE least(hw / abs(dx), hh / abs(dy)) END AS t FROM y)
SELECT edge_id, CAST(round_even(cx + t * dx, 0) AS INT) AS x, CAST(round_even(cy + t * dy, 0) AS INT) AS y FROM z""")
def ray_exits(spark: SparkSession, d: str) -> DataFrame:
    """Where each edge leaves the box of its first node on the way to the centre of its second."""
    n = nodes(spark, d).filter("bbox_global is not null")
    of = lambda end, c: n.select(F.col("node_id").alias(end), F.col("bbox_global").alias(c))
    e = table(spark, d, "graph_edges").filter("edge_id is not null").select("edge_id", "from_node", "to_node").distinct()
    x = e.join(of("from_node", "a"), "from_node").join(of("to_node", "b"), "to_node").select("edge_id", "a", G.centre_x(F.col("b")).alias("tx"), G.centre_y(F.col("b")).alias("ty")).distinct()
    return x.select("edge_id", G.ray_exit(F.col("a"), F.col("tx"), F.col("ty")).alias("at")).select("edge_id", "at.x", "at.y")


@query(f"""WITH {EDGE_LINES}, q AS (SELECT DISTINCT fixture, edge_id, from_node, to_node, p[1][1]::DOUBLE AS ax, p[1][2]::DOUBLE AS ay, p[-1][1]::DOUBLE AS bx, p[-1][2]::DOUBLE AS by_ FROM l),
m AS (SELECT a.edge_id AS a, b.edge_id AS b, sqrt(pow(a.bx - a.ax, 2) + pow(a.by_ - a.ay, 2)) AS n, (a.bx - a.ax) AS dx, (a.by_ - a.ay) AS dy, b.ax - a.ax AS px, b.ay - a.ay AS py, b.bx - a.ax AS qx, b.by_ - a.ay AS qy FROM q a JOIN q b ON a.fixture = b.fixture AND a.from_node = b.from_node AND a.to_node = b.to_node AND a.edge_id < b.edge_id)
SELECT DISTINCT a, b, coalesce(n > 1 AND abs(px * dy / n - py * dx / n) <= 1 AND abs(qx * dy / n - qy * dx / n) <= 1 AND least(n, greatest((px * dx + py * dy) / n, (qx * dx + qy * dy) / n)) - greatest(0, least((px * dx + py * dy) / n, (qx * dx + qy * dy) / n)) > 1, false) AS along FROM m""")
def parallel_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between the same nodes, and whether they run along each other."""
    e = table(spark, d, "graph_edges").filter("edge_id is not null and fixture is not null and size(polyline_global) > 1").select("fixture", "edge_id", "from_node", "to_node", "polyline_global").distinct()
    at = lambda i, k: F.get(F.element_at("polyline_global", i), F.lit(k)).cast("double")
    of = lambda p: e.select("fixture", "from_node", "to_node", F.col("edge_id").alias(p), *[at(i, k).alias(f"{p}_{c}") for i, k, c in ((1, 0, "ax"), (1, 1, "ay"), (-1, 0, "bx"), (-1, 1, "by"))]).distinct()
    ends = lambda p: tuple(F.col(f"{p}_{c}") for c in ("ax", "ay", "bx", "by"))
    pairs = of("a").join(of("b"), ["fixture", "from_node", "to_node"]).filter("a < b")
    return pairs.select("a", "b", G.collinear_overlap(ends("a"), ends("b")).alias("along")).distinct()


@query(f"""WITH t AS ({DRAWING_SQL['tile_generator']}), {EDGE_LINES},
e AS (SELECT DISTINCT fixture, edge_id, p[-1][1] AS x, p[-1][2] AS y FROM l)
SELECT DISTINCT t.fixture, t.tile_id, e.edge_id, CASE WHEN abs(e.x - t.x) <= 25 THEN 'left' WHEN abs(e.x - t.x - t.w) <= 25 THEN 'right' WHEN abs(e.y - t.y) <= 25 THEN 'top' ELSE 'bottom' END AS side
FROM t JOIN e ON e.fixture = t.fixture AND e.x BETWEEN t.x - 25 AND t.x + t.w + 25 AND e.y BETWEEN t.y - 25 AND t.y + t.h + 25 WHERE least(abs(e.x - t.x), abs(e.x - t.x - t.w), abs(e.y - t.y), abs(e.y - t.y - t.h)) <= 25""")
def continuation_hints(spark: SparkSession, d: str) -> DataFrame:
    """Ends of lines within 25 pixels of a tile's boundary: where the next tile may continue them."""
    e = table(spark, d, "graph_edges").filter("edge_id is not null and fixture is not null and size(polyline_global) > 1")
    at = lambda k: F.get(F.element_at("polyline_global", -1), F.lit(k))
    # an end meets the tiles of its grid cell only; a tile covers bounded cells
    cell = F.struct(F.floor(F.col("px") / 1000).cast("int").alias("cx"), F.floor(F.col("py") / 1000).cast("int").alias("cy"))
    ends = e.select("fixture", "edge_id", at(0).alias("px"), at(1).alias("py")).distinct().withColumn("cell", cell)
    tiles = tile_generator(spark, d).withColumn("cell", F.explode(G.cells(F.struct("x", "y", "w", "h"), 1000, 25)))
    off = {"left": F.abs(F.col("px") - F.col("x")), "right": F.abs(F.col("px") - F.col("x") - F.col("w")), "top": F.abs(F.col("py") - F.col("y")), "bottom": F.abs(F.col("py") - F.col("y") - F.col("h"))}
    within = F.col("px").between(F.col("x") - 25, F.col("x") + F.col("w") + 25) & F.col("py").between(F.col("y") - 25, F.col("y") + F.col("h") + 25)
    side = F.when(off["left"] <= 25, "left").when(off["right"] <= 25, "right").when(off["top"] <= 25, "top").otherwise("bottom")
    return tiles.join(ends, ["fixture", "cell"]).filter(within & (F.least(*off.values()) <= 25)).select("fixture", "tile_id", "edge_id", side.alias("side")).distinct()


@query(f"""WITH RECURSIVE m AS (SELECT a, b FROM ({FURTHER_SQL['near_codes']})), v AS (SELECT vec_id AS node FROM embeddings WHERE len(embedding) >= 64), b AS (SELECT a AS s, b AS t FROM m UNION SELECT b, a FROM m),
c(node, low) AS (SELECT node, node FROM v UNION SELECT b.t, c.low FROM c JOIN b ON b.s = c.node WHERE c.low < b.t)
SELECT node, min(low) AS drawing FROM c GROUP BY node""")
def duplicate_drawings(spark: SparkSession, d: str) -> DataFrame:
    """Images (vectors) in groups of near-equal codes, by the least of each group."""
    codes = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), similarity.sign_code(F.col("embedding")).alias("code")).filter("code is not null")
    pairs = similarity.near_codes(codes, 7).select(F.col("a").alias("from_node"), F.col("b").alias("to_node"))
    held = graph.components(pairs, codes.select(F.col("id").alias("node")))
    return held.select("node", F.col("component").alias("drawing"))


@query("""SELECT doc_id, CASE WHEN doc_id <= 100 THEN 0.005 * doc_id / 100 ELSE 0.0001 + (0.005 - 0.0001) * (1 + cos(pi() * least(1.0, (doc_id - 100) / 900.0))) / 2 END::DOUBLE AS rate FROM documents WHERE doc_id IS NOT NULL""")
def learning_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rate of the training step of every document's number."""
    return table(spark, d, "documents").filter("doc_id is not null").select("doc_id", G.learning_rate(F.col("doc_id"), 1000, 0.005).alias("rate"))


@query("""SELECT DISTINCT coalesce(new_edge.id, '') AS edge, new_edge.from_node AS from_node, 'process' AS line_type, true AS gt_added FROM review_actions WHERE new_edge IS NOT NULL AND new_edge.attributes IS NOT NULL""")
def overridden_edges(spark: SparkSession, d: str) -> DataFrame:
    """New edges with two of their fields set by dotted paths."""
    e = table(spark, d, "review_actions").filter("new_edge is not null and new_edge.attributes is not null").select("new_edge")
    value = F.col("new_edge")
    for path, to in {"line_type": F.lit("process"), "attributes.gt_added": F.lit(True)}.items():
        value = G.overridden(value, path, to)
    return e.select(value.alias("e")).select(F.coalesce("e.id", F.lit("")).alias("edge"), "e.from_node", "e.line_type", "e.attributes.gt_added").distinct()


# --- written and read again --------------------------------------------------


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@query("""SELECT run_id, fixture, metric_kind, query_id, score, cost_usd, input_tokens, nullif(detail, '') AS detail FROM results""")
def results_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The fact table written as CSV and read again; a CSV file has no empty texts, they come back as nulls."""
    path = _folder(spark, "results-csv")
    writers.write_results(table(spark, d, "results").withColumn("condition", F.col("run_condition")).withColumn("domain", F.col("plant_domain")), path)
    return files.read_results(spark, path).select("run_id", "fixture", "metric_kind", "query_id", "score", "cost_usd", "input_tokens", "detail")


@query("""SELECT fixture, count(*) AS nodes, count(label) AS labels, CAST(sum(page_index) AS BIGINT) AS pages, count(*) FILTER (bbox_global.w > 100) AS wide FROM graph_nodes WHERE fixture IS NOT NULL GROUP BY fixture""")
def graph_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Nodes written as JSON per drawing and read again by the schema of annotations."""
    path = _folder(spark, "nodes-json")
    n = table(spark, d, "graph_nodes").filter("fixture is not null").select("fixture", F.col("node_id").alias("id"), "page_index", "kind", "label", "bbox_global", "confidence", "attributes")
    writers.write_json(n, path, by=["fixture"])
    rows, _ = files.read_annotations(spark, f"{path}/*")
    folder = F.regexp_extract("file", "fixture=([^/]+)/", 1)
    held = rows.withColumn("fixture", F.url_decode(folder))
    return held.groupBy("fixture").agg(F.count(F.lit(1)).alias("nodes"), F.count("label").alias("labels"), F.sum("page_index").alias("pages"), F.count(F.when(F.col("bbox_global.w") > 100, 1)).alias("wide"))


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
