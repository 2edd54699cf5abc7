"""Queries that resolve observations, route and score evidence; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions import geometry as G
from tracemill.functions import hashing as H
from tracemill.functions import text as X
from tracemill.operators import matching, resolve, roles, sequence, spatial
from tracemill.plans.drawings import CELL, EDGES, GAP, NODES, PAGE, _side, edges, label_key, nodes
from tracemill.session import materialise, table

# Fixed values in this module: base confidences 0.72, 0.54, 0.34 and their additions; edge contributions 0.06, -0.14,
# 0.10, -0.08, -0.35 with bounds 0.05 and 0.98; page limits 8, 30, 25; furniture from 0.55 of the width and 0.80 (title
# block 0.78) of the height; suppression shares 0.8, 0.9 and 0.25.
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Annotations with a box, each id once, in the shape of the resolver."""
    a = table(spark, d, "annotations").filter("annotation_id is not null and bbox_global is not null and fixture is not null and page_index is not null and bbox_global.w > 0 and bbox_global.h > 0")
    a = sequence.newest(a, ["annotation_id"], [F.asc_nulls_last("extracted_at"), F.asc_nulls_last("loaded_at"), F.asc_nulls_last("label"), F.asc_nulls_last("confidence")])
    return a.select(
        F.concat_ws("/", "fixture", F.col("page_index").cast("string")).alias("scope"),
        F.coalesce("kind", F.lit("")).alias("kind"),
        F.col("annotation_id").alias("id"),
        F.coalesce(F.unix_micros("extracted_at"), F.lit(0)).alias("ord"),
        X.label_key(F.col("label")).alias("key"),
        F.coalesce("label", F.lit("")).alias("label"),
        G.confidence_rank(F.col("confidence")).alias("rank"),
        F.col("bbox_global").alias("box"),
    )


OBS = f"""o AS (SELECT fixture || '/' || page_index AS scope, coalesce(kind, '') AS kind, annotation_id AS id, coalesce(epoch_us(extracted_at), 0) AS ord, {label_key('label')} AS key, coalesce(label, '') AS label,
  CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS rank, bbox_global FROM (SELECT *, row_number() OVER (PARTITION BY annotation_id ORDER BY extracted_at NULLS LAST, loaded_at NULLS LAST, label NULLS LAST, confidence NULLS LAST) AS p_ FROM annotations
  WHERE annotation_id IS NOT NULL AND bbox_global IS NOT NULL AND fixture IS NOT NULL AND page_index IS NOT NULL AND bbox_global.w > 0 AND bbox_global.h > 0) WHERE p_ = 1)"""
INTER = "greatest(0, least(a.bbox_global.x + a.bbox_global.w, b.bbox_global.x + b.bbox_global.w) - greatest(a.bbox_global.x, b.bbox_global.x))::BIGINT * greatest(0, least(a.bbox_global.y + a.bbox_global.h, b.bbox_global.y + b.bbox_global.h) - greatest(a.bbox_global.y, b.bbox_global.y))"
IOU = f"({INTER}) / (a.bbox_global.w::BIGINT * a.bbox_global.h + b.bbox_global.w::BIGINT * b.bbox_global.h - ({INTER}))::DOUBLE"


@query(f"""WITH RECURSIVE {OBS}, l AS (SELECT a.id AS s, b.id AS t FROM o a JOIN o b ON a.scope = b.scope AND a.kind = b.kind AND a.id <> b.id AND ((a.key <> '' AND a.key = b.key) OR {IOU} >= 0.3)),
c(id, low) AS (SELECT id, id FROM o UNION SELECT l.t, c.low FROM c JOIN l ON l.s = c.id WHERE c.low < l.t), m AS (SELECT id, min(low) AS cluster FROM c GROUP BY id)
SELECT scope, kind, cluster, arg_max(label, (rank, -ord, id)) AS label, count(*) AS members, CAST(count(DISTINCT nullif(label, '')) AS INT) AS readings, min(bbox_global.x) AS x0, min(bbox_global.y) AS y0, max(bbox_global.x + bbox_global.w) AS x1, max(bbox_global.y + bbox_global.h) AS y1
FROM o JOIN m USING (id) GROUP BY scope, kind, cluster""")
def reconcile_transitive(spark: SparkSession, d: str) -> DataFrame:
    """Annotations of one page and kind merged by label or overlap, transitively, into entities."""
    o = materialise(observations(spark, d), "observations")
    return resolve.entities(o, resolve.clusters(o))


@query()
def reconcile_sequential(spark: SparkSession, d: str) -> DataFrame:
    """The same by folding in order of extraction; grey overlaps are conflicts."""
    return resolve.resolve_in_order(materialise(observations(spark, d), "observations"))


@query(f"""WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY scope, kind, key ORDER BY rank DESC, ord, id) AS p FROM o WHERE key <> '') SELECT scope, kind, key, id AS chosen, label, rank FROM r WHERE p = 1""")
def coalesce_merge(spark: SparkSession, d: str) -> DataFrame:
    """The best reading of each labelled entity of a page: highest confidence, then first."""
    o = observations(spark, d).filter("key <> ''")
    return sequence.newest(o, ["scope", "kind", "key"], [F.desc("rank"), "ord", "id"]).select("scope", "kind", "key", F.col("id").alias("chosen"), "label", "rank")


@query(f"""WITH {OBS}, g AS (SELECT scope, kind, key, count(*) AS n, max(rank) AS best, count(DISTINCT label) AS labels, count(*) FILTER (label <> '') AS given FROM o WHERE key <> '' GROUP BY ALL)
SELECT scope, kind, key, CAST(round(least(0.98, greatest(0.05, CASE best WHEN 3 THEN 0.72 WHEN 2 THEN 0.54 ELSE 0.34 END + least(0.14, 0.07 * (n - 1)) + CASE WHEN given > 0 THEN 0.04 ELSE 0 END - CASE WHEN labels > 1 THEN 0.18 ELSE 0 END)), 3) AS DOUBLE) AS confidence FROM g""")
def fused_confidence(spark: SparkSession, d: str) -> DataFrame:
    g = observations(spark, d).filter("key <> ''").groupBy("scope", "kind", "key").agg(
        F.count(F.lit(1)).alias("n"), F.max("rank").alias("best"), F.countDistinct("label").alias("labels"), F.count(F.when(F.col("label") != "", 1)).alias("given")
    )
    base = F.when(F.col("best") == 3, 0.72).when(F.col("best") == 2, 0.54).otherwise(0.34)
    score = base + F.least(F.lit(0.14), 0.07 * (F.col("n") - 1)) + F.when(F.col("given") > 0, 0.04).otherwise(0.0) - F.when(F.col("labels") > 1, 0.18).otherwise(0.0)
    return g.select("scope", "kind", "key", F.round(F.least(F.lit(0.98), F.greatest(F.lit(0.05), score)), 3).alias("confidence"))


@query("""WITH p AS (SELECT fixture, page_index, count(*) FILTER (regexp_matches(label, '[A-Z]{1,4}-[0-9]{2,}')) AS tags, count(*) FILTER (line_type IS NOT NULL) AS lines, count(*) AS spans,
  bool_or(contains(lower(coalesce(label, '')), 'legend')) AS legend FROM annotations GROUP BY ALL)
SELECT fixture, page_index, CASE WHEN legend THEN 'legend' WHEN tags >= 8 AND lines >= 30 THEN 'pid' WHEN page_index = 0 AND spans < 25 AND lines < 30 THEN 'cover' ELSE 'pid' END AS role,
  CASE WHEN legend THEN 'high' WHEN tags >= 8 AND lines >= 30 THEN 'medium' WHEN page_index = 0 AND spans < 25 AND lines < 30 THEN 'medium' ELSE 'low' END AS confidence FROM p""")
def page_roles(spark: SparkSession, d: str) -> DataFrame:
    """Role of each page by the first rule that holds; doubtful pages stay drawings."""
    p = table(spark, d, "annotations").groupBy(*PAGE).agg(
        F.count(F.when(F.col("label").rlike("[A-Z]{1,4}-[0-9]{2,}"), 1)).alias("tags"),
        F.count("line_type").alias("lines"),
        F.count(F.lit(1)).alias("spans"),
        F.max(F.lower(F.coalesce("label", F.lit(""))).contains("legend")).alias("legend"),
    )
    dense, sparse = (F.col("tags") >= 8) & (F.col("lines") >= 30), (F.col("page_index") == 0) & (F.col("spans") < 25) & (F.col("lines") < 30)
    role = F.when(F.col("legend"), "legend").when(dense, "pid").when(sparse, "cover").otherwise("pid")
    return p.select(*PAGE, role.alias("role"), F.when(F.col("legend"), "high").when(dense | sparse, "medium").otherwise("low").alias("confidence"))


PAGES = "p AS (SELECT fixture, page_index, max(bbox_global.x + bbox_global.w) AS pw, max(bbox_global.y + bbox_global.h) AS ph FROM graph_nodes WHERE bbox_global IS NOT NULL GROUP BY ALL)"


@query(f"""WITH {NODES}, {PAGES} SELECT n.fixture, n.page_index, count(*) FILTER (bbox_global.x + bbox_global.w / 2.0 >= pw * 0.55 AND bbox_global.y + bbox_global.h / 2.0 >= ph * 0.80) AS furniture,
 count(*) FILTER (bbox_global.x + bbox_global.w / 2.0 >= pw * 0.55 AND bbox_global.y + bbox_global.h / 2.0 >= ph * 0.78) AS title_block, count(*) FILTER (bbox_global.x <= 60 OR bbox_global.x + bbox_global.w >= pw - 60) AS at_margin FROM n JOIN p ON n.fixture = p.fixture AND n.page_index = p.page_index WHERE bbox_global IS NOT NULL GROUP BY ALL""")
def sheet_furniture(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("bbox_global")
    p = table(spark, d, "graph_nodes").filter("bbox_global is not null").groupBy(*PAGE).agg(F.max(G.right(b)).alias("pw"), F.max(G.bottom(b)).alias("ph"))
    right = G.centre_x(b) >= F.col("pw") * 0.55
    n = nodes(spark, d).filter("bbox_global is not null").join(p, PAGE)
    return n.groupBy(*PAGE).agg(
        F.count(F.when(right & (G.centre_y(b) >= F.col("ph") * 0.80), 1)).alias("furniture"),
        F.count(F.when(right & (G.centre_y(b) >= F.col("ph") * 0.78), 1)).alias("title_block"),
        F.count(F.when((b["x"] <= 60) | (G.right(b) >= F.col("pw") - 60), 1)).alias("at_margin"),
    )


@query("""SELECT doc_id FROM documents WHERE (lang IS NULL OR lower(trim(lang)) = 'en') AND (fixture IS NULL OR fixture LIKE '%crude%') AND doc_kind IN ('legend_entry', 'knowledge_entry')""")
def applicable_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose scope holds: a null field applies to anything, kinds by overlap of lists."""
    kinds = F.array(F.lit("legend_entry"), F.lit("knowledge_entry"))
    ok = (F.col("lang").isNull() | (F.lower(F.trim("lang")) == "en")) & (F.col("fixture").isNull() | F.col("fixture").contains("crude")) & F.arrays_overlap(F.array("doc_kind"), kinds)
    return table(spark, d, "documents").filter(ok).select("doc_id")


@query("""SELECT fixture, arg_max(plant_domain, (loaded_at, run_id, plant_domain)) FILTER (plant_domain IS NOT NULL AND run_id IS NOT NULL) AS plant_domain, arg_max(source_type, (loaded_at, run_id, source_type)) FILTER (source_type IS NOT NULL AND run_id IS NOT NULL) AS source_type FROM results GROUP BY fixture""")
def context_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Context of each drawing: of every field the latest value given wins."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & F.col("run_id").isNotNull(), F.struct("loaded_at", "run_id", c))).alias(c)
    return table(spark, d, "results").groupBy("fixture").agg(last("plant_domain"), last("source_type"))


@query("""WITH n AS (SELECT DISTINCT label FROM graph_nodes WHERE length(label) >= 3), a AS (SELECT DISTINCT label FROM annotations WHERE length(label) >= 3),
e AS (SELECT a.label, n.label AS matched, 'exact' AS how FROM a JOIN n USING (label)),
f AS (SELECT a.label, min(n.label) AS matched, 'prefix' AS how FROM a JOIN n ON substr(a.label, 1, 3) = substr(n.label, 1, 3) AND (starts_with(a.label, n.label) OR starts_with(n.label, a.label)) WHERE a.label NOT IN (SELECT label FROM e) GROUP BY a.label)
SELECT * FROM e UNION ALL SELECT * FROM f""")
def prefix_match(spark: SparkSession, d: str) -> DataFrame:
    """Annotation labels matched with node labels: exactly, else where one begins with the other (the least); blocked by three letters."""
    of = lambda t: table(spark, d, t).filter("length(label) >= 3").select("label").distinct()
    n, a = of("graph_nodes"), of("annotations")
    exact = a.join(n, "label", "left_semi").select("label", F.col("label").alias("matched"), F.lit("exact").alias("how"))
    rest = a.join(n, "label", "left_anti").withColumn("b", F.substring("label", 1, 3))
    near = rest.join(n.select(F.col("label").alias("m"), F.substring("label", 1, 3).alias("b")), "b").filter(F.col("label").startswith(F.col("m")) | F.col("m").startswith(F.col("label")))
    return exact.unionByName(near.groupBy("label").agg(F.min("m").alias("matched")).withColumn("how", F.lit("prefix")))


@query(f"""WITH {NODES} SELECT a.node_id AS a, b.node_id AS b, round({GAP}, 6) AS gap FROM n a JOIN n b ON a.fixture = b.fixture AND a.page_index = b.page_index AND a.kind = b.kind AND a.node_id < b.node_id WHERE {GAP} <= 20""")
def radius_self_join(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return spatial.within(_side(n, "l", "kind"), _side(n, "r", "kind"), PAGE, CELL, 20).filter("l_id < r_id and l_kind = r_kind").select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), F.round("gap", 6).alias("gap"))


@query(f"""WITH {NODES}, {OBS}, s AS (SELECT n.fixture || '/' || n.page_index AS scope, kind, node_id, regexp_replace(lower(label), '[^a-z0-9]+', '', 'g') AS l FROM n WHERE label IS NOT NULL AND kind IS NOT NULL),
t AS (SELECT scope, kind, id, regexp_replace(lower(label), '[^a-z0-9]+', '', 'g') AS l FROM o WHERE label <> '' AND kind <> '')
SELECT DISTINCT s.node_id, t.id AS annotation_id FROM s JOIN t ON s.scope = t.scope AND s.kind = t.kind AND regexp_extract(s.l, '([0-9]{{3,}})', 1) = regexp_extract(t.l, '([0-9]{{3,}})', 1) WHERE regexp_extract(s.l, '([0-9]{{3,}})', 1) <> '' AND s.l <> t.l AND (contains(s.l, t.l) OR contains(t.l, s.l))""")
def near_miss_join(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and annotations of one page and kind whose labels contain one another without being equal; blocked by their number."""
    digits = lambda c: F.regexp_extract(c, "([0-9]{3,})", 1)
    s = nodes(spark, d).filter("label is not null and kind is not null and fixture is not null and page_index is not null").select(F.concat_ws("/", "fixture", F.col("page_index").cast("string")).alias("scope"), "kind", "node_id", X.tag_key(F.col("label")).alias("s")).withColumn("g", digits("s"))
    t = observations(spark, d).filter("label <> '' and kind <> ''").select("scope", "kind", F.col("id").alias("annotation_id"), X.tag_key(F.col("label")).alias("t")).withColumn("g", digits("t"))
    j = s.filter("g <> ''").join(t, ["scope", "kind", "g"]).filter("s <> t").filter(F.col("s").contains(F.col("t")) | F.col("t").contains(F.col("s")))
    return j.select("node_id", "annotation_id").distinct()


@query(f"""WITH {NODES}, c AS (SELECT a.node_id AS glyph, b.node_id AS valve, {GAP} AS gap FROM n a JOIN n b ON a.fixture = b.fixture AND a.page_index = b.page_index WHERE a.kind = 'instrument' AND b.label LIKE '%V-%' AND b.kind = 'equipment' AND {GAP} <= 300),
r AS (SELECT *, row_number() OVER (PARTITION BY glyph ORDER BY gap, valve) AS place FROM c) SELECT n.node_id AS glyph, coalesce(r.valve, '') AS valve, CAST(coalesce(r.place, 0) AS INT) AS place FROM n LEFT JOIN r ON r.glyph = n.node_id AND r.place <= 3 WHERE n.kind = 'instrument'""")
def glyph_valves(spark: SparkSession, d: str) -> DataFrame:
    """Each instrument's three nearest valves within 300 pixels; those without any stay."""
    n = nodes(spark, d)
    pairs = spatial.within(_side(n.filter("kind = 'instrument'"), "l"), _side(n.filter("kind = 'equipment' and label like '%V-%'"), "r"), PAGE, CELL, 300)
    ranked = pairs.withColumn("place", F.row_number().over(W.partitionBy("l_id").orderBy("gap", "r_id"))).filter("place <= 3").select(F.col("l_id").alias("glyph"), F.col("r_id").alias("valve"), "place")
    return n.filter("kind = 'instrument'").select(F.col("node_id").alias("glyph")).join(ranked, "glyph", "left").select("glyph", F.coalesce("valve", F.lit("")).alias("valve"), F.coalesce("place", F.lit(0)).alias("place"))


@query(f"""WITH {NODES} SELECT DISTINCT b.node_id AS fragment FROM n a JOIN n b ON a.fixture = b.fixture AND a.page_index = b.page_index AND a.node_id <> b.node_id WHERE {GAP} <= 150 AND length(b.label) >= 3 AND length(a.label) > length(b.label) AND contains(a.label, b.label)""")
def tag_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Nodes whose label is part of a longer label within 150 pixels."""
    n = nodes(spark, d)
    pairs = spatial.within(_side(n, "l", "label"), _side(n.filter("length(label) >= 3"), "r", "label"), PAGE, CELL, 150)
    return pairs.filter("l_id <> r_id and length(l_label) > length(r_label) and contains(l_label, r_label)").select(F.col("r_id").alias("fragment")).distinct()


@query(f"""WITH {NODES} SELECT a.node_id FROM n a WHERE bbox_global IS NOT NULL AND {' AND '.join(f"EXISTS (SELECT 1 FROM n b WHERE b.fixture = a.fixture AND b.page_index = a.page_index AND b.kind = '{k}' AND b.node_id <> a.node_id AND {GAP} <= 250)" for k in ('instrument', 'equipment', 'opc'))}""")
def existential_triple(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with a neighbour of each of three kinds within 250 pixels."""
    n = nodes(spark, d)
    near = spatial.within(_side(n, "l"), _side(n.filter("kind in ('instrument', 'equipment', 'opc')"), "r", "kind"), PAGE, CELL, 250).filter("l_id <> r_id")
    return near.groupBy("l_id").agg(F.countDistinct("r_kind").alias("k")).filter("k = 3").select(F.col("l_id").alias("node_id"))


ENDS = "v AS (SELECT DISTINCT fixture, edge_id, polyline_global[i][1] AS x, polyline_global[i][2] AS y FROM graph_edges, (VALUES (1), (-1)) AS s(i) WHERE len(polyline_global) >= 2 AND edge_id IS NOT NULL)"


@query(f"""WITH {ENDS} SELECT a.fixture, a.x, a.y, count(*) AS ends, min(edge_id) AS first_edge FROM v a GROUP BY a.fixture, a.x, a.y HAVING count(*) > 1""")
def shared_vertices(spark: SparkSession, d: str) -> DataFrame:
    """Points in which several lines of a drawing end."""
    at = lambda i, j: F.element_at(F.element_at("polyline_global", i), j)
    e = table(spark, d, "graph_edges").filter("size(polyline_global) >= 2 and edge_id is not null")
    v = e.select("fixture", "edge_id", F.inline(F.array(*[F.struct(at(i, 1).alias("x"), at(i, 2).alias("y")) for i in (1, -1)]))).distinct()
    return v.groupBy("fixture", "x", "y").agg(F.count(F.lit(1)).alias("ends"), F.min("edge_id").alias("first_edge")).filter("ends > 1")


SAID = "coalesce(json_extract_string(CASE WHEN json_valid({t}.attributes) THEN {t}.attributes END, '$.{f}'), '')"
ROLE_TEXT = "lower(concat_ws(' ', {t}.label, {t}.source_quote, " + ", ".join(SAID.replace("{f}", f) for f in ("equipment_class", "valve_type", "instrument_function", "structural_description")) + "))"
ROLE = (
    "CASE WHEN {t}.kind = 'opc' THEN 'opc' WHEN " + SAID.replace("{f}", "instrument_function") + " = 'valve_actuator' OR " + SAID.replace("{f}", "valve_type") + " IN ('control', 'control_valve') OR " + SAID.replace("{f}", "actuation_type") + " <> '' OR regexp_matches(" + ROLE_TEXT + ", '" + roles.ACTUATOR_TEXT + "')"
    " THEN 'actuator_valve' WHEN {t}.kind = 'instrument' THEN 'instrument' WHEN regexp_matches(" + ROLE_TEXT + ", '" + roles.MOTOR_TEXT + "') THEN 'motor' WHEN regexp_matches(" + ROLE_TEXT + ", '" + roles.POWER_TEXT + "') THEN 'power_source' ELSE 'equipment' END"
)


@query(f"""WITH {NODES}, x AS (SELECT DISTINCT edge_id, from_node, to_node, line_type, confidence, coalesce(len(polyline_global) >= 2, false) AS drawn FROM graph_edges WHERE edge_id IS NOT NULL AND coalesce(from_node, '') <> '' AND coalesce(to_node, '') <> ''),
q AS (SELECT n.node_id, {ROLE.replace('{t}', 'n')} AS role FROM n),
r AS (SELECT x.*, s.role AS a, t.role AS b, [s.role, t.role] AS ab FROM x LEFT JOIN q s ON s.node_id = x.from_node LEFT JOIN q t ON t.node_id = x.to_node),
c AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN 'invalid'
  WHEN line_type = 'process' THEN CASE WHEN NOT list_contains(ab, 'instrument') THEN 'valid' WHEN a = b THEN 'invalid' ELSE 'uncertain' END
  WHEN line_type IN ('signal_electric', 'signal_pneumatic') THEN CASE WHEN list_sort(ab) IN (['instrument', 'instrument'], ['actuator_valve', 'instrument']) THEN 'valid' ELSE 'invalid' END
  WHEN line_type = 'instrument_capillary' THEN CASE WHEN NOT list_contains(ab, 'instrument') THEN 'invalid' WHEN list_has_any(ab, ['equipment', 'actuator_valve']) THEN 'valid' ELSE 'uncertain' END
  WHEN line_type = 'electrical_power' THEN CASE WHEN list_sort(ab) IN (['equipment', 'motor'], ['motor', 'power_source']) THEN 'valid' ELSE 'invalid' END ELSE 'uncertain' END AS fit FROM r),
s AS (SELECT edge_id, fit, CAST(round(greatest(0.05, least(0.98, 0.5 + CASE WHEN drawn THEN 0.06 ELSE -0.14 END + CASE fit WHEN 'valid' THEN 0.10 WHEN 'uncertain' THEN -0.08 ELSE -0.35 END + CASE confidence WHEN 'high' THEN 0.06 WHEN 'low' THEN -0.08 ELSE 0 END)), 3) AS DOUBLE) AS score FROM c)
SELECT DISTINCT edge_id, fit, score, CASE WHEN score >= 0.80 THEN 'high' WHEN score >= 0.55 THEN 'medium' ELSE 'low' END AS level FROM s""")
def edge_scores(spark: SparkSession, d: str) -> DataFrame:
    """Edges scored by their geometry, by what their type may join and by how sure the decision for them was."""
    role = roles.role_of(F.col("kind"), F.col("attributes"), [F.col("label"), F.col("source_quote")])
    held = nodes(spark, d).select("node_id", role.alias("role"))
    of = lambda end, c: held.select(F.col("node_id").alias(end), F.col("role").alias(c))
    x = table(spark, d, "graph_edges").filter("edge_id is not null and coalesce(from_node, '') <> '' and coalesce(to_node, '') <> ''")
    x = x.select("edge_id", "from_node", "to_node", "line_type", "confidence", F.coalesce(F.size("polyline_global") >= 2, F.lit(False)).alias("drawn")).distinct()
    r = roles.with_fit(x.join(of("from_node", "a"), "from_node", "left").join(of("to_node", "b"), "to_node", "left"), "line_type", "a", "b")
    score = roles.evidence_score(F.col("drawn"), F.col("fit"), F.lit(False), F.col("confidence"), F.lit(False))
    return r.select("edge_id", "fit", score.alias("score")).withColumn("level", roles.score_level(F.col("score"))).distinct()


@query("""WITH g AS (SELECT user_id, epoch_us(CAST(ts AS TIMESTAMP)) / 1e6 - lag(epoch_us(CAST(ts AS TIMESTAMP))) OVER (PARTITION BY user_id ORDER BY ts, event_id) / 1e6 AS gap FROM events),
s AS (SELECT user_id, count(*) AS n, avg(gap) AS m, stddev_pop(gap) AS sd, median(gap) AS med FROM g WHERE gap IS NOT NULL GROUP BY user_id HAVING count(*) >= 3)
SELECT user_id, n, round(m, 3) AS mean_gap, round(sd / nullif(m, 0), 6) AS cv, round(med, 3) AS median_gap, CASE WHEN sd / nullif(m, 0) <= 0.65 THEN 'even' WHEN med / nullif(m, 0) <= 0.35 THEN 'bursty' ELSE 'mixed' END AS style FROM s""")
def run_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Gap statistics of each user's events with the population deviation, and the style they make."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    g = table(spark, d, "events").withColumn("t", t).withColumn("gap", F.col("t") - F.lag("t").over(w)).filter("gap is not null")
    s = g.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("m"), F.stddev_pop("gap").alias("sd"), F.median("gap").alias("med")).filter("n >= 3")
    m = F.nullif(F.col("m"), F.lit(0.0))
    style = F.when(F.col("sd") / m <= 0.65, "even").when(F.col("med") / m <= 0.35, "bursty").otherwise("mixed")
    return s.select("user_id", "n", F.round("m", 3).alias("mean_gap"), F.round(F.col("sd") / m, 6).alias("cv"), F.round("med", 3).alias("median_gap"), style.alias("style"))


@query("""WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE))::DOUBLE AS s, CAST(o_totalprice / 1000 AS DOUBLE) AS e FROM orders WHERE o_custkey IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY s, e, o_orderkey) AS k FROM o WHERE s IS NOT NULL AND e IS NOT NULL),
c(o_custkey, o_orderkey, k, kept, held) AS (SELECT o_custkey, o_orderkey, k, true, [{'s': s, 'e': e}] FROM r WHERE k = 1
  UNION ALL SELECT o_custkey, o_orderkey, k, f, CASE WHEN f THEN list_append(held, {'s': s, 'e': e})[-4:] ELSE held END
  FROM (SELECT r.o_custkey, r.o_orderkey, r.k, r.s, r.e, c.held, len(list_filter(c.held, lambda x: abs(x.s - r.s) <= 30 AND abs(x.e - r.e) <= 30)) = 0 AS f FROM c JOIN r ON r.o_custkey = c.o_custkey AND r.k = c.k + 1))
SELECT o_custkey, o_orderkey, kept FROM c""")
def look_back_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer kept unless one of the last four kept is near in day and price."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).cast("double").alias("s"), (F.col("o_totalprice") / 1000).cast("double").alias("e"))
    return resolve.look_back_dedup(o, "o_custkey", "o_orderkey", "s", "e", 4, 30.0)


@query(f"""WITH RECURSIVE {NODES}, p AS (SELECT a.node_id AS b, b.node_id AS w FROM n a JOIN n b ON a.fixture = b.fixture AND a.page_index = b.page_index AND a.kind = b.kind AND a.node_id <> b.node_id WHERE b.bbox_global.w::BIGINT * b.bbox_global.h > 0 AND b.bbox_global.w::BIGINT * b.bbox_global.h < 0.8 * (a.bbox_global.w::BIGINT * a.bbox_global.h) AND coalesce(a.system_confidence, 0.5) >= greatest(0.25, 0.5 * coalesce(b.system_confidence, 0.5)) AND ({INTER}) / (b.bbox_global.w::BIGINT * b.bbox_global.h)::DOUBLE >= 0.9),
c(b, w, free) AS (SELECT b, w, b NOT IN (SELECT w FROM p) FROM p
  UNION ALL SELECT b, w, b NOT IN (SELECT y.w FROM c y WHERE y.w NOT IN (SELECT z.w FROM c z WHERE z.free) AND y.b NOT IN (SELECT z.w FROM c z WHERE z.free) AND NOT y.free)
  FROM c WHERE NOT free AND w NOT IN (SELECT z.w FROM c z WHERE z.free) AND b NOT IN (SELECT z.w FROM c z WHERE z.free)),
gone AS (SELECT DISTINCT w FROM c WHERE free)
SELECT node_id, node_id NOT IN (SELECT w FROM gone) AS kept FROM n WHERE bbox_global IS NOT NULL AND fixture IS NOT NULL AND page_index IS NOT NULL""")
def containment_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of one page and kind that lie nine tenths within a kept one, a quarter larger and not much less sure, are fragments."""
    n = nodes(spark, d).withColumn("sure", F.coalesce("system_confidence", F.lit(0.5)))
    pairs = spatial.near_pairs(_side(n, "l", "kind", "sure"), _side(n, "r", "kind", "sure"), PAGE, CELL).filter("l_id <> r_id and l_kind = r_kind")
    big = G.area(F.col("r_box")) < 0.8 * G.area(F.col("l_box"))
    sure = F.col("l_sure") >= F.greatest(F.lit(0.25), 0.5 * F.col("r_sure"))
    held = pairs.filter(big & sure & (G.inside(F.col("l_box"), F.col("r_box")) >= 0.9))
    boxes = n.filter("bbox_global is not null and fixture is not null and page_index is not null").select(*PAGE, F.col("node_id").alias("id"))
    return matching.kept_of_pairs(boxes, held.select(*PAGE, F.col("l_id").alias("better"), F.col("r_id").alias("worse")), PAGE).select(F.col("id").alias("node_id"), "kept")


@query("""SELECT DISTINCT node_id, substr(sha256('7:' || node_id), 1, 16) AS place FROM graph_nodes WHERE node_id IS NOT NULL""")
def epoch_order(spark: SparkSession, d: str) -> DataFrame:
    """A seeded order of all nodes, as a key to sort by."""
    return table(spark, d, "graph_nodes").filter("node_id is not null").select("node_id", F.substring(F.sha2(F.concat(F.lit("7:"), F.col("node_id")), 256), 1, 16).alias("place")).distinct()


@query("""WITH a AS (SELECT DISTINCT fixture, label FROM annotations WHERE label IS NOT NULL), n AS (SELECT DISTINCT fixture, label FROM graph_nodes WHERE label IS NOT NULL)
SELECT a.fixture, count(*) AS observed, count(n.label) AS retained, round(100.0 * count(n.label) / count(*), 1) AS retained_pct FROM a LEFT JOIN n ON a.fixture = n.fixture AND a.label = n.label GROUP BY a.fixture""")
def retention(spark: SparkSession, d: str) -> DataFrame:
    of = lambda t: table(spark, d, t).filter("label is not null").select("fixture", "label").distinct()
    j = of("annotations").join(of("graph_nodes").withColumn("held", F.lit(True)), ["fixture", "label"], "left")
    return j.groupBy("fixture").agg(F.count(F.lit(1)).alias("observed"), F.count("held").alias("retained"), F.round(100.0 * F.count("held") / F.count(F.lit(1)), 1).alias("retained_pct"))


@query(f"""WITH {EDGES} SELECT fixture, count(*) AS n, count(*) FILTER (line_type = 'process') AS process, count(*) FILTER (from_node = to_node) AS loops, count(DISTINCT least(from_node, to_node) || '|' || greatest(from_node, to_node)) AS pairs FROM e GROUP BY fixture""")
def connectivity_counts(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).groupBy("fixture").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("line_type") == "process", 1)).alias("process"), F.count(F.when(F.col("from_node") == F.col("to_node"), 1)).alias("loops"), F.countDistinct(H.undirected_key(F.col("from_node"), F.col("to_node"))).alias("pairs")
    )


@query("""WITH u AS (SELECT label, kind, 0 AS rank FROM annotations WHERE label IS NOT NULL AND kind IS NOT NULL UNION ALL SELECT label, kind, 1 FROM graph_nodes WHERE label IS NOT NULL AND kind IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY rank DESC, kind) AS p FROM u) SELECT label, kind, rank FROM r WHERE p = 1""")
def keyed_union(spark: SparkSession, d: str) -> DataFrame:
    """Labels of annotations and nodes in one table; what nodes say wins."""
    of = lambda t, r: table(spark, d, t).filter("label is not null and kind is not null").select("label", "kind", F.lit(r).alias("rank"))
    return sequence.newest(of("annotations", 0).unionByName(of("graph_nodes", 1)), ["label"], [F.desc("rank"), "kind"]).select("label", "kind", "rank")


@query("""SELECT annotation_id, CASE WHEN bbox_global IS NULL THEN 'rejected' WHEN bbox_global.w <= 0 OR bbox_global.h <= 0 THEN 'rejected' WHEN kind = 'note' THEN 'retyped' WHEN confidence = 'low' AND label IS NULL THEN 'review' ELSE 'accepted' END AS disposition,
 CASE WHEN bbox_global IS NULL THEN 'no_box' WHEN bbox_global.w <= 0 OR bbox_global.h <= 0 THEN 'empty_box' WHEN kind = 'note' THEN 'text_only' WHEN confidence = 'low' AND label IS NULL THEN 'weak' ELSE '' END AS reason, count(*) AS n FROM annotations GROUP BY ALL""")
def admission_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Every annotation with the first gate that it meets; rejected ones are data too."""
    b = F.col("bbox_global")
    weak = (F.col("confidence") == "low") & F.col("label").isNull()
    gate = lambda a, e, t, w, o: F.when(b.isNull(), a).when((b["w"] <= 0) | (b["h"] <= 0), e).when(F.col("kind") == "note", t).when(weak, w).otherwise(o)
    return table(spark, d, "annotations").groupBy("annotation_id", gate("rejected", "rejected", "retyped", "review", "accepted").alias("disposition"), gate("no_box", "empty_box", "text_only", "weak", "").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
