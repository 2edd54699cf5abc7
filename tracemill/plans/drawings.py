"""Queries over drawings: labels, boxes, matching, graphs, quality; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions import geometry as G
from tracemill.functions import hashing as H
from tracemill.functions import text as X
from tracemill.operators import graph, matching, metrics, quality, ranking, sequence, spatial
from tracemill.session import materialise, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
PAGE = ["fixture", "page_index"]
CELL = 400


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """The newest row of each node."""
    n = table(spark, d, "graph_nodes").filter("node_id is not null")
    return sequence.newest(n, ["node_id"], [F.desc_nulls_last("extracted_at"), F.desc_nulls_last("loaded_at"), F.desc_nulls_last("label"), F.desc_nulls_last("system_confidence"), F.desc_nulls_last("attributes"), F.desc_nulls_last("page_index")])


NODES = """n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY extracted_at DESC NULLS LAST, loaded_at DESC NULLS LAST, label DESC NULLS LAST,
  system_confidence DESC NULLS LAST, attributes DESC NULLS LAST, page_index DESC NULLS LAST) AS place_ FROM graph_nodes WHERE node_id IS NOT NULL) WHERE place_ = 1)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges with both ends, each edge key's ends once."""
    return table(spark, d, "graph_edges").filter("coalesce(from_node, '') <> '' and coalesce(to_node, '') <> ''").select("fixture", "edge_id", "from_node", "to_node", "line_type").distinct()


EDGES = "e AS (SELECT DISTINCT fixture, edge_id, from_node, to_node, line_type FROM graph_edges WHERE coalesce(from_node, '') <> '' AND coalesce(to_node, '') <> '')"
LABEL_KEY = "regexp_replace(regexp_replace(upper(trim(coalesce({c}, ''))), '[^A-Z0-9_-]+', '', 'g'), '(^|[^0-9])0+([0-9])', '\\1\\2', 'g')"


def label_key(c: str) -> str:
    return LABEL_KEY.replace("{c}", c)


# --- labels -----------------------------------------------------------------


@query(f"SELECT DISTINCT label, {label_key('label')} AS label_key, regexp_replace(upper(label), '[^A-Z0-9]+', '', 'g') AS text_key, regexp_replace(lower(label), '[^a-z0-9]+', '', 'g') AS tag_key, trim(regexp_replace(lower(label), '\\s+', ' ', 'g')) AS squeezed FROM graph_nodes WHERE label IS NOT NULL")
def label_normalise(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("label")
    return table(spark, d, "graph_nodes").filter("label is not null").select("label", X.label_key(c).alias("label_key"), X.text_key(c).alias("text_key"), X.tag_key(c).alias("tag_key"), X.squeeze(c).alias("squeezed")).distinct()


@query(f"""WITH {NODES}, k AS (SELECT node_id, fixture, page_index, kind, {label_key('label')} AS l FROM n WHERE label IS NOT NULL AND page_index IS NOT NULL AND fixture IS NOT NULL),
f AS (SELECT *, translate(l, 'OIS', '015') AS f FROM k)
SELECT a.node_id AS a, b.node_id AS b, a.l AS label_a, b.l AS label_b FROM f a JOIN f b ON a.fixture = b.fixture AND a.page_index = b.page_index AND a.kind IS NOT DISTINCT FROM b.kind AND a.f = b.f AND a.node_id < b.node_id AND a.l <> b.l
WHERE list_sum([CASE WHEN substr(a.l, i, 1) <> substr(b.l, i, 1) THEN 1 ELSE 0 END FOR i IN range(1, length(a.l) + 1)]) = 1""")
def ocr_flip_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of nodes of one page and kind whose labels differ in one confusable character."""
    k = nodes(spark, d).filter("label is not null and page_index is not null and fixture is not null").select("node_id", *PAGE, F.coalesce("kind", F.lit("")).alias("kind"), X.label_key(F.col("label")).alias("l"))
    k = k.withColumn("f", X.flip_key(F.col("l")))
    b = k.select(*PAGE, "kind", "f", F.col("node_id").alias("b"), F.col("l").alias("label_b"))
    pairs = k.withColumnRenamed("node_id", "a").withColumnRenamed("l", "label_a").join(b, [*PAGE, "kind", "f"]).filter("a < b and label_a <> label_b")
    return pairs.filter(X.differing_chars(F.col("label_a"), F.col("label_b")) == 1).select("a", "b", "label_a", "label_b")


@query("""WITH v AS (SELECT DISTINCT lower(trim(json_extract_string(attributes, '$.valve_type'))) AS value FROM graph_nodes WHERE json_extract_string(attributes, '$.valve_type') IS NOT NULL),
c AS (SELECT v.value, k.canonical, levenshtein(v.value, k.canonical) AS distance FROM v, canonical_values k WHERE k.field_name = 'valve_type' AND levenshtein(v.value, k.canonical) <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY distance, canonical) AS place FROM c)
SELECT value, canonical AS nearest, CAST(distance AS INT) AS distance FROM r WHERE place = 1""")
def nearest_key(spark: SparkSession, d: str) -> DataFrame:
    """Nearest registry key within two edits of each distinct value. The registry is a fixed list of one field."""
    v = table(spark, d, "graph_nodes").select(F.lower(F.trim(F.get_json_object("attributes", "$.valve_type"))).alias("value")).filter("value is not null").distinct()
    k = table(spark, d, "canonical_values").filter("field_name = 'valve_type'").agg(F.collect_set("canonical").alias("keys"))
    held = v.join(F.broadcast(k)).select("value", F.explode("keys").alias("nearest")).withColumn("distance", F.levenshtein("value", "nearest", 2)).filter("distance >= 0")
    best = W.partitionBy("value").orderBy("distance", "nearest")
    return held.withColumn("place", F.row_number().over(best)).filter("place = 1").select("value", "nearest", "distance")


@query("""SELECT fixture, CAST(sum(levenshtein(coalesce(label, ''), coalesce(alternate_readings[1], ''))) AS BIGINT) AS edits, CAST(sum(length(coalesce(label, ''))) AS BIGINT) AS chars,
  round(sum(levenshtein(coalesce(label, ''), coalesce(alternate_readings[1], ''))) / nullif(sum(length(coalesce(label, ''))), 0)::DOUBLE, 6) AS error_rate FROM graph_nodes WHERE len(alternate_readings) > 0 GROUP BY fixture""")
def char_error_rate(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "graph_nodes").filter("size(alternate_readings) > 0").withColumn("read", F.element_at("alternate_readings", 1))
    return metrics.error_rate(pairs, ["fixture"], "label", "read").select("fixture", "edits", "chars", F.round("error_rate", 6).alias("error_rate"))


@query("""SELECT DISTINCT label, regexp_replace(lower(regexp_extract(label, '([A-Za-z]{1,5}-?[0-9]{2,}[A-Za-z]?)', 1)), '[^a-z0-9]+', '', 'g') AS root,
  CASE WHEN p = '' THEN NULL WHEN contains(substr(p, 2), 'C') THEN 'controller' WHEN contains(substr(p, 2), 'T') THEN 'transmitter' WHEN contains(substr(p, 2), 'I') THEN 'indicator' WHEN contains(substr(p, 2), 'R') THEN 'recorder'
  WHEN contains(substr(p, 2), 'E') THEN 'element' WHEN contains(substr(p, 2), 'S') THEN 'switch' WHEN contains(substr(p, 2), 'A') THEN 'alarm' WHEN contains(substr(p, 2), 'V') THEN 'valve_actuator' ELSE 'unclassified_instrument' END AS function
FROM (SELECT label, regexp_extract(upper(label), '^([A-Z]+)', 1) AS p FROM graph_nodes WHERE label IS NOT NULL)""")
def tag_semantics(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("label")
    prefix = F.regexp_extract(F.upper(c), "^([A-Z]+)", 1)
    return table(spark, d, "graph_nodes").filter("label is not null").select("label", X.tag_root(c).alias("root"), F.when(prefix != "", X.instrument_function(prefix)).alias("function")).distinct()


TOKENS = "list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace({c}, '^\\s*opc[\\s\\-_:]*(?:in|out)?[\\s\\-_:]*', ' ', 'i'), '\\([^)]*\\)', ' ', 'g')), '([a-z0-9]+)', 1), lambda w: length(w) >= 3 AND w NOT IN ('inlet', 'outlet', 'in', 'out', 'to', 'from'))"


@query(f"""SELECT label, len(t) AS tokens, coalesce(t[1], '') AS head FROM (SELECT label, {TOKENS.replace('{c}', 'label')} AS t FROM (SELECT DISTINCT label FROM graph_nodes WHERE kind = 'opc' AND label IS NOT NULL))""")
def connector_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = X.connector_tokens(F.col("label"))
    return table(spark, d, "graph_nodes").filter("kind = 'opc' and label is not null").select("label").distinct().select("label", F.size(t).cast("bigint").alias("tokens"), F.coalesce(F.get(t, F.lit(0)), F.lit("")).alias("head"))


PROSE = "'" + "', '".join(X.PROSE_WORDS) + "'"
STARTS = "'" + "', '".join(X.PROSE_STARTS) + "'"
#: Items of an answer, as in text.list_items
ITEMS = f"""list_filter([regexp_replace(regexp_replace(regexp_replace(trim(p), '^([-*•]|[0-9]+[.)])\\s+', ''), '^[A-Za-z0-9]\\s*:\\s+', ''), '[.,;:]+$', '') FOR p IN flatten([regexp_split_to_array(s, '[,;]') FOR s IN list_filter([trim(x) FOR x IN regexp_split_to_array({{c}}, '\\r?\\n')],
  lambda s: s <> '' AND NOT ends_with(s, ':') AND NOT regexp_full_match(s, '`{{{{3,}}}}\\s*\\w*\\s*')
   AND NOT (len(regexp_split_to_array(lower(s), '\\s+')) > 1 AND regexp_replace(regexp_split_to_array(lower(s), '\\s+')[1], '^[.,;:!?"'']+|[.,;:!?"'']+$', '', 'g') IN ({STARTS}))
   AND len(list_filter(regexp_split_to_array(lower(s), '\\s+'), lambda w: regexp_replace(w, '^[.,;:!?"''()\\[\\]]+|[.,;:!?"''()\\[\\]]+$', '', 'g') IN ({PROSE}))) = 0)])], lambda p: p <> '')""".replace("{{{{", "{{").replace("}}}}", "}}")


@query(f"""SELECT doc_id, len({ITEMS.replace('{c}', 'text').replace('{{3,}}', '{3,}')}) AS items, CASE WHEN len(l) > 0 THEN TRY_CAST(l[-1] AS BIGINT) END AS lone FROM (SELECT doc_id, text,
  list_filter([trim(x) FOR x IN regexp_split_to_array(text, '\\r?\\n')], lambda s: regexp_full_match(s, '-?[0-9]+')) AS l FROM documents WHERE text IS NOT NULL)""")
def parse_answers(spark: SparkSession, d: str) -> DataFrame:
    """Items of each text read as a list answer, and the last line that is an integer alone."""
    t = F.col("text")
    lone = F.filter(F.transform(F.split(t, r"\r?\n"), lambda s: F.trim(s)), lambda s: s.rlike("^-?[0-9]+$"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(X.list_items(t)).cast("bigint").alias("items"), F.try_element_at(lone, F.lit(-1)).try_cast("bigint").alias("lone"))


@query("""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, 'Is there a process flow path from [A-Z0-9-]+ to [A-Z0-9-]+\\?', 0)) AS q FROM documents WHERE text IS NOT NULL)
SELECT q AS question, trim(regexp_extract(q, '(?i)from\\s+`?([A-Za-z0-9._\\-/ ]+?)`?\\s+to\\s+`?([A-Za-z0-9._\\-/ ]+?)`?\\s*\\??\\s*$', 1)) AS src, trim(regexp_extract(q, '(?i)from\\s+`?([A-Za-z0-9._\\-/ ]+?)`?\\s+to\\s+`?([A-Za-z0-9._\\-/ ]+?)`?\\s*\\??\\s*$', 2)) AS dst, count(*) AS n FROM s GROUP BY q""")
def path_questions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"Is there a process flow path from [A-Z0-9-]+ to [A-Z0-9-]+\?"), 0)).alias("question"))
    ends = X.path_endpoints(F.col("question"))
    return s.groupBy("question").agg(F.count(F.lit(1)).alias("n")).select("question", ends["src"].alias("src"), ends["dst"].alias("dst"), "n")


@query("""SELECT DISTINCT t AS value, CASE WHEN regexp_matches(t, '(\\bfrom\\b|inlet)') THEN 'in' WHEN regexp_matches(t, '(\\bto\\b|outlet)') THEN 'out' END AS direction,
  CASE WHEN contains(t, 'instrument air') THEN 'instrument_air' WHEN contains(t, 'nitrogen') THEN 'nitrogen' WHEN contains(t, 'cws') THEN 'cooling_water_supply' ELSE regexp_replace(regexp_replace(t, '\\b(to|from)\\b', ' ', 'g'), '[^a-z0-9]+', '', 'g') END AS service,
  regexp_replace(regexp_replace(t, '[^a-z0-9]+', '-', 'g'), '(^-+)|(-+$)', '', 'g') AS slug
FROM (SELECT lower(json_extract_string(attributes, '$.equipment_class')) AS t FROM graph_nodes) WHERE t IS NOT NULL""")
def service_and_direction(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("value")
    v = table(spark, d, "graph_nodes").select(F.lower(F.get_json_object("attributes", "$.equipment_class")).alias("value")).filter("value is not null").distinct()
    return v.select("value", X.flow_direction(t).alias("direction"), X.service_key(t).alias("service"), X.slug(t).alias("slug"))


# --- boxes ------------------------------------------------------------------

IOU = "({i}) / nullif(a.bbox_global.w::BIGINT * a.bbox_global.h + b.bbox_global.w::BIGINT * b.bbox_global.h - ({i}), 0)::DOUBLE".replace(
    "{i}", "greatest(0, least(a.bbox_global.x + a.bbox_global.w, b.bbox_global.x + b.bbox_global.w) - greatest(a.bbox_global.x, b.bbox_global.x))::BIGINT * greatest(0, least(a.bbox_global.y + a.bbox_global.h, b.bbox_global.y + b.bbox_global.h) - greatest(a.bbox_global.y, b.bbox_global.y))"
)


def _side(df: DataFrame, p: str, *more: str) -> DataFrame:
    return df.select(*PAGE, F.col("node_id").alias(f"{p}_id"), F.col("bbox_global").alias(f"{p}_box"), *[F.col(c).alias(f"{p}_{c}") for c in more]).filter(f"{p}_box is not null and fixture is not null and page_index is not null")


@query(f"""WITH {NODES} SELECT a.node_id AS a, b.node_id AS b, round({IOU}, 6) AS iou FROM n a JOIN n b ON a.fixture = b.fixture AND a.page_index = b.page_index AND a.kind = b.kind AND a.node_id < b.node_id WHERE {IOU} >= 0.3""")
def iou_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of one page and kind that overlap by 0.3 or more."""
    n = nodes(spark, d)
    pairs = spatial.overlaps(_side(n, "l", "kind"), _side(n, "r", "kind"), PAGE, CELL, 0.3)
    return pairs.filter("l_id < r_id and l_kind = r_kind").select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), F.round("iou", 6).alias("iou"))


@query(f"""WITH {NODES} SELECT a.node_id AS a, b.node_id AS b, round({IOU}, 6) AS iou FROM n a JOIN n b ON a.fixture = b.fixture AND a.page_index = b.page_index AND a.kind = b.kind AND a.node_id < b.node_id WHERE {IOU} >= 0.15 AND {IOU} < 0.3""")
def iou_grey_zone(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps too small to merge and too large to pass: 0.15 to below 0.3."""
    n = nodes(spark, d)
    pairs = spatial.overlaps(_side(n, "l", "kind"), _side(n, "r", "kind"), PAGE, CELL, 0.15)
    return pairs.filter("l_id < r_id and l_kind = r_kind and iou < 0.3").select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), F.round("iou", 6).alias("iou"))


GAP = "sqrt(pow(greatest(0, a.bbox_global.x - (b.bbox_global.x + b.bbox_global.w), b.bbox_global.x - (a.bbox_global.x + a.bbox_global.w)), 2) + pow(greatest(0, a.bbox_global.y - (b.bbox_global.y + b.bbox_global.h), b.bbox_global.y - (a.bbox_global.y + a.bbox_global.h)), 2))"


@query(f"""WITH {NODES}, c AS (SELECT a.node_id AS instrument, b.node_id AS equipment, {GAP} AS gap FROM n a JOIN n b ON a.fixture = b.fixture AND a.page_index = b.page_index WHERE a.kind = 'instrument' AND b.kind = 'equipment' AND {GAP} <= 120),
r AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY gap, equipment) AS p FROM c) SELECT instrument, equipment, round(gap, 6) AS gap FROM r WHERE p = 1""")
def nearest_join(spark: SparkSession, d: str) -> DataFrame:
    """Each instrument's nearest equipment on its page within 120 pixels."""
    n = nodes(spark, d)
    near = spatial.nearest(_side(n.filter("kind = 'instrument'"), "l"), _side(n.filter("kind = 'equipment'"), "r"), PAGE, CELL, 120, ["r_id"])
    return near.select(F.col("l_id").alias("instrument"), F.col("r_id").alias("equipment"), F.round("gap", 6).alias("gap"))


@query(f"""WITH {NODES}, c AS (SELECT a.node_id AS instrument, b.node_id AS equipment, {GAP} AS gap FROM n a JOIN n b ON a.fixture = b.fixture AND a.page_index = b.page_index WHERE a.kind = 'instrument' AND b.kind = 'equipment' AND {GAP} <= 200),
r AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY gap, equipment) AS p, row_number() OVER (PARTITION BY equipment ORDER BY gap, instrument) AS q FROM c) SELECT instrument, equipment, round(gap, 6) AS gap FROM r WHERE p = 1 AND q = 1 AND gap <= 120""")
def mutual_best(spark: SparkSession, d: str) -> DataFrame:
    """Instruments and equipment that are each other's nearest, at most 120 pixels apart."""
    n = nodes(spark, d)
    pairs = spatial.within(_side(n.filter("kind = 'instrument'"), "l"), _side(n.filter("kind = 'equipment'"), "r"), PAGE, CELL, 200)
    return spatial.mutual_best(pairs, PAGE, "gap", 120).select(F.col("l_id").alias("instrument"), F.col("r_id").alias("equipment"), F.round("gap", 6).alias("gap"))


@query(f"""WITH {NODES}, c AS (SELECT a.node_id AS inner_node, b.node_id AS container, row_number() OVER (PARTITION BY a.node_id ORDER BY b.bbox_global.w::BIGINT * b.bbox_global.h, b.node_id) AS p FROM n a JOIN n b ON a.fixture = b.fixture AND a.page_index = b.page_index
  WHERE a.bbox_global.w::BIGINT * a.bbox_global.h > 0 AND b.bbox_global.w::BIGINT * b.bbox_global.h > a.bbox_global.w::BIGINT * a.bbox_global.h
  AND greatest(0, least(a.bbox_global.x + a.bbox_global.w, b.bbox_global.x + b.bbox_global.w) - greatest(a.bbox_global.x, b.bbox_global.x))::BIGINT * greatest(0, least(a.bbox_global.y + a.bbox_global.h, b.bbox_global.y + b.bbox_global.h) - greatest(a.bbox_global.y, b.bbox_global.y)) >= 0.9 * (a.bbox_global.w::BIGINT * a.bbox_global.h))
SELECT inner_node, container FROM c WHERE p = 1""")
def containment_join(spark: SparkSession, d: str) -> DataFrame:
    """The smallest larger box of the page that holds nine tenths of a node's."""
    n = nodes(spark, d)
    return spatial.containers(_side(n, "l"), _side(n, "r"), PAGE, CELL, 0.9).select(F.col("l_id").alias("inner_node"), F.col("r_id").alias("container"))


SEGMENTS = "s AS (SELECT DISTINCT fixture, edge_id AS seg, polyline_global[1][1]::BIGINT AS ax, polyline_global[1][2]::BIGINT AS ay, polyline_global[2][1]::BIGINT AS bx, polyline_global[2][2]::BIGINT AS by_ FROM graph_edges WHERE len(polyline_global) = 2 AND line_type = 'signal_electric' AND edge_id IS NOT NULL AND fixture IS NOT NULL)"
CROSS = "sign(({q}bx - {q}ax) * ({p}ay - {q}ay) - ({q}by_ - {q}ay) * ({p}ax - {q}ax)) * sign(({q}bx - {q}ax) * ({p}by_ - {q}ay) - ({q}by_ - {q}ay) * ({p}bx - {q}ax)) < 0"


@query(f"""WITH {SEGMENTS} SELECT DISTINCT a.seg AS a, b.seg AS b FROM s a JOIN s b ON a.fixture = b.fixture AND a.seg < b.seg WHERE {CROSS.replace('{p}', 'a.').replace('{q}', 'b.')} AND {CROSS.replace('{p}', 'b.').replace('{q}', 'a.')}""")
def segment_crossings(spark: SparkSession, d: str) -> DataFrame:
    """Straight signal lines of one drawing that properly cross."""
    at = lambda i, j: F.element_at(F.element_at("polyline_global", i), j)
    s = table(spark, d, "graph_edges").filter("size(polyline_global) = 2 and line_type = 'signal_electric' and edge_id is not null and fixture is not null")
    s = s.select("fixture", F.col("edge_id").alias("seg"), at(1, 1).alias("ax"), at(1, 2).alias("ay"), at(2, 1).alias("bx"), at(2, 2).alias("by")).distinct()
    return spatial.crossings(s, ["fixture"], 1000).select("a", "b").distinct()


@query("""SELECT fixture, page_index, min(bbox_global.x) AS x0, min(bbox_global.y) AS y0, max(bbox_global.x + bbox_global.w) AS x1, max(bbox_global.y + bbox_global.h) AS y1, count(*) AS n FROM graph_nodes WHERE bbox_global IS NOT NULL GROUP BY ALL""")
def page_envelope(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("bbox_global")
    return table(spark, d, "graph_nodes").filter("bbox_global is not null").groupBy(*PAGE).agg(
        F.min(b["x"]).alias("x0"), F.min(b["y"]).alias("y0"), F.max(G.right(b)).alias("x1"), F.max(G.bottom(b)).alias("y1"), F.count(F.lit(1)).alias("n")
    )


@query("""WITH p AS (SELECT fixture, page_index, min(bbox_global.x) AS x0, min(bbox_global.y) AS y0, max(bbox_global.x + bbox_global.w) AS x1, max(bbox_global.y + bbox_global.h) AS y1 FROM graph_nodes WHERE bbox_global IS NOT NULL GROUP BY ALL),
z AS (SELECT n.fixture, n.page_index, substr('ABCD', 1 + CAST(least(3, greatest(0, floor((bbox_global.y + bbox_global.h / 2.0 - y0) * 4 / greatest(y1 - y0, 1)))) AS INT), 1) || CAST(1 + CAST(least(3, greatest(0, floor((bbox_global.x + bbox_global.w / 2.0 - x0) * 4 / greatest(x1 - x0, 1)))) AS INT) AS VARCHAR) AS zone
  FROM graph_nodes n JOIN p ON n.fixture = p.fixture AND n.page_index = p.page_index WHERE bbox_global IS NOT NULL)
SELECT fixture, page_index, zone, count(*) AS n FROM z GROUP BY ALL""")
def page_zones(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "graph_nodes").filter("bbox_global is not null")
    b = F.col("bbox_global")
    zone = G.page_zone(G.centre_x(b), G.centre_y(b), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return n.join(page_envelope(spark, d).drop("n"), PAGE).groupBy(*PAGE, zone.alias("zone")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT fixture, page_index, max(bbox_global.x + bbox_global.w) AS w, max(bbox_global.y + bbox_global.h) AS h FROM graph_nodes WHERE bbox_global IS NOT NULL AND fixture IS NOT NULL AND page_index IS NOT NULL GROUP BY ALL),
x AS (SELECT *, unnest(range(CAST(greatest(1, ceil((w - 200) / 1800.0)) AS BIGINT))) AS c FROM p), y AS (SELECT *, unnest(range(CAST(greatest(1, ceil((h - 200) / 1800.0)) AS BIGINT))) AS r FROM x)
SELECT fixture, 'p' || page_index || '-r' || r || '-c' || c AS tile_id, CAST(least(c * 1800, greatest(w - 2000, 0)) AS INT) AS x, CAST(least(r * 1800, greatest(h - 2000, 0)) AS INT) AS y, CAST(least(2000, w) AS INT) AS w, CAST(least(2000, h) AS INT) AS h FROM y""")
def tile_generator(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping tiles of 2000 pixels, a tenth shared, the last ones moved back onto the page."""
    p = page_envelope(spark, d).filter("fixture is not null and page_index is not null").select(*PAGE, F.col("x1").alias("pw"), F.col("y1").alias("ph"))
    steps = lambda v: F.sequence(F.lit(0), (F.greatest(F.lit(1), F.ceil((v - 200) / 1800)) - 1).cast("int"))
    t = p.withColumn("c", F.explode(steps(F.col("pw")))).withColumn("r", F.explode(steps(F.col("ph"))))
    at = lambda i, v: F.least(F.col(i) * 1800, F.greatest(F.col(v) - 2000, F.lit(0))).cast("int")
    name = F.concat(F.lit("p"), F.col("page_index").cast("string"), F.lit("-r"), F.col("r").cast("string"), F.lit("-c"), F.col("c").cast("string"))
    return t.select("fixture", name.alias("tile_id"), at("c", "pw").alias("x"), at("r", "ph").alias("y"), F.least(F.lit(2000), F.col("pw")).cast("int").alias("w"), F.least(F.lit(2000), F.col("ph")).cast("int").alias("h"))


@query(f"""WITH {NODES}, v AS (SELECT fixture, page_index, greatest(bbox_global.w, bbox_global.h) AS m FROM n WHERE kind IN ('equipment', 'instrument', 'opc') AND bbox_global IS NOT NULL),
u AS (SELECT fixture, page_index, list_sort(list(m))[CAST(floor(count(m) / 2) AS INT) + 1] AS m FROM v GROUP BY ALL)
SELECT fixture, page_index, CAST(greatest(30, round_even(m * 1.5, 0)) AS INT) AS snap, CAST(greatest(30, round_even(m * 3.0, 0)) AS INT) AS loose FROM u""")
def snap_radius(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).filter("kind in ('equipment', 'instrument', 'opc') and bbox_global is not null").withColumn("m", F.greatest("bbox_global.w", "bbox_global.h"))
    u = n.groupBy(*PAGE).agg(metrics.upper_median("m").alias("m"))
    size = lambda k: F.greatest(F.lit(30), F.bround(F.col("m") * k)).cast("int")
    return u.select(*PAGE, size(1.5).alias("snap"), size(3.0).alias("loose"))


@query(f"""WITH {NODES}, e AS (SELECT DISTINCT fixture, edge_id, polyline_global AS p FROM graph_edges WHERE len(polyline_global) >= 2 AND edge_id IS NOT NULL AND fixture IS NOT NULL),
s AS (SELECT fixture, edge_id || '@' || p[1][1] || '@' || p[1][2] AS edge, unnest([{{'side': 'from', 'x': p[1][1], 'y': p[1][2]}}, {{'side': 'to', 'x': p[-1][1], 'y': p[-1][2]}}]) AS q FROM e),
d AS (SELECT DISTINCT fixture, edge, q.side AS side, q.x AS x, q.y AS y FROM s),
m AS (SELECT d.fixture, d.edge, d.side, n.node_id, sqrt(pow(greatest(0, bbox_global.x - x, x - bbox_global.x - bbox_global.w), 2) + pow(greatest(0, bbox_global.y - y, y - bbox_global.y - bbox_global.h), 2)) AS gap FROM d JOIN n ON n.fixture = d.fixture WHERE bbox_global IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY fixture, edge, side ORDER BY gap, node_id) AS k FROM m WHERE gap <= 90),
v AS (SELECT fixture, edge, max(node_id) FILTER (side = 'from' AND gap <= 30) AS ft, max(node_id) FILTER (side = 'to' AND gap <= 30) AS tt, max(node_id) FILTER (side = 'from') AS fl, max(node_id) FILTER (side = 'to') AS tl FROM r WHERE k = 1 GROUP BY ALL)
SELECT u.fixture, u.edge, CASE WHEN (ft IS NULL) <> (tt IS NULL) THEN coalesce(ft, fl) ELSE ft END AS from_node, CASE WHEN (ft IS NULL) <> (tt IS NULL) THEN coalesce(tt, tl) ELSE tt END AS to_node,
  ((ft IS NULL) <> (tt IS NULL)) AND fl IS NOT NULL AND tl IS NOT NULL AS loosened FROM (SELECT DISTINCT fixture, edge FROM d) u LEFT JOIN v ON v.fixture = u.fixture AND v.edge = u.edge""")
def loose_snap(spark: SparkSession, d: str) -> DataFrame:
    """Ends of two-point lines snapped to the drawing's nodes: within 30 pixels, and within 90 for the other end if exactly one end snapped."""
    at = lambda i, j: F.element_at(F.element_at("polyline_global", i), j)
    e = table(spark, d, "graph_edges").filter("size(polyline_global) >= 2 and edge_id is not null and fixture is not null").select("fixture", "edge_id", "polyline_global").distinct()
    spot = lambda i: F.struct(at(i, 1).alias("x"), at(i, 2).alias("y"), F.lit(0).alias("w"), F.lit(0).alias("h"))
    ends = e.select("fixture", F.concat_ws("@", "edge_id", at(1, 1).cast("string"), at(1, 2).cast("string")).alias("edge"), F.inline(F.array(F.struct(F.lit("from").alias("side"), spot(1).alias("l_box")), F.struct(F.lit("to").alias("side"), spot(-1).alias("l_box")))))
    n = nodes(spark, d).filter("bbox_global is not null and fixture is not null").select("fixture", F.col("node_id").alias("r_id"), F.col("bbox_global").alias("r_box"))
    return spatial.snapped(ends.distinct(), n, ["fixture"], CELL, 30, 90)


# --- pairing ----------------------------------------------------------------


@query(f"""WITH {NODES}, o AS (SELECT fixture, node_id, page_index, regexp_extract(upper(label), '^OPC-(IN|OUT)-', 1) AS dir, regexp_extract(label, '([0-9]+)$', 1) AS ref FROM n WHERE kind = 'opc' AND label IS NOT NULL),
p AS (SELECT a.fixture, a.node_id AS source, b.node_id AS target, count(*) OVER (PARTITION BY a.node_id) AS na, count(*) OVER (PARTITION BY b.node_id) AS nb FROM o a JOIN o b ON a.fixture = b.fixture AND a.ref = b.ref AND a.dir = 'OUT' AND b.dir = 'IN' WHERE a.ref <> '')
SELECT fixture, source, target, CASE WHEN na = 1 AND nb = 1 THEN 'paired' ELSE 'ambiguous' END AS status FROM p""")
def unique_pairing(spark: SparkSession, d: str) -> DataFrame:
    """Outgoing and incoming connectors of one drawing with one number; paired where it is the only one on both sides."""
    o = nodes(spark, d).filter("kind = 'opc' and label is not null and fixture is not null").select("fixture", "node_id", F.regexp_extract(F.upper("label"), "^OPC-(IN|OUT)-", 1).alias("dir"), F.regexp_extract("label", "([0-9]+)$", 1).alias("ref")).filter("ref <> ''")
    a = o.filter("dir = 'OUT'").select("fixture", "ref", F.col("node_id").alias("source"))
    b = o.filter("dir = 'IN'").select("fixture", "ref", F.col("node_id").alias("target"))
    n = lambda c: F.count(F.lit(1)).over(W.partitionBy(c))
    p = a.join(b, ["fixture", "ref"]).withColumn("na", n("source")).withColumn("nb", n("target"))
    return p.select("fixture", "source", "target", F.when((F.col("na") == 1) & (F.col("nb") == 1), "paired").otherwise("ambiguous").alias("status"))


@query(f"""WITH {EDGES} SELECT DISTINCT least(a.from_node, a.to_node) AS low_node, greatest(a.from_node, a.to_node) AS high_node FROM e a JOIN e b ON a.from_node = b.to_node AND a.to_node = b.from_node WHERE a.from_node <> a.to_node""")
def reciprocal_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of nodes with an edge each way."""
    e = edges(spark, d).filter("from_node <> to_node").select("from_node", "to_node").distinct()
    back = e.select(F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node"))
    return e.join(back, ["from_node", "to_node"], "left_semi").select(F.least("from_node", "to_node").alias("low_node"), F.greatest("from_node", "to_node").alias("high_node")).distinct()


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return materialise(spatial.within(_side(n.filter("kind = 'instrument'"), "l"), _side(n.filter("kind = 'equipment'"), "r"), PAGE, CELL, 60).select(*PAGE, "l_id", "r_id", "gap"), "candidates")


@query(f"""WITH RECURSIVE {NODES}, c0 AS (SELECT a.node_id AS l, b.node_id AS r, round({GAP}, 6) AS g FROM n a JOIN n b ON a.fixture = b.fixture AND a.page_index = b.page_index WHERE a.kind = 'instrument' AND b.kind = 'equipment' AND {GAP} <= 60),
c(l, r, g, pl, pr) AS (SELECT l, r, g, row_number() OVER (PARTITION BY l ORDER BY g, l, r), row_number() OVER (PARTITION BY r ORDER BY g, l, r) FROM c0
  UNION ALL SELECT l, r, g, row_number() OVER (PARTITION BY l ORDER BY g, l, r), row_number() OVER (PARTITION BY r ORDER BY g, l, r)
  FROM (SELECT *, bool_or(pl = 1 AND pr = 1) OVER (PARTITION BY l) AS hl, bool_or(pl = 1 AND pr = 1) OVER (PARTITION BY r) AS hr FROM c) WHERE NOT hl AND NOT hr)
SELECT l AS instrument, r AS equipment FROM c WHERE pl = 1 AND pr = 1""")
def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one pairs of instruments and equipment, nearest first, per connected part of the candidates."""
    parts = matching.part_of(_candidates(spark, d), PAGE).withColumn("g", F.round("gap", 6))
    return matching.per_group(parts, ["part"], ["g", "l_id", "r_id"], lambda rows: [(p, a, b) for (a, b) in matching.greedy_pairs([(r[2], r[3]) for r in rows]) for p in (rows[0][0],)], ["part", "g", "l_id", "r_id"], "part string, instrument string, equipment string").select("instrument", "equipment")


@query()
def max_cardinality(spark: SparkSession, d: str) -> DataFrame:
    """As many one-to-one pairs as there can be, per connected part; how many each part has."""
    parts = matching.part_of(_candidates(spark, d), PAGE)
    return matching.per_group(parts, ["part"], ["l_id", "r_id"], lambda rows: [(rows[0][0], len(matching.most_pairs([(r[1], r[2]) for r in rows])))], ["part", "l_id", "r_id"], "part string, pairs int")


@query()
def max_weight(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one pairs of greatest total closeness, per connected part."""
    parts = matching.part_of(_candidates(spark, d), PAGE).withColumn("w", F.round(61 - F.col("gap"), 6))
    fold = lambda rows: [(a, b, w) for a, b, w in matching.heaviest_pairs([(r[1], r[2], r[3]) for r in rows])]
    return matching.per_group(parts, ["part"], ["l_id", "r_id"], fold, ["part", "l_id", "r_id", "w"], "instrument string, equipment string, closeness double")


@query(f"""WITH RECURSIVE {NODES}, p AS (SELECT a.node_id AS b, b.node_id AS w FROM n a JOIN n b ON a.fixture = b.fixture AND a.page_index = b.page_index AND a.kind = b.kind AND a.node_id <> b.node_id WHERE {IOU} >= 0.5 AND (CASE a.confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END > CASE b.confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END OR (CASE a.confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END = CASE b.confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AND a.node_id < b.node_id))),
c(b, w, free) AS (SELECT b, w, b NOT IN (SELECT w FROM p) FROM p
  UNION ALL SELECT b, w, b NOT IN (SELECT y.w FROM c y WHERE y.w NOT IN (SELECT z.w FROM c z WHERE z.free) AND y.b NOT IN (SELECT z.w FROM c z WHERE z.free) AND NOT y.free)
  FROM c WHERE NOT free AND w NOT IN (SELECT z.w FROM c z WHERE z.free) AND b NOT IN (SELECT z.w FROM c z WHERE z.free)),
gone AS (SELECT DISTINCT w FROM c WHERE free)
SELECT node_id, node_id NOT IN (SELECT w FROM gone) AS kept FROM n WHERE bbox_global IS NOT NULL AND fixture IS NOT NULL AND page_index IS NOT NULL""")
def suppress_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Greedy suppression of nodes of one page and kind that overlap by half or more a better one (by confidence, then id)."""
    n = nodes(spark, d).withColumn("rank", G.confidence_rank(F.col("confidence")))
    side = lambda p: _side(n, p, "kind", "rank")
    pairs = spatial.overlaps(side("l"), side("r"), PAGE, CELL, 0.5).filter("l_kind = r_kind and l_id <> r_id and (l_rank > r_rank or (l_rank = r_rank and l_id < r_id))")
    boxes = n.filter("bbox_global is not null and fixture is not null and page_index is not null").select(*PAGE, F.col("node_id").alias("id"))
    return matching.kept_of_pairs(boxes, pairs.select(*PAGE, F.col("l_id").alias("better"), F.col("r_id").alias("worse")), PAGE).select(F.col("id").alias("node_id"), "kept")


# --- ordered ----------------------------------------------------------------


@query("""WITH o AS (SELECT user_id, event_id, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600000000 AS f FROM events),
r AS (SELECT *, sum(CASE WHEN f IS NULL OR f THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS n, min(t) AS first, max(t) AS last FROM r GROUP BY user_id, run""")
def gaps_and_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a user's events with no hour between."""
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    ran = sequence.runs(e, ["user_id"], F.col("t"), F.col("t"), ["t", "event_id"], 3_600_000_000)
    return ran.groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


@query("""WITH o AS (SELECT event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT a || '>' || b || '>' || c AS gram, count(*) AS n FROM o WHERE c IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL GROUP BY gram""")
def ngram_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("event_type is not null")
    return sequence.neighbours(e, ["user_id"], ["ts", "event_id"], "event_type", 3).groupBy(F.array_join("window", ">").alias("gram")).agg(F.count(F.lit(1)).alias("n"))


ROUND10 = "[CAST(round_even(v / 10.0, 0) * 10 AS INT) FOR v IN polyline_global[{i}]]"


@query(f"""WITH x AS (SELECT DISTINCT edge_id, from_node, to_node, coalesce(line_type, 'other') AS kind, len(polyline_global) AS points, CASE WHEN len(polyline_global) > 0 THEN list_sort([{ROUND10.replace('{i}', '1')}, {ROUND10.replace('{i}', '-1')}]) END AS ends
  FROM graph_edges WHERE coalesce(from_node, '') <> '' AND coalesce(to_node, '') <> '' AND edge_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY least(from_node, to_node), greatest(from_node, to_node), kind, ends ORDER BY points NULLS FIRST, edge_id) AS p FROM x)
SELECT least(from_node, to_node) AS low_node, greatest(from_node, to_node) AS high_node, kind, edge_id, CAST(points AS INT) AS points FROM r WHERE p = 1""")
def priority_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Undirected edges once per ends, type and rounded line ends, the one of fewest points."""
    e = table(spark, d, "graph_edges").filter("coalesce(from_node, '') <> '' and coalesce(to_node, '') <> '' and edge_id is not null")
    k = sequence.edge_keys(e).withColumn("points", F.when(F.col("polyline_global").isNotNull(), F.size("polyline_global"))).select("edge_id", "low_node", "high_node", "kind", "ends", "points").distinct()
    return sequence.newest(k, ["low_node", "high_node", "kind", "ends"], [F.asc_nulls_first("points"), "edge_id"]).select("low_node", "high_node", "kind", "edge_id", "points")


@query("""WITH g AS (SELECT l_suppkey, l_partkey, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS p, q - lead(q) OVER w AS margin FROM g WINDOW w AS (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey)) SELECT l_suppkey, l_partkey, q, margin FROM r WHERE p = 1""")
def best_runner_up(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").cast("double").alias("q"))
    return sequence.margins(g, ["l_suppkey"], "q", ["l_partkey"]).select("l_suppkey", "l_partkey", "q", "margin")


# --- graphs -----------------------------------------------------------------


@query(f"""WITH RECURSIVE {EDGES}, b AS (SELECT from_node AS s, to_node AS t FROM e WHERE from_node <> to_node UNION SELECT to_node, from_node FROM e WHERE from_node <> to_node), c(node, low) AS (SELECT s, s FROM b UNION SELECT b.t, c.low FROM c JOIN b ON b.s = c.node WHERE c.low < b.t)
SELECT node, min(low) AS component FROM c GROUP BY node""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(edges(spark, d))


@query(f"""WITH RECURSIVE {EDGES}, {NODES}, b AS (SELECT from_node AS s, to_node AS t FROM e UNION SELECT to_node, from_node FROM e), r(node) AS (SELECT node_id FROM n WHERE kind = 'opc' UNION SELECT b.t FROM r JOIN b ON b.s = r.node)
SELECT node FROM r""")
def reachability(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that some off-page connector reaches over any line, connectors included."""
    sources = nodes(spark, d).filter("kind = 'opc'").select(F.lit("opc").alias("source"), F.col("node_id").alias("node"))
    return graph.reachable(edges(spark, d), sources).select("node")


@query(f"""WITH RECURSIVE {EDGES}, b AS (SELECT from_node AS s, to_node AS t FROM e WHERE from_node <> to_node UNION SELECT to_node, from_node FROM e WHERE from_node <> to_node),
c(round, s, t, ds, dt, whole) AS (SELECT 0, s, t, count(*) OVER (PARTITION BY s), count(*) OVER (PARTITION BY t), false FROM b
  UNION ALL SELECT round + 1, s, t, count(*) OVER (PARTITION BY s), count(*) OVER (PARTITION BY t), false FROM (SELECT *, bool_and(ds >= 2 AND dt >= 2) OVER () AS stable FROM c) WHERE ds >= 2 AND dt >= 2 AND NOT stable)
SELECT s AS node, count(*) AS degree FROM c WHERE round = (SELECT max(round) FROM c) AND ds >= 2 AND dt >= 2 GROUP BY s""")
def k_core(spark: SparkSession, d: str) -> DataFrame:
    return graph.k_core(edges(spark, d), 2)


@query(f"""WITH {EDGES}, b AS (SELECT from_node AS node, to_node AS o, NULL AS i FROM e UNION ALL SELECT to_node, NULL, from_node FROM e)
SELECT node, count(DISTINCT o) AS n_out, count(DISTINCT i) AS n_in, coalesce(min(o), '') AS first_out, coalesce(min(i), '') AS first_in FROM b GROUP BY node""")
def adjacency_listing(spark: SparkSession, d: str) -> DataFrame:
    a = graph.adjacency(edges(spark, d))
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    return a.select("node", F.size("outgoing").cast("bigint").alias("n_out"), F.size("incoming").cast("bigint").alias("n_in"), first("outgoing").alias("first_out"), first("incoming").alias("first_in"))


@query(f"""WITH RECURSIVE {EDGES}, {NODES}, k AS (SELECT from_node AS s, to_node AS t, CASE WHEN line_type = 'process' THEN 1.0 ELSE 2.0 END::DOUBLE AS w FROM e), q AS (SELECT s, t, min(w) AS w FROM (SELECT * FROM k UNION ALL SELECT t, s, w FROM k) GROUP BY ALL),
stop AS (SELECT node_id FROM n WHERE kind <> 'opc' AND label IS NULL),
r(node, distance) USING KEY (node) AS (SELECT DISTINCT node_id, 0.0::DOUBLE FROM n WHERE kind = 'opc'
  UNION SELECT f.node, f.d FROM (SELECT q.t AS node, min(r.distance + q.w) AS d FROM r JOIN q ON q.s = r.node WHERE r.node NOT IN (SELECT node_id FROM stop) OR r.distance = 0 GROUP BY q.t) f LEFT JOIN recurring.r o ON o.node = f.node WHERE o.node IS NULL OR f.d < o.distance)
SELECT node, distance FROM r""")
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """Least cost from any off-page connector; a process line costs 1, another 2; unlabelled nodes are reached, not passed."""
    e = edges(spark, d).withColumn("w", F.when(F.col("line_type") == "process", 1.0).otherwise(2.0))
    n = nodes(spark, d)
    sources = n.filter("kind = 'opc'").select(F.lit("opc").alias("source"), F.col("node_id").alias("node"))
    stops = n.filter("kind <> 'opc' and label is null").select(F.col("node_id").alias("node"))
    return graph.shortest_distances(e, sources, "w", stops).select("node", "distance")


@query(f"""WITH RECURSIVE {EDGES}, b AS (SELECT DISTINCT from_node AS s, to_node AS t FROM e WHERE from_node <> to_node),
c(round, s, t, fed) AS (SELECT 0, s, t, s IN (SELECT t FROM b) FROM b
  UNION ALL SELECT round + 1, s, t, s IN (SELECT t FROM c WHERE fed) FROM (SELECT *, bool_and(fed) OVER () AS stable FROM c) WHERE fed AND NOT stable),
m AS (SELECT max(round) AS last FROM c), o AS (SELECT DISTINCT t FROM c, m WHERE round = last AND fed)
SELECT node, CASE WHEN node IN (SELECT t FROM o) THEN NULL ELSE CAST(coalesce((SELECT max(round) + 1 FROM c WHERE t = node), 0) AS INT) END AS level
FROM (SELECT s AS node FROM b UNION SELECT t FROM b)""")
def topological_order(spark: SparkSession, d: str) -> DataFrame:
    """Level of each node in the direction of flow; null on cycles."""
    return graph.topological_levels(edges(spark, d).filter("from_node <> to_node"))


# --- ranking ----------------------------------------------------------------

TERMS = ["relief", "valve", "spent", "acid", "manifold"]


@query("""WITH e AS (SELECT doc_id, regexp_extract_all(lower(coalesce(doc_kind, '')), '([a-z0-9]+)', 1) AS h, [lower(source)] AS t, regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9]+)', 1) AS b FROM documents),
q AS (SELECT unnest(['relief', 'valve', 'spent', 'acid', 'manifold']) AS term),
w AS (SELECT doc_id, term, CASE WHEN list_contains(h, term) THEN 4.0 WHEN list_contains(t, term) THEN 2.0 WHEN list_contains(b, term) THEN 1.0 / (1.0 + len(b) / 120.0) ELSE 0.0 END AS w FROM e, q),
f AS (SELECT term, count(*) AS df FROM w WHERE w > 0 GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (SELECT count(*) FROM documents) / (1 + df)::DOUBLE) * w), 6) AS score FROM w JOIN f USING (term) WHERE w > 0 GROUP BY doc_id""")
def ranked_retrieval(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("tags", F.array("source"))
    return ranking.retrieve(docs, TERMS, "doc_id", "doc_kind", "tags", "text").select("doc_id", F.round("score", 6).alias("score"))


@query("""WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE lang IS NOT NULL) SELECT lang, doc_id, CAST(rank AS INT) AS rank FROM r ORDER BY rank, lang LIMIT 24""")
def round_robin_topk(spark: SparkSession, d: str) -> DataFrame:
    """The longest document of each language, then the second of each, up to 24: a top-k report."""
    docs = table(spark, d, "documents").filter("lang is not null").select("lang", "doc_id", "n_chars")
    return ranking.round_robin(docs, ["lang"], [F.desc("n_chars"), "doc_id"], 24).select("lang", "doc_id", "rank")


@query("""WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY created_at NULLS FIRST, doc_id, n_chars) AS k FROM documents WHERE n_chars BETWEEN 0 AND 40000),
c(source, k, used, admitted) AS (SELECT source, k, n_chars, [doc_id] FROM o WHERE k = 1
  UNION ALL SELECT o.source, o.k, CASE WHEN len(admitted) < 8 AND used + n_chars <= 40000 THEN used + n_chars ELSE used END, CASE WHEN len(admitted) < 8 AND used + n_chars <= 40000 THEN list_append(admitted, doc_id) ELSE admitted END
  FROM c JOIN o ON o.source IS NOT DISTINCT FROM c.source AND o.k = c.k + 1)
SELECT source, array_to_string(arg_max(admitted, k), ',') AS admitted, CAST(max(used) AS BIGINT) AS used FROM c GROUP BY source""")
def budget_admission(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source by date under 40 000 characters and eight documents; what doesn't fit is skipped."""
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars", "created_at")
    held = ranking.admitted(docs, ["source"], [F.col("created_at"), F.col("doc_id"), F.col("n_chars")], "doc_id", "n_chars", 40_000, 8)
    return held.select("source", F.array_join(F.transform("admitted", lambda k: k.cast("string")), ",").alias("admitted"), "used")


HASH100 = "CAST(('0x' || substr(sha256({c}), 1, 8)) AS BIGINT) % 100"


@query(f"""WITH g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS lead FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, lead, {HASH100.replace('{c}', 'CAST(lead AS VARCHAR)')} AS b FROM g)
SELECT doc_id, lead, CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'validation' ELSE 'test' END AS split FROM b""")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    """70/15/15 split by the least key of each group of equal texts, so that copies never part. Texts are grouped by their digest."""
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    lead = t.groupBy("digest").agg(F.min("doc_id").alias("lead"))
    return t.join(lead, "digest").select("doc_id", "lead", H.split_name(F.col("lead").cast("string")).alias("split"))


@query(f"SELECT DISTINCT node_id FROM graph_nodes WHERE node_id IS NOT NULL AND {HASH100.replace('{c}', 'node_id')} < 10")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """A reproducible tenth of the nodes: a sampling operator."""
    return table(spark, d, "graph_nodes").filter("node_id is not null").filter(H.hash_bucket(F.col("node_id"), 100) < 10).select("node_id").distinct()


@query("""SELECT DISTINCT edge_id, 'edge-' || substr(sha256(least(from_node, to_node) || chr(31) || greatest(from_node, to_node) || chr(31) || coalesce(line_type, '')), 1, 16) AS stable FROM graph_edges WHERE coalesce(from_node, '') <> '' AND coalesce(to_node, '') <> ''""")
def stable_edge_ids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "graph_edges").filter("coalesce(from_node, '') <> '' and coalesce(to_node, '') <> ''")
    return e.select("edge_id", H.stable_id("edge", F.least("from_node", "to_node"), F.greatest("from_node", "to_node"), F.col("line_type")).alias("stable")).distinct()


# --- quality ----------------------------------------------------------------


@query("""SELECT key, CAST(n AS BIGINT) AS n FROM (SELECT trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t, min(doc_id) AS key, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY t) WHERE n > 1""")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2(X.squeeze(F.col("text")), 256).alias("t"))
    return t.groupBy("t").agg(F.min("doc_id").alias("key"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "n")


@query(f"""WITH {NODES} SELECT fixture, kind, {label_key('label')} AS label_key, count(*) AS n, min(node_id) AS first_node FROM n WHERE label IS NOT NULL AND {label_key('label')} <> '' GROUP BY ALL HAVING count(*) > 1""")
def duplicate_tags(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).filter("label is not null").withColumn("label_key", X.label_key(F.col("label"))).filter("label_key <> ''")
    return n.groupBy("fixture", "kind", "label_key").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("first_node")).filter("n > 1")


@query("""SELECT rule, path, severity, count(*) AS n FROM (
  SELECT 'node_id_unique' AS rule, node_id AS path, 'error' AS severity FROM graph_nodes GROUP BY node_id HAVING count(*) > 1
  UNION ALL SELECT 'from_node_known', edge_id, 'error' FROM graph_edges e WHERE from_node IS NOT NULL AND NOT EXISTS (SELECT 1 FROM graph_nodes n WHERE n.node_id = e.from_node)
  UNION ALL SELECT 'to_node_known', edge_id, 'error' FROM graph_edges e WHERE to_node IS NOT NULL AND NOT EXISTS (SELECT 1 FROM graph_nodes n WHERE n.node_id = e.to_node)
  UNION ALL SELECT 'from_node_given', edge_id, 'error' FROM graph_edges WHERE from_node IS NULL OR trim(from_node) = ''
  UNION ALL SELECT 'label_given', node_id, 'warning' FROM graph_nodes WHERE label IS NULL OR trim(label) = ''
  UNION ALL SELECT 'confidence_known', node_id, 'error' FROM graph_nodes WHERE confidence IS NOT NULL AND confidence NOT IN ('low', 'medium', 'high')
  UNION ALL SELECT 'label_form', node_id, 'error' FROM graph_nodes WHERE label IS NOT NULL AND NOT regexp_matches(label, '^[A-Z]{1,3}(-[A-Z]+)?-[0-9]+[A-Z]?$')
  UNION ALL SELECT 'confidence_range', node_id, 'error' FROM graph_nodes WHERE system_confidence IS NOT NULL AND (system_confidence < 0 OR system_confidence > 1)) GROUP BY ALL""")
def rule_pack(spark: SparkSession, d: str) -> DataFrame:
    n, e = table(spark, d, "graph_nodes"), table(spark, d, "graph_edges")
    node, edge, q = F.col("node_id"), F.col("edge_id"), quality
    conf = F.col("system_confidence")
    issues = q.pack(
        q.unique(n.filter("node_id is not null"), ["node_id"], "node_id_unique"),
        q.foreign_key(e, "from_node", n, "node_id", edge, "from_node_known"),
        q.foreign_key(e, "to_node", n, "node_id", edge, "to_node_known"),
        q.required(e, F.col("from_node"), edge, "from_node_given"),
        q.required(n, F.col("label"), node, "label_given", "warning"),
        q.one_of(n, F.col("confidence"), ["low", "medium", "high"], node, "confidence_known"),
        q.matches(n, F.col("label"), "^[A-Z]{1,3}(-[A-Z]+)?-[0-9]+[A-Z]?$", node, "label_form"),
        q.issue(n.filter((conf < 0) | (conf > 1)), "confidence_range", node),
    )
    return issues.groupBy("rule", "path", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH k AS (SELECT {label_key('label')} AS key, fixture FROM graph_nodes WHERE label IS NOT NULL) SELECT key, count(DISTINCT fixture) AS kinds FROM k GROUP BY key HAVING count(DISTINCT fixture) > 1""")
def definition_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Labels that more than one drawing defines."""
    n = table(spark, d, "graph_nodes").filter("label is not null")
    return quality.conflicts(n, X.label_key(F.col("label")), F.col("fixture"))


@query("""SELECT label, 'missing' AS side FROM (SELECT label FROM graph_nodes WHERE label IS NOT NULL EXCEPT SELECT label FROM annotations) UNION ALL SELECT label, 'undeclared' FROM (SELECT label FROM annotations WHERE label IS NOT NULL EXCEPT SELECT label FROM graph_nodes)""")
def manifest_difference(spark: SparkSession, d: str) -> DataFrame:
    """Labels of nodes without an annotation, and of annotations without a node."""
    return quality.difference(table(spark, d, "graph_nodes").filter("label is not null"), table(spark, d, "annotations").filter("label is not null"), "label")


@query(f"""WITH {NODES}, {EDGES}, t AS (SELECT DISTINCT from_node AS k FROM e UNION SELECT to_node FROM e)
SELECT n.fixture, count(*) AS nodes, count(*) FILTER (label IS NULL OR trim(label) = '') AS unlabelled, count(*) FILTER (t.k IS NULL) AS isolated, round(count(*) FILTER (t.k IS NULL) / count(*)::DOUBLE, 6) AS isolated_share,
  CASE WHEN count(*) FILTER (t.k IS NULL) / count(*)::DOUBLE > 0.2 THEN 'warn' ELSE 'ok' END AS verdict FROM n LEFT JOIN t ON t.k = n.node_id GROUP BY n.fixture""")
def graph_quality(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    touched = e.select(F.explode(F.array("from_node", "to_node")).alias("node_id")).distinct().withColumn("touched", F.lit(True))
    blank = F.col("label").isNull() | (F.trim("label") == "")
    g = nodes(spark, d).join(touched, "node_id", "left").groupBy("fixture").agg(F.count(F.lit(1)).alias("nodes"), F.count(F.when(blank, 1)).alias("unlabelled"), F.count(F.when(F.col("touched").isNull(), 1)).alias("isolated"))
    share = F.col("isolated") / F.col("nodes")
    return g.withColumn("isolated_share", F.round(share, 6)).withColumn("verdict", F.when(share > 0.2, "warn").otherwise("ok"))


@query("""SELECT kind, coalesce(confidence, 'none') AS confidence, count(*) AS n, count(*) FILTER (len(source_annotation_ids) = 0) AS unsupported, max(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS rank FROM graph_nodes GROUP BY ALL""")
def summary_tallies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_nodes").groupBy("kind", F.coalesce("confidence", F.lit("none")).alias("confidence")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.size("source_annotation_ids") == 0, 1)).alias("unsupported"), F.max(G.confidence_rank(F.col("confidence"))).alias("rank")
    )


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
