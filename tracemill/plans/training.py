"""Queries p1, p2, p3, p5, p6 and p7 over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.moments import moment_micros
from tracemill.operators import changes, drift, nested, orphans, profile, units
from tracemill.session import materialise, table

MEASURES = ["score", "cost_usd", "wall_clock_s", "input_tokens"]


def _load_profiles(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "results")
    values = profile.unpivot_measures(results, MEASURES)
    return profile.load_profiles(values, results.count() * len(MEASURES))


def p1_profile(spark: SparkSession, d: str) -> DataFrame:
    """Exact profile of each load's measures, with its distance from the rest of its feed."""
    kept = ["feed", "load_id", F.col("stratum").alias("phase"), "column_name", "rows", "nulls", "distinct_values"]
    numbers = ["low", "q1", "median", "q3", "high"]
    return _load_profiles(spark, d).select(*kept, *numbers, F.round("ks", 6).alias("ks"))


P1_PROFILE_SQL = """
WITH v AS (
  SELECT coalesce(feed, '') AS feed, load_id, coalesce(CAST(phase AS VARCHAR), '') AS phase, u.column_name, u.value
  FROM results, LATERAL (VALUES ('score', score), ('cost_usd', cost_usd), ('wall_clock_s', wall_clock_s),
    ('input_tokens', CAST(input_tokens AS DOUBLE))) AS u(column_name, value)
  WHERE load_id IS NOT NULL),
c AS (SELECT feed, phase, column_name, load_id, value, count(*) AS c FROM v GROUP BY ALL),
g AS (SELECT feed, phase, column_name, load_id, CAST(sum(c) AS BIGINT) AS rows,
  CAST(coalesce(sum(c) FILTER (value IS NULL), 0) AS BIGINT) AS nulls FROM c GROUP BY ALL),
r AS (SELECT *, sum(c) OVER (PARTITION BY feed, phase, column_name ORDER BY value RANGE UNBOUNDED PRECEDING) AS ale,
    sum(c) OVER (PARTITION BY feed, phase, column_name, value) AS aeq,
    sum(c) OVER (PARTITION BY feed, phase, column_name, load_id ORDER BY value) AS le,
    sum(c) OVER (PARTITION BY feed, phase, column_name, load_id) AS n,
    sum(c) OVER (PARTITION BY feed, phase, column_name) AS na
  FROM c WHERE value IS NOT NULL),
k AS (SELECT feed, phase, column_name, load_id, count(*) AS distinct_values, min(value) AS low,
    min(value) FILTER (le >= ceil(0.25 * n)) AS q1, min(value) FILTER (le >= ceil(0.5 * n)) AS median,
    min(value) FILTER (le >= ceil(0.75 * n)) AS q3, max(value) AS high,
    round(max(greatest(abs(le / n::DOUBLE - (ale - le) / nullif(na - n, 0)::DOUBLE),
      abs((le - c) / n::DOUBLE - (ale - aeq - le + c) / nullif(na - n, 0)::DOUBLE))), 6) AS ks
  FROM r GROUP BY ALL)
SELECT feed, load_id, phase, column_name, rows, nulls, distinct_values, low, q1, median, q3, high, ks
FROM g LEFT JOIN k USING (feed, phase, column_name, load_id)
"""


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.departing_loads(_load_profiles(spark, d)).select("load_id", "column_name").distinct()


P1_FOUND_SQL = P1_PROFILE_SQL.split("k AS (SELECT")[0] + """
z AS (SELECT *, greatest(abs(le / n::DOUBLE - (ale - le) / nullif(na - n, 0)::DOUBLE), abs((le - c) / n::DOUBLE - (ale - aeq - le + c) / nullif(na - n, 0)::DOUBLE)) AS d,
    (ale - le) / nullif(na - n, 0)::DOUBLE AS rle, (ale - aeq - le + c) / nullif(na - n, 0)::DOUBLE AS rlt FROM r),
k AS (SELECT feed, phase, column_name, load_id, max(d) * sqrt(max(n) * (max(na) - max(n)) / max(na)::DOUBLE) AS ks, coalesce(sum(c) FILTER (rle <= 0.025 OR rlt >= 0.975), 0) AS tail FROM z GROUP BY ALL),
i AS (SELECT feed, phase, column_name, load_id, coalesce(sum(c) FILTER (value = floor(value)), 0) AS whole FROM c GROUP BY ALL),
t AS (SELECT g.*, i.whole, k.ks, coalesce(k.tail, 0) AS tail, rows - nulls AS filled, sum(rows) OVER w - rows AS rr, sum(nulls) OVER w - nulls AS rn, sum(whole) OVER w - whole AS rw
  FROM g JOIN i USING (feed, phase, column_name, load_id) LEFT JOIN k USING (feed, phase, column_name, load_id) WINDOW w AS (PARTITION BY feed, phase, column_name)),
u AS (SELECT load_id, column_name, ks, unnest([{'x': tail, 'n': filled, 'rx': 0.05 * (rr - rn), 'rn': rr - rn}, {'x': nulls, 'n': rows, 'rx': rn, 'rn': rr}, {'x': whole, 'n': filled, 'rx': rw, 'rn': rr - rn}]) AS q FROM t),
y AS (SELECT *, (q.rx + 1) / (q.rn + 2)::DOUBLE AS p FROM u)
SELECT DISTINCT load_id, column_name FROM y WHERE ks > 2.6 OR (q.rn > 0 AND q.n > 0 AND abs(q.x / q.n::DOUBLE - p) > 0.05 AND abs(q.x / q.n::DOUBLE - p) * q.n > 8
  AND abs(q.x / q.n::DOUBLE - p) > 6.5 * sqrt(p * (1 - p) * (1 / q.n::DOUBLE + 1 / q.rn::DOUBLE)))
"""


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return units.common_units(table(spark, d, "graph_nodes"))


def p2_shifts(spark: SparkSession, d: str) -> DataFrame:
    """Unit changes in the histories of values that carry no unit."""
    return units.unit_shifts(units.bare_values(table(spark, d, "graph_nodes")))


def p2_reversed(spark: SparkSession, d: str) -> DataFrame:
    """The values without a unit, those of shifted stretches brought back to the unit of their history."""
    values = materialise(units.bare_values(table(spark, d, "graph_nodes")), "bare-values")
    back = units.reverse_shifts(values, units.unit_shifts(values))
    return back.select("source", "node_id", "field_name", "at", F.round("amount", 6).alias("amount"), F.round("common", 6).alias("common"), "unit")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    profiles = materialise(drift.column_profiles(table(spark, d, "file_records")), "column-profiles")
    return drift.layout_changes(profiles)


def p3_unified(spark: SparkSession, d: str) -> DataFrame:
    """The unified columns of each series: rows and values in them, from how many files, how many were converted in vain."""
    files = table(spark, d, "file_records")
    profiles = materialise(drift.column_profiles(files), "column-profiles")
    changes_ = materialise(drift.layout_changes(profiles), "changes")
    rows = drift.unified(files, drift.unified_paths(profiles, changes_))
    cells = rows.select("file_series", "file_name", "unfit", F.explode("fields").alias("unified_path", "value"))
    return cells.groupBy("file_series", "unified_path").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count("value").alias("filled"),
        F.countDistinct("file_name").alias("files"),
        F.sum(F.array_contains("unfit", F.col("unified_path")).cast("bigint")).alias("unfit"),
    )


def review_changes(actions: DataFrame) -> DataFrame:
    """Review actions as a change feed: is_edge, entity_id, seq, op, from_node, to_node, label."""
    op = F.regexp_replace(F.lower(F.trim("op")), r"[\s\-]+", "_")
    edge = op.startswith("edge_")
    bare = F.regexp_replace(op, "^edge_", "")
    added = bare == "add"
    kind = F.when(added, changes.INSERT).when(bare == "revise", changes.UPDATE).when(bare == "drop", changes.DELETE)
    ends = lambda side: F.when(edge & added, F.col(f"new_edge.{side}")).when(edge, F.col(f"after_edge.{side}"))
    return actions.filter(F.col("op").isNotNull()).select(
        edge.alias("is_edge"),
        F.nullif(F.when(edge & added, F.col("new_edge.id")).when(edge, F.col("edge_id")).otherwise(F.col("node_id")), F.lit("")).alias("entity_id"),
        moment_micros(F.col("ts")).alias("seq"),
        kind.alias("op"),
        ends("from_node").alias("from_node"),
        ends("to_node").alias("to_node"),
        F.when(~edge, F.col("label")).alias("label"),
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    keys, payload = ["is_edge", "entity_id"], ["from_node", "to_node", "label"]
    state = changes.fold_changes(review_changes(table(spark, d, "review_actions")), keys, "seq", "op", payload)
    rows = changes.current_rows(state, keys, payload)
    return rows.select("entity_id", *[F.coalesce(c, F.lit("")).alias(c) for c in payload])


P5_FOUND_SQL = r"""
WITH a AS (
  SELECT replace(replace(lower(trim(op)), '-', '_'), ' ', '_') AS o, trim(ts) AS t, * EXCLUDE (op, ts) FROM review_actions),
b AS (
  SELECT starts_with(o, 'edge_') AS is_edge,
    nullif(CASE WHEN o = 'edge_add' THEN new_edge.id WHEN starts_with(o, 'edge_') THEN edge_id ELSE node_id END, '') AS entity_id,
    CASE WHEN regexp_full_match(t, '[0-9]{13}') THEN CAST(t AS BIGINT) * 1000
      WHEN regexp_full_match(t, '[0-9]{2}\.[0-9]{2}\.[0-9]{4} .*') THEN epoch_us(strptime(t, '%d.%m.%Y %H:%M:%S'))
      WHEN regexp_full_match(t, '.*(Z|[+-][0-9]{2}:[0-9]{2})') THEN epoch_us(CAST(t AS TIMESTAMPTZ))
      ELSE epoch_us(CAST(t AS TIMESTAMP)) END AS seq,
    replace(o, 'edge_', '') AS k,
    CASE WHEN o = 'edge_add' THEN new_edge.from_node WHEN starts_with(o, 'edge_') THEN after_edge.from_node END AS from_node,
    CASE WHEN o = 'edge_add' THEN new_edge.to_node WHEN starts_with(o, 'edge_') THEN after_edge.to_node END AS to_node,
    CASE WHEN NOT starts_with(o, 'edge_') THEN label END AS label
  FROM a),
s AS (
  SELECT is_edge, entity_id, max(seq) FILTER (k = 'add') AS ins, max(seq) FILTER (k = 'drop') AS del,
    arg_max(from_node, seq) FILTER (k IN ('add', 'revise')) AS from_node,
    arg_max(to_node, seq) FILTER (k IN ('add', 'revise')) AS to_node,
    arg_max(label, seq) FILTER (k IN ('add', 'revise')) AS label
  FROM b WHERE entity_id IS NOT NULL GROUP BY ALL)
SELECT entity_id, coalesce(from_node, '') AS from_node, coalesce(to_node, '') AS to_node, coalesce(label, '') AS label
FROM s WHERE ins IS NOT NULL AND (del IS NULL OR ins > del)
"""


# JSON in strings is opened, as deep as it goes; a cell's place is its document's and its own, its parent the cell that holds the string
P6_TREE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT record_id, 'r' AS doc, CAST(NULL AS VARCHAR) AS up, CAST(NULL AS VARCHAR) AS k0, '' AS pre, body FROM (SELECT DISTINCT record_id, body FROM nested_records WHERE json_valid(body))
  UNION ALL
  SELECT d.record_id, d.doc || '/' || j.id, CASE WHEN j.parent IS NULL THEN d.up ELSE d.doc || ':' || j.parent END, CASE WHEN j.parent IS NULL THEN d.k0 ELSE j.key END, d.pre || substr(j.fullkey, 2), json_extract_string(j.value, '$')
  FROM d, LATERAL json_tree(d.body) j
  WHERE j.type = 'VARCHAR' AND regexp_matches(json_extract_string(j.value, '$'), '^\s*[\[{]') AND json_valid(json_extract_string(j.value, '$'))),
t AS (
  SELECT d.record_id, d.doc || ':' || j.id AS i, j.id AS n, CASE WHEN j.parent IS NULL THEN d.up ELSE d.doc || ':' || j.parent END AS p, CASE WHEN j.parent IS NULL THEN d.k0 ELSE j.key END AS k, d.pre || substr(j.fullkey, 2) AS place,
    j.type AS ty, json_extract_string(j.value, '$') AS v
  FROM d, LATERAL json_tree(d.body) j
  WHERE NOT (j.type = 'VARCHAR' AND regexp_matches(json_extract_string(j.value, '$'), '^\s*[\[{]') AND json_valid(json_extract_string(j.value, '$')))),
"""

P6_FOUND_SQL = P6_TREE_SQL + """
o AS (SELECT record_id, p AS i, max(v) FILTER (k = 'id') AS id, bool_or(k = 'id') AS has_id, bool_or(k = 'kind') AS has_kind, bool_or(k = 'op') AS has_op, bool_or(k = 'seq') AS has_seq,
    max(v) FILTER (k = 'seq') AS seq FROM t WHERE k IS NOT NULL GROUP BY record_id, p),
n AS (SELECT record_id, i, id FROM o WHERE has_id AND has_kind AND id IS NOT NULL),
a AS (SELECT record_id, i, seq FROM o WHERE has_op AND has_seq AND seq IS NOT NULL),
s AS (SELECT n.record_id, n.id, c.i, c.ty, c.v FROM n JOIN t c ON c.record_id = n.record_id AND c.p = n.i AND c.k = 'source_annotation_ids'),
e AS (SELECT s.record_id, s.id, c.i, c.ty, c.v FROM s JOIN t c ON c.record_id = s.record_id AND c.p = s.i WHERE s.ty = 'ARRAY'),
b AS (SELECT n.record_id, n.id, c.i, c.ty FROM n JOIN t c ON c.record_id = n.record_id AND c.p = n.i AND c.k = 'bbox_global'),
x AS (SELECT b.record_id, b.id, c.v FROM b JOIN t c ON c.record_id = b.record_id AND c.p = b.i AND c.k = 'x' WHERE b.ty = 'OBJECT'
  UNION ALL SELECT b.record_id, b.id, arg_min(c.v, c.n) FROM b JOIN t c ON c.record_id = b.record_id AND c.p = b.i WHERE b.ty = 'ARRAY' GROUP BY b.record_id, b.id, b.i HAVING count(*) = 4),
g AS (SELECT a.record_id, a.seq, c.i FROM a JOIN t c ON c.record_id = a.record_id AND c.p = a.i AND c.k = 'new_edge'),
h AS (SELECT g.record_id, g.seq, g.i FROM g JOIN t c ON c.record_id = g.record_id AND c.p = g.i AND c.k = 'attributes' JOIN t q ON q.record_id = c.record_id AND q.p = c.i AND q.k = 'gt_added'
  WHERE lower(trim(q.v)) IN ('true', '1', 'yes', 'y', 't')),
l AS (
  SELECT record_id, 'node_annotation' AS link_kind, id AS parent_key, v AS child_key FROM s WHERE ty NOT IN ('ARRAY', 'OBJECT')
  UNION SELECT record_id, 'node_annotation', id, v FROM e WHERE ty NOT IN ('ARRAY', 'OBJECT')
  UNION SELECT e.record_id, 'node_annotation', e.id, c.v FROM e JOIN t c ON c.record_id = e.record_id AND c.p = e.i AND c.k = 'id' WHERE e.ty = 'OBJECT'
  UNION SELECT record_id, 'node_box', id, CAST(CAST(floor(CAST(v AS DOUBLE) + 0.5) AS BIGINT) AS VARCHAR) FROM x WHERE v IS NOT NULL
  UNION SELECT h.record_id, 'added_edge', h.seq, c.v FROM h JOIN t c ON c.record_id = h.record_id AND c.p = h.i AND c.k = 'id'
  UNION SELECT a.record_id, 'revised_from', a.seq, f.v FROM a JOIN t c ON c.record_id = a.record_id AND c.p = a.i AND c.k = 'before' JOIN t f ON f.record_id = c.record_id AND f.p = c.i AND f.k = 'from_node')
SELECT * FROM l WHERE child_key IS NOT NULL AND parent_key IS NOT NULL
"""


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "nested_records")
    return nested.child_links(nested.entity_tables(records, "record_id", "body"), "record_id")


def p6_tables(spark: SparkSession, d: str) -> DataFrame:
    """The flat tables that the records fall into, by repeated ancestor, with their columns and how often each is filled."""
    return nested.table_layouts(nested.record_rows(table(spark, d, "nested_records"), "record_id", "body"), "record_id")


P6_TABLES_SQL = P6_TREE_SQL + r"""
s AS (SELECT record_id, place, regexp_extract(place, '^(.*\])\.', 1) AS row_at FROM t WHERE ty NOT IN ('OBJECT', 'ARRAY', 'NULL') AND v IS NOT NULL AND place <> ''),
c AS (SELECT record_id, row_at, replace(ltrim(regexp_replace(row_at, '\[\d+\]', '[]', 'g'), '.'), '"', '') AS table_path,
    replace(ltrim(regexp_replace(substr(place, length(row_at) + 1), '\[\d+\]', '[]', 'g'), '.'), '"', '') AS column_path FROM s)
SELECT table_path, column_path, contains(column_path, '[]') AS is_list, count(DISTINCT (record_id, row_at)) AS rows, count(DISTINCT record_id) AS records FROM c GROUP BY ALL
"""


def graph_references(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """key ('n:' or 'a:' and the key referred to), at, table_name, row_key, field_name: one row per reference of both tables."""
    ref = lambda name, key: F.struct(F.lit(name).alias("field_name"), key.alias("key"))
    ann = F.transform(F.coalesce("source_annotation_ids", F.array().cast("array<string>")), lambda k: ref("source_annotation_ids", F.concat(F.lit("a:"), F.nullif(k, F.lit("")))))
    node = lambda c: ref(c, F.concat(F.lit("n:"), F.nullif(F.col(c), F.lit(""))))
    at = F.unix_micros("extracted_at").alias("at")
    of_edges = edges.select(at, F.lit("graph_edges").alias("table_name"), F.col("edge_id").alias("row_key"), F.inline(F.concat(F.array(node("from_node"), node("to_node")), ann)))
    of_nodes = nodes.select(at, F.lit("graph_nodes").alias("table_name"), F.col("node_id").alias("row_key"), F.inline(ann))
    return of_edges.unionByName(of_nodes)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes, annotations = (table(spark, d, t) for t in ("graph_edges", "graph_nodes", "annotations"))
    span = lambda t, key, lead: t.select(
        F.concat(F.lit(lead), F.nullif(F.col(key), F.lit(""))).alias("key"), F.unix_micros("extracted_at").alias("begin"), F.unix_micros("dropped_at").alias("end")
    )
    parents = span(nodes, "node_id", "n:").unionByName(span(annotations, "annotation_id", "a:"))
    rows = 4 * edges.count() + 3 * nodes.count() + annotations.count()
    found = orphans.orphan_references(graph_references(edges, nodes), parents, rows)
    month = F.coalesce(F.date_format(F.timestamp_micros("at"), "yyyy-MM"), F.lit(""))
    return found.select(
        "table_name", F.coalesce("row_key", F.lit("")).alias("row_key"), "field_name", F.expr("substr(key, 3)").alias("missing_key"), month.alias("report_month"), "reason"
    ).distinct()


P7_FOUND_SQL = """
WITH refs AS (
  SELECT 'graph_edges' AS table_name, edge_id AS row_key, 'from_node' AS field_name, 'n' AS k, from_node AS key, extracted_at AS t FROM graph_edges
  UNION ALL SELECT 'graph_edges', edge_id, 'to_node', 'n', to_node, extracted_at FROM graph_edges
  UNION ALL SELECT 'graph_edges', edge_id, 'source_annotation_ids', 'a', unnest(source_annotation_ids), extracted_at FROM graph_edges
  UNION ALL SELECT 'graph_nodes', node_id, 'source_annotation_ids', 'a', unnest(source_annotation_ids), extracted_at FROM graph_nodes),
parents AS (
  SELECT 'n' AS k, node_id AS key, extracted_at AS b, dropped_at AS e FROM graph_nodes
  UNION ALL SELECT 'a', annotation_id, extracted_at, dropped_at FROM annotations),
j AS (
  SELECT r.table_name, r.row_key, r.field_name, r.key, r.t, count(p.key) AS n,
    coalesce(bool_or(p.b <= r.t), false) AS begun, coalesce(bool_or(p.b <= r.t AND (p.e IS NULL OR p.e > r.t)), false) AS holds
  FROM (SELECT DISTINCT * FROM refs WHERE key IS NOT NULL AND key <> '') r
  LEFT JOIN parents p ON p.k = r.k AND p.key = r.key GROUP BY r.table_name, r.row_key, r.field_name, r.k, r.key, r.t)
SELECT DISTINCT table_name, coalesce(row_key, '') AS row_key, field_name, key AS missing_key,
  coalesce(strftime(t AT TIME ZONE 'UTC', '%Y-%m'), '') AS report_month,
  CASE WHEN n = 0 THEN 'missing' WHEN begun THEN 'dropped' ELSE 'later' END AS reason
FROM j WHERE NOT holds
"""


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_profile, p2_found, p2_shifts, p2_reversed, p3_found, p3_unified, p5_found, p6_found, p6_tables, p7_found)}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND_SQL, "p1_profile": P1_PROFILE_SQL, "p6_found": P6_FOUND_SQL, "p6_tables": P6_TABLES_SQL, "p5_found": P5_FOUND_SQL, "p7_found": P7_FOUND_SQL}
