"""Lints, rule packs and answer parsing over the whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions import text as X
from tracemill.operators import quality
from tracemill.plans.drawings import ITEMS, NODES, TOKENS, nodes
from tracemill.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# What lints allow and ask for.
SCORINGS = ["exact", "contains", "set_match", "graph_reachability", "numeric_tolerance"]
SOURCE_TYPES = ["scanned", "raster", "vector"]
SIGNALS = ["signal_electric", "signal_pneumatic", "instrument_capillary", "electrical_power"]
TAG_FORMAT = "^[A-Z]{1,5}-?[0-9]{2,}[A-Z]?$"


def _listed(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _finding(df: DataFrame, scope: Column, check: str, level: str, example: Column) -> DataFrame:
    """scope, check, level, n, example: how often a check fails in each scope, with the least example."""
    return df.groupBy(F.coalesce(scope.cast("string"), F.lit("")).alias("scope")).agg(F.count(F.lit(1)).alias("n"), F.min(example).alias("example")).select("scope", F.lit(check).alias("check"), F.lit(level).alias("level"), "n", "example")


@query("""WITH n AS (SELECT DISTINCT fixture, node_id, kind, label FROM graph_nodes WHERE node_id IS NOT NULL), e AS (SELECT DISTINCT fixture, edge_id, from_node, to_node, line_type FROM graph_edges WHERE edge_id IS NOT NULL),
d AS (SELECT fixture, node_id AS id FROM n GROUP BY ALL HAVING count(*) > 1), x AS (SELECT fixture, edge_id AS id FROM e GROUP BY ALL HAVING count(*) > 1),
k AS (SELECT DISTINCT fixture, node_id FROM n),
g AS (SELECT DISTINCT e.fixture, e.edge_id AS id FROM e LEFT JOIN k a ON a.fixture = e.fixture AND a.node_id = e.from_node LEFT JOIN k b ON b.fixture = e.fixture AND b.node_id = e.to_node WHERE a.node_id IS NULL OR b.node_id IS NULL)
SELECT coalesce(fixture, '') AS scope, 'duplicate node id' AS check, 'error' AS level, count(*) AS n, min(id) AS example FROM d GROUP BY 1
UNION ALL SELECT coalesce(fixture, ''), 'duplicate edge id', 'error', count(*), min(id) FROM x GROUP BY 1
UNION ALL SELECT coalesce(fixture, ''), 'dangling endpoint', 'error', count(*), min(id) FROM g GROUP BY 1""")
def graph_lint(spark: SparkSession, d: str) -> DataFrame:
    """Per drawing: node and edge ids that stand for more than one thing, and edges whose ends aren't nodes of the drawing."""
    n = table(spark, d, "graph_nodes").filter("node_id is not null").select("fixture", "node_id", "kind", "label").distinct()
    e = table(spark, d, "graph_edges").filter("edge_id is not null").select("fixture", "edge_id", "from_node", "to_node", "line_type").distinct()
    twice = lambda df, key: df.groupBy("fixture", key).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    known = n.filter("fixture is not null").select("fixture", F.col("node_id").alias("end")).distinct().withColumn("held", F.lit(1))
    ends = e.select("fixture", "edge_id", F.explode(F.array("from_node", "to_node")).alias("end"))
    loose = ends.join(known, ["fixture", "end"], "left").filter("held is null").select("fixture", "edge_id").distinct()
    return (
        _finding(twice(n, "node_id"), F.col("fixture"), "duplicate node id", "error", F.col("node_id"))
        .unionByName(_finding(twice(e, "edge_id"), F.col("fixture"), "duplicate edge id", "error", F.col("edge_id")))
        .unionByName(_finding(loose, F.col("fixture"), "dangling endpoint", "error", F.col("edge_id")))
    )


@query(f"""WITH q AS (SELECT DISTINCT fixture, query_id, family, scoring, entity_count_truth FROM results WHERE metric_kind IS NOT NULL AND phase = 1),
t AS (SELECT fixture, query_id AS id FROM (SELECT DISTINCT fixture, query_id, family FROM q WHERE query_id IS NOT NULL AND family IS NOT NULL) GROUP BY ALL HAVING count(*) > 1)
SELECT coalesce(fixture, '') AS scope, 'missing ' || f AS check, 'error' AS level, count(*) AS n, min(coalesce(query_id, '')) AS example FROM (SELECT fixture, query_id, unnest([CASE WHEN query_id IS NULL THEN 'query_id' END, CASE WHEN family IS NULL THEN 'family' END, CASE WHEN scoring IS NULL THEN 'scoring' END]) AS f FROM q) WHERE f IS NOT NULL GROUP BY ALL
UNION ALL SELECT coalesce(fixture, ''), 'unknown scoring', 'error', count(*), min(coalesce(query_id, '')) FROM q WHERE scoring NOT IN ({_listed(SCORINGS)}) GROUP BY 1
UNION ALL SELECT coalesce(fixture, ''), 'query of several families', 'error', count(*), min(id) FROM t GROUP BY 1""")
def query_lint(spark: SparkSession, d: str) -> DataFrame:
    """Per drawing: questions without what every question has, with an unknown scoring, or with one id for several families."""
    q = table(spark, d, "results").filter("metric_kind is not null and phase = 1").select("fixture", "query_id", "family", "scoring", "entity_count_truth").distinct()
    name = F.coalesce("query_id", F.lit(""))
    lacking = [F.when(F.col(c).isNull(), f"missing {c}") for c in ("query_id", "family", "scoring")]
    missing = q.select("fixture", name.alias("name"), F.explode(F.array_compact(F.array(*lacking))).alias("check"))
    missing = missing.groupBy(F.coalesce("fixture", F.lit("")).alias("scope"), "check").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("example"))
    several = q.filter("query_id is not null and family is not null").select("fixture", "query_id", "family").distinct().groupBy("fixture", "query_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return (
        missing.select("scope", "check", F.lit("error").alias("level"), "n", "example")
        .unionByName(_finding(q.filter(~F.col("scoring").isin(SCORINGS)), F.col("fixture"), "unknown scoring", "error", name))
        .unionByName(_finding(several, F.col("fixture"), "query of several families", "error", F.col("query_id")))
    )


@query("""WITH a AS (SELECT DISTINCT fixture, annotation_id, kind, label, confidence, page_index, bbox_global, extracted_at FROM annotations),
t AS (SELECT fixture, annotation_id AS id FROM (SELECT DISTINCT fixture, annotation_id, kind, label FROM a WHERE annotation_id IS NOT NULL) GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT fixture, coalesce(annotation_id, '') AS id, unnest([CASE WHEN annotation_id IS NULL OR annotation_id = '' THEN 'no id' END, CASE WHEN kind IS NULL THEN 'no kind' END, CASE WHEN page_index IS NULL OR page_index < 0 THEN 'no page' END,
  CASE WHEN bbox_global IS NULL OR bbox_global.w <= 0 OR bbox_global.h <= 0 THEN 'no area' END, CASE WHEN confidence IS NULL OR confidence NOT IN ('high', 'medium', 'low') THEN 'unknown confidence' END]) AS check FROM a)
SELECT coalesce(fixture, '') AS scope, c."check", 'error' AS level, count(*) AS n, min(id) AS example FROM c WHERE c."check" IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT coalesce(fixture, ''), 'duplicate annotation id', 'error', count(*), min(id) FROM t GROUP BY 1""")
def annotation_lint(spark: SparkSession, d: str) -> DataFrame:
    """Per drawing: annotations that break the row's schema, and ids that stand for different ones."""
    a = table(spark, d, "annotations").select("fixture", "annotation_id", "kind", "label", "confidence", "page_index", "bbox_global", "extracted_at").distinct()
    rules = {
        "no id": F.coalesce(F.col("annotation_id") == "", F.lit(True)),
        "no kind": F.col("kind").isNull(),
        "no page": F.coalesce(F.col("page_index") < 0, F.lit(True)),
        "no area": F.col("bbox_global").isNull() | (F.col("bbox_global.w") <= 0) | (F.col("bbox_global.h") <= 0),
        "unknown confidence": F.coalesce(~F.col("confidence").isin("high", "medium", "low"), F.lit(True)),
    }
    found = a.select(F.coalesce("fixture", F.lit("")).alias("scope"), F.coalesce("annotation_id", F.lit("")).alias("id"), F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()]))).alias("check"))
    found = found.groupBy("scope", "check").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("example")).select("scope", "check", F.lit("error").alias("level"), "n", "example")
    twice = a.filter("annotation_id is not null").select("fixture", "annotation_id", "kind", "label").distinct().groupBy("fixture", "annotation_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return found.unionByName(_finding(twice, F.col("fixture"), "duplicate annotation id", "error", F.col("annotation_id")))


@query(f"""WITH m AS (SELECT fixture, count(DISTINCT source_type) AS kinds, min(source_type) AS source_type, count(DISTINCT plant_domain) AS domains, max(entity_count_truth) AS truth FROM results WHERE fixture IS NOT NULL GROUP BY fixture)
SELECT fixture AS scope, c AS check, CASE WHEN contains(c, 'unknown') THEN 'error' ELSE 'warn' END AS level FROM (SELECT fixture, unnest([CASE WHEN kinds = 0 THEN 'no source_type' END, CASE WHEN domains = 0 THEN 'no plant_domain' END, CASE WHEN truth IS NULL THEN 'no entity_count_truth' END,
 CASE WHEN kinds > 1 THEN 'several source_types' END, CASE WHEN source_type NOT IN ({_listed(SOURCE_TYPES)}) THEN 'unknown source_type' END]) AS c FROM m) WHERE c IS NOT NULL""")
def meta_lint(spark: SparkSession, d: str) -> DataFrame:
    """Drawings whose recommended fields are absent or contradict, or whose source type is none of the known."""
    m = table(spark, d, "results").filter("fixture is not null").groupBy("fixture").agg(
        F.countDistinct("source_type").alias("kinds"), F.min("source_type").alias("source_type"), F.countDistinct("plant_domain").alias("domains"), F.max("entity_count_truth").alias("truth")
    )
    rules = [
        F.when(F.col("kinds") == 0, "no source_type"),
        F.when(F.col("domains") == 0, "no plant_domain"),
        F.when(F.col("truth").isNull(), "no entity_count_truth"),
        F.when(F.col("kinds") > 1, "several source_types"),
        F.when(~F.col("source_type").isin(SOURCE_TYPES), "unknown source_type"),
    ]
    found = m.select(F.col("fixture").alias("scope"), F.explode(F.array_compact(F.array(*rules))).alias("check"))
    return found.withColumn("level", F.when(F.col("check").contains("unknown"), "error").otherwise("warn"))


def _said(attributes: str, field: str) -> str:
    return f"json_extract_string(CASE WHEN json_valid({attributes}) THEN {attributes} END, '$.{field}')"


@query(f"""WITH {NODES}, e AS (SELECT DISTINCT fixture, edge_id, from_node, to_node, line_type, coalesce(len(polyline_global), 0) AS points FROM graph_edges WHERE edge_id IS NOT NULL),
i AS (SELECT fixture || '/' || node_id AS path, 'tag_name' AS rule, 'warning' AS severity, 'tag is of no known form' AS message FROM n WHERE kind = 'equipment' AND label IS NOT NULL AND NOT regexp_matches(upper(trim(label)), '{TAG_FORMAT}')
 UNION ALL SELECT 'documents/' || doc_id, 'drawing_number', 'warning', 'report names no drawing' FROM documents WHERE doc_kind = 'extraction_report' AND coalesce(fixture, '') = '' AND doc_id IS NOT NULL
 UNION ALL SELECT fixture || '/' || edge_id, 'signal_source', 'error', 'signal has no source' FROM e WHERE line_type IN ({_listed(SIGNALS)}) AND coalesce(from_node, '') = ''
 UNION ALL SELECT fixture || '/' || edge_id, 'signal_target', 'error', 'signal has no target' FROM e WHERE line_type IN ({_listed(SIGNALS)}) AND coalesce(to_node, '') = ''
 UNION ALL SELECT fixture || '/' || node_id, 'loop_number', 'warning', 'instrument has no loop number' FROM n WHERE kind = 'instrument' AND coalesce({_said('attributes', 'loop_number')}, '') = ''
 UNION ALL SELECT fixture || '/' || edge_id, 'empty_segment', 'warning', 'segment has no items and no ends' FROM e WHERE line_type = 'process' AND points < 2 AND coalesce(from_node, '') = '' AND coalesce(to_node, '') = '')
SELECT DISTINCT path, rule, severity, message FROM i WHERE path IS NOT NULL""")
def semantic_rules(spark: SparkSession, d: str) -> DataFrame:
    """The rules of a drawing's meaning: tag forms, drawing numbers, ends of signals, loop numbers, empty segments; one row per breach."""
    n = nodes(spark, d)
    e = table(spark, d, "graph_edges").filter("edge_id is not null").select("fixture", "edge_id", "from_node", "to_node", "line_type", F.coalesce(F.greatest(F.size("polyline_global"), F.lit(0)), F.lit(0)).alias("points")).distinct()
    node, edge = F.concat("fixture", F.lit("/"), "node_id"), F.concat("fixture", F.lit("/"), "edge_id")
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    signal = F.col("line_type").isin(SIGNALS)
    rules = [
        (n.filter((F.col("kind") == "equipment") & F.col("label").isNotNull() & ~F.upper(F.trim("label")).rlike(TAG_FORMAT)), node, "tag_name", "warning", "tag is of no known form"),
        (table(spark, d, "documents").filter((F.col("doc_kind") == "extraction_report") & none("fixture") & F.col("doc_id").isNotNull()), F.concat(F.lit("documents/"), F.col("doc_id").cast("string")), "drawing_number", "warning", "report names no drawing"),
        (e.filter(signal & none("from_node")), edge, "signal_source", "error", "signal has no source"),
        (e.filter(signal & none("to_node")), edge, "signal_target", "error", "signal has no target"),
        (n.filter((F.col("kind") == "instrument") & (F.coalesce(F.get_json_object("attributes", "$.loop_number"), F.lit("")) == "")), node, "loop_number", "warning", "instrument has no loop number"),
        (e.filter((F.col("line_type") == "process") & (F.col("points") < 2) & none("from_node") & none("to_node")), edge, "empty_segment", "warning", "segment has no items and no ends"),
    ]
    parts = [df.select(path.alias("path"), F.lit(rule).alias("rule"), F.lit(level).alias("severity"), F.lit(said).alias("message")) for df, path, rule, level, said in rules]
    return quality.pack(*parts).filter("path is not null").distinct()


@query("""WITH r AS (SELECT DISTINCT annotation_id, bbox_global, label FROM annotations WHERE annotation_id IS NOT NULL), n AS (SELECT DISTINCT node_id, bbox_global, system_confidence FROM graph_nodes WHERE node_id IS NOT NULL),
t AS (SELECT node_id FROM (SELECT DISTINCT node_id, bbox_global FROM n) GROUP BY node_id HAVING count(*) > 1),
c AS (SELECT node_id, unnest([CASE WHEN bbox_global IS NULL OR bbox_global.w IS NULL OR bbox_global.h IS NULL OR bbox_global.x IS NULL OR bbox_global.y IS NULL THEN 'no box' WHEN bbox_global.w <= 0 OR bbox_global.h <= 0 THEN 'no area' END,
 CASE WHEN system_confidence < 0 OR system_confidence > 1 OR isnan(system_confidence) THEN 'confidence out of range' END]) AS fault FROM n UNION ALL SELECT node_id, 'id of several boxes' FROM t)
SELECT fault, count(DISTINCT node_id) AS nodes, min(node_id) AS first_node FROM c WHERE fault IS NOT NULL GROUP BY fault""")
def prediction_validator(spark: SparkSession, d: str) -> DataFrame:
    """Faults of predicted boxes: incomplete, without area, with a confidence outside 0 to 1, or several under one id."""
    n = table(spark, d, "graph_nodes").filter("node_id is not null").select("node_id", "bbox_global", "system_confidence").distinct()
    b = F.col("bbox_global")
    incomplete = b.isNull() | b["x"].isNull() | b["y"].isNull() | b["w"].isNull() | b["h"].isNull()
    c = F.col("system_confidence")
    faults = F.array_compact(F.array(F.when(incomplete, "no box").when((b["w"] <= 0) | (b["h"] <= 0), "no area"), F.when((c < 0) | (c > 1) | F.isnan(c), "confidence out of range")))
    twice = n.select("node_id", "bbox_global").distinct().groupBy("node_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("node_id", F.lit("id of several boxes").alias("fault"))
    return n.select("node_id", F.explode(faults).alias("fault")).unionByName(twice).groupBy("fault").agg(F.countDistinct("node_id").alias("nodes"), F.min("node_id").alias("first_node"))


@query(f"""WITH {NODES}, v AS (SELECT u.f AS field_name, u.v AS value FROM n, LATERAL (VALUES ('equipment_class', {_said('attributes', 'equipment_class')}), ('valve_type', {_said('attributes', 'valve_type')}), ('instrument_function', {_said('attributes', 'instrument_function')})) AS u(f, v) WHERE u.v IS NOT NULL),
g AS (SELECT field_name, value, count(*) AS n FROM v GROUP BY ALL)
SELECT coalesce(c.field_name, g.field_name) AS field_name, CASE WHEN g.value IS NULL THEN 'unused' WHEN c.canonical IS NULL THEN 'unlisted' ELSE 'covered' END AS state, count(*) AS names, CAST(coalesce(sum(g.n), 0) AS BIGINT) AS nodes
FROM (SELECT DISTINCT field_name, canonical FROM canonical_values) c FULL JOIN g ON g.field_name = c.field_name AND g.value = c.canonical GROUP BY 1, 2""")
def legend_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per field: listed names that nodes use, listed names that none uses, and used names that the list lacks."""
    fields = ["equipment_class", "valve_type", "instrument_function"]
    v = nodes(spark, d).select(F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.get_json_object("attributes", f"$.{f}").alias("value")) for f in fields]))).filter("value is not null")
    g = v.groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, d, "canonical_values").select("field_name", F.col("canonical").alias("value")).distinct().withColumn("listed", F.lit(True))
    state = F.when(F.col("n").isNull(), "unused").when(F.col("listed").isNull(), "unlisted").otherwise("covered")
    return c.join(g, ["field_name", "value"], "full").groupBy("field_name", state.alias("state")).agg(F.count(F.lit(1)).alias("names"), F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"))


@query("""WITH r AS (SELECT run_id, fixture, min(loaded_at) AS "at", min(run_condition) AS run_condition, min(phase) AS phase, min(source_type) AS source_type, max(trial) AS trials FROM results WHERE run_id IS NOT NULL AND fixture IS NOT NULL GROUP BY run_id, fixture),
l AS (SELECT *, lag(run_id) OVER w AS prior, lag(run_condition) OVER w AS c0, lag(phase) OVER w AS p0, lag(source_type) OVER w AS s0 FROM r WINDOW w AS (PARTITION BY fixture ORDER BY "at", run_id))
SELECT fixture, run_id, prior, concat_ws(',', CASE WHEN run_condition IS DISTINCT FROM c0 THEN 'run_condition' END, CASE WHEN phase IS DISTINCT FROM p0 THEN 'phase' END, CASE WHEN source_type IS DISTINCT FROM s0 THEN 'source_type' END) AS blockers FROM l WHERE prior IS NOT NULL""")
def resume_compatibility(spark: SparkSession, d: str) -> DataFrame:
    """Each run of a drawing against the one before: the gated settings that differ and forbid resuming it."""
    gated = ["run_condition", "phase", "source_type"]
    r = table(spark, d, "results").filter("run_id is not null and fixture is not null").groupBy("run_id", "fixture").agg(F.min("loaded_at").alias("at"), *[F.min(c).alias(c) for c in gated])
    w = W.partitionBy("fixture").orderBy("at", "run_id")
    held = r.withColumn("prior", F.lag("run_id").over(w)).withColumns({f"before_{c}": F.lag(c).over(w) for c in gated}).filter("prior is not null")
    return held.select("fixture", "run_id", "prior", F.concat_ws(",", *[F.when(~F.col(c).eqNullSafe(F.col(f"before_{c}")), c) for c in gated]).alias("blockers"))


# --- answers ----------------------------------------------------------------

_THREE = "{3,}"
INT_ANSWER = r"""TRY_CAST(coalesce(list_filter([trim(x) FOR x IN regexp_split_to_array({c}, '\r?\n')], lambda s: regexp_full_match(s, '-?[0-9]+'))[-1], nullif(regexp_replace(regexp_extract({c}, '((?:^|[^A-Za-z0-9])-)?([0-9]+)', 0), '^[^0-9-]', ''), '')) AS BIGINT)"""
_YES, _NO = "('yes', 'true', 'y', 't', '1')", "('no', 'false', 'n', 'f', '0')"
BOOL_ANSWER = r"""(SELECT CASE WHEN f IN {yes} THEN true WHEN f IN {no} THEN false WHEN l IN {yes} THEN true WHEN l IN {no} THEN false WHEN starts_with(flat, 'yes') THEN true WHEN starts_with(flat, 'no') THEN false END
 FROM (SELECT flat, regexp_replace(words[1], '^[.,;:!?"'']+|[.,;:!?"'']+$', '', 'g') AS f, regexp_replace(words[-1], '^[.,;:!?"'']+|[.,;:!?"'']+$', '', 'g') AS l FROM (SELECT trim(lower({c})) AS flat, regexp_split_to_array(trim(lower({c})), '\s+') AS words)))""".replace("{yes}", _YES).replace("{no}", _NO)


@query(f"""SELECT doc_id, {INT_ANSWER.replace('{c}', 'text')} AS number, {BOOL_ANSWER.replace('{c}', 'text')} AS truth FROM documents WHERE doc_kind = 'query_transcript' AND text IS NOT NULL""")
def scalar_answers(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts read as an integer and as a yes or no."""
    docs = table(spark, d, "documents").filter("doc_kind = 'query_transcript' and text is not null")
    return docs.select("doc_id", X.int_answer(F.col("text")).alias("number"), X.bool_answer(F.col("text")).alias("truth"))


@query(f"""WITH a AS (SELECT doc_id, text, ['list', 'integer', 'boolean', 'text'][1 + CAST(doc_id % 4 AS INT)] AS kind FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL AND doc_kind = 'query_transcript')
SELECT doc_id, kind, CASE kind WHEN 'list' THEN array_to_string({ITEMS.replace('{c}', 'text').replace('{{3,}}', _THREE)}, '|') WHEN 'integer' THEN CAST({INT_ANSWER.replace('{c}', 'text')} AS VARCHAR) WHEN 'boolean' THEN CAST({BOOL_ANSWER.replace('{c}', 'text')} AS VARCHAR) ELSE text END AS answer FROM a""")
def coerced_answers(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts coerced to the kind expected of them, the four kinds in turn."""
    kinds = F.array(*[F.lit(k) for k in ("list", "integer", "boolean", "text")])
    docs = table(spark, d, "documents").filter("text is not null and doc_id is not null and doc_kind = 'query_transcript'").withColumn("kind", F.element_at(kinds, (F.col("doc_id") % 4).cast("int") + 1))
    a = X.coerced_answer(F.col("kind"), F.col("text"))
    return docs.select("doc_id", "kind", a.alias("a")).select("doc_id", "kind", F.coalesce(F.array_join("a.items", "|"), F.col("a.number").cast("string"), F.col("a.truth").cast("string"), F.col("a.text")).alias("answer"))


@query(f"""WITH o AS (SELECT DISTINCT fixture, label, {TOKENS.replace('{c}', 'label')} AS t FROM graph_nodes WHERE kind = 'opc' AND label IS NOT NULL AND fixture IS NOT NULL),
a AS (SELECT DISTINCT fixture, label, {TOKENS.replace('{c}', 'label')} AS t FROM annotations WHERE kind = 'opc' AND label IS NOT NULL AND fixture IS NOT NULL)
SELECT o.fixture, o.label AS node_label, a.label AS annotation_label FROM o JOIN a ON o.fixture = a.fixture WHERE len(o.t) > 0 AND len(a.t) > 0 AND (list_has_any(o.t, a.t) OR starts_with(o.t[1], a.t[1]) OR starts_with(a.t[1], o.t[1]))""")
def connector_matches(spark: SparkSession, d: str) -> DataFrame:
    """Connector labels of nodes and annotations of one drawing that name the same connector, loosely.

    Labels meet by a common token or by the first letters of their leading
    token, so that a drawing's labels are never all paired.
    """
    of = lambda t, c: table(spark, d, t).filter("kind = 'opc' and label is not null and fixture is not null").select("fixture", F.col("label").alias(c)).distinct()
    head = lambda t: F.substring(F.get(t, F.lit(0)), 1, 3)
    keyed = lambda df, c: df.withColumn("t", X.connector_tokens(F.col(c))).filter("size(t) > 0").withColumn("k", F.explode(F.array_distinct(F.concat(F.transform("t", lambda w: F.concat(F.lit("="), w)), F.array(head(F.col("t"))))))).drop("t")
    met = keyed(of("graph_nodes", "node_label"), "node_label").join(keyed(of("annotations", "annotation_label"), "annotation_label"), ["fixture", "k"]).drop("k").distinct()
    return met.filter(X.connectors_alike(F.col("node_label"), F.col("annotation_label"))).select("fixture", "node_label", "annotation_label")


ROOT = "regexp_replace(lower(regexp_extract({c}, '([A-Za-z]{1,5}-?[0-9]{2,}[A-Za-z]?)', 1)), '[^a-z0-9]+', '', 'g')"


@query(f"""WITH {NODES} SELECT node_id, {ROOT.replace('{c}', 'label')} <> '' AND {ROOT.replace('{c}', 'label')} = {ROOT.replace('{c}', 'source_quote')} AS same FROM n WHERE label IS NOT NULL AND source_quote IS NOT NULL""")
def same_roots(spark: SparkSession, d: str) -> DataFrame:
    """Whether a node's label and its quote name the same tag."""
    return nodes(spark, d).filter("label is not null and source_quote is not null").select("node_id", X.same_root(F.col("label"), F.col("source_quote")).alias("same"))


_KEY = "CASE WHEN contains({c}, 'instrument air') THEN 'instrument_air' WHEN contains({c}, 'compressed air') THEN 'compressed_air' WHEN contains({c}, 'dry air') OR contains({c}, 'dried air') THEN 'dried_air' WHEN contains({c}, 'purified air') THEN 'purified_air' WHEN contains({c}, 'nitrogen') THEN 'nitrogen' WHEN contains({c}, 'cooling water supply') OR contains({c}, 'cws') THEN 'cooling_water_supply' WHEN contains({c}, 'cooling water return') OR contains({c}, 'cwr') THEN 'cooling_water_return' ELSE regexp_replace(regexp_replace(regexp_replace({c}, '\\b(to|from)\\b', ' ', 'g'), '2401[-a-z0-9/]+', ' ', 'g'), '[^a-z0-9]+', '', 'g') END"


@query(f"""WITH {NODES}, k AS (SELECT node_id, {_KEY.replace('{c}', 'lower(label)')} AS x, {_KEY.replace('{c}', 'lower(source_quote)')} AS y FROM n WHERE label IS NOT NULL AND source_quote IS NOT NULL)
SELECT node_id, CASE WHEN x = '' OR y = '' THEN 0.0 WHEN x = y THEN 2.0 WHEN contains(x, y) OR contains(y, x) THEN 1.0 END::DOUBLE AS score FROM k""")
def service_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How well a node's label and its quote agree as services."""
    return nodes(spark, d).filter("label is not null and source_quote is not null").select("node_id", X.services_agree(F.col("label"), F.col("source_quote")).alias("score"))


@query("""WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'all' WHEN 1 THEN CAST(1 + doc_id % 7 AS VARCHAR) WHEN 2 THEN (1 + doc_id % 5) || ' - ' || (3 + doc_id % 9) ELSE 'none' END AS spec FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, spec, TRY_CAST(regexp_extract(spec, '^\\s*([0-9]+)', 1) AS INT) AS a, coalesce(TRY_CAST(nullif(regexp_extract(spec, '-\\s*([0-9]+)\\s*$', 1), '') AS INT), TRY_CAST(regexp_extract(spec, '^\\s*([0-9]+)', 1) AS INT)) AS b FROM s)
SELECT doc_id, spec, array_to_string(CASE WHEN spec = 'all' THEN range(1, 9) WHEN a >= 1 AND least(b, 8) >= a THEN range(a, least(b, 8) + 1) ELSE [] END, ',') AS pages FROM p""")
def page_specs(spark: SparkSession, d: str) -> DataFrame:
    """Page specifications made of document numbers, as pages of a drawing of eight."""
    k = F.col("doc_id")
    spec = F.when(k % 4 == 0, "all").when(k % 4 == 1, (1 + k % 7).cast("string")).when(k % 4 == 2, F.concat((1 + k % 5).cast("string"), F.lit(" - "), (3 + k % 9).cast("string"))).otherwise("none")
    s = table(spark, d, "documents").filter("doc_id is not null").select("doc_id", spec.alias("spec"))
    return s.select("doc_id", "spec", F.array_join(F.transform(X.page_numbers(F.col("spec"), F.lit(8)), lambda p: p.cast("string")), ",").alias("pages"))


@query(f"""WITH {NODES}, r AS (SELECT node_id, nullif(regexp_replace(upper(regexp_extract(coalesce(label, ''), '(?i)\\b(DW[0-9]{{2}}[- ]?[0-9]{{3,5}})\\b', 1)), '\\s+', '', 'g'), '') AS a, nullif(regexp_replace(upper(regexp_extract(coalesce(source_quote, ''), '(?i)\\b(DW[0-9]{{2}}[- ]?[0-9]{{3,5}})\\b', 1)), '\\s+', '', 'g'), '') AS b FROM n WHERE kind = 'opc')
SELECT CASE WHEN coalesce(a, b) IS NULL THEN 'none' ELSE 'explicit' END AS state, count(*) AS connectors FROM r GROUP BY 1""")
def drawing_references(spark: SparkSession, d: str) -> DataFrame:
    """Connectors with and without an explicit drawing number in their label or quote."""
    found = X.drawing_reference(F.col("label"), F.col("source_quote"))
    return nodes(spark, d).filter("kind = 'opc'").groupBy(F.when(found.isNull(), "none").otherwise("explicit").alias("state")).agg(F.count(F.lit(1)).alias("connectors"))


@query(f"""WITH {NODES} SELECT node_id, array_to_string(CASE WHEN len(alternate_readings) > 0 THEN alternate_readings WHEN trim(regexp_replace(source_quote, '\\s+', ' ', 'g')) <> '' THEN [trim(regexp_replace(source_quote, '\\s+', ' ', 'g'))] ELSE [] END, '|') AS readings FROM n""")
def reading_lists(spark: SparkSession, d: str) -> DataFrame:
    """Readings of every node as a list, whether they were given as a list, as one text or not at all."""
    listed = F.when(F.size("alternate_readings") > 0, F.col("alternate_readings"))
    return nodes(spark, d).select("node_id", F.array_join(X.string_list(F.col("source_quote"), listed), "|").alias("readings"))


@query("""WITH p AS (SELECT DISTINCT annotation_id, attributes AS a FROM annotations WHERE annotation_id IS NOT NULL AND attributes IS NOT NULL)
SELECT CASE WHEN NOT json_valid(a) THEN 'damaged' WHEN json_type(a) <> 'OBJECT' THEN 'not an object' WHEN json_extract_string(a, '$.note') IS NULL THEN 'without note' ELSE 'whole' END AS state, count(*) AS payloads FROM p GROUP BY 1""")
def payload_states(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of annotations by how they can be read; damaged ones are told apart and harm no other."""
    p = table(spark, d, "annotations").filter("annotation_id is not null and attributes is not null").select("annotation_id", "attributes").distinct()
    held = F.try_parse_json("attributes")
    state = F.when(held.isNull(), "damaged").when(~F.trim("attributes").startswith("{"), "not an object").when(F.get_json_object("attributes", "$.note").isNull(), "without note").otherwise("whole")
    return p.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("payloads"))


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
