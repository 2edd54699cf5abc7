"""Further queries: forests and paths, codes, tiles, scores per class; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions import geometry as G
from tracemill.functions import text as X
from tracemill.operators import graph, metrics, sequence, similarity, spatial
from tracemill.plans.drawings import CELL, EDGES, NODES, PAGE, SQL as DRAWING_SQL, _side, edges, label_key, nodes, tile_generator
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


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).filter("edge_id is not null").withColumn("w", F.when(F.col("line_type") == "process", 1.0).otherwise(2.0))


@query()
def spanning_forest(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a least spanning forest of the drawings' graph, process lines first."""
    return graph.spanning_forest(_weighted(spark, d), "w", "edge_id")


@query(f"""WITH RECURSIVE {EDGES}, {NODES}, k AS (SELECT from_node AS s, to_node AS t, CASE WHEN line_type = 'process' THEN 1.0 ELSE 2.0 END::DOUBLE AS w FROM e WHERE edge_id IS NOT NULL), q AS (SELECT s, t, min(w) AS w FROM (SELECT * FROM k UNION ALL SELECT t, s, w FROM k) GROUP BY ALL),
r(node, distance) USING KEY (node) AS (SELECT DISTINCT node_id, 0.0::DOUBLE FROM n WHERE kind = 'opc'
  UNION SELECT f.node, f.d FROM (SELECT q.t AS node, min(r.distance + q.w) AS d FROM r JOIN q ON q.s = r.node GROUP BY q.t) f LEFT JOIN recurring.r o ON o.node = f.node WHERE o.node IS NULL OR f.d < o.distance)
SELECT node, distance, (SELECT min(q.s) FROM q JOIN r x ON x.node = q.s WHERE q.t = r.node AND q.s <> q.t AND r.distance > 0 AND abs(x.distance + q.w - r.distance) < 1e-9) AS via FROM r""")
def shortest_path_tree(spark: SparkSession, d: str) -> DataFrame:
    """Least cost from any off-page connector, with the neighbour that the path comes from."""
    sources = nodes(spark, d).filter("kind = 'opc'").select(F.lit("opc").alias("source"), F.col("node_id").alias("node"))
    e = _weighted(spark, d)
    return graph.path_tree(graph.shortest_distances(e, sources, "w"), e, "w").select("node", "distance", "via")


@query("""WITH c AS (SELECT vec_id, list_aggregate([CASE WHEN v > 0 THEN '1' ELSE '0' END FOR v IN embedding[1:64]], 'string_agg', '') AS code FROM embeddings WHERE len(embedding) >= 64),
g AS (SELECT code, min(vec_id) AS lead FROM c GROUP BY code)
SELECT g.lead AS a, c.vec_id AS b, 0 AS distance FROM c JOIN g USING (code) WHERE c.vec_id <> g.lead
UNION ALL SELECT a.lead, b.lead, CAST(hamming(a.code, b.code) AS INT) FROM g a JOIN g b ON a.lead < b.lead AND hamming(a.code, b.code) <= 7""")
def near_codes(spark: SparkSession, d: str) -> DataFrame:
    """Vectors whose sign codes differ in at most seven of 64 places."""
    codes = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), similarity.sign_code(F.col("embedding")).alias("code"))
    return similarity.near_codes(codes, 7)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 50 = 0 AND embedding IS NOT NULL),
p AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(query AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS s FROM q, embeddings WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS place FROM p) SELECT query_id, vec_id, CAST(place AS INT) AS place, round(s, 6) AS score FROM r WHERE place <= 5""")
def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of all vectors for every one whose id is divisible by 50: a top-k search of a stated set."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = v.filter("vec_id % 50 = 0 and embedding is not null").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return similarity.nearest_vectors(v, q, 5).select("query_id", "vec_id", "place", F.round("score", 6).alias("score"))


@query(f"""WITH t AS ({DRAWING_SQL['tile_generator']}),
n AS (SELECT *, lag(x + w) OVER (PARTITION BY fixture, split_part(tile_id, '-', 1), y ORDER BY x) AS before, lead(x) OVER (PARTITION BY fixture, split_part(tile_id, '-', 1), y ORDER BY x) AS after_ FROM t)
SELECT fixture, tile_id, CAST(CASE WHEN before > x THEN floor((before + x) / 2.0) ELSE x END AS INT) AS core_x0, CAST(CASE WHEN after_ < x + w THEN floor((after_ + x + w) / 2.0) ELSE x + w END AS INT) AS core_x1 FROM n""")
def ownership_midpoints(spark: SparkSession, d: str) -> DataFrame:
    """The columns that each tile owns: overlaps with its left and right neighbour are split in the middle."""
    t = tile_generator(spark, d).withColumn("page", F.substring_index("tile_id", "-", 1))
    w = W.partitionBy("fixture", "page", "y").orderBy("x")
    before, after = F.lag(F.col("x") + F.col("w")).over(w), F.lead("x").over(w)
    end = F.col("x") + F.col("w")
    n = t.withColumn("before", before).withColumn("after", after)
    return n.select(
        "fixture",
        "tile_id",
        F.when(F.col("before") > F.col("x"), F.floor((F.col("before") + F.col("x")) / 2)).otherwise(F.col("x")).cast("int").alias("core_x0"),
        F.when(F.col("after") < end, F.floor((F.col("after") + end) / 2)).otherwise(end).cast("int").alias("core_x1"),
    )


@query("""WITH t AS (SELECT DISTINCT fixture, kind, label FROM graph_nodes WHERE label IS NOT NULL AND kind IS NOT NULL), p AS (SELECT DISTINCT fixture, kind, label FROM annotations WHERE label IS NOT NULL AND kind IS NOT NULL),
c AS (SELECT coalesce(t.kind, p.kind) AS kind, count(*) FILTER (t.label IS NOT NULL AND p.label IS NOT NULL) AS tp, count(p.label) AS predicted, count(t.label) AS actual FROM t FULL JOIN p ON t.fixture IS NOT DISTINCT FROM p.fixture AND t.kind = p.kind AND t.label = p.label GROUP BY 1)
SELECT kind, tp, predicted, actual, round(CASE WHEN predicted > 0 THEN tp / predicted::DOUBLE ELSE 0 END, 6) AS precision, round(CASE WHEN actual > 0 THEN tp / actual::DOUBLE ELSE 0 END, 6) AS recall, round(CASE WHEN predicted + actual > 0 THEN 2.0 * tp / (predicted + actual) ELSE 0 END, 6) AS f1 FROM c""")
def per_class_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Labels of annotations held against those of nodes, per kind; undefined shares are 0."""
    of = lambda t, c: table(spark, d, t).filter("label is not null and kind is not null").select(F.coalesce("fixture", F.lit("")).alias("fixture"), "kind", "label").distinct().withColumn(c, F.lit(1))
    c = of("graph_nodes", "t").join(of("annotations", "p"), ["fixture", "kind", "label"], "full").groupBy("kind").agg(F.count(F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), 1)).alias("tp"), F.count("p").alias("predicted"), F.count("t").alias("actual"))
    p, r, f = metrics.prf(F.col("tp"), F.col("predicted"), F.col("actual"), F.lit(0.0))
    return c.select("kind", "tp", "predicted", "actual", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


@query(f"""WITH {NODES} SELECT node_id, CASE WHEN lower(trim(label)) = lower(trim(alternate_readings[1])) THEN 1.0 ELSE 0.0 END::DOUBLE AS exact,
 CASE WHEN contains(regexp_replace(lower(alternate_readings[1]), '[^a-z0-9]+', '', 'g'), regexp_replace(lower(label), '[^a-z0-9]+', '', 'g')) THEN 1.0 ELSE 0.0 END::DOUBLE AS held,
 CASE WHEN {label_key('label')} = {label_key('alternate_readings[1]')} THEN 1.0 ELSE 0.0 END::DOUBLE AS same_key FROM n WHERE label IS NOT NULL AND alternate_readings[1] IS NOT NULL""")
def scorer_registry(spark: SparkSession, d: str) -> DataFrame:
    """The first other reading of each label scored by the registered scorers."""
    a = F.get("alternate_readings", F.lit(0))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    scorers = {
        "exact": one(F.lower(F.trim("label")) == F.lower(F.trim(a))),
        "held": one(X.tag_key(a).contains(X.tag_key(F.col("label")))),
        "same_key": one(X.label_key(F.col("label")) == X.label_key(a)),
    }
    return nodes(spark, d).filter(F.col("label").isNotNull() & a.isNotNull()).select("node_id", *[c.alias(n) for n, c in scorers.items()])


@query(f"""WITH {NODES}, c AS (SELECT a.node_id AS tag, b.node_id AS node, sqrt(pow(a.bbox_global.x + a.bbox_global.w / 2.0 - b.bbox_global.x - b.bbox_global.w / 2.0, 2) + pow(a.bbox_global.y + a.bbox_global.h / 2.0 - b.bbox_global.y - b.bbox_global.h / 2.0, 2)) / greatest(20, b.bbox_global.w, b.bbox_global.h) AS s,
 greatest(0, a.bbox_global.x - (b.bbox_global.x + b.bbox_global.w), b.bbox_global.x - (a.bbox_global.x + a.bbox_global.w)) AS dx, greatest(0, a.bbox_global.y - (b.bbox_global.y + b.bbox_global.h), b.bbox_global.y - (a.bbox_global.y + a.bbox_global.h)) AS dy
 FROM n a JOIN n b ON a.fixture = b.fixture AND a.page_index = b.page_index WHERE a.kind = 'instrument' AND b.kind = 'equipment')
SELECT tag, node, round(s, 6) AS score, CASE WHEN s <= 3.0 THEN 'accepted' ELSE 'candidate' END AS state FROM c WHERE s <= 3.6 AND sqrt(dx * dx + dy * dy) <= 300""")
def tag_node_scores(spark: SparkSession, d: str) -> DataFrame:
    """Instruments and equipment within 300 pixels by the distance of their centres in sizes of the latter: accepted up to 3, candidates up to 3.6."""
    n = nodes(spark, d)
    pairs = spatial.within(_side(n.filter("kind = 'instrument'"), "l"), _side(n.filter("kind = 'equipment'"), "r"), PAGE, CELL, 300)
    s = G.centre_distance(F.col("l_box"), F.col("r_box")) / F.greatest(F.lit(20), F.col("r_box.w"), F.col("r_box.h"))
    return pairs.withColumn("s", s).filter("s <= 3.6").select(F.col("l_id").alias("tag"), F.col("r_id").alias("node"), F.round("s", 6).alias("score"), F.when(F.col("s") <= 3.0, "accepted").otherwise("candidate").alias("state"))


@query("""SELECT source_kind, sha256(body) AS digest, count(*) AS n, count(DISTINCT file_name) AS files FROM file_records WHERE body IS NOT NULL GROUP BY ALL HAVING count(DISTINCT file_name) > 1""")
def content_cache(spark: SparkSession, d: str) -> DataFrame:
    """Records by the digest of their content that more than one file holds: what a content-addressed cache computes once."""
    r = table(spark, d, "file_records").filter("body is not null").select("source_kind", F.sha2("body", 256).alias("digest"), "file_name")
    return r.groupBy("source_kind", "digest").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_name").alias("files")).filter("files > 1")


@query("""WITH f AS (SELECT file_series, file_name, min(written_at) AS w, count(DISTINCT line_no) AS lines FROM file_records WHERE written_at IS NOT NULL AND file_series IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY file_series ORDER BY w DESC, file_name DESC) AS p FROM f WHERE lines >= 10) SELECT file_series, file_name, lines FROM r WHERE p = 1""")
def resumable_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """The newest file of each series that is complete enough (ten lines) to resume from."""
    f = table(spark, d, "file_records").filter("written_at is not null and file_series is not null").groupBy("file_series", "file_name").agg(F.min("written_at").alias("w"), F.countDistinct("line_no").alias("lines"))
    return sequence.newest(f.filter("lines >= 10"), ["file_series"], [F.desc("w"), F.desc("file_name")]).select("file_series", "file_name", "lines")


@query("""WITH x AS (SELECT event_id, user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS f FROM events),
y AS (SELECT *, k - sum(f) OVER (PARTITION BY user_id ORDER BY k) AS g FROM x), z AS (SELECT user_id, g, count(*) AS row_len FROM y WHERE f = 1 GROUP BY user_id, g)
SELECT user_id, max(row_len) AS longest, CAST(sum(row_len) AS BIGINT) AS total FROM z GROUP BY user_id""")
def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    """Longest row of failures and failures in all per user."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    f = F.when(F.col("event_type") == "error", 1).otherwise(0)
    y = table(spark, d, "events").withColumn("f", f).withColumn("k", F.row_number().over(w)).withColumn("g", F.col("k") - F.sum("f").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return y.filter("f = 1").groupBy("user_id", "g").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"), F.sum("n").alias("total"))


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
