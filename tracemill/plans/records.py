"""Queries over streams, change logs, JSON and documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import geometry as G
from tracemill.functions import text as X
from tracemill.operators import changes, quality, sequence
from tracemill.plans.training import P5_FOUND_SQL, review_changes
from tracemill.session import materialise, table
from tracemill.streaming import windows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP))) AS start, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(28,9))) AS DOUBLE), 6) AS amount FROM events GROUP BY ALL""")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts by a stream over the events, driven to its end; the batches' updates are folded to the newest."""
    schema = table(spark, d, "events").schema
    kept: list[DataFrame] = []

    def each(batch: DataFrame, number: int) -> None:
        kept.append(materialise(batch.withColumn("batch", F.lit(number)), "windows"))

    stream = windows.file_stream(spark, d, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    windows.run_available(windows.tumbling(stream, "ts", "event_type", "value", "1 hour", "3650 days"), each, "update")
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return sequence.newest(out, ["start", "event_type"], [F.desc("batch")]).select("start", "event_type", "n", F.round("amount", 6).alias("amount"))


@query("""WITH o AS (SELECT user_id, epoch_us(CAST(ts AS TIMESTAMP)) AS t, lag(epoch_us(CAST(ts AS TIMESTAMP))) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
r AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM o)
SELECT min(t) AS start, user_id, count(*) AS n FROM r GROUP BY user_id, s""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.sessions(e, "ts", "user_id", "30 minutes", "0 seconds")


@query("SELECT event_id, event_type FROM events WHERE event_id > 100")
def incremental_poll(spark: SparkSession, d: str) -> DataFrame:
    return windows.after(table(spark, d, "events"), "event_id", 100).select("event_id", "event_type")




@query(P5_FOUND_SQL)
def batched_changes(spark: SparkSession, d: str) -> DataFrame:
    """The same state as p5_found, from two batches merged, the later one first."""
    feed = review_changes(table(spark, d, "review_actions"))
    late = F.pmod(F.xxhash64("entity_id", "seq"), F.lit(2)) == 0
    apply = windows.ChangeApplier(["is_edge", "entity_id"], "seq", "op", ["from_node", "to_node", "label"])
    apply(feed.filter(late | late.isNull()))
    apply(feed.filter(~late))
    rows = apply.rows()
    return rows.select("entity_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("from_node", "to_node", "label")])


@query(P5_FOUND_SQL.split("SELECT entity_id, coalesce")[0] + """
SELECT is_edge, entity_id, del AS deleted FROM s WHERE del IS NOT NULL AND (ins IS NULL OR ins <= del)""")
def tombstones(spark: SparkSession, d: str) -> DataFrame:
    """Entities whose drop is the last word."""
    state = changes.fold_changes(review_changes(table(spark, d, "review_actions")), ["is_edge", "entity_id"], "seq", "op", ["label"])
    return changes.tombstones(state, ["is_edge", "entity_id"])


@query("""WITH a AS (SELECT fixture, session_id, received_at, ts, op, node_id, edge_id, row_number() OVER (PARTITION BY fixture, session_id ORDER BY received_at DESC NULLS LAST, ts DESC NULLS LAST, op DESC NULLS LAST, node_id DESC NULLS LAST, edge_id DESC NULLS LAST) AS p FROM review_actions)
SELECT fixture, session_id, op, coalesce(node_id, '') AS node_id FROM a WHERE p = 1""")
def undo_last(spark: SparkSession, d: str) -> DataFrame:
    """The action of each session that an undo takes back: the one received last."""
    a = table(spark, d, "review_actions")
    last = sequence.newest(a, ["fixture", "session_id"], [F.desc_nulls_last(c) for c in ("received_at", "ts", "op", "node_id", "edge_id")])
    return last.select("fixture", "session_id", "op", F.coalesce("node_id", F.lit("")).alias("node_id"))


@query("""WITH k AS (SELECT attributes AS a FROM graph_nodes WHERE attributes IS NOT NULL), u AS (SELECT unnest(json_keys(a)) AS key, a FROM k WHERE json_valid(a))
SELECT key, count(*) AS n, count(DISTINCT json_extract_string(a, '$."' || key || '"')) AS kinds FROM u GROUP BY key""")
def attribute_inventory(spark: SparkSession, d: str) -> DataFrame:
    """How often each attribute is given and how many values it has."""
    held = table(spark, d, "graph_nodes").filter("attributes is not null").select(F.explode(F.from_json("attributes", "map<string,string>")).alias("key", "value"))
    return held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("kinds"))


@query("""SELECT fixture, CAST(sum(len(source_annotation_ids)) AS BIGINT) AS given, CAST(sum(len(list_distinct(source_annotation_ids))) AS BIGINT) AS kinds, count(*) FILTER (len(source_annotation_ids) > len(list_distinct(source_annotation_ids))) AS repeated
FROM graph_edges WHERE source_annotation_ids IS NOT NULL AND NOT list_contains(list_transform(source_annotation_ids, lambda x: x IS NULL), true) GROUP BY fixture""")
def evidence_union(spark: SparkSession, d: str) -> DataFrame:
    """Evidence ids of edges, given and distinct."""
    ids = F.col("source_annotation_ids")
    e = table(spark, d, "graph_edges").filter(ids.isNotNull() & ~F.exists(ids, lambda x: x.isNull()))
    kinds = F.size(F.array_distinct(ids))
    return e.groupBy("fixture").agg(F.sum(F.size(ids)).alias("given"), F.sum(kinds).alias("kinds"), F.count(F.when(F.size(ids) > kinds, 1)).alias("repeated"))


@query("""WITH i AS (SELECT DISTINCT node_id FROM graph_nodes WHERE node_id IS NOT NULL), v AS (SELECT DISTINCT node_id, replace(replace(lower(trim(op)), '-', '_'), ' ', '_') AS op FROM review_actions WHERE node_id IS NOT NULL AND op IS NOT NULL)
SELECT coalesce(v.op, 'missing') AS decision, count(*) AS n FROM i LEFT JOIN v USING (node_id) GROUP BY decision""")
def decision_audit(spark: SparkSession, d: str) -> DataFrame:
    """A decision for every node, those without one included."""
    i = table(spark, d, "graph_nodes").filter("node_id is not null").select("node_id").distinct()
    op = F.regexp_replace(F.lower(F.trim("op")), "[ -]", "_")
    v = table(spark, d, "review_actions").filter("node_id is not null and op is not null").select("node_id", op.alias("op")).distinct()
    return i.join(v, "node_id", "left").groupBy(F.coalesce("op", F.lit("missing")).alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT doc_id FROM documents WHERE lang = 'en'), q AS (SELECT doc_id FROM documents WHERE lang = 'de')
SELECT (SELECT count(*) FROM (SELECT doc_id FROM (SELECT * FROM p UNION ALL SELECT * FROM q) GROUP BY doc_id HAVING count(*) > 1)) AS overlapping,
 (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM (SELECT * FROM p UNION ALL SELECT * FROM q))) AS uncovered, 0 AS outside""")
def partition_assertion(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    parts = docs.filter("lang = 'en'").select("doc_id").unionByName(docs.filter("lang = 'de'").select("doc_id"))
    return quality.disjoint_cover(parts, docs, "doc_id").select("overlapping", "uncovered", F.col("outside").cast("int").alias("outside"))


@query("""SELECT p_partkey, CAST(85 + 170 * ceil(floor(w * s1 * s2) / 512) * ceil(floor(h * s1 * s2) / 512) AS BIGINT) AS tokens FROM (SELECT *, least(1.0::DOUBLE, 768.0 / least(w * s1, h * s1)) AS s2 FROM
  (SELECT *, least(1.0::DOUBLE, 2048.0::DOUBLE / greatest(w, h)) AS s1 FROM (SELECT p_partkey, CAST(p_size * 97 + 200 AS INT) AS w, CAST(p_retailprice AS INT) AS h FROM part)))""")
def image_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 97 + 200).cast("int").alias("w"), F.round("p_retailprice").cast("int").alias("h"))
    return p.select("p_partkey", G.image_tokens(F.col("w"), F.col("h")).alias("tokens"))


@query("""SELECT p_partkey, trim(substr(p_name, 1, least(CASE WHEN instr(p_name, ' ') > 0 THEN instr(p_name, ' ') ELSE 9999 END, length(p_name) + 1) - 1)) AS head,
 CASE WHEN ends_with(lower(trim(p_type)), 'valve') THEN 'valve' ELSE 'other' END AS family FROM part""")
def name_heads(spark: SparkSession, d: str) -> DataFrame:
    """Part names up to their first blank, and the broad class of their type."""
    return table(spark, d, "part").select("p_partkey", X.until_marker(F.col("p_name"), [" "]).alias("head"), X.broad_class(F.col("p_type")).alias("family"))


@query("""WITH c AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders) SELECT a.o_orderkey, b.o_orderkey AS previous FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM c) a JOIN c b ON a.p = b.o_orderkey WHERE b.o_totalprice > 250000""")
def as_of_previous(spark: SparkSession, d: str) -> DataFrame:
    """Each order with its customer's order before, where that was large: an as-of join by a window."""
    from pyspark.sql import Window as W

    o = table(spark, d, "orders")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.withColumn("previous", F.lag("o_orderkey").over(w)).withColumn("price", F.lag("o_totalprice").over(w)).filter("price > 250000").select("o_orderkey", "previous")


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
