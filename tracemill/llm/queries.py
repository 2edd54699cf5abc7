"""Queries p4, p8, p9 and p10 over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import canonical, leakage, packing, spans
from tracemill.session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.node_entries(table(spark, d, "graph_nodes"), table(spark, d, "canonical_values"))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_targets"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each target are, and how even their cost."""
    return packing.fill_report(p8_pack(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.filter("words > 0").select("doc_id", "item_id").distinct()


def p9_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an item's template with other values in its slots."""
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.filter("words = 0").select("doc_id", "item_id", "slots", "changed_slots").distinct()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_chars(table(spark, d, "documents"))


def p10_passages(spark: SparkSession, d: str) -> DataFrame:
    """Fuzzy passages of pairs of documents: chains of exact stretches, what stands between them aligned.

    What stands in many places is linked to one other document that has it, not
    to all; a copy of a whole text is linked to the lowest document of its text.
    """
    found = spans.Shared(table(spark, d, "documents"), linked=True)
    chained = found.passages(found.matches().unionByName(found.links()), overlap=True)
    rows = found.aligned(chained.unionByName(found.copy_passages()))
    return rows.select("a", "b", "from_a", "to_a", "from_b", "to_b", "matched", F.size("stretches").alias("stretches"), "edits", F.round("identity", 6).alias("identity"))


def queries() -> dict:
    return {f.__name__: f for f in (p4_found, p8_pack, p8_fill, p9_found, p9_reparameterised, p10_found, p10_passages)}


P10_FOUND_SQL = """
WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 400),
w AS (SELECT doc_id, p, hash(substr(text, p, 400)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS p FROM t)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM w JOIN s USING (h))
SELECT doc_id, CAST(sum(least(400, p - coalesce(q, -400))) AS BIGINT) AS shared_chars FROM c GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"p10_found": P10_FOUND_SQL}
