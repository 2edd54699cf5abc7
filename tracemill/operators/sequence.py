"""Ordered analytics: runs, windows of neighbours, newest rows and priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def runs(df: DataFrame, by: list[str], start: Column, end: Column, order: list, most_gap: float) -> DataFrame:
    """Rows with the number of their run: a new run begins where the gap to the furthest end so far exceeds most_gap."""
    w = W.partitionBy(*by).orderBy(*order)
    before = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (start - before > most_gap), 1).otherwise(0)
    return df.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("fresh")


def longest_run(ran: DataFrame, by: list[str], order: str) -> DataFrame:
    """The run of most rows of each group (ties: the earlier): run, rows, first, last."""
    each = ran.groupBy(*by, "run").agg(F.count(F.lit(1)).alias("rows"), F.min(order).alias("first"), F.max(order).alias("last"))
    best = W.partitionBy(*by).orderBy(F.desc("rows"), "run")
    return each.withColumn("place", F.row_number().over(best)).filter("place = 1").drop("place")


def neighbours(df: DataFrame, by: list[str], order: list, value: str, size: int) -> DataFrame:
    """Windows of `size` successive values, as an array; shorter ones at the end don't come."""
    w = W.partitionBy(*by).orderBy(*order)
    parts = [F.col(value), *[F.lead(value, k).over(w) for k in range(1, size)]]
    held = df.withColumn("left", F.count(F.lit(1)).over(W.partitionBy(*by)) - F.row_number().over(w) + 1)
    return held.withColumn("window", F.array(*parts)).filter(F.col("left") >= size).drop("left")


def newest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("place = 1").drop("place")


def numbered(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """Rows numbered from 0 within their key."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def margins(df: DataFrame, keys: list[str], score: str, order: list) -> DataFrame:
    """Best row of each key with its lead over the runner-up (null if there is none)."""
    w = W.partitionBy(*keys).orderBy(F.desc(score), *order)
    ranked = df.withColumn("place", F.row_number().over(w)).withColumn("margin", F.col(score) - F.lead(score).over(w))
    return ranked.filter("place = 1").drop("place")


def edge_keys(edges: DataFrame) -> DataFrame:
    """Undirected identity of edges: sorted ends, type, and polyline ends rounded to 10 pixels, sorted."""
    tens = lambda p: F.transform(p, lambda v: (F.bround(v / 10.0) * 10).cast("int"))
    line = F.col("polyline_global")
    ends = F.when(F.size(line) > 0, F.array_sort(F.array(tens(F.element_at(line, 1)), tens(F.element_at(line, -1)))))
    return (
        edges.withColumn("low_node", F.least("from_node", "to_node"))
        .withColumn("high_node", F.greatest("from_node", "to_node"))
        .withColumn("kind", F.coalesce("line_type", F.lit("other")))
        .withColumn("ends", F.coalesce(F.to_json(ends), F.lit("")))
    )
