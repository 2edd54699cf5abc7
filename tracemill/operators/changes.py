"""Applying a feed of inserts, updates and deletes to rebuild the current state.

The fold is commutative and idempotent: per key only maxima are kept, so rows
may arrive repeatedly, late and in any order, and states of disjoint batches
merge into the state of their union. Deleted keys stay in the state as
tombstones, so that a late row that is older than the delete stays without
effect.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERT, UPDATE, DELETE = "insert", "update", "delete"


def fold_changes(changes: DataFrame, keys: list[str], seq: str, op: str, payload: list[str], base: DataFrame | None = None) -> DataFrame:
    """State of every key ever seen, tombstones included.

    changes: one row per change; `op` is insert, update or delete, other values
    change nothing. `seq` orders the changes; at one seq an insert counts before
    an update and an update before a delete, and of two alike the greater
    payload wins. An insert sets the whole payload, nulls too; an update sets
    the payload columns that it carries (null leaves a column as it is) of a
    key that exists. base: rows of an earlier table, older than every change.

    Rows without key (any null key column), seq or op are left out. Columns
    other than those named are ignored. Result: keys, `inserted`, `deleted`
    (largest seq of either, null if none) and `v_<column>` = struct(seq, rank,
    value) of the newest write.
    """
    rows = changes.select(*keys, F.col(seq).alias("_seq"), F.col(op).alias("_op"), *[F.col(c).alias(f"_p_{c}") for c in payload])
    if base is not None:
        oldest = F.lit(None).cast(rows.schema["_seq"].dataType)
        rows = rows.unionByName(
            base.select(*keys, oldest.alias("_seq"), F.lit("base").alias("_op"), *[F.col(c).alias(f"_p_{c}") for c in payload])
        )
    rows = rows.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    rows = rows.filter(((F.col("_op").isin(INSERT, UPDATE, DELETE)) & F.col("_seq").isNotNull()) | (F.col("_op") == "base"))
    rank = F.when(F.col("_op") == "base", 0).when(F.col("_op") == INSERT, 1).otherwise(2)
    inserts, deletes = F.col("_op").isin(INSERT, "base"), F.col("_op") == DELETE

    def newest(c: str) -> Column:
        writes = inserts | ((F.col("_op") == UPDATE) & F.col(f"_p_{c}").isNotNull())
        return F.max(F.when(writes, F.struct(F.col("_seq").alias("seq"), rank.alias("rank"), F.col(f"_p_{c}").alias("value")))).alias(f"v_{c}")

    return rows.groupBy(*keys).agg(
        F.max(F.when(F.col("_op") == INSERT, F.col("_seq"))).alias("inserted"),
        F.max(F.when(deletes, F.col("_seq"))).alias("deleted"),
        F.max(F.col("_op") == "base").alias("based"),
        *[newest(c) for c in payload],
    )


def merge_states(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """State of the union of two batches: the same maxima over the two states."""
    rest = [c for c in left.columns if c not in keys]
    return left.unionByName(right).groupBy(*keys).agg(*[F.max(c).alias(c) for c in rest])


def current_rows(state: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """The rows that exist: inserted later than deleted, with their newest payload."""
    alive = (F.col("inserted").isNotNull() & (F.col("deleted").isNull() | (F.col("inserted") > F.col("deleted")))) | (
        F.col("based") & F.col("deleted").isNull()
    )
    return state.filter(alive).select(*keys, *[F.col(f"v_{c}.value").alias(c) for c in payload])


def tombstones(state: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose delete is the last word; they are kept against late changes."""
    return state.filter(F.col("deleted").isNotNull() & (F.col("inserted").isNull() | (F.col("inserted") <= F.col("deleted")))).select(
        *keys, "deleted"
    )
