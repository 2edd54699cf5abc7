"""Constraint rules: each gives rows of rule, path, severity; packs are unions of rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issue(df: DataFrame, rule: str, path: Column, severity: str = "error") -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), path.cast("string").alias("path"), F.lit(severity).alias("severity"))


def unique(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Keys that come more than once."""
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return issue(many, rule, F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))


def required(df: DataFrame, column: Column, path: Column, rule: str, severity: str = "error") -> DataFrame:
    """Rows whose column is null or blank."""
    return issue(df.filter(column.isNull() | (F.trim(column.cast("string")) == "")), rule, path, severity)


def one_of(df: DataFrame, column: Column, allowed: list[str], path: Column, rule: str) -> DataFrame:
    """Rows whose column isn't null and not allowed."""
    return issue(df.filter(column.isNotNull() & ~column.isin(allowed)), rule, path)


def foreign_key(df: DataFrame, column: str, parents: DataFrame, key: str, path: Column, rule: str) -> DataFrame:
    """Rows whose non-null reference has no parent."""
    held = parents.select(F.col(key).alias("_k")).filter("_k is not null").distinct()
    left = df.filter(F.col(column).isNotNull()).withColumn("_path", path)
    return issue(left.join(held, F.col(column) == F.col("_k"), "left_anti"), rule, F.col("_path"))


def matches(df: DataFrame, column: Column, pattern: str, path: Column, rule: str) -> DataFrame:
    """Rows whose column isn't null and doesn't match."""
    return issue(df.filter(column.isNotNull() & ~column.rlike(pattern)), rule, path)


def pack(*rules: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), rules)


def difference(declared: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """key, side: what is declared but not present, and the other way round."""
    a, b = declared.select(key).distinct(), present.select(key).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("undeclared")))


def conflicts(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """Keys with more than one distinct non-null value: key, kinds."""
    return df.filter(key.isNotNull()).groupBy(key.alias("key")).agg(F.countDistinct(value).alias("kinds")).filter("kinds > 1")


def disjoint_cover(parts: DataFrame, domain: DataFrame, key: str) -> DataFrame:
    """One row: overlapping keys, keys of the domain that no part has, and keys outside the domain."""
    each = parts.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    both = each.join(domain.select(key).distinct().withColumn("d", F.lit(True)), key, "full")
    return both.agg(
        F.count(F.when(F.col("n") > 1, 1)).alias("overlapping"), F.count(F.when(F.col("n").isNull(), 1)).alias("uncovered"), F.count(F.when(F.col("d").isNull(), 1)).alias("outside")
    )
