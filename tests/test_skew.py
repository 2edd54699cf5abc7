"""Hot groups are cut by share and by size, in an expression or out of a table, and never change a result."""

import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import skew
from tracemill.operators.orphans import orphan_references
from test_orphans import PARENTS, REFS, brute


def rows(rng, n):
    # one key with 30 %, one with 0.15 %
    return [("hot" if rng.random() < 0.3 else "warm" if rng.random() < 0.002 else f"k{rng.randrange(n)}", rng.randrange(1000)) for _ in range(n)]


@pytest.mark.parametrize("most", [0, 5_000])
def test_keys_above_a_number_of_rows_are_cut(spark, monkeypatch, most):
    monkeypatch.setattr(skew, "MOST_LITERALS", most)
    monkeypatch.setattr(skew, "TASK_ROWS", 20)
    data = rows(random.Random(2), 20_000)
    df = spark.createDataFrame(data, "key string, at bigint")
    cuts = skew.hot_cuts(df, F.col("key"), F.col("at"), len(data), 64)
    assert (cuts.table is None) == (most > 0)
    got = skew.with_slice(df, F.col("key"), F.col("at"), cuts).groupBy("key", "slice").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")).collect()
    held = {}
    for r in got:
        held.setdefault(r["key"], []).append((r["slice"], r["n"], r["lo"], r["hi"]))
    assert len(held["hot"]) > 30 and len(held["warm"]) >= 4
    for parts in held.values():
        parts.sort()
        assert all(a[3] < b[2] for a, b in zip(parts, parts[1:]))  # no order value is parted
    assert sum(r["n"] for r in got) == len(data)


def test_without_hot_keys(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", None)], "key string, at bigint")
    cuts = skew.hot_cuts(df, F.col("key"), F.col("at"), 3, 8)
    assert not cuts and [r["slice"] for r in skew.with_slice(df, F.col("key"), F.col("at"), cuts).collect()] == [0, 0, 0]
    empty = df.limit(0)
    assert skew.with_slice(empty, F.col("key"), F.col("at"), skew.hot_cuts(empty, F.col("key"), F.col("at"), 0, 8)).count() == 0


def test_orphans_with_cuts_from_a_table(spark, monkeypatch):
    monkeypatch.setattr(skew, "MOST_LITERALS", 0)
    rng = random.Random(5)
    keys = ["hot"] * 40 + [f"k{i}" for i in range(20)] + ["", None, "nobody"]
    parents = [(rng.choice(keys[:-1]), rng.choice([None, *range(50)]), rng.choice([None, *range(60)]), "x") for _ in range(150)]
    refs = [(rng.choice(keys), rng.choice([None, *range(55)]), f"r{i}", None) for i in range(500)]
    got = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(refs, parents)
