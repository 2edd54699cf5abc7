"""Finding hot groups and cutting them into slices of an order column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.session import materialise

#: A group is cut if it has more than this share of all rows or more rows than one task should sort, whichever is less.
HOT_SHARE, TASK_ROWS = 0.002, 5_000_000
#: Rows of the sample that finds hot groups, and rows of it at least that a group of TASK_ROWS has. It decides only where slices are cut, never what a result holds.
SAMPLE_ROWS, SEEN_ROWS = 200_000, 100
#: Cut points that an expression may hold; more are joined from a table.
MOST_LITERALS = 5_000


class Cuts:
    """Ascending cut points of an order column by key: `held` where they are few, else `table` (k, cuts)."""

    def __init__(self, held: dict[str, list] | None, table: DataFrame | None = None):
        self.held, self.table = held, table

    def __bool__(self) -> bool:
        return self.table is not None or bool(self.held)

    def rows(self, df: DataFrame) -> DataFrame:
        """k, cuts of every hot key, as a table."""
        if self.table is not None:
            return self.table
        return df.sparkSession.createDataFrame([(k, [float(c) for c in v]) for k, v in (self.held or {}).items()], "k string, cuts array<double>")


def hot_cuts(df: DataFrame, key: Column, order: Column, rows: int, slices: int) -> Cuts:
    """Cut points of `order` for the keys with too many rows.

    rows: about how many rows df has. A key gets a slice for every half
    TASK_ROWS, 8 at least and `slices` at most. What reaches the driver is at
    most MOST_LITERALS cut points whatever the data; more stay in a written
    table. A missed or superfluous hot key costs balance only.
    """
    fraction = min(1.0, max(SAMPLE_ROWS, rows / TASK_ROWS * SEEN_ROWS) / max(rows, 1))
    picked = df.select(key.alias("k"), order.cast("double").alias("o")).filter("k is not null and o is not null")
    if fraction < 1.0:
        picked = picked.sample(fraction, seed=17)
    least = max(2, int(min(HOT_SHARE * rows, TASK_ROWS) * fraction))
    by = W.partitionBy("k")
    ranked = picked.withColumn("n", F.count(F.lit(1)).over(by)).filter(F.col("n") > least).withColumn("r", F.row_number().over(by.orderBy("o")))
    parts = F.least(F.lit(slices), F.greatest(F.lit(8), F.ceil(F.col("n") * (2 / (fraction * TASK_ROWS)))))
    step = F.floor(F.col("r") * parts / F.col("n")) > F.floor((F.col("r") - 1) * parts / F.col("n"))
    found = materialise(ranked.filter(step & (F.col("r") < F.col("n"))).groupBy("k").agg(F.array_sort(F.collect_set("o")).alias("cuts")), "cuts")
    total = found.agg(F.coalesce(F.sum(F.size("cuts")), F.lit(0))).first()[0]
    if total > MOST_LITERALS:
        return Cuts(None, found)
    return Cuts({r["k"]: list(r["cuts"]) for r in found.collect()})


def with_slice(df: DataFrame, key: Column, order: Column, cuts: Cuts) -> DataFrame:
    """df with `slice`, the number of the slice that a row falls into: 0 for keys that aren't hot.

    Slices are half-open on the left (o <= cut belongs to the lower slice), so
    rows with one order value are never parted.
    """
    below = lambda held: F.coalesce(F.size(F.filter(held, lambda c: c < order)), F.lit(0))
    if cuts.table is not None:
        named = cuts.table.withColumnRenamed("k", "_k").withColumnRenamed("cuts", "_cuts")
        return df.join(named, key == F.col("_k"), "left").withColumn("slice", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(below(F.col("_cuts")))).drop("_k", "_cuts")
    if not cuts.held:
        return df.withColumn("slice", F.lit(0))
    held = F.create_map(*[x for k, v in cuts.held.items() for x in (F.lit(k), F.array(*[F.lit(float(c)) for c in v]))])
    return df.withColumn("slice", F.when(held[key].isNull(), F.lit(0)).otherwise(below(held[key])))
