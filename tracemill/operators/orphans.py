"""References to records that are missing, withdrawn or entered only later.

References and parent rows are co-partitioned by key and sorted by time, and
one linear pass merges both: the running maximum of the ends of all parent
validity intervals that have begun tells whether any of them still holds. Keys
with a large share of all rows are cut into time slices; each slice starts
from the running maximum of the slices before it, which is a small aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.operators.skew import hot_cuts, with_slice
from tracemill.session import parallelism

_OPEN = 9223372036854775807
_NEVER = -9223372036854775807


def orphan_references(refs: DataFrame, parents: DataFrame, rows: int | None = None) -> DataFrame:
    """References that don't hold at their time, with the reason.

    refs: `key` string, `at` bigint (micros) and any further columns. parents:
    `key` string, `begin` bigint, `end` bigint (null: open). A reference holds
    if a parent row with its key has begin <= at and end null or > at. Reasons:
    `missing` (no parent row has the key), `dropped` (one begins at or before
    `at`), else `later`. Null and '' keys are no references. A reference
    without time precedes every parent; a parent without begin never begins
    but counts as a row with the key. Repeated parents change nothing; repeated
    references come out as often as they went in. rows: about how many rows
    both have together, for finding hot keys; counted where not given.
    """
    more = [c for c in refs.columns if c not in ("key", "at")]
    refs = refs.filter(F.col("key").isNotNull() & (F.col("key") != ""))
    parents = parents.filter(F.col("key").isNotNull() & (F.col("key") != ""))
    if rows is None:
        rows = refs.count() + parents.count()
    side = F.struct(*[F.col(c) for c in more]).alias("ref")
    spans = (
        parents.select("key", F.coalesce("begin", F.lit(_OPEN)).alias("at"), F.coalesce("end", F.lit(_OPEN)).alias("end"))
        .groupBy("key", "at")
        .agg(F.max("end").alias("end"))
    )
    asked = refs.select("key", F.coalesce("at", F.lit(_NEVER)).alias("at"), side)
    none = F.lit(None).cast(asked.schema["ref"].dataType)
    both = spans.select("key", "at", "end", none.alias("ref")).unionByName(asked.select("key", "at", F.lit(None).cast("bigint").alias("end"), "ref"))
    bare = refs.select("key", "at").unionByName(parents.select("key", F.col("begin").alias("at")))
    cuts = hot_cuts(bare, F.col("key"), F.col("at"), rows, max(8, parallelism(refs.sparkSession)))
    both = with_slice(both, F.col("key"), F.col("at"), cuts)
    seen = W.partitionBy("key", "slice").orderBy("at", F.col("ref").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    merged = both.withColumn("until", F.max("end").over(seen)).withColumn(
        "known", F.max(F.when(F.col("ref").isNull(), 1)).over(W.partitionBy("key", "slice"))
    )
    if cuts:
        # one row per hot key and slice
        hot = cuts.rows(refs)
        held = spans.join(hot.select(F.col("k").alias("key")), "key", "left_semi")
        per = with_slice(held, F.col("key"), F.col("at"), cuts).groupBy("key", "slice").agg(F.max("end").alias("end"))
        grid = hot.select(F.col("k").alias("key"), F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("slice"))
        before = W.partitionBy("key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
        carried = (
            grid.join(per, ["key", "slice"], "left")
            .withColumn("carried", F.max("end").over(before))
            .withColumn("ever", F.max(F.col("end").isNotNull().cast("int")).over(W.partitionBy("key")))
            .select("key", "slice", "carried", "ever")
        )
        merged = (
            merged.join(carried, ["key", "slice"], "left")
            .withColumn("until", F.greatest("until", "carried"))
            .withColumn("known", F.coalesce(F.nullif(F.col("ever"), F.lit(0)), F.col("known")))
        )
    reason = F.when(F.col("known").isNull(), "missing").when(F.col("until").isNotNull(), "dropped").otherwise("later")
    orphans = merged.filter(F.col("ref").isNotNull() & (F.col("until").isNull() | (F.col("until") <= F.col("at"))))
    return orphans.select(
        "key", F.when(F.col("at") != _NEVER, F.col("at")).alias("at"), reason.alias("reason"), *[F.col("ref")[c].alias(c) for c in more]
    )
