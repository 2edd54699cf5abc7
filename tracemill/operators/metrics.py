"""Evaluation metrics over fact tables: means, pivots, totals, run-over-run differences, pools and votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FAMILIES = ["inventory", "counting", "connectivity", "identification"]
PHASE2_METRICS = ["phase2_equipment_f1", "phase2_instrument_f1", "phase2_opc_f1", "phase2_tag_exact", "phase2_edge_f1"]
TOTALS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "image_tokens", "n_steps", "n_tool_calls", "retries"]


def exact_sum(c: Column, scale: int = 9) -> Column:
    """Sum that doesn't depend on the order of its rows: over decimals, given as double."""
    return F.sum(c.cast(f"decimal(28,{scale})")).cast("double")


def exact_mean(c: Column) -> Column:
    return exact_sum(c) / F.count(c)


def family_means(facts: DataFrame, condition: str) -> DataFrame:
    """fixture, family, score (mean), n_trials (distinct) of phase 1 under a condition."""
    sub = facts.filter((F.col("phase") == 1) & (F.col("run_condition") == condition))
    return sub.groupBy("fixture", "family").agg(exact_mean(F.col("score")).alias("score"), F.countDistinct("trial").alias("n_trials"))


def family_table(facts: DataFrame, condition: str) -> DataFrame:
    """One row per fixture: a column per family, their mean over those there are, cost and latency; and a macro row.

    The macro row holds means of means, sums of totals and medians of medians;
    it is no roll-up. Fixtures and families that are null are left out.
    """
    sub = facts.filter((F.col("phase") == 1) & (F.col("run_condition") == condition) & F.col("fixture").isNotNull())
    wide = sub.groupBy("fixture").agg(
        *[exact_mean(F.when(F.col("family") == f, F.col("score"))).alias(f) for f in FAMILIES],
        exact_sum(F.col("cost_usd")).alias("cost_total"),
        F.median("cost_usd").alias("cost_median"),
        F.median("wall_clock_s").alias("latency_median"),
        F.sum("input_tokens").alias("input_tokens_total"),
        F.count(F.lit(1)).alias("n_calls"),
    )
    there = reduce(lambda a, b: a + b, [F.when(F.col(f).isNotNull(), 1).otherwise(0) for f in FAMILIES])
    total = reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(0.0)) for f in FAMILIES])
    wide = wide.withColumn("overall", F.when(there > 0, total / there))
    macro = wide.agg(
        F.lit("macro").alias("fixture"),
        *[exact_mean(F.col(f)).alias(f) for f in FAMILIES],
        exact_sum(F.col("cost_total")).alias("cost_total"),
        F.median("cost_median").alias("cost_median"),
        F.median("latency_median").alias("latency_median"),
        F.sum("input_tokens_total").alias("input_tokens_total"),
        F.sum("n_calls").alias("n_calls"),
        exact_mean(F.col("overall")).alias("overall"),
    )
    return wide.unionByName(macro)


def metric_table(facts: DataFrame, condition: str) -> DataFrame:
    """One row per fixture of phase 2: the mean of each metric, null where it has none."""
    sub = facts.filter((F.col("phase") == 2) & (F.col("run_condition") == condition))
    return sub.groupBy("fixture").agg(*[exact_mean(F.when(F.col("metric_kind") == m, F.col("score"))).alias(m) for m in PHASE2_METRICS])


def billable(facts: DataFrame, run_metric: str = "phase2_run") -> DataFrame:
    """Rows that carry a cost of their own: phase 1, and the run rows of phase 2."""
    return facts.filter((F.col("phase") == 1) | ((F.col("phase") == 2) & (F.col("metric_kind") == run_metric)))


def phase_totals(facts: DataFrame, by: list[str]) -> DataFrame:
    """Null-safe sums of cost, time and counts per group and phase, and `total` over both phases. A group without rows has none."""
    rows = billable(facts)
    both = rows.withColumn("part", F.explode(F.array(F.concat(F.lit("phase"), F.col("phase").cast("string")), F.lit("total"))))
    return both.groupBy(*by, "part").agg(
        F.coalesce(exact_sum(F.col("cost_usd")), F.lit(0.0)).alias("cost_usd"),
        F.coalesce(exact_sum(F.col("wall_clock_s")), F.lit(0.0)).alias("wall_clock_s"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in TOTALS],
        F.count(F.lit(1)).alias("n_calls"),
    )


def run_differences(before: DataFrame, after: DataFrame, keys: list[str], sigmas: float = 2.0, null_safe: bool = True) -> DataFrame:
    """Groups whose mean moved by `sigmas` standard deviations or more, of the larger of both runs.

    The deviation is that of a sample, 0 for a single row; at 0 any change
    beyond 1e-9 counts. Groups in one run only don't. null_safe: null keys are
    groups like any (the default); without it rows with a null key are dropped
    before, as grouped data frames do.
    """

    def per(df: DataFrame, side: str) -> DataFrame:
        if not null_safe:
            df = df.dropna(subset=keys)
        return df.groupBy(*keys).agg(
            exact_mean(F.col("score")).alias(f"score_{side}"), F.count(F.lit(1)).alias(f"n_{side}"), F.stddev_samp("score").alias(f"sd_{side}")
        )

    a, b = per(before, "prev").alias("a"), per(after, "curr").alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    sd = F.greatest(F.coalesce(F.nanvl("sd_prev", F.lit(0.0)), F.lit(0.0)), F.coalesce(F.nanvl("sd_curr", F.lit(0.0)), F.lit(0.0)))
    moved = a.join(b, on).select(*[F.col(f"a.{k}").alias(k) for k in keys], "score_prev", "score_curr", "n_prev", "n_curr", sd.alias("sd"))
    moved = moved.withColumn("delta", F.col("score_curr") - F.col("score_prev"))
    flagged = F.when(F.col("sd") == 0, F.abs("delta") > 1e-9).otherwise(F.abs("delta") >= sigmas * F.col("sd"))
    return moved.filter(flagged)


def json_map_sums(facts: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Sums per key of JSON maps of counts; null, empty and damaged ones count nothing."""
    held = facts.select(*by, F.explode(F.from_json(column, "map<string,bigint>")).alias("key", "n"))
    return held.groupBy(*by, "key").agg(F.sum("n").alias("n"))


def prf(tp: Column, predicted: Column, actual: Column, undefined: Column) -> tuple[Column, Column, Column]:
    """precision, recall, F1 from counts; `undefined` (0.0 or null) where a denominator is 0."""
    p = F.when(predicted > 0, tp / predicted).otherwise(undefined)
    r = F.when(actual > 0, tp / actual).otherwise(undefined)
    f = F.when(predicted + actual > 0, 2.0 * tp / (predicted + actual)).otherwise(undefined)
    return p, r, f


def pooled(counts: DataFrame, by: list[str]) -> DataFrame:
    """Micro metrics over pooled tp, predicted, actual, and the mean F1 of the rows, an undefined one as 0."""
    none = F.lit(None).cast("double")
    each = counts.withColumn("f", prf(F.col("tp"), F.col("predicted"), F.col("actual"), F.lit(0.0))[2])
    p, r, f = prf(F.col("tp"), F.col("predicted"), F.col("actual"), none)
    sums = each.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("actual").alias("actual"), exact_mean(F.col("f")).alias("macro_f1"))
    return sums.withColumn("precision", p).withColumn("recall", r).withColumn("micro_f1", f)


def set_scores(expected: Column, actual: Column) -> tuple[Column, Column, Column, Column]:
    """tp, fp, fn and F1 of two arrays as sets; two empty sets score 1."""
    e, a = F.array_distinct(expected), F.array_distinct(actual)
    tp = F.size(F.array_intersect(e, a))
    fp, fn = F.size(F.array_except(a, e)), F.size(F.array_except(e, a))
    f1 = F.when(tp + fp + fn == 0, 1.0).otherwise(2.0 * tp / (2 * tp + fp + fn))
    return tp, fp, fn, f1


def within_tolerance(expected: Column, actual: Column, tolerance: float) -> Column:
    """1 if the relative error is at most `tolerance`; an expected 0 needs exactly 0; 0 for nulls."""
    ok = F.when(expected == 0, actual == 0).otherwise(F.abs(actual - expected) / F.abs(expected) <= tolerance)
    return F.when(ok, 1.0).otherwise(0.0)


def weighted_mode(df: DataFrame, by: list[str], value: str, weight: Column, order: list[Column]) -> DataFrame:
    """Value of greatest total weight (at least 1 a row, rounded half even); ties go to the one that comes first."""
    w = F.greatest(F.lit(1.0), F.bround(weight)).cast("bigint")
    votes = df.groupBy(*by, value).agg(F.sum(w).alias("votes"), F.min(F.struct(*order)).alias("first"))
    best = W.partitionBy(*by).orderBy(F.desc("votes"), "first")
    return votes.withColumn("place", F.row_number().over(best)).filter("place = 1").select(*by, value, "votes")


def upper_median(c: str) -> Column:
    """The middle of the ordered values, the upper of two; null if there are none."""
    return F.get(F.array_sort(F.collect_list(c)), F.floor(F.count(c) / 2).cast("int"))


def one_distinct(c: Column) -> Column:
    """The value if a group has exactly one non-empty one, case and blanks aside, else null; the least spelling."""
    key = F.nullif(F.lower(F.trim(c)), F.lit(""))
    return F.when(F.countDistinct(key) == 1, F.min(F.when(key.isNotNull(), F.trim(c))))


def unanimous(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Groups whose non-null values all agree: value, samples, confidence by samples (3 high, 2 medium, 1 low)."""
    g = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.countDistinct(value).alias("kinds"), F.min(value).alias(value), F.count(F.lit(1)).alias("samples"))
    return g.filter("kinds = 1").select(*by, value, "samples", F.when(F.col("samples") >= 3, "high").when(F.col("samples") == 2, "medium").otherwise("low").alias("vote"))


def error_rate(pairs: DataFrame, by: list[str], reference: str, prediction: str) -> DataFrame:
    """Edit distance over reference characters, pooled per group; null without reference characters. A null side counts as ''."""
    r, p = F.coalesce(reference, F.lit("")), F.coalesce(prediction, F.lit(""))
    sums = pairs.groupBy(*by).agg(F.sum(F.levenshtein(r, p)).alias("edits"), F.sum(F.length(r)).alias("chars"))
    return sums.withColumn("error_rate", F.when(F.col("chars") > 0, F.col("edits") / F.col("chars")))


def deltas_to(df: DataFrame, by: list[str], mode: str, base: str, values: list[str]) -> DataFrame:
    """Totals per mode less those of the base mode of the same group."""
    totals = df.groupBy(*by, mode).agg(*[exact_sum(F.col(v)).alias(v) for v in values])
    at = totals.filter(F.col(mode) == base).select(*by, *[F.col(v).alias(f"base_{v}") for v in values])
    return totals.join(at, by).select(*by, mode, *[F.col(v) for v in values], *[(F.col(v) - F.col(f"base_{v}")).alias(f"delta_{v}") for v in values])


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def upper_bound_check(df: DataFrame, value: Column) -> DataFrame:
    """Rows that break value's validity: null, NaN, infinite or outside 0 to 1."""
    return df.filter(value.isNull() | F.isnan(value) | (value < 0) | (value > 1))
