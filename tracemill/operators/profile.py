"""Column profiles of loads, and the loads that depart from their feed.

Values are unpivoted, counted per (feed, stratum, column, load, value) before
any shuffle, and sorted by value within each feed's column. Prefix counts over
that order are the cumulative curves of the feed and of each load: they give
exact distinct counts, exact quantiles, and the exact two-sample
Kolmogorov-Smirnov distance of each load from the rest of its feed. Feeds with
a large share of all rows are cut into value slices, whose prefix counts start
from the totals of the slices below.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.operators.skew import hot_cuts, with_slice
from tracemill.session import parallelism

#: Scaled KS distance beyond which chance is no explanation (asymptotic p about 3e-6).
KS_LIMIT = 2.6
#: Standard errors by which a rate (nulls, outlying values, integral values) must depart, and by how much at least.
RATE_LIMIT, RATE_STEP = 6.5, 0.05
#: Rows by which a rate must depart at least; below, the normal error of a rate means little.
RATE_ROWS = 8
#: Share of the rest of the feed beyond each end that counts as outlying.
TAIL = 0.025
KEYS = ["feed", "stratum", "column_name"]


def unpivot_measures(results: DataFrame, measures: list[str], feed: str = "feed", load: str = "load_id", stratum: str = "phase") -> DataFrame:
    """feed, load_id, stratum, column_name, value (double; NaN is null). Rows without load are left out; a null feed or stratum is a group of its own."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("value")) for c in measures])
    return results.filter(F.col(load).isNotNull()).select(
        F.coalesce(F.col(feed).cast("string"), F.lit("")).alias("feed"),
        F.col(load).cast("string").alias("load_id"),
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
        F.inline(pairs),
    )


def load_profiles(values: DataFrame, rows: int) -> DataFrame:
    """One row per feed, stratum, column and load.

    rows, nulls, distinct_values, low, q1, median, q3, high, negative, zero and
    integral shares; the same of the rest of the feed for nulls and integral;
    ks (distance from the rest, null without values on either side) and scaled
    ks; outlying (share of values beyond the rest's outer TAIL shares). Repeated
    rows count as often as they come; ties share one step of the curves.
    rows: about how many values there are, for finding hot feeds.
    """
    counted = values.groupBy(*KEYS, "load_id", "value").agg(F.count(F.lit(1)).alias("c"))
    here, all_ = W.partitionBy(*KEYS, "load_id"), W.partitionBy(*KEYS)
    nulls = (
        counted.groupBy(*KEYS, "load_id")
        .agg(
            F.sum("c").alias("rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("c"))), F.lit(0)).alias("nulls"),
            F.coalesce(F.sum(F.when(F.col("value") == F.floor("value"), F.col("c"))), F.lit(0)).alias("integral"),
        )
        .withColumn("rest_rows", F.sum("rows").over(all_) - F.col("rows"))
        .withColumn("rest_nulls", F.sum("nulls").over(all_) - F.col("nulls"))
        .withColumn("rest_integral", F.sum("integral").over(all_) - F.col("integral"))
    )
    key = F.concat_ws("\x1f", *KEYS)
    cuts = hot_cuts(values, key, F.col("value"), rows, max(8, parallelism(values.sparkSession)))
    sliced = with_slice(counted.filter("value is not null"), key, F.col("value"), cuts)
    below = sliced.groupBy(*KEYS, "slice", "load_id").agg(F.sum("c").alias("n"))
    up_to = [W.unboundedPreceding, -1]
    totals = below.groupBy(*KEYS, "slice").agg(F.sum("n").alias("n")).select(
        *KEYS,
        "slice",
        F.coalesce(F.sum("n").over(W.partitionBy(*KEYS).orderBy("slice").rowsBetween(*up_to)), F.lit(0)).alias("all_below"),
        F.sum("n").over(W.partitionBy(*KEYS)).alias("all_n"),
    )
    offsets = below.select(
        *KEYS,
        "slice",
        "load_id",
        F.coalesce(F.sum("n").over(W.partitionBy(*KEYS, "load_id").orderBy("slice").rowsBetween(*up_to)), F.lit(0)).alias("load_below"),
        F.sum("n").over(here).alias("load_n"),
    ).join(totals, [*KEYS, "slice"])
    at = W.partitionBy(*KEYS, "slice").orderBy("value")
    curve = W.partitionBy(*KEYS, "slice", "load_id").orderBy("value")
    ranked = (
        sliced.withColumn("all_le", F.sum("c").over(at.rangeBetween(W.unboundedPreceding, W.currentRow)))
        .withColumn("all_eq", F.sum("c").over(at.rangeBetween(W.currentRow, W.currentRow)))
        .withColumn("load_le", F.sum("c").over(curve.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .join(offsets, [*KEYS, "slice", "load_id"])
    )
    le, lt = F.col("load_below") + F.col("load_le"), F.col("load_below") + F.col("load_le") - F.col("c")
    ale, alt = F.col("all_below") + F.col("all_le"), F.col("all_below") + F.col("all_le") - F.col("all_eq")
    n, m = F.col("load_n"), F.nullif(F.col("all_n") - F.col("load_n"), F.lit(0))
    rest_le, rest_lt = (ale - le) / m, (alt - lt) / m

    def quantile(q: float) -> Column:
        return F.min(F.when(le >= F.ceil(F.lit(q) * n), F.col("value")))

    curves = ranked.groupBy(*KEYS, "load_id").agg(
        F.count(F.lit(1)).alias("distinct_values"),
        F.min("value").alias("low"),
        quantile(0.25).alias("q1"),
        quantile(0.5).alias("median"),
        quantile(0.75).alias("q3"),
        F.max("value").alias("high"),
        (F.sum(F.when(F.col("value") < 0, F.col("c")).otherwise(0)) / F.first(n)).alias("negative"),
        (F.sum(F.when(F.col("value") == 0, F.col("c")).otherwise(0)) / F.first(n)).alias("zero"),
        F.max(F.greatest(F.abs(le / n - rest_le), F.abs(lt / n - rest_lt))).alias("ks"),
        (F.sum(F.when((rest_le <= TAIL) | (rest_lt >= 1 - TAIL), F.col("c")).otherwise(0)) / F.first(n)).alias("outlying"),
        F.first(F.sqrt(n * m / (n + m))).alias("scale"),
    )
    return nulls.join(curves, [*KEYS, "load_id"], "left").withColumn("scaled_ks", F.col("ks") * F.col("scale")).drop("scale")


def _rate_departs(x: Column, n: Column, rest_x: Column, rest_n: Column) -> Column:
    """Whether a count of n departs from the rest's rate, by the pooled error of both."""
    n, rest_n = F.nullif(n, F.lit(0)), F.nullif(rest_n, F.lit(0))
    p = (rest_x + 1) / (rest_n + 2)
    off = F.abs(x / n - p)
    return (off > RATE_STEP) & (off * n > RATE_ROWS) & (off > F.lit(RATE_LIMIT) * F.sqrt(p * (1 - p) * (1 / n + 1 / rest_n)))


def departing_loads(profiles: DataFrame) -> DataFrame:
    """Profiles with `reasons`, the ways in which a load departs from the other loads of its feed; only those with one.

    Reasons: distribution (scaled KS), outlying (share of values in the rest's
    tails), nulls, form (share of integral values). Loads that are alone in
    their feed and stratum never depart.
    """
    filled, rest_filled = F.col("rows") - F.col("nulls"), F.col("rest_rows") - F.col("rest_nulls")
    reasons = F.filter(
        F.array(
            F.when(F.col("scaled_ks") > KS_LIMIT, "distribution"),
            F.when(_rate_departs(F.col("outlying") * filled, filled, F.lit(2 * TAIL) * rest_filled, rest_filled), "outlying"),
            F.when(_rate_departs(F.col("nulls"), F.col("rows"), F.col("rest_nulls"), F.col("rest_rows")), "nulls"),
            F.when(_rate_departs(F.col("integral"), filled, F.col("rest_integral"), rest_filled), "form"),
        ),
        lambda r: r.isNotNull(),
    )
    return profiles.withColumn("reasons", reasons).filter(F.size("reasons") > 0)


def ks_chance(scaled: float) -> float:
    """Asymptotic probability that chance alone gives a scaled KS distance this large."""
    return min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * scaled * scaled) for k in range(1, 30)))
