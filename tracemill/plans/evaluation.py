"""Queries over the evaluation fact table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import geometry as G
from tracemill.functions import text as X
from tracemill.operators import metrics as M
from tracemill.operators import sequence as S
from tracemill.session import table

R6 = lambda c, name=None: F.round(c, 6).alias(name or c)
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
SELECT fixture, family, round(CAST(sum(CAST(score AS DECIMAL(28,9))) AS DOUBLE) / count(score), 6) AS score, count(DISTINCT trial) AS n_trials
FROM results WHERE phase = 1 AND run_condition = 'baseline' GROUP BY fixture, family""")
def eval_long_mean(spark: SparkSession, d: str) -> DataFrame:
    return M.family_means(table(spark, d, "results"), "baseline").select("fixture", "family", R6("score"), "n_trials")


@query("""
WITH w AS (SELECT fixture,
  CAST(sum(CAST(score AS DECIMAL(28,9))) FILTER (family = 'inventory') AS DOUBLE) / nullif(count(score) FILTER (family = 'inventory'), 0) AS inventory,
  CAST(sum(CAST(score AS DECIMAL(28,9))) FILTER (family = 'counting') AS DOUBLE) / nullif(count(score) FILTER (family = 'counting'), 0) AS counting,
  CAST(sum(CAST(score AS DECIMAL(28,9))) FILTER (family = 'connectivity') AS DOUBLE) / nullif(count(score) FILTER (family = 'connectivity'), 0) AS connectivity,
  CAST(sum(CAST(score AS DECIMAL(28,9))) FILTER (family = 'identification') AS DOUBLE) / nullif(count(score) FILTER (family = 'identification'), 0) AS identification,
  CAST(sum(CAST(cost_usd AS DECIMAL(28,9))) AS DOUBLE) AS cost_total, median(cost_usd) AS cost_median, median(wall_clock_s) AS latency_median,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens_total, count(*) AS n_calls
  FROM results WHERE phase = 1 AND run_condition = 'baseline' AND fixture IS NOT NULL GROUP BY fixture),
o AS (SELECT *, (coalesce(inventory, 0) + coalesce(counting, 0) + coalesce(connectivity, 0) + coalesce(identification, 0)) /
  nullif((inventory IS NOT NULL)::INT + (counting IS NOT NULL)::INT + (connectivity IS NOT NULL)::INT + (identification IS NOT NULL)::INT, 0) AS overall FROM w),
u AS (SELECT fixture, inventory, counting, connectivity, identification, overall, cost_total, cost_median, latency_median, input_tokens_total, n_calls FROM o
  UNION ALL SELECT 'macro', avg(inventory), avg(counting), avg(connectivity), avg(identification), avg(overall), sum(cost_total), median(cost_median),
  median(latency_median), CAST(sum(input_tokens_total) AS BIGINT), CAST(sum(n_calls) AS BIGINT) FROM o)
SELECT fixture, round(inventory, 6) AS inventory, round(counting, 6) AS counting, round(connectivity, 6) AS connectivity, round(identification, 6) AS identification,
  round(overall, 6) AS overall, round(cost_total, 6) AS cost_total, round(cost_median, 9) AS cost_median, round(latency_median, 9) AS latency_median, input_tokens_total, n_calls FROM u""")
def eval_fact_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = M.family_table(table(spark, d, "results"), "baseline")
    medians = [F.round(c, 9).alias(c) for c in ("cost_median", "latency_median")]
    return wide.select("fixture", *[R6(c) for c in (*M.FAMILIES, "overall", "cost_total")], *medians, "input_tokens_total", "n_calls")


@query("""
SELECT fixture, """ + ", ".join(
    f"round(CAST(sum(CAST(score AS DECIMAL(28,9))) FILTER (metric_kind = '{m}') AS DOUBLE) / nullif(count(score) FILTER (metric_kind = '{m}'), 0), 6) AS {m}" for m in M.PHASE2_METRICS
) + " FROM results WHERE phase = 2 AND run_condition = 'baseline' GROUP BY fixture")
def conditional_metric_pivot(spark: SparkSession, d: str) -> DataFrame:
    return M.metric_table(table(spark, d, "results"), "baseline").select("fixture", *[R6(m) for m in M.PHASE2_METRICS])


_TOTALS_SQL = """
WITH b AS (SELECT * FROM results WHERE phase = 1 OR (phase = 2 AND metric_kind = 'phase2_run')),
p AS (SELECT *, 'phase' || CAST(phase AS VARCHAR) AS part FROM b UNION ALL SELECT *, 'total' FROM b)
SELECT {by}part, round(coalesce(CAST(sum(CAST(cost_usd AS DECIMAL(28,9))) AS DOUBLE), 0), 6) AS cost_usd,
  round(coalesce(CAST(sum(CAST(wall_clock_s AS DECIMAL(28,9))) AS DOUBLE), 0), 6) AS wall_clock_s, """ + ", ".join(
    f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in M.TOTALS
) + ", count(*) AS n_calls FROM p GROUP BY {by}part"


@query(_TOTALS_SQL.replace("{by}", ""))
def run_totals(spark: SparkSession, d: str) -> DataFrame:
    t = M.phase_totals(table(spark, d, "results"), [])
    return t.select("part", R6("cost_usd"), R6("wall_clock_s"), *M.TOTALS, "n_calls")


@query(_TOTALS_SQL.replace("{by}", "run_condition, "))
def totals_by_condition(spark: SparkSession, d: str) -> DataFrame:
    t = M.phase_totals(table(spark, d, "results"), ["run_condition"])
    return t.select("run_condition", "part", R6("cost_usd"), R6("wall_clock_s"), *M.TOTALS, "n_calls")


KEYS = ["run_condition", "fixture", "metric_kind", "family"]


@query("""
WITH a AS (SELECT run_condition, fixture, metric_kind, family, CAST(sum(CAST(score AS DECIMAL(28,9))) AS DOUBLE) / nullif(count(score), 0) AS s, count(*) AS n, coalesce(stddev_samp(score), 0) AS sd
  FROM results WHERE loaded_at < TIMESTAMPTZ '2025-07-01 00:00:00+00' GROUP BY ALL),
b AS (SELECT run_condition, fixture, metric_kind, family, CAST(sum(CAST(score AS DECIMAL(28,9))) AS DOUBLE) / nullif(count(score), 0) AS s, count(*) AS n, coalesce(stddev_samp(score), 0) AS sd
  FROM results WHERE loaded_at >= TIMESTAMPTZ '2025-07-01 00:00:00+00' GROUP BY ALL),
m AS (SELECT b.run_condition, b.fixture, b.metric_kind, b.family, a.n AS n_prev, b.n AS n_curr, b.s - a.s AS delta, greatest(a.sd, b.sd) AS sd
  FROM a JOIN b ON a.run_condition IS NOT DISTINCT FROM b.run_condition AND a.fixture IS NOT DISTINCT FROM b.fixture
  AND a.metric_kind IS NOT DISTINCT FROM b.metric_kind AND a.family IS NOT DISTINCT FROM b.family)
SELECT run_condition, fixture, metric_kind, family, n_prev, n_curr, round(delta, 6) AS delta, round(sd, 6) AS sd FROM m
WHERE CASE WHEN sd = 0 THEN abs(delta) > 1e-9 ELSE abs(delta) >= 2 * sd END""")
def sigma_diff(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "results")
    half = F.col("loaded_at") < F.lit("2025-07-01T00:00:00Z").cast("timestamp")
    return M.run_differences(r.filter(half), r.filter(~half), KEYS).select(*KEYS, "n_prev", "n_curr", R6("delta"), R6("sd"))


@query("""
WITH u AS (SELECT run_condition, unnest(json_keys(tool_call_counts_json)) AS key, tool_call_counts_json AS j FROM results WHERE json_valid(tool_call_counts_json) AND json_type(tool_call_counts_json) = 'OBJECT')
SELECT run_condition, key, CAST(sum(CAST(json_extract(j, '$."' || key || '"') AS BIGINT)) AS BIGINT) AS n FROM u GROUP BY run_condition, key""")
def json_map_sum(spark: SparkSession, d: str) -> DataFrame:
    return M.json_map_sums(table(spark, d, "results"), "tool_call_counts_json", ["run_condition"])


@query("""
WITH t AS (SELECT fixture, list_distinct(list(metric_kind) FILTER (phase = 1)) AS e, list_distinct(list(metric_kind) FILTER (score >= 0.9)) AS a FROM results GROUP BY fixture),
c AS (SELECT fixture, coalesce(len(list_intersect(coalesce(e, []), coalesce(a, []))), 0) AS tp, coalesce(len(e), 0) AS ne, coalesce(len(a), 0) AS na FROM t)
SELECT fixture, CAST(tp AS INT) AS tp, CAST(na - tp AS INT) AS fp, CAST(ne - tp AS INT) AS fn, round(CASE WHEN ne + na - tp = 0 THEN 1.0 ELSE 2.0 * tp / (ne + na) END, 6) AS f1 FROM c""")
def set_prf(spark: SparkSession, d: str) -> DataFrame:
    """Metric kinds of phase 1 against those that ever score 0.9, per fixture, as sets."""
    sets = table(spark, d, "results").groupBy("fixture").agg(
        F.collect_set(F.when(F.col("phase") == 1, F.col("metric_kind"))).alias("e"), F.collect_set(F.when(F.col("score") >= 0.9, F.col("metric_kind"))).alias("a")
    )
    tp, fp, fn, f1 = M.set_scores(F.col("e"), F.col("a"))
    return sets.select("fixture", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.round(f1, 6).alias("f1"))


@query("""
WITH a AS (SELECT n_nationkey, n_name, round(avg(c_acctbal), 2) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT n_name, count(*) AS n, CAST(sum(CASE WHEN CASE WHEN mean = 0 THEN c_acctbal = 0 ELSE abs(c_acctbal - mean) / abs(mean) <= 0.25 END THEN 1 ELSE 0 END) AS BIGINT) AS within
FROM customer JOIN a ON c_nationkey = n_nationkey GROUP BY n_name""")
def numeric_tolerance(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    mean = c.groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 2).alias("mean"))
    scored = c.join(mean, "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return scored.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.sum(M.within_tolerance(F.col("mean"), F.col("c_acctbal"), 0.25)).cast("bigint").alias("within"))


@query("""
WITH c AS (SELECT run_condition, fixture, count(*) FILTER (score >= 0.8) AS tp, count(score) AS predicted, count(*) AS actual FROM results WHERE phase = 2 GROUP BY ALL),
s AS (SELECT run_condition, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(predicted) AS BIGINT) AS predicted, CAST(sum(actual) AS BIGINT) AS actual,
  round(avg(CASE WHEN predicted + actual > 0 THEN 2.0 * tp / (predicted + actual) ELSE 0 END), 6) AS macro_f1 FROM c GROUP BY run_condition)
SELECT run_condition, tp, predicted, actual, macro_f1, round(tp / nullif(predicted, 0)::DOUBLE, 6) AS precision, round(tp / nullif(actual, 0)::DOUBLE, 6) AS recall,
  round(2.0 * tp / nullif(predicted + actual, 0), 6) AS micro_f1 FROM s""")
def detection_pool(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "results").filter("phase = 2")
    counts = r.groupBy("run_condition", "fixture").agg(F.count(F.when(F.col("score") >= 0.8, 1)).alias("tp"), F.count("score").alias("predicted"), F.count(F.lit(1)).alias("actual"))
    return M.pooled(counts, ["run_condition"]).select("run_condition", "tp", "predicted", "actual", R6("macro_f1"), R6("precision"), R6("recall"), R6("micro_f1"))


@query("""
WITH x AS (SELECT * , row_number() OVER (PARTITION BY run_condition, fixture, query_id ORDER BY loaded_at DESC, run_id DESC, trial DESC, score DESC, cost_usd DESC, input_tokens DESC) AS place FROM results WHERE query_id IS NOT NULL)
SELECT run_condition, fixture, query_id, run_id, trial, round(score, 6) AS score FROM x WHERE place = 1""".replace("DESC,", "DESC NULLS LAST,").replace("input_tokens DESC", "input_tokens DESC NULLS LAST"))
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "results").filter("query_id is not null")
    order = [F.desc_nulls_last(c) for c in ("loaded_at", "run_id", "trial", "score", "cost_usd", "input_tokens")]
    return S.newest(r, ["run_condition", "fixture", "query_id"], order).select("run_condition", "fixture", "query_id", "run_id", "trial", R6("score"))


@query("""
WITH k AS (SELECT DISTINCT fixture, query_id, run_id FROM results WHERE query_id IS NOT NULL AND run_id IS NOT NULL)
SELECT fixture, query_id, run_id, CAST(row_number() OVER (PARTITION BY fixture, query_id ORDER BY run_id) - 1 AS INT) AS trial_index FROM k""")
def trial_index(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "results").filter("query_id is not null and run_id is not null").select("fixture", "query_id", "run_id").distinct()
    return S.numbered(k, ["fixture", "query_id"], [F.asc_nulls_first("run_id")], "trial_index")


@query("""
WITH p AS (SELECT DISTINCT fixture, query_id, trial FROM results WHERE phase = 1 AND query_id IS NOT NULL),
done AS (SELECT DISTINCT fixture, query_id, trial FROM results WHERE phase = 1 AND query_id IS NOT NULL AND score >= 0.9)
SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM done x WHERE x.fixture IS NOT DISTINCT FROM p.fixture AND x.query_id = p.query_id AND x.trial IS NOT DISTINCT FROM p.trial)""")
def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Planned cells without a row that scores 0.9; null keys match null keys."""
    cells = table(spark, d, "results").filter("phase = 1 and query_id is not null")
    planned = cells.select("fixture", "query_id", "trial").distinct()
    return planned.exceptAll(cells.filter("score >= 0.9").select("fixture", "query_id", "trial").distinct())


@query("""
WITH v AS (SELECT fixture, metric_kind, CAST(greatest(1, round_even(coalesce(wall_clock_s, 0), 0)) AS BIGINT) AS w, run_id, trial, query_id FROM results WHERE metric_kind IS NOT NULL),
g AS (SELECT fixture, metric_kind, CAST(sum(w) AS BIGINT) AS votes, min((coalesce(run_id, ''), coalesce(trial, -1), coalesce(query_id, ''))) AS f FROM v GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY fixture ORDER BY votes DESC, f, metric_kind) AS place FROM g)
SELECT fixture, metric_kind, votes FROM r WHERE place = 1""")
def weighted_mode(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "results").filter("metric_kind is not null")
    first = [F.coalesce("run_id", F.lit("")), F.coalesce("trial", F.lit(-1)), F.coalesce("query_id", F.lit("")), F.col("metric_kind")]
    return M.weighted_mode(r, ["fixture"], "metric_kind", F.coalesce("wall_clock_s", F.lit(0.0)), first)


@query("""
SELECT l_suppkey, round(CAST(sum(CAST(l_quantity AS DECIMAL(28,9)) * CAST(l_discount AS DECIMAL(9,4))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(28,9))) AS DOUBLE), 6) AS weighted_discount FROM lineitem GROUP BY l_suppkey""")
def weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    q, x = F.col("l_quantity").cast("decimal(18,6)"), F.col("l_discount").cast("decimal(9,4)")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(q * x).cast("double") / F.sum(q).cast("double"), 6).alias("weighted_discount"))


@query("""
SELECT l_suppkey, CAST(list_sort(list(l_quantity))[CAST(floor(count(l_quantity) / 2) AS INT) + 1] AS DOUBLE) AS upper_median, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_suppkey""")
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(M.upper_median("l_quantity").cast("double").alias("upper_median"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT fixture, CASE WHEN count(DISTINCT nullif(lower(trim(plant_domain)), '')) = 1 THEN min(trim(plant_domain)) FILTER (nullif(trim(plant_domain), '') IS NOT NULL) END AS plant_domain,
  CASE WHEN count(DISTINCT nullif(lower(trim(source_type)), '')) = 1 THEN min(trim(source_type)) FILTER (nullif(trim(source_type), '') IS NOT NULL) END AS source_type FROM results GROUP BY fixture""")
def unique_or_null(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "results").groupBy("fixture").agg(M.one_distinct(F.col("plant_domain")).alias("plant_domain"), M.one_distinct(F.col("source_type")).alias("source_type"))


@query("""
WITH g AS (SELECT fixture, family, count(DISTINCT scoring) AS kinds, min(scoring) AS scoring, count(*) AS samples FROM results WHERE scoring IS NOT NULL AND family IS NOT NULL GROUP BY ALL)
SELECT fixture, family, scoring, samples, CASE WHEN samples >= 3 THEN 'high' WHEN samples = 2 THEN 'medium' ELSE 'low' END AS vote FROM g WHERE kinds = 1""")
def unanimous_vote(spark: SparkSession, d: str) -> DataFrame:
    return M.unanimous(table(spark, d, "results").filter("family is not null"), ["fixture", "family"], "scoring")


@query("""
WITH t AS (SELECT fixture, run_condition, CAST(sum(CAST(cost_usd AS DECIMAL(28,9))) AS DOUBLE) AS cost_usd, CAST(sum(CAST(score AS DECIMAL(28,9))) AS DOUBLE) AS score FROM results GROUP BY ALL)
SELECT t.fixture, t.run_condition, round(t.cost_usd, 6) AS cost_usd, round(t.score, 6) AS score, round(t.cost_usd - b.cost_usd, 6) AS delta_cost_usd, round(t.score - b.score, 6) AS delta_score
FROM t JOIN t b ON b.fixture = t.fixture AND b.run_condition = 'baseline'""")
def condition_deltas(spark: SparkSession, d: str) -> DataFrame:
    t = M.deltas_to(table(spark, d, "results"), ["fixture"], "run_condition", "baseline", ["cost_usd", "score"])
    return t.select("fixture", "run_condition", *[R6(c) for c in ("cost_usd", "score", "delta_cost_usd", "delta_score")])


@query("""
SELECT metric_kind, coalesce(CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.5 THEN 'middle' WHEN score IS NOT NULL THEN 'low' END, 'none') AS band, count(*) AS n FROM results GROUP BY ALL""")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    band = F.when(F.col("score") >= 0.9, "high").when(F.col("score") >= 0.5, "middle").when(F.col("score").isNotNull(), "low").otherwise("none")
    return M.confusion(table(spark, d, "results").withColumn("band", band), "metric_kind", "band")


@query("""
SELECT event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(28,9))) AS DOUBLE), 6) AS amount,
  round(coalesce(CAST(sum(CAST(value AS DECIMAL(28,9))) FILTER (event_type = 'purchase') AS DOUBLE), 0), 6) AS billed, bool_and(value IS NOT NULL) AS complete FROM events GROUP BY event_type""")
def ledger_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    billed = F.coalesce(M.exact_sum(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0.0))
    return e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(M.exact_sum(F.col("value")), 6).alias("amount"), F.round(billed, 6).alias("billed"), F.every(F.col("value").isNotNull()).alias("complete")
    )


@query("""
WITH o AS (SELECT fixture, CASE WHEN lower(trim(op)) LIKE '%keep' THEN 'keep' WHEN lower(trim(op)) LIKE '%drop' THEN 'drop' WHEN lower(trim(op)) LIKE '%add' THEN 'add' ELSE 'other' END AS k FROM review_actions WHERE op IS NOT NULL)
SELECT fixture, count(*) AS actions, round(100.0 * count(*) FILTER (k = 'keep') / nullif(count(*) FILTER (k IN ('keep', 'drop')), 0), 1) AS confirm_pct,
  round(100.0 * count(*) FILTER (k = 'drop') / nullif(count(*) FILTER (k IN ('keep', 'drop')), 0), 1) AS reject_pct, round(100.0 * count(*) FILTER (k = 'add') / count(*), 1) AS add_pct FROM o GROUP BY fixture""")
def action_rates(spark: SparkSession, d: str) -> DataFrame:
    op = F.lower(F.trim("op"))
    k = F.when(op.endswith("keep"), "keep").when(op.endswith("drop"), "drop").when(op.endswith("add"), "add").otherwise("other")
    n = lambda *ks: F.count(F.when(F.col("k").isin(*ks), 1))
    both = F.nullif(n("keep", "drop"), F.lit(0))
    return table(spark, d, "review_actions").filter("op is not null").withColumn("k", k).groupBy("fixture").agg(
        F.count(F.lit(1)).alias("actions"),
        F.round(100.0 * n("keep") / both, 1).alias("confirm_pct"),
        F.round(100.0 * n("drop") / both, 1).alias("reject_pct"),
        F.round(100.0 * n("add") / F.count(F.lit(1)), 1).alias("add_pct"),
    )


@query("""
SELECT run_condition, fixture, round(CAST(sum(CAST((coalesce(input_tokens, 0) * 3.0 + coalesce(output_tokens, 0) * 15.0 + coalesce(cache_read_tokens, 0) * 0.3 + coalesce(cache_write_tokens, 0) * 3.75) / 1000000 AS DECIMAL(28,9))) AS DOUBLE), 4) AS cost FROM results GROUP BY ALL""")
def token_cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    cost = G.token_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("cache_read_tokens"), F.col("cache_write_tokens"), (3.0, 15.0, 0.3, 3.75))
    return table(spark, d, "results").groupBy("run_condition", "fixture").agg(F.round(M.exact_sum(cost), 4).alias("cost"))


@query("""
WITH c AS (SELECT fixture, round(avg(score), 3) AS f, round(CAST(sum(CAST(cost_usd AS DECIMAL(28,9))) AS DOUBLE), 6) AS cost FROM results WHERE fixture IS NOT NULL GROUP BY fixture)
SELECT fixture, f AS score, cost, CAST(row_number() OVER (ORDER BY f DESC, cost, fixture) AS INT) AS place FROM c ORDER BY f DESC, cost, fixture LIMIT 2""")
def top_two_promotion(spark: SparkSession, d: str) -> DataFrame:
    """The two best fixtures by (-score, cost, name): a top-k report. One row per fixture is ranked."""
    from pyspark.sql import Window as W

    c = table(spark, d, "results").filter("fixture is not null").groupBy("fixture").agg(F.round(F.avg("score"), 3).alias("score"), F.round(M.exact_sum(F.col("cost_usd")), 6).alias("cost"))
    best = c.orderBy(F.desc("score"), "cost", "fixture").limit(2)
    return best.withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), "cost", "fixture")))


@query("""
SELECT DISTINCT run_id, CASE WHEN regexp_matches(run_id, '^[0-9]{8}T[0-9]{6}') THEN epoch_us(strptime(substr(run_id, 1, 15), '%Y%m%dT%H%M%S')) END AS moment FROM results""")
def run_timestamp_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "results").select("run_id", X.run_moment(F.col("run_id")).alias("moment")).distinct()


@query("""
SELECT fixture, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, (s % 3600) // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS elapsed
FROM (SELECT fixture, CAST(floor(coalesce(sum(CAST(wall_clock_s AS DECIMAL(28,9))), 0)) AS BIGINT) AS s FROM results GROUP BY fixture)""")
def elapsed_format(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "results").groupBy("fixture").agg(F.coalesce(F.sum(F.col("wall_clock_s").cast("decimal(28,9)")), F.lit(0)).alias("s"))
    return t.select("fixture", X.elapsed(F.col("s")).alias("elapsed"))


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
