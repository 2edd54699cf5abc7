import math

from pyspark.sql import functions as F

from tracemill.operators import metrics as M

FACTS = "run_condition string, fixture string, phase int, metric_kind string, family string, score double, trial int, cost_usd double, wall_clock_s double, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint, image_tokens bigint, n_steps bigint, n_tool_calls bigint, retries bigint, tool_call_counts_json string"


def fact(fixture, family, score, trial=0, cost=1.0, phase=1, kind="phase1_query", condition="baseline", seconds=2.0, tools=None):
    return (condition, fixture, phase, kind, family, score, trial, cost, seconds, 10, None, None, None, None, 1, None, None, tools)


def test_family_table_macro_row(spark):
    rows = [fact("a", "inventory", 1.0), fact("a", "inventory", 0.0, 1), fact("a", "counting", 1.0, cost=5.0), fact("b", "inventory", None), fact("b", "counting", 0.5), fact(None, "counting", 1.0), fact("a", "counting", 0.0, phase=2)]
    got = {r["fixture"]: r for r in M.family_table(spark.createDataFrame(rows, FACTS), "baseline").collect()}
    assert set(got) == {"a", "b", "macro"}
    assert got["a"]["inventory"] == 0.5 and got["a"]["overall"] == 0.75 and got["b"]["inventory"] is None and got["b"]["overall"] == 0.5
    assert got["macro"]["overall"] == 0.625 and got["macro"]["cost_total"] == 9.0 and got["macro"]["n_calls"] == 5 and got["macro"]["cost_median"] == 1.0
    assert [r["fixture"] for r in M.family_table(spark.createDataFrame([], FACTS), "baseline").collect()] == ["macro"]


def test_totals_leave_out_metric_rows(spark):
    rows = [fact("a", "x", 1.0), fact("a", None, 1.0, phase=2, kind="phase2_edge_f1", cost=9.0), fact("a", None, 1.0, phase=2, kind="phase2_run", cost=4.0)]
    got = {r["part"]: r for r in M.phase_totals(spark.createDataFrame(rows, FACTS), []).collect()}
    assert got["phase1"]["cost_usd"] == 1.0 and got["phase2"]["cost_usd"] == 4.0 and got["total"]["cost_usd"] == 5.0 and got["total"]["n_calls"] == 2 and got["total"]["retries"] == 0


def test_differences_keep_null_keys(spark):
    before = spark.createDataFrame([fact("a", None, 0.5), fact("a", "f", 0.1), fact("a", "f", 0.9, 1)], FACTS)
    after = spark.createDataFrame([fact("a", None, 0.6), fact("a", "f", 0.2), fact("a", "f", 0.9, 1), fact("new", "f", 1.0)], FACTS)
    keys = ["run_condition", "fixture", "family"]
    assert [(r["family"], round(r["delta"], 6)) for r in M.run_differences(before, after, keys).collect()] == [(None, 0.1)]
    assert M.run_differences(before, after, keys, null_safe=False).count() == 0


def test_json_maps_and_scores(spark):
    df = spark.createDataFrame([fact("a", "f", 1.0, tools=t) for t in ('{"x":2,"y":1}', '{"x":3}', "", None, "{")], FACTS)
    assert {(r["key"], r["n"]) for r in M.json_map_sums(df, "tool_call_counts_json", []).collect()} == {("x", 5), ("y", 1)}
    sets = spark.createDataFrame([([], []), (["a", "b", "b"], ["b", "c"])], "e array<string>, a array<string>")
    tp, fp, fn, f1 = M.set_scores(F.col("e"), F.col("a"))
    assert [tuple(r) for r in sets.select(tp, fp, fn, f1).collect()] == [(0, 0, 0, 1.0), (1, 1, 1, 0.5)]
    t = spark.createDataFrame([(0.0, 0.0), (0.0, 0.1), (10.0, 10.5), (10.0, None)], "e double, a double")
    assert [r[0] for r in t.select(M.within_tolerance(F.col("e"), F.col("a"), 0.05)).collect()] == [1.0, 0.0, 1.0, 0.0]


def test_votes_and_medians(spark):
    df = spark.createDataFrame([("g", "x", 1.4, 0), ("g", "y", 0.2, 1), ("g", "y", 0.3, 2), ("g", "x", 0.6, 3), ("h", "z", 2.5, 4)], "k string, v string, w double, o int")
    got = {tuple(r) for r in M.weighted_mode(df, ["k"], "v", F.col("w"), [F.col("o")]).collect()}
    assert got == {("g", "x", 2), ("h", "z", 2)}
    assert df.groupBy("k").agg(M.upper_median("o").alias("m")).orderBy("k").collect()[0]["m"] == 2
    one = spark.createDataFrame([("a", " X "), ("a", "x"), ("b", "p"), ("b", "q"), ("c", None), ("c", "")], "k string, v string")
    assert {tuple(r) for r in one.groupBy("k").agg(M.one_distinct(F.col("v")).alias("v")).collect()} == {("a", "X"), ("b", None), ("c", None)}
    assert [tuple(r) for r in M.unanimous(one.filter("k = 'a'").withColumn("v", F.lower(F.trim("v"))), ["k"], "v").collect()] == [("a", "x", 2, "medium")]


def test_pools(spark):
    df = spark.createDataFrame([("c", 0, 0, 0), ("c", 2, 4, 2)], "k string, tp bigint, predicted bigint, actual bigint")
    r = M.pooled(df, ["k"]).first()
    assert r["precision"] == 0.5 and r["recall"] == 1.0 and math.isclose(r["micro_f1"], 2 / 3) and math.isclose(r["macro_f1"], 1 / 3)
    none = M.pooled(df.filter("tp = 0"), ["k"]).first()
    assert none["precision"] is None and none["micro_f1"] is None and none["macro_f1"] == 0.0
    e = spark.createDataFrame([("a", "kitten", "sitting"), ("a", None, "x"), ("b", None, None)], "k string, r string, p string")
    assert {(r["k"], r["edits"], r["error_rate"]) for r in M.error_rate(e, ["k"], "r", "p").collect()} == {("a", 4, 4 / 6), ("b", 0, None)}
