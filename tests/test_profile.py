import math
import random

from tracemill.operators import profile

SCHEMA = "feed string, load_id string, phase int, score double, cost_usd double, slice string, value string"


def ks(a, b):
    return max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in a + b)


def table(spark, rng):
    rows = []
    for load in range(8):
        for _ in range(rng.randrange(40, 60)):
            score = round(rng.random(), 1) * (100 if load == 3 else 1)
            cost = None if load == 5 and rng.random() < 0.6 else rng.lognormvariate(0, 1)
            rows.append(("f", f"l{load}", 1, None if rng.random() < 0.05 else score, cost, "x", None))
    rows += [("g", "only", 1, 1.0, None, None, None), ("f", None, 1, 1.0, 1.0, None, None), (None, "l9", None, float("nan"), 1.0, None, None)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_profiles_are_exact_and_bad_loads_come_out(spark):
    rows, df = table(spark, random.Random(4))
    values = profile.unpivot_measures(df, ["score", "cost_usd"])
    got = {(r["feed"], r["column_name"], r["load_id"]): r for r in profile.load_profiles(values, 2 * len(rows)).collect()}
    for c, column in ((3, "score"), (4, "cost_usd")):
        for load in range(8):
            a = [r[c] for r in rows if r[1] == f"l{load}" and r[c] is not None]
            b = [r[c] for r in rows if r[0] == "f" and r[1] not in (None, f"l{load}") and r[c] is not None]
            p = got["f", column, f"l{load}"]
            assert math.isclose(p["ks"], ks(a, b), abs_tol=1e-12)
            assert p["distinct_values"] == len(set(a)) and p["low"] == min(a) and p["high"] == max(a)
            assert p["median"] == sorted(a)[math.ceil(len(a) / 2) - 1]
            assert p["nulls"] == sum(r[c] is None for r in rows if r[1] == f"l{load}")
    assert got["", "score", "l9"]["nulls"] == 1 and got["g", "score", "only"]["ks"] is None
    bad = {(r["load_id"], r["column_name"]) for r in profile.departing_loads(profile.load_profiles(values, 2 * len(rows))).collect()}
    assert bad == {("l3", "score"), ("l5", "cost_usd")}


def test_empty(spark):
    values = profile.unpivot_measures(spark.createDataFrame([], SCHEMA), ["score"])
    assert profile.departing_loads(profile.load_profiles(values, 0)).count() == 0


def test_chance():
    assert profile.ks_chance(profile.KS_LIMIT) < 1e-5 < profile.ks_chance(2.0)
