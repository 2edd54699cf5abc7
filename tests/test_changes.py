import random

from pyspark.sql import functions as F

from tracemill.functions.moments import moment_micros
from tracemill.operators import changes
from tracemill.plans.training import review_changes

COLUMNS = "k string, s bigint, op string, v string, w string, extra string"


def state(rows):
    """Brute force: apply in order, repeats once."""
    rank = {"insert": 0, "update": 1, "delete": 2}
    held = {}
    for k, s, op, v, w, _ in sorted({r[:5] + (None,) for r in rows if r[0] is not None and r[1] is not None and r[2] in rank}, key=lambda r: (r[1], rank[r[2]], r[3] or "", r[4] or "")):
        if op == "insert":
            held[k] = [v, w]
        elif op == "update" and k in held:
            held[k] = [v if v is not None else held[k][0], w if w is not None else held[k][1]]
        elif op == "delete":
            held.pop(k, None)
    return {(k, *x) for k, x in held.items()}


def test_any_order_repeats_and_batches(spark):
    rng = random.Random(5)
    rows, used = [], set()
    for _ in range(600):
        k, s = rng.choice(["hot"] * 5 + list("abcdefgh")), rng.randrange(5000)
        if (k, s) in used:
            continue
        used.add((k, s))
        op = rng.choice(["insert", "update", "update", "delete", "keep"])
        rows.append((k, s, op, rng.choice([None, "x", "y", str(s)]), str(s), None))
    rows += rows[:100] + [(None, 1, "insert", "n", "n", None), ("q", None, "insert", "n", "n", None), ("r", 4, None, "n", "n", None)]
    want = state(rows)
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, COLUMNS)
        folded = changes.fold_changes(df, ["k"], "s", "op", ["v", "w"])
        assert {tuple(r) for r in changes.current_rows(folded, ["k"], ["v", "w"]).collect()} == want
        a, b = df.filter("s % 2 = 0 or s is null"), df.filter("s % 2 = 1")
        merged = changes.merge_states(changes.fold_changes(b, ["k"], "s", "op", ["v", "w"]), changes.fold_changes(a, ["k"], "s", "op", ["v", "w"]), ["k"])
        assert {tuple(r) for r in changes.current_rows(merged, ["k"], ["v", "w"]).collect()} == want


def test_tombstones_base_and_empty(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    feed = spark.createDataFrame([("a", 5, "delete", None), ("a", 4, "insert", "late"), ("b", 3, "update", "new")], "k string, s bigint, op string, v string")
    folded = changes.fold_changes(feed, ["k"], "s", "op", ["v"], base)
    assert [tuple(r) for r in changes.current_rows(folded, ["k"], ["v"]).collect()] == [("b", "new")]
    assert [tuple(r) for r in changes.tombstones(folded, ["k"]).collect()] == [("a", 5)]
    assert changes.current_rows(changes.fold_changes(feed.limit(0), ["k"], "s", "op", ["v"]), ["k"], ["v"]).count() == 0


def test_moments(spark):
    texts = {
        "2025-01-08T06:30:14": 1736317814000000,
        "2025-01-08T06:30:14Z": 1736317814000000,
        "2025-01-08 06:30:14.250": 1736317814250000,
        "2025-01-08T11:30:14+05:00": 1736317814000000,
        "2025-01-08T11:30:14+0500": 1736317814000000,
        "2025-01-07T23:30:14-07:00": 1736317814000000,
        "1736317814000": 1736317814000000,
        "1736317814": 1736317814000000,
        "08.01.2025 06:30:14": 1736317814000000,
        "2025-01-08": 1736294400000000,
        "nonsense": None,
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", moment_micros(F.col("t")).alias("m"))
    assert {r["t"]: r["m"] for r in df.collect()} == texts


def test_review_actions_with_nulls(spark):
    end = "struct<from_node:string,to_node:string,line_type:string>"
    new = "struct<id:string,from_node:string,to_node:string,line_type:string,confidence:string,attributes:struct<gt_added:boolean>>"
    rows = [
        ("2025-01-01T00:00:02", " Edge-Add ", None, "wrong", None, None, None, ("e1", "a", "b", None, None, None)),
        ("2025-01-01T00:00:03", "EDGE_REVISE", None, "e1", None, None, ("c", "d", None), None),
        ("2025-01-01T00:00:01", "add", "n1", None, "L1", None, None, None),
        (None, "drop", "n1", None, None, None, None, None),
        ("2025-01-01T00:00:01", None, "n2", None, None, None, None, None),
        ("2025-01-01T00:00:01", "add", "", None, "x", None, None, None),
    ]
    df = spark.createDataFrame(rows, f"ts string, op string, node_id string, edge_id string, label string, before_edge {end}, after_edge {end}, new_edge {new}")
    folded = changes.fold_changes(review_changes(df), ["is_edge", "entity_id"], "seq", "op", ["from_node", "to_node", "label"])
    got = {tuple(r) for r in changes.current_rows(folded, ["is_edge", "entity_id"], ["from_node", "to_node", "label"]).collect()}
    assert got == {(True, "e1", "c", "d", None), (False, "n1", None, None, "L1")}
