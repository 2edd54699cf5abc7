import itertools
import json
import random

from tracemill.operators import drift

FILES = "file_series string, file_name string, source_kind string, written_at timestamp, loaded_at timestamp, line_no int, body string"


def rows(files):
    from datetime import datetime, timedelta, timezone

    out = []
    for k, (series, name, kind, records) in enumerate(files):
        out += [(series, name, kind, datetime(2025, 1, 1, tzinfo=timezone.utc) + timedelta(days=k), None, n, r if isinstance(r, (str, type(None))) else json.dumps(r)) for n, r in enumerate(records)]
    random.Random(3).shuffle(out)
    return out + out[:3]


def test_changes_of_a_series(spark):
    a = [{"id": f"n{i}", "label": f"L{i}", "attributes": {"cls": ["p", "q", "r"][i % 3], "ok": i % 2 == 0}, "gone": i} for i in range(12)]
    b = [{"id": f"n{i}", "tag": f"L{i}" if i != 4 else "edited", "attributes": {"klass": ["p", "q", "r"][i % 3], "ok": str(i % 2 == 0).lower()}, "fresh": f"x{i}"} for i in range(12)]
    c = [{"id": f"n{i}", "tag": f"L{i}", "attributes": {"klass": ["p", "q", "r"][i % 3], "ok": None}, "fresh": f"x{i}"} for i in range(12)]
    files = [("s", "s/1", "graph", a), ("s", "s/2", "graph", b + [None, "", "{", "[1]", {"id": None}]), ("s", "s/3", "graph", c), ("t", "t/1", "results", [{"trial": 1.0, "v": 1}]), ("t", "t/2", "results", [{"trial": 1, "w": 1.0}])]
    table = spark.createDataFrame(rows(files), FILES)
    profile = drift.column_profiles(table)
    got = {tuple(r) for r in drift.layout_changes(profile).collect()}
    assert got == {
        ("s/2", "renamed", "label", "tag"),
        ("s/2", "renamed", "attributes.cls", "attributes.klass"),
        ("s/2", "retyped", "attributes.ok", "attributes.ok"),
        ("s/2", "removed", "gone", ""),
        ("s/2", "added", "", "fresh"),
        ("t/2", "renamed", "v", "w"),
    }
    held = {}
    for r in drift.unified(table, drift.unified_paths(profile, drift.layout_changes(profile))).collect():
        held.setdefault(r["file_name"], {})[r["record"]] = (r["fields"], r["unfit"])
    assert held["s/1"]["n3"] == ({"id": "n3", "tag": "L3", "attributes.klass": "p", "attributes.ok": "false", "gone": "3"}, [])
    assert held["s/2"]["n4"][0]["tag"] == "edited" and held["s/3"]["n1"][0]["attributes.ok"] is None and held["t/1"]["1"][0] == {"trial": "1", "w": "1"}


def test_values_of_other_kinds():
    assert [drift.as_kind(v, k) for v, k in ((1, "string"), ("2.0", "number"), ("x", "number"), (" True", "boolean"), (0, "boolean"), (True, "number"), (None, "number"), ("a", "array"), (7, "boolean"))] == [
        ("1", True), ("2", True), ("x", False), ("true", True), ("false", True), ("1", True), (None, True), ('["a"]', True), ("7", False)
    ]


def test_large_files_are_compared_by_sketches(spark, monkeypatch):
    monkeypatch.setattr(drift, "SKETCH", 64)
    rng = random.Random(4)
    a = [{"id": i, "first": rng.random(), "second": rng.randrange(50), "third": i % 7} for i in range(1500)]
    b = [{"id": r["id"], "une": r["first"] if rng.random() < 0.9 else 0, "deux": r["second"], "trois": rng.randrange(7)} for r in a if rng.random() < 0.9]
    files = spark.createDataFrame(rows([("s", "s/1", "graph", a), ("s", "s/2", "graph", b)]), FILES).repartition(7)
    profile = drift.column_profiles(files)
    assert {r[0] for r in profile.selectExpr("size(sketch)").distinct().collect()} == {64}
    got = {tuple(r) for r in drift.layout_changes(profile).collect()}
    assert got == {("s/2", "renamed", "first", "une"), ("s/2", "renamed", "second", "deux"), ("s/2", "removed", "third", ""), ("s/2", "added", "", "trois")}


def test_empty(spark):
    files = spark.createDataFrame([], FILES)
    profile = drift.column_profiles(files)
    assert drift.layout_changes(profile).count() == 0
    assert drift.unified(files, drift.unified_paths(profile, drift.layout_changes(profile))).count() == 0


def test_matching_is_best():
    rng = random.Random(2)
    for _ in range(40):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        w = [[rng.choice([0, 0, 1, 2, 3, 5]) * 1.0 for _ in range(m)] for _ in range(n)]
        got = sum(w[a][b] for a, b in drift.best_matching(w))
        small, large = (range(n), range(m)) if n <= m else (range(m), range(n))
        best = max(sum((w[a][b] if n <= m else w[b][a]) for a, b in zip(small, p)) for p in itertools.permutations(large, len(small)))
        assert got == best
