import json
import os

import pytest
from pyspark.sql import functions as F

from tracemill.sources import files, writers
from tracemill.streaming import ledger, windows


def test_ledger_rules():
    events = [
        ("l", "r1", "reserve", 4.0), ("l", "r1", "reserve", 4.0), ("l", "r2", "reserve", 7.0), ("l", "r2", "reserve", 6.0), ("l", "r1", "settle", 3.0), ("l", "r1", "settle", 3.0),
        ("l", "r2", "settle", None), ("l", "r3", "reserve", 2.0), ("l", "r2", "reconcile", 5.0), ("l", "r2", "reconcile", 5.0), ("l", "r3", "reserve", 2.0), ("l", "r3", "settle", 2.5), ("l", "r4", "reserve", 0.1), ("l", "zz", "settle", 1.0),
    ]
    got = [(r[4], r[5], r[6]) for r in ledger.replay(events, 10.0)]
    assert got == [
        ("reserved", 4.0, 0.0), ("repeated", 4.0, 0.0), ("refused", 4.0, 0.0), ("reserved", 10.0, 0.0), ("billed", 6.0, 3.0), ("repeated", 6.0, 3.0),
        ("unresolved", 6.0, 3.0), ("refused", 6.0, 3.0), ("billed", 0.0, 8.0), ("repeated", 0.0, 8.0), ("reserved", 2.0, 8.0), ("halted", 0.0, 10.5), ("refused", 0.0, 10.5), ("unknown", 0.0, 10.5),
    ]


def test_ledger_as_a_stream(spark, tmp_path):
    rows = [("l", 1, "r1", "reserve", 4.0), ("l", 2, "r1", "settle", 3.0), ("m", 3, "q", "reserve", 99.0), ("l", 4, "r1", "settle", 3.0)]
    schema = "ledger string, seq bigint, request string, event string, amount double"
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    stream = windows.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, "*.parquet")
    windows.run_available(ledger.ledger_stream(stream, 10.0), lambda b, _: seen.extend(tuple(r) for r in b.collect()))
    assert sorted((r[0], r[1], r[4]) for r in seen if r[2] != "reserve") == [("l", "r1", "billed"), ("l", "r1", "repeated")]
    assert ("m", "q", "reserve", 99.0, "refused", 0.0, 0.0) in seen


def test_breaker():
    b = ledger.Breaker(3, 4)
    assert [b.observe(x) for x in (True, True, False, True, True)] == [None, None, None, None, "total"]
    c = ledger.Breaker(2, 9)
    assert [c.observe(x) for x in (True, True)] == [None, "consecutive"]


def test_windows_and_offsets(spark):
    df = spark.createDataFrame([(0, "a", 1.5), (10, "a", None), (3700, "a", 1.0), (20, "b", 2.0)], "s int, k string, v double").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r["start"], r["k"], r["n"], r["amount"]) for r in windows.tumbling(df, "ts", "k", "v", "1 hour", "0 seconds").collect()}
    assert got == {(0, "a", 2, 1.5), (3600000000, "a", 1, 1.0), (0, "b", 1, 2.0)}
    assert {(r["k"], r["n"]) for r in windows.sessions(df, "ts", "k", "1 minute", "0 seconds").collect()} == {("a", 2), ("a", 1), ("b", 1)}
    assert windows.after(df, "s", 10).count() == 2


def test_change_applier(spark):
    s = "k string, seq bigint, op string, v string"
    apply = windows.ChangeApplier(["k"], "seq", "op", ["v"])
    assert apply.rows() is None
    for batch in ([("a", 3, "update", "z"), ("b", 9, "delete", None)], [("a", 1, "insert", "x"), ("b", 2, "insert", "y")], []):
        apply(spark.createDataFrame(batch, s))
    assert [tuple(r) for r in apply.rows().collect()] == [("a", "z")]


def test_results_csv_round_trip(spark, tmp_path):
    old = tmp_path / "old.csv"
    names = [x.rsplit(" ", 1)[0].strip() for x in files.RESULTS.split(",")]
    kept = [n for n in names if n not in files.BACKFILLED]
    values = {"run_id": "r", "phase": "1", "score": "0.5", "detail": '"said ""x"", y"'}
    old.write_text(",".join(kept) + "\n" + ",".join(values.get(n, "") for n in kept) + "\n")
    got = files.read_results(spark, str(old))
    row = got.first()
    assert row["score"] == 0.5 and row["detail"] == 'said "x", y' and row["retries"] == 0 and row["cost_usd"] is None and got.columns == names
    writers.write_results(got.drop("image_tokens"), str(tmp_path / "new"))
    again = files.read_results(spark, str(tmp_path / "new"))
    assert again.drop("tool_call_counts_json").collect() == got.drop("tool_call_counts_json").collect()
    bad = tmp_path / "bad.csv"
    bad.write_text("run_id,score\nr,1\n")
    with pytest.raises(ValueError):
        files.read_results(spark, str(bad))


def test_graph_and_annotation_files(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g/a.json").write_text(json.dumps({"schema_version": "1", "nodes": [{"id": "n1", "kind": "x", "bbox_global": {"x": 1, "y": 2, "w": 3, "h": 4}}], "edges": [{"id": "e", "from_node": "n1", "to_node": "n1", "polyline_global": [[1, 2], [3, 4]]}]}, indent=1))
    (tmp_path / "g/b.json").write_text("{ broken")
    graphs = files.read_graphs(spark, str(tmp_path / "g"))
    assert files.graph_nodes(graphs).select("id", "bbox_global.w").collect()[0]["w"] == 3 and files.graph_edges(graphs).count() == 1
    assert sum(r["_corrupt_record"] is not None for r in graphs.collect()) == 1
    (tmp_path / "a.jsonl").write_text('{"id":"1","page_index":0}\n{"id":\n')
    rows, rejected = files.read_annotations(spark, str(tmp_path / "a.jsonl"))
    assert [r["id"] for r in rows.collect()] == ["1"] and len(rejected.collect()) == 1


def test_graphml(spark, tmp_path):
    (tmp_path / "x.graphml").write_text('<graphml><graph><node id="a"><data key="label">P-1</data></node><node id="a"/><node id="b"/><edge source="a" target="b"/><edge source="a" target="z"><data key="k">v</data></edge></graph></graphml>')
    nodes, edges, issues = files.read_graphml(spark, str(tmp_path / "x.graphml"))
    assert nodes.count() == 3 and edges.count() == 2
    assert {(r["issue"], r["id"]) for r in issues.collect()} == {("duplicate_id", "a"), ("dangling_edge", "z")}
    assert {"label": "P-1"} in [r["data"] for r in nodes.collect()]


def test_catalogues_pages_and_runs(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "m.yaml").write_text("fixtures:\n- stem: a\n- {stem: b, role: train}\n")
    assert {(r["stem"], r["role"], r["source_type"]) for r in files.read_manifest(spark, str(tmp_path / "m.yaml")).collect()} == {("a", "eval", "vector"), ("b", "train", "vector")}
    (tmp_path / "k").mkdir()
    (tmp_path / "k/1.yaml").write_text("id: v\nheading: Valve\ntags: [x, 2]\n")
    (tmp_path / "k/2.yaml").write_text("a: [")
    assert {(r["id"], tuple(r["tags"])) for r in files.read_knowledge(spark, str(tmp_path / "k")).collect()} == {("v", ("x", "2")), (None, ())}
    html = spark.createDataFrame([("<table><tr><th>A &amp; B</th><td> x <b>y</b>\n</td><td>&nbsp;</td></tr></table>",), (None,)], "h string")
    assert [r[0] for r in html.select(files.html_cells(F.col("h"))).collect()] == [["A & B", "x y"], None]
    for name, text in (("20250101T000000-a", '{"question":"q1","cost_usd":1.0}'), ("20250301T000000-b", '{"question":"q2"}'), ("20250401T000000-c", "{")):
        os.makedirs(tmp_path / "runs" / name)
        (tmp_path / "runs" / name / "run.json").write_text(text)
    assert [r["question"] for r in files.recent_runs(spark, str(tmp_path / "runs/*/run.json")).collect()] == ["q2", "q1"]
    assert files.inventory(spark, str(tmp_path / "runs"), "*.json").filter("length(sha256) = 64").count() == 3


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 0.5, None), ("c_d", 1.0, 3)], "name string, score double, n int").orderBy("name")
    text = writers.run_report("Run", {"Scores": df})
    assert "| a\\|b | 0.5000 |  |" in text and text.startswith("# Run")
    assert r"c\_d & 1.0000 & 3 \\" in writers.latex_table(df, "T_1")
    writers.write_json(df, str(tmp_path / "j"), ["name"])
    assert spark.read.text(str(tmp_path / "j")).filter("value like '{\"n\":3,\"score\":1.0}'").count() == 1
