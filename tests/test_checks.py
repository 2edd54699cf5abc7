"""Lints over rows with planted faults, and the answer parsers' cases."""

from datetime import datetime

from pyspark.sql import functions as F

from tracemill.functions import text as X
from tracemill.operators import roles
from tracemill.plans import checks


def faulty(spark, small, tmp_path):
    """Folder of the smallest tables in which some rows break rules."""
    out = str(tmp_path)
    for name in ("graph_nodes", "graph_edges", "annotations", "results", "documents", "canonical_values"):
        df = spark.read.parquet(f"{small}/{name}.parquet")
        one = df.limit(1)
        if name == "graph_nodes":
            bad = one.withColumns({"fixture": F.lit("F"), "node_id": F.lit("bad"), "kind": F.lit("instrument"), "attributes": F.lit("{}"), "system_confidence": F.lit(1.5), "label": F.lit("twice")})
            other = bad.withColumns({"label": F.lit("again"), "bbox_global": F.when(F.lit(False), F.col("bbox_global"))})
            df = df.unionByName(bad).unionByName(other)
        if name == "graph_edges":
            df = df.unionByName(one.withColumns({"fixture": F.lit("F"), "edge_id": F.lit("loose"), "from_node": F.lit(""), "to_node": F.lit("bad"), "line_type": F.lit("signal_electric")}))
        if name == "annotations":
            df = df.unionByName(one.withColumns({"fixture": F.lit("F"), "annotation_id": F.lit("odd"), "confidence": F.lit("sure"), "page_index": F.lit(-1), "attributes": F.lit("{")}))
        if name == "results":
            df = df.unionByName(one.withColumns({"fixture": F.lit("F"), "phase": F.lit(1), "metric_kind": F.lit("q"), "query_id": F.lit(None).cast("string"), "scoring": F.lit("guess"), "source_type": F.lit("paper"), "run_id": F.lit("r1"), "loaded_at": F.lit(datetime(2025, 1, 1)).cast("timestamp")}))
            df = df.unionByName(one.withColumns({"fixture": F.lit("F"), "phase": F.lit(2), "source_type": F.lit("paper"), "run_id": F.lit("r2"), "loaded_at": F.lit(datetime(2025, 1, 2)).cast("timestamp")}))
        if name == "documents":
            df = df.unionByName(one.withColumns({"doc_id": F.lit(-7).cast("bigint"), "doc_kind": F.lit("extraction_report"), "fixture": F.lit("")}))
        df.coalesce(1).write.parquet(f"{out}/{name}.parquet")
    return out


def test_lints_find_planted_faults(spark, small, tmp_path):
    d = faulty(spark, small, tmp_path)
    of = lambda f: {(r["check"], r["example"]) for r in f(spark, d).filter("scope = 'F'").collect()}
    assert of(checks.graph_lint) == {("duplicate node id", "bad"), ("dangling endpoint", "loose")}
    assert ("missing query_id", "") in of(checks.query_lint) and ("unknown scoring", "") in of(checks.query_lint)
    assert of(checks.annotation_lint) == {("no page", "odd"), ("unknown confidence", "odd")}
    assert ("unknown source_type", "error") in {(r["check"], r["level"]) for r in checks.meta_lint(spark, d).filter("scope = 'F'").collect()}
    rules = {(r["path"], r["rule"]) for r in checks.semantic_rules(spark, d).collect()}
    assert {("F/loose", "signal_source"), ("F/bad", "loop_number"), ("documents/-7", "drawing_number")} <= rules and ("F/loose", "signal_target") not in rules
    assert {r["fault"] for r in checks.prediction_validator(spark, d).collect()} >= {"no box", "confidence out of range", "id of several boxes"}
    assert {r["state"] for r in checks.payload_states(spark, d).collect()} >= {"damaged"}
    assert [r["blockers"] for r in checks.resume_compatibility(spark, d).filter("fixture = 'F'").collect()] == ["phase"]


def items(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(X.list_items(F.col("t")).alias("i")).first()["i"]


def test_list_answers(spark):
    assert items(spark, "Pumps:\n- P-101\n* P-102.\n1) P-103\nA: V-1, 2: V-2; V-3") == ["P-101", "P-102", "P-103", "V-1", "V-2", "V-3"]
    assert items(spark, "Reasoning P-9, P-8\n<answer>\nP-1\nP-2\n</answer> and more") == ["P-1", "P-2"]
    assert items(spark, "PSV-1 and PSV-2 confirmed.\nConfirmed: PSV-3\nPSV-4\n```python\n```") == ["PSV-4"]
    assert items(spark, "<answer></answer>") == [] and items(spark, "") == [] and items(spark, "Answer") == ["Answer"]


def test_services_and_connectors(spark):
    rows = [("来自 仪表空气 总管", "IA"), ("to CWS header", "x"), ("from 2401-AB/12 slops", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(X.service_key(F.col("a"))).collect()]
    assert got == ["instrument_air", "cooling_water_supply", "slops"]
    alike = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(X.connectors_alike(F.col("a"), F.col("b"))).first()[0]
    assert alike("OPC-IN-MNb47121", "MNb inlet") and alike("Feed A inlet", "OPC IN: feed to V-1") and not alike("to from", "out") and not alike("Feed", "Slops (feed)")


def test_drawing_references_and_lists(spark):
    df = spark.createDataFrame([("see dw12 345 sheet", None, None), ("none", "DW99-12345", ["a"]), (None, "  b   c ", None), (None, None, [])], "a string, b string, l array<string>")
    assert [r[0] for r in df.select(X.drawing_reference(F.col("a"), F.col("b"))).collect()] == ["DW12345", "DW99-12345", None, None]
    assert [r[0] for r in df.select(X.string_list(F.col("b"), F.col("l"))).collect()] == [[], ["a"], ["b c"], []]


def test_fits_of_roles(spark):
    held = {(line, a, b): v for line, a, b, v in roles.fit_rows()}
    assert len(held) == len(roles.FITS) * len(roles.ROLES) ** 2
    assert held["process", "instrument", "instrument"] == "invalid" and held["process", "opc", "instrument"] == "uncertain" and held["process", "opc", "equipment"] == "valid"
    assert held["electrical_power", "power_source", "motor"] == "valid" and held["electrical_power", "motor", "motor"] == "invalid"
    assert held["instrument_capillary", "instrument", "opc"] == "uncertain" and held["instrument_capillary", "actuator_valve", "instrument"] == "valid"
    df = spark.createDataFrame([("process", "opc", None), ("other", "opc", "opc")], "t string, a string, b string")
    assert [r["fit"] for r in roles.with_fit(df, "t", "a", "b").orderBy("t").collect()] == ["uncertain", "invalid"]
    score = lambda *x: spark.range(1).select(roles.evidence_score(*[F.lit(v) for v in x])).first()[0]
    assert score(True, "valid", True, "high", False) == 0.8 and score(True, "valid", True, "high", True) == 0.35 and score(False, "invalid", False, None, False) == 0.05
