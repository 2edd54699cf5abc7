"""What lines may join, as a table of line types and roles, and the score of an edge's evidence."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Roles by kind, attributes and text; verdicts by line type and the roles of both ends; what each piece of evidence counts.
ROLES = ["opc", "actuator_valve", "instrument", "motor", "power_source", "equipment"]
ACTUATOR_TEXT = r"(control\s*valve|actuat|operated\s*valve|\b[fpalt]cv[- ]?[0-9])"
MOTOR_TEXT = r"(\bmotor\b|电机|motor[- ]?driven|\bm[- ]?[0-9]{2,})"
POWER_TEXT = r"(power\s*(source|supply)|电源|switchgear|mcc)"
#: By line type: the verdict of any two roles, then those of particular ones; 'any' is any role, the last that fits counts.
FITS = {
    "process": [("any", "any", "valid"), ("instrument", "any", "uncertain"), ("instrument", "instrument", "invalid")],
    "signal_electric": [("any", "any", "invalid"), ("instrument", "actuator_valve", "valid"), ("instrument", "instrument", "valid")],
    "signal_pneumatic": [("any", "any", "invalid"), ("instrument", "actuator_valve", "valid"), ("instrument", "instrument", "valid")],
    "instrument_capillary": [("any", "any", "invalid"), ("instrument", "any", "uncertain"), ("instrument", "equipment", "valid"), ("instrument", "actuator_valve", "valid")],
    "electrical_power": [("any", "any", "invalid"), ("motor", "equipment", "valid"), ("motor", "power_source", "valid")],
}
BASE = 0.50
LOWEST, HIGHEST, GATED = 0.05, 0.98, 0.35
GEOMETRY = {True: 0.06, False: -0.14}
FIT_POINTS = {"valid": 0.10, "uncertain": -0.08, "invalid": -0.35}
TOPOLOGY_POINTS = 0.08
DECISION_POINTS = {"high": 0.06, "medium": 0.0, "low": -0.08}
LEVELS = [(0.80, "high"), (0.55, "medium")]


def role_of(kind: Column, attributes: Column, texts: list[Column]) -> Column:
    """Role of a node; attributes is its JSON, texts are what may name a role."""
    said = lambda f: F.coalesce(F.get_json_object(attributes, f"$.{f}"), F.lit(""))
    text = F.lower(F.concat_ws(" ", *texts, *[said(f) for f in ("equipment_class", "valve_type", "instrument_function", "structural_description")]))
    actuated = (said("instrument_function") == "valve_actuator") | said("valve_type").isin("control", "control_valve") | (said("actuation_type") != "") | text.rlike(ACTUATOR_TEXT)
    return F.when(kind == "opc", "opc").when(actuated, "actuator_valve").when(kind == "instrument", "instrument").when(text.rlike(MOTOR_TEXT), "motor").when(text.rlike(POWER_TEXT), "power_source").otherwise("equipment")


def fit_rows() -> list[tuple[str, str, str, str]]:
    """(line type, role, role, verdict) for every pair of roles."""
    out = {}
    for line, rules in FITS.items():
        for a, b, verdict in rules:
            for x in ROLES if a == "any" else [a]:
                for y in ROLES if b == "any" else [b]:
                    out[line, x, y] = out[line, y, x] = verdict
    return [(*k, v) for k, v in sorted(out.items())]


def with_fit(edges: DataFrame, line: str, a: str, b: str) -> DataFrame:
    """edges with `fit`: the verdict of its line type and its ends' roles; invalid without both ends, uncertain for other types."""
    rows = edges.sparkSession.createDataFrame(fit_rows(), f"{line} string, {a} string, {b} string, verdict string")
    fit = F.when(F.col(a).isNull() | F.col(b).isNull(), "invalid").otherwise(F.coalesce("verdict", F.lit("uncertain")))
    # the table holds a row per line type and pair of roles, 180 of them
    return edges.join(F.broadcast(rows), [line, a, b], "left").withColumn("fit", fit).drop("verdict")


def evidence_score(drawn: Column, fit: Column, topology: Column, decision: Column, gated: Column) -> Column:
    """Score between LOWEST and HIGHEST of independent pieces of evidence; at most GATED where a gate holds. A null decision counts nothing."""
    points = lambda c, held: F.coalesce(reduce(lambda w, kv: w.when(c == kv[0], F.lit(kv[1])), held.items(), F.when(F.lit(False), 0.0)), F.lit(0.0))
    total = reduce(add, [F.lit(BASE), points(drawn, GEOMETRY), points(fit, FIT_POINTS), F.when(topology, TOPOLOGY_POINTS).otherwise(0.0), points(decision, DECISION_POINTS)])
    return F.round(F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.when(gated, F.least(total, F.lit(GATED))).otherwise(total))), 3)


def score_level(score: Column) -> Column:
    return reduce(lambda w, x: w.when(score >= x[0], x[1]), LEVELS, F.when(F.lit(False), "")).otherwise("low")
