import random

import pytest
from pyspark.sql import functions as F

from tracemill.llm import canonical as C
from tracemill.llm.thesaurus import NAMES

VALUES = {
    ("equipment_class", "PUMP."): "pump",
    ("equipment_class", " upmp no. 2"): "pump",
    ("equipment_class", "existing METERING PUMP"): "pump",
    ("equipment_class", "exchanger, heat"): "heat_exchanger",
    ("equipment_class", "heat exchnlager"): "heat_exchanger",
    ("equipment_class", "'Válvula' - spare"): "valve",
    ("equipment_class", "WÄRMETAUSCHER"): "heat_exchanger",
    ("equipment_class", "drying drum"): "dryer",
    ("equipment_class", "ladder"): "",
    ("equipment_class", "rev 17"): "",
    ("equipment_class", ""): "",
    ("equipment_class", "   "): "",
    ("equipment_class", "??"): "",
    ("equipment_class", "x" * 3000): "",
    ("valve_type", "three ways"): "three_way",
    ("valve_type", "pup piece"): "",
    ("valve_type", "gae"): "gate",
    ("valve_type", "psv"): "safety_relief",
    ("instrument_function", "alarm (low)"): "alarm",
    ("instrument_function", "Noidicator"): "indicator",
    ("instrument_function", "cable tray"): "",
    ("instrument_function", "valve"): "",
}


@pytest.fixture(scope="module")
def reference(spark):
    rows = [(f, c, "gloss") for f, held in NAMES.items() for c in held]
    return spark.createDataFrame(rows + [(None, None, None)], "field_name string, canonical string, gloss string")


def test_values(spark, reference):
    df = spark.createDataFrame([*VALUES, *VALUES, ("valve_type", None), ("unknown", "gate")], "field_name string, value string")
    got = {(r["field_name"], r["value"]): r["canonical"] for r in C.map_values(df, reference).collect()}
    assert got == VALUES | {("unknown", "gate"): ""}
    assert C.map_values(df.limit(0), reference).count() == 0
    assert {r["canonical"] for r in C.map_values(df, reference.limit(0)).collect()} == {""}


def test_nodes(spark, reference):
    rows = [("a", '{"valve_type":"gate","equipment_class":"vlv"}', "x"), ("a", '{"valve_type":"gate","equipment_class":"vlv"}', "x"), ("b", None, "x"), ("c", "{", "x"), ("d", '{"valve_type":null}', "x"), (None, '{"valve_type":"x"}', "x"), ("e", '{"valve_type":5}', "x")]
    got = C.node_entries(spark.createDataFrame(rows, "node_id string, attributes string, value string"), reference)
    assert sorted(tuple(r) for r in got.collect()) == [("a", "equipment_class", "valve"), ("e", "valve_type", "")]


def test_join_finds_every_similar_pair(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9)))
    a, b = {word() for _ in range(80)}, {word() for _ in range(60)}
    v = spark.createDataFrame([("f", x) for x in a], "field_name string, key string")
    e = spark.createDataFrame([("f", x) for x in b], "field_name string, entry_key string")

    def tokens(x):
        every = list(x) + [("^" + x + "$")[i : i + 2] for i in range(len(x) + 1)]
        return {(t, every[: i + 1].count(t)) for i, t in enumerate(every)}

    for least in (0.35, 0.6):
        want = {(x, y) for x in a for y in b if len(tokens(x) & tokens(y)) / len(tokens(x) | tokens(y)) >= least}
        assert {(r["key"], r["entry_key"]) for r in C.similar_entries(v, e, least).collect()} == want


def test_edits(spark):
    pairs = [("abc", "abc", 0), ("abc", "acb", 1), ("ca", "abc", 2), ("kitten", "sitting", 3), ("a", "b", 1), ("contorlelr", "controller", 2), ("exchnlager", "exchanger", 2), ("ab", "ba", 1), ("vavle", "valve", 1)]
    df = spark.createDataFrame(pairs, "a string, b string, want int")
    assert [r["got"] for r in df.select(C.edits(F.col("a"), F.col("b")).alias("got")).collect()] == [p[2] for p in pairs]


def test_edits_against_brute_force(spark):
    def near(word):
        """All words within one edit."""
        out = {word}
        for i in range(len(word) + 1):
            out |= {word[:i] + c + word[i:] for c in "ab"}
            if i < len(word):
                out |= {word[:i] + word[i + 1 :], *(word[:i] + c + word[i + 1 :] for c in "ab")}
            if i + 1 < len(word):
                out.add(word[:i] + word[i + 1] + word[i] + word[i + 2 :])
        return out

    rng = random.Random(7)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(40)]
    pairs = [(a, b) for a in words for b in words]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("off", C.edits(F.col("a"), F.col("b")))
    for r in df.collect():
        one = near(r["a"])
        want = 0 if r["a"] == r["b"] else 1 if r["b"] in one else 2 if any(r["b"] in near(x) for x in one if x) else 3
        assert min(r["off"], 3) == want, r


def test_readings(spark):
    df = spark.createDataFrame([("f", " 'Mixer' no. 4"), ("f", "Tower, Cooling"), ("f", "existing  PUMP (new)"), ("f", "act. for valve"), ("f", "3-way"), ("f", None)], "field_name string, value string")
    got = {}
    for r in C.readings(df.filter("value is not null"), {"f": ["thing"]}, 40).collect():
        got.setdefault(r["value"], {})[r["key"]] = r["cost"]
    assert got[" 'Mixer' no. 4"]["mixer"] == 0 and got["Tower, Cooling"]["coolingtower"] == C.TURNED and got["act. for valve"]["valveact"] == C.TURNED
    assert got["existing  PUMP (new)"]["pump"] == C.TURNED + C.LAST and got["3-way"]["threeway"] == 0


def test_spellings(spark, reference):
    held = {(r["field_name"], r["entry_key"]): (r["canonical"], r["kind"]) for r in C.spellings(reference, spark.createDataFrame([("valve_type", "check", "non return valve")], "field_name string, canonical string, name string")).collect()}
    assert held["equipment_class", "vlv"] == ("valve", "short") and held["equipment_class", "exchanger"] == ("heat_exchanger", "head")
    assert held["valve_type", "nrv"] == ("check", "short") and held["instrument_function", "indicat~"] == ("indicator", "stem")
    assert held["equipment_class", "tank"] == ("tank", "name") and ("equipment_class", "co") not in held  # of column and compressor both


def test_without_names_and_gloss(spark, reference):
    df = spark.createDataFrame([("equipment_class", "bomba"), ("equipment_class", "pmp"), ("equipment_class", "main pump"), ("equipment_class", "word " * 30_000)], "field_name string, value string")
    none = spark.createDataFrame([], "field_name string, canonical string, name string")
    got = {r["value"][:9]: r["canonical"] for r in C.map_values(df, reference.drop("gloss"), none).collect()}
    assert got == {"bomba": "", "pmp": "pump", "main pump": "pump", "word word": ""}
