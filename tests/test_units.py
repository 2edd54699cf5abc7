import numpy as np
import pytest

from tracemill.functions.quantities import common_amount
from tracemill.operators import units

CASES = [
    ("design_duty", "129", None, "duty: 129 KW", 129),
    ("design_duty", "2.15", None, "Q = 2.15MW", 2150),
    ("design_duty", 1.78, "megawatt", None, 1780),
    ("design_duty", "762 898", None, "design duty = 762 898 Btu/h; tube size dn 500", 224),
    ("design_duty", "24,3", None, "heat duty: 24,3 MM Btu/hr", 7122),
    ("design_duty", "0.0979 Gcal/h", None, None, 114),
    ("design_duty", "ca. 132894 kcal/h", None, None, 155),
    ("design_duty", 1910.5, "MJ/h", None, 531),
    ("design_duty", "44342 W", None, None, 44),
    ("design_duty", "1.171,1", None, "heat duty = 1.171,1 kW", 1171),
    ("design_duty", "158191", None, "E-3559", None),
    ("design_duty", "TBD", None, "duty 5 kW", None),
    ("design_duty", None, "kW", None, None),
    ("design_duty", True, "kW", None, None),
    ("heat_transfer_area", "5'629 ft²", None, None, 52295),
    ("heat_transfer_area", "39.8sq.m", None, None, 3980),
    ("heat_transfer_area", "418 971", "cm²", None, 4190),
    ("heat_transfer_area", "84,5", "sq ft", None, 785),
    ("heat_transfer_area", "263", None, '2 passes; nominal dia: 8"; area 263', None),
    ("tube_length", "1,78 m", None, None, 1780),
    ("tube_length", "2,964.9", None, "L 2,964.9 MM", 2965),
    ("tube_length", "ca. 12'-11\"", None, None, 3937),
    ("tube_length", "5'-6 1/2\"", None, None, 1689),
    ("tube_length", "19 ft 5.5 in", None, None, 5931),
    ("tube_length", " 1'354 MM", None, None, 1354),
    ("tube_length", "53,7", None, 'L: 53,7"; A 393.5 m^2', 1364),
    ("tube_nominal_diameter", 16, "inch", None, 400),
    ("tube_nominal_diameter", "dn 700", None, None, 700),
    ("tube_nominal_diameter", "DN-25", None, None, 25),
    ("tube_nominal_diameter", "1-1/4", None, 'tube nominal diameter 1-1/4"; surface: 1 234 sq. ft.', 32),
    ("tube_nominal_diameter", "3/4", None, "tube nominal diameter: NPS 3/4", 20),
    ("tube_nominal_diameter", "3,2cm", None, None, 32),
    ("tube_nominal_diameter", 0.08, "m", None, 80),
    ("tube_nominal_diameter", "approx. NPS 12 (design)", None, None, 300),
]


@pytest.mark.parametrize("field,value,unit,quote,want", CASES)
def test_amounts(field, value, unit, quote, want):
    assert common_amount(field, value, unit, [quote]) == want


def test_operator_with_nulls_and_repeats(spark):
    s = "node_id string, attributes string, source_quote string, alternate_readings array<string>, label string, common_amount string"
    rows = [("a", '{"design_duty":"5 kW"}', None, None, None, "x")] * 2 + [("b", None, None, None, None, None), ("c", '{"design_duty":', "q", [None], "l", None), (None, '{"design_duty":"5 kW"}', None, [], None, None), ("d", '{"tube_length":"%s mm"}' % ("9" * 400), None, None, None, None), ("e", '["design_duty"]', None, None, None, None)]
    assert [tuple(r) for r in units.common_units(spark.createDataFrame(rows, s)).collect()] == [("a", "design_duty", 5)]
    assert units.common_units(spark.createDataFrame([], s)).count() == 0


def test_segments_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(30):
        size = int(rng.integers(1, 9))
        x = rng.choice([0.0, 3.0], size) + rng.normal(0, 0.1, size)
        n, s, q = np.ones(size), x, x * x
        got = [*units.segment(n, s, q, 0.5), size]
        cost = lambda cuts: sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip(cuts, cuts[1:])) + 0.5 * (len(cuts) - 2)  # noqa: B023, E731
        every = [[0, *[i + 1 for i in range(size - 1) if m >> i & 1], size] for m in range(1 << (size - 1))]
        assert cost(got) <= min(cost(c) for c in every) + 1e-9


def test_shift_is_found_and_reversed(spark):
    day = 86_400_000_000
    rows = [("s", f"n{i}", "tube_length", i * day // 4, 3000.0 + i if i < 120 else 3.0 + i / 1000) for i in range(160)]
    values = spark.createDataFrame(rows, "source string, node_id string, field_name string, at bigint, amount double")
    shifts = units.unit_shifts(values)
    assert {(r["unit"], r["from_day"]) for r in shifts.collect()} == {("", 0), ("m", 30)}
    back = units.reverse_shifts(values, shifts).filter("common < 1000").count()
    assert back == 0
    assert units.unit_shifts(values.limit(0)).count() == 0


def test_recall_of_planted_shifts(spark):
    """Histories of scattered values that change their unit twice: nine shifts of ten and more come out, to the day and with the right unit."""
    rng = np.random.default_rng(11)
    day = 86_400_000_000
    rows, planted = [], {}
    for k in range(60):
        field = list(units.KNOWN_FACTORS)[k % 4]
        names = list(units.KNOWN_FACTORS[field])
        other, first, last = names[1 + int(rng.integers(len(names) - 1))], int(rng.integers(60, 80)), int(rng.integers(85, 105))
        planted[f"s{k}", field, first] = other
        planted[f"s{k}", field, last] = ""
        for d in range(120):
            for _ in range(int(rng.integers(4, 9))):
                true = 10 ** rng.normal(3.0, 0.25)
                rows.append((f"s{k}", f"n{len(rows)}", field, d * day + int(rng.integers(day)), float(true / (units.KNOWN_FACTORS[field][other] if first <= d < last else 1.0))))
    values = spark.createDataFrame(rows, "source string, node_id string, field_name string, at bigint, amount double")
    got = {(r["source"], r["field_name"], r["from_day"]): r["unit"] for r in units.unit_shifts(values).collect()}
    hits = sum(got.get(key) == unit for key, unit in planted.items())
    extra = sum(1 for key in got if key not in planted and key[2] > 0)
    print("shifts of", len(planted), ":", hits, "found,", extra, "more")
    assert hits >= 0.9 * len(planted) and extra <= 0.05 * len(planted)


def test_home_in_another_unit():
    levels = [np.log10(2.0), np.log10(2.0 / 0.3048), np.log10(2.0 / 0.0254)]  # m, ft, in: the most is in m
    f = units.KNOWN_FACTORS["tube_length"]
    named = units.named_shifts(levels, [100, 40, 30], 0, f, 0.05)
    assert [u for u, _ in named] == ["", "ft", "in"] and abs(named[1][1] - 0.3048) < 1e-9
    assert units.named_shifts([1.0, 1.2], [2, 1], 0, f, 0.05) == [("", 1.0), ("", 1.0)]
