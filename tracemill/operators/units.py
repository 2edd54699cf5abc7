"""One unit for quantities that were recorded in many.

Two ways, for two kinds of values. Where a unit stands anywhere in a record it
is read and the value converted exactly (`common_units`). Where none does, the
history of a source is segmented: an exact penalised changepoint search on log
values finds level shifts, and a shift that matches a known factor marks a
change of unit that is reversed (`unit_shifts`, `reverse_shifts`).
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.jsonwalk import complete_json
from tracemill.functions.quantities import FIELDS, common_amount, plain_text, read_quantity

AMOUNTS = "node_id string, field_name string, common_amount bigint"


def common_units(nodes: DataFrame) -> DataFrame:
    """node_id, field_name, common_amount of every value with a unit in its record.

    Reads node_id, attributes, source_quote, alternate_readings and label; other
    columns are ignored. Null or damaged attributes, null values, texts without
    a number, numbers without unit and amounts beyond 64 bits give no row.
    Repeated rows give one.
    """
    named = " or ".join(f"contains(attributes, '{f}')" for f in FIELDS)

    def convert(batches):
        for b in batches:
            rows = []
            for node, attributes, quote, readings, label in zip(b.node_id, b.attributes, b.source_quote, b.alternate_readings, b.label):
                whole, held = complete_json(attributes)
                if not whole or not isinstance(held, dict):
                    continue
                texts = [quote, *(readings if readings is not None else ()), label]
                for field in FIELDS:
                    if field in held:
                        amount = common_amount(field, held[field], held.get(f"{field}_unit"), texts)
                        if amount is not None and -(2**63) <= amount < 2**63:
                            rows.append((node, field, amount))
            yield pd.DataFrame(rows, columns=["node_id", "field_name", "common_amount"])

    picked = nodes.filter(F.col("node_id").isNotNull()).filter(named)
    return picked.select("node_id", "attributes", "source_quote", "alternate_readings", "label").mapInPandas(convert, AMOUNTS).distinct()


def bare_values(nodes: DataFrame) -> DataFrame:
    """source, node_id, field_name, at, amount of the values that carry no unit anywhere in their record."""
    named = " or ".join(f"contains(attributes, '{f}')" for f in FIELDS)

    def read(batches):
        for b in batches:
            rows = []
            for source, node, at, attributes, quote, readings, label in zip(
                b.fixture, b.node_id, b["at"], b.attributes, b.source_quote, b.alternate_readings, b.label
            ):
                whole, held = complete_json(attributes)
                if not whole or not isinstance(held, dict):
                    continue
                texts = [quote, *(readings if readings is not None else ()), label]
                for field in FIELDS:
                    value = held.get(field)
                    if value is None or isinstance(value, (bool, list, dict)):
                        continue
                    if common_amount(field, value, held.get(f"{field}_unit"), texts) is None:
                        number = read_quantity(field, plain_text(value if isinstance(value, str) else json.dumps(value)))[0]
                        if number is not None and number > 0:
                            rows.append((source, node, field, at, float(number)))
            yield pd.DataFrame(rows, columns=["source", "node_id", "field_name", "at", "amount"])

    picked = nodes.filter(F.col("node_id").isNotNull() & F.col("fixture").isNotNull() & F.col("extracted_at").isNotNull()).filter(named)
    return picked.select("fixture", "node_id", F.unix_micros("extracted_at").alias("at"), "attributes", "source_quote", "alternate_readings", "label").mapInPandas(
        read, "source string, node_id string, field_name string, at bigint, amount double"
    )


def segment(n: np.ndarray, total: np.ndarray, squares: np.ndarray, penalty: float) -> list[int]:
    """Starts of the segments of least squared error plus penalty per change.

    Exact: optimal partitioning over all starts, with the starts pruned that can
    never again be best. Every point is n values with their sum and square sum.
    """
    cn, cs, cq = (np.concatenate([[0.0], np.cumsum(x)]) for x in (n, total, squares))
    size = len(n)
    best = np.full(size + 1, math.inf)
    best[0] = -penalty
    last = np.zeros(size + 1, dtype=np.int64)
    starts = np.array([0], dtype=np.int64)
    for end in range(1, size + 1):
        cost = (cq[end] - cq[starts]) - (cs[end] - cs[starts]) ** 2 / (cn[end] - cn[starts])
        whole = best[starts] + cost + penalty
        k = int(np.argmin(whole))
        best[end], last[end] = whole[k], starts[k]
        starts = np.append(starts[whole - penalty <= best[end]], end)
    out, at = [], size
    while at > 0:
        at = int(last[at])
        out.append(at)
    return out[::-1]


#: Known factors of the units of one field to its common unit, which comes first.
KNOWN_FACTORS = {
    "design_duty": {"kW": 1.0, "MW": 1000.0, "W": 0.001, "kcal/h": 0.001163, "Btu/h": 0.000293071, "MMBtu/h": 293.071, "Gcal/h": 1163.0, "MJ/h": 0.277778},
    "heat_transfer_area": {"dm2": 1.0, "m2": 100.0, "cm2": 0.01, "ft2": 9.290304},
    "tube_length": {"mm": 1.0, "m": 1000.0, "cm": 10.0, "in": 25.4, "ft": 304.8},
    "tube_nominal_diameter": {"DN": 1.0, "in": 25.0, "cm": 10.0, "m": 1000.0},
}
SHIFTS = "source string, field_name string, from_day int, to_day int, values bigint, level double, unit string, factor double"
#: Variance of log10 below which changes of level don't matter; all known factors lie much further apart.
LEAST_SPREAD = 0.0025


def noise(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> float:
    """Variance of single values about a level that may shift: robust, from the differences of successive points."""
    total = q.sum() / n.sum() - (s.sum() / n.sum()) ** 2
    if len(n) > 2:
        steps = np.diff(s / n) ** 2 / (1 / n[1:] + 1 / n[:-1])
        total = min(total, float(np.median(steps)) / 0.455)
    return max(total, LEAST_SPREAD)


def named_shifts(levels: list[float], counts: list[float], home: int, factors: dict[str, float], tolerance: float) -> list[tuple[str, float]]:
    """(unit, factor to the unit of segment `home`) of each segment; ('', 1) where its level is no known factor away.

    The home segment may itself be in any of the units: that one counts under
    which most values lie at a known factor, the common unit of several.
    """
    best, fit = None, -1.0
    for base, f in factors.items():
        got, score = [], 0.0
        for level, n in zip(levels, counts):
            want = levels[home] - level + math.log10(f)
            off, unit, g = min(((abs(want - math.log10(g)), u, g) for u, g in factors.items()), key=lambda x: x[0])
            got.append((unit, g / f) if off <= tolerance and unit != base else ("", 1.0))
            score += n * (off <= tolerance)
        if score > fit:
            best, fit = got, score
    return best if best is not None else [("", 1.0)] * len(levels)


def unit_shifts(values: DataFrame, penalty: float = 3.0, tolerance: float = 0.12) -> DataFrame:
    """Segments of every (source, field) history, with the unit that each one's shift from the largest marks.

    values: source, field_name, at (micros), amount > 0. Histories are first
    aggregated to days (count, sum, square sum of log10), on the map side too,
    so that a group holds one row a day whatever the number of values; changes
    are exact to the day. A segment whose level lies a known factor (within
    `tolerance` in log10) below or above the history's largest segment gets that
    unit; others get '' and factor 1. Nulls are left out; an empty table gives
    no row.
    """
    log = F.log10("amount")
    days = (
        values.filter("source is not null and field_name is not null and at is not null and amount > 0")
        .withColumn("day", F.floor(F.col("at") / F.lit(86_400_000_000)).cast("int"))
        .groupBy("source", "field_name", "day")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(log).alias("s"), F.sum(log * log).alias("q"))
    )

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        n, s, q = (pdf[c].to_numpy(dtype=float) for c in ("n", "s", "q"))
        cuts = [*segment(n, s, q, penalty * noise(n, s, q) * math.log(max(n.sum(), 2.0))), len(n)]
        parts = [(a, b, n[a:b].sum(), s[a:b].sum() / n[a:b].sum()) for a, b in zip(cuts, cuts[1:])]
        home = max(range(len(parts)), key=lambda k: (parts[k][2], -k))
        field, days_ = pdf.field_name.iloc[0], pdf.day.to_numpy()
        named = named_shifts([p[3] for p in parts], [p[2] for p in parts], home, KNOWN_FACTORS.get(field, {}), tolerance)
        rows = [(pdf.source.iloc[0], field, int(days_[a]), int(days_[b - 1]), int(count), round(level, 9), unit, factor) for (a, b, count, level), (unit, factor) in zip(parts, named)]
        return pd.DataFrame(rows, columns=["source", "field_name", "from_day", "to_day", "values", "level", "unit", "factor"])

    return days.groupBy("source", "field_name").applyInPandas(one, SHIFTS)


def reverse_shifts(values: DataFrame, shifts: DataFrame) -> DataFrame:
    """The values in the unit of their history's main segment. shifts: one row per history segment, far fewer than values."""
    day = F.floor(F.col("at") / F.lit(86_400_000_000)).cast("int")
    s = shifts.select(F.col("source").alias("s_"), F.col("field_name").alias("f_"), "from_day", "to_day", "factor", "unit")
    on = (F.col("source") == F.col("s_")) & (F.col("field_name") == F.col("f_")) & day.between(F.col("from_day"), F.col("to_day"))
    return values.join(s, on, "left").select(
        "source", "node_id", "field_name", "at", "amount", (F.col("amount") * F.coalesce("factor", F.lit(1.0))).alias("common"), F.coalesce("unit", F.lit("")).alias("unit")
    )
