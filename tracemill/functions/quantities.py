"""Reading numbers and units out of free text, exactly."""

from __future__ import annotations

import re
import unicodedata
from fractions import Fraction
from functools import lru_cache

# Unit definitions. Duty in kW, area in dm2, length in mm.
BTU_IT_J = Fraction("1055.05585262")
CAL_IT_J = Fraction("4.1868")
ENERGY_J = {
    "btu": BTU_IT_J,
    "cal": CAL_IT_J,
    "j": Fraction(1),
    "wh": Fraction(3600),
}
PREFIX = {"": 1, "k": 10**3, "m": 10**6, "g": 10**9}
SECONDS = {"s": 1, "min": 60, "h": 3600, "d": 86400}
AREA_DM2 = {
    "m2": Fraction(100),
    "dm2": Fraction(1),
    "cm2": Fraction(1, 100),
    "mm2": Fraction(1, 10000),
    "ft2": Fraction("9.290304"),
    "in2": Fraction("0.064516"),
    "yd2": Fraction("83.612736"),
}
LENGTH_MM = {
    "mm": Fraction(1),
    "cm": Fraction(10),
    "dm": Fraction(100),
    "m": Fraction(1000),
    "in": Fraction("25.4"),
    "ft": Fraction("304.8"),
    "yd": Fraction("914.4"),
}
# The standard pairing of nominal pipe size (inch) and DN.
NPS_DN = {
    "1/8": 6,
    "1/4": 8,
    "3/8": 10,
    "1/2": 15,
    "3/4": 20,
    "1": 25,
    "5/4": 32,
    "3/2": 40,
    "2": 50,
    "5/2": 65,
    "3": 80,
    "7/2": 90,
    "4": 100,
    "9/2": 115,
    "5": 125,
    "6": 150,
    "7": 175,
    "8": 200,
    "9": 225,
}
PAIRING = {Fraction(k): v for k, v in NPS_DN.items()}

LABELS = {
    "design_duty": r"(?:design\s+duty|heat\s+duty|thermal\s+duty|duty|q)",
    "heat_transfer_area": r"(?:heat\s+transfer\s+(?:area|surface)|exchange\s+area|area|surface|a)",
    "tube_length": r"(?:tubes?\s*,?\s*length|length|l)",
    "tube_nominal_diameter": r"(?:tube\s+nominal\s+dia(?:meter|\.)?|nominal\s+dia(?:meter|\.)?|tube\s+(?:size|dia(?:meter|\.)?))",
}
FIELDS = tuple(LABELS)

_VULGAR = {"¼": " 1/4", "½": " 1/2", "¾": " 3/4", "⅛": " 1/8", "⅜": " 3/8", "⅝": " 5/8", "⅞": " 7/8"}
_QUOTES = {"″": '"', "“": '"', "”": '"', "„": '"', "′": "'", "’": "'", "‘": "'", "`": "'", "´": "'", "⁄": "/", "−": "-", "–": "-"}
_SWAP = str.maketrans(_VULGAR | _QUOTES)

_GROUPED = r"\d{1,3}(?:(?P<g>[ '])\d{3})(?:(?P=g)\d{3})*(?!\d)(?:[.,]\d+)?"
_PLAIN = r"\d+(?:[.,]\d+)*|[.,]\d+"
_FRACTION = r"(?:(?P<whole>\d+)(?:\s+|\s*-\s*))?(?P<num>\d+)\s*/\s*(?P<den>[1-9]\d*)"
_NUMBER = re.compile(rf"(?P<sign>-(?=[\d.,]))?(?:(?P<frac>{_FRACTION})|(?P<grouped>{_GROUPED})|(?P<plain>{_PLAIN}))")
_INCHES = r"(?:(?P<iw>\d+(?:[.,]\d+)?)?(?:[\s-]*(?P<in_>\d+)\s*/\s*(?P<id>[1-9]\d*))?)"
_FEET_INCH = re.compile(
    rf"(?P<feet>\d+)\s*(?:'(?!\d{{3}}(?!\d|\s*(?:\"|in)))|ft\.?|feet|foot)\s*-?\s*{_INCHES}\s*(?:\"|''|inch(?:es)?|in)\.?(?![a-z])"
)

_TIME = r"\s*(?:/|per\s|p)\s*(?P<t>sec(?:ond)?s?|s|min(?:ute)?s?|hours?|hrs?|h|days?|d)\b\.?"
_UNITS = {
    "design_duty": [
        re.compile(rf"(?P<p>mm|mega|kilo|giga|[kmg])?\s*(?P<e>btu|cal(?:orie)?s?|joules?|j)(?:{_TIME})"),
        re.compile(r"(?P<p>mega|kilo|giga|[kmg])?\s*(?P<w>watts?|w)(?![a-z])(?!\s*h\b)"),
    ],
    "heat_transfer_area": [
        re.compile(r"(?:sq(?:uare)?\.?\s*(?P<u>mm|cm|dm|met(?:er|re)s?|m|feet|foot|ft|inch(?:es)?|in|yd)\.?)(?![a-z])"),
        re.compile(r"(?P<u>mm|cm|dm|met(?:er|re)s?|m|feet|foot|ft|inch(?:es)?|in|yd)\.?\s*(?:\^|\*\*)?\s*2(?!\d)"),
    ],
    "tube_length": [
        re.compile(r"(?P<u>millimet(?:er|re)s?|centimet(?:er|re)s?|mm|cm|dm|met(?:er|re)s?|mtrs?|m|feet|foot|ft|inch(?:es)?|in|yd)\.?(?![a-z0-9^])"),
        re.compile(r"(?P<u>\"|''|')"),
    ],
}
_UNITS["tube_nominal_diameter"] = [re.compile(r"(?P<u>dn|nps)(?![a-z])"), *_UNITS["tube_length"]]
_BEFORE = re.compile(r"(?P<u>dn|nps)\s*[-.:]?\s*$")
_ALIKE = {"feet": "ft", "foot": "ft", "inch": "in", "inches": "in", '"': "in", "''": "in", "'": "ft", "mtr": "m", "mtrs": "m"}


def plain_text(text: str) -> str:
    """Compatibility forms folded, primes and vulgar fractions plain, lower case."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text.translate(_SWAP)).lower())


def read_number(m: re.Match) -> Fraction | None:
    """The one value of a matched number: a lone comma is decimal, so is a lone dot; of both the last is."""
    if m["frac"]:
        value = Fraction(int(m["whole"] or 0)) + Fraction(int(m["num"]), int(m["den"]))
    else:
        text = (m["grouped"] or m["plain"]).replace(" ", "").replace("'", "")
        dots, commas = text.count("."), text.count(",")
        if dots and commas:
            last = max(text.rfind("."), text.rfind(","))
            if text.count(text[last]) > 1:
                return None
            text = re.sub(r"[.,]", "", text[:last]) + "." + text[last + 1 :]
        elif dots > 1 or commas > 1:
            text = re.sub(r"[.,]", "", text)
        else:
            text = text.replace(",", ".")
        value = Fraction(text)
    return -value if m["sign"] else value


def unit_at(field: str, text: str) -> tuple[str, Fraction] | None:
    """The unit that text begins with, as (name, factor to the common unit); factor 0 for inches that name a nominal size."""
    text = text.lstrip(" ")
    for pattern in _UNITS[field]:
        m = pattern.match(text)
        if not m:
            continue
        found = m.groupdict()
        if field == "design_duty":
            lead = {"mm": "m", "mega": "m", "kilo": "k", "giga": "g"}.get(found["p"] or "", found["p"] or "")
            if found.get("w"):
                return "w", Fraction(PREFIX[lead], 1000)
            energy = {"b": "btu", "c": "cal", "j": "j"}[found["e"][0]]
            scale = 1000 if energy == "btu" and found["p"] == "m" else PREFIX[lead]
            per = found["t"]
            seconds = SECONDS["min" if per.startswith("mi") else per[0]]
            return energy, ENERGY_J[energy] * scale / seconds / 1000
        unit = found["u"]
        unit = _ALIKE.get(unit, "mm" if unit.startswith("milli") else "cm" if unit.startswith("centi") else "m" if unit.startswith("met") else unit)
        if field == "heat_transfer_area":
            return unit, AREA_DM2[f"{unit}2"]
        if field == "tube_nominal_diameter":
            return (unit, Fraction(0)) if unit in ("in", "nps") else (unit, Fraction(1) if unit == "dn" else LENGTH_MM[unit])
        return unit, LENGTH_MM[unit]
    return None


def nominal(inches: Fraction) -> Fraction:
    """DN of a nominal size in inches: the pairing, 25 mm an inch from 10 inches on and between."""
    return Fraction(PAIRING.get(inches, inches * 25))


def common(value: Fraction, factor: Fraction) -> int:
    """The value in the common unit, rounded half up."""
    exact = nominal(value) if factor == 0 else value * factor
    return (2 * exact.numerator + exact.denominator) // (2 * exact.denominator)


def _feet_inches(text: str) -> tuple[Fraction, re.Match] | None:
    m = _FEET_INCH.match(text)
    if not m or not (m["iw"] or m["in_"]):
        return None
    inches = Fraction((m["iw"] or "0").replace(",", "."))
    if m["in_"]:
        inches += Fraction(int(m["in_"]), int(m["id"]))
    return Fraction(m["feet"]) * 12 + inches, m


@lru_cache(maxsize=4096)
def _label(field: str) -> re.Pattern:
    return re.compile(rf"(?:^|[^a-z0-9]){LABELS[field]}\s*(?:\([^)]*\)\s*)?[:=]?\s*(?:is|of|approx\.?|ca\.?|~)?\s*(?=[\d.,-]|dn|nps)")


def read_quantity(field: str, text: str) -> tuple[Fraction | None, tuple[str, Fraction] | None, str]:
    """(number, unit, rest) of the first quantity in plain text."""
    for m in re.finditer(r"[\d.,-]", text):
        start = m.start()
        if field == "tube_length" and (both := _feet_inches(text[start:])):
            return both[0], ("in", LENGTH_MM["in"]), text[start + both[1].end() :]
        n = _NUMBER.match(text, start)
        if not n:
            continue
        value = read_number(n)
        if value is None:
            return None, None, ""
        unit = unit_at(field, text[n.end() :])
        if field == "tube_nominal_diameter" and (b := _BEFORE.search(text[:start].rstrip())):
            unit = (b["u"], Fraction(1) if b["u"] == "dn" else Fraction(0))
        return abs(value) if field == "tube_nominal_diameter" and n["sign"] else value, unit, text[n.end() :]
    return None, None, ""


def common_amount(field: str, value, unit_text: str | None, texts: list[str | None]) -> int | None:
    """A value in the common unit of its field, or None if it is no value or no unit stands in its record.

    The unit is looked for in the value's own text, then in the unit field of
    the record, then in the record's other texts behind the field's name, there
    with the same number.
    """
    if value is None or isinstance(value, (bool, list, dict)):
        return None
    if isinstance(value, (int, float)):
        try:
            number, unit = Fraction(str(value)), None
        except ValueError:
            return None
    else:
        number, unit, _ = read_quantity(field, plain_text(value))
    if number is None:
        return None
    if unit is None and isinstance(unit_text, str):
        unit = unit_at(field, plain_text(unit_text))
    if unit is None:
        for text in texts:
            if not text:
                continue
            plain = plain_text(text)
            for m in _label(field).finditer(plain):
                stated, there, _ = read_quantity(field, plain[m.end() :].split(";")[0])
                if there is not None and stated == number:
                    unit = there
                    break
            if unit is not None:
                break
    return None if unit is None else common(number, unit[1])

