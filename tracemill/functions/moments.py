"""Moments named in text, as UTC microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment_micros(text: Column) -> Column:
    """UTC microseconds of the moment that a client-written text names; null if it names none.

    Read: ISO date-times with T or blank, fractions, Z or an offset with or
    without colon; day-first dates with dots; epoch seconds, milliseconds and
    microseconds by their number of digits. Without an offset the text is UTC.
    """
    t = F.trim(text)
    iso = F.regexp_replace(t, r"^(\d{1,2})\.(\d{1,2})\.(\d{4})", "$3-$2-$1")
    iso = F.regexp_replace(iso, r"(:\d\d(?:[.,]\d+)?)\s*([+-]\d\d):?(\d\d)$", "$1$2:$3")
    iso = F.regexp_replace(iso, r"(:\d\d),(\d+)", "$1.$2")
    zoned = iso.rlike(r":\d\d(\.\d+)?\s*([zZ]|UTC|[+-]\d\d:\d\d)$")
    iso = F.when(zoned, F.regexp_replace(iso, r"z$", "Z")).when(iso.contains(":"), F.concat(iso, F.lit("Z"))).otherwise(
        F.concat(iso, F.lit("T00:00:00Z"))
    )
    digits = t.try_cast("bigint")
    return (
        F.when(t.rlike(r"^-?\d{16}$"), digits)
        .when(t.rlike(r"^-?\d{13}$"), digits * 1000)
        .when(t.rlike(r"^-?\d{9,10}$"), digits * 1000000)
        .when(t.rlike(r"^\d{1,4}[-.]\d{1,2}[-.]\d{1,4}"), F.unix_micros(iso.try_cast("timestamp")))
    )
