"""Stable identifiers and buckets out of content, the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts' text joined by U+001F; nulls count as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(digest(*parts), 1, 16))


def undirected_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def hash_bucket(key: Column, buckets: int) -> Column:
    """Bucket by the first 32 bits of the key's SHA-256."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def split_name(key: Column) -> Column:
    """train, validation or test, 70 to 15 to 15, by the key's bucket."""
    b = hash_bucket(key, 100)
    return F.when(b < 70, "train").when(b < 85, "validation").otherwise("test")
