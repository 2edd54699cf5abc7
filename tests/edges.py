"""Tables for edge cases, made from the smallest test tables' schemas."""

import os

from pyspark.sql import functions as F


def write_edge_tables(spark, source: str, out: str, nulls: bool) -> str:
    """All tables without rows, or with two rows of nulls, two of the first row and one of it with every second column null."""
    for name in sorted(os.listdir(source)):
        df = spark.read.parquet(f"{source}/{name}")
        edge = df.limit(0)
        if nulls:
            one = df.limit(1)
            blank = one.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
            half = one.select(*[F.lit(None).cast(f.dataType).alias(f.name) if k % 2 else F.col(f.name) for k, f in enumerate(df.schema)])
            edge = blank.unionByName(blank).unionByName(one).unionByName(one).unionByName(half)
        edge.coalesce(1).write.parquet(f"{out}/{name}")
    return out
