"""Codes and vectors: near codes by bands, nearest vectors of a stated query set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sign_code(vector: Column, bits: int = 64) -> Column:
    """The signs of the first `bits` entries as text of 0 and 1; null for shorter vectors."""
    return F.when(F.size(vector) >= bits, F.array_join(F.transform(F.slice(vector, 1, bits), lambda v: F.when(v > 0, "1").otherwise("0")), ""))


def hamming(a: Column, b: Column) -> Column:
    """Places in which two codes of 0 and 1 of one length differ, at most 64 bits."""
    halves = lambda c: (F.conv(F.substring(c, 1, 32), 2, 10).cast("bigint"), F.conv(F.substring(c, 33, 32), 2, 10).cast("bigint"))
    (ah, al), (bh, bl) = halves(a), halves(b)
    return F.bit_count(ah.bitwiseXOR(bh)) + F.bit_count(al.bitwiseXOR(bl))


def near_codes(codes: DataFrame, most: int, bits: int = 64) -> DataFrame:
    """a, b, distance of pairs of ids whose codes differ in at most `most` places. codes: id, code.

    The code is cut into most + 1 bands; codes that near agree in one of them
    (pigeonhole), so a join per band finds every pair. Equal codes are grouped
    first: each group is joined through its least id, and its other members are
    linked to that one.
    """
    held = codes.filter(F.col("code").isNotNull())
    lead = held.groupBy("code").agg(F.min("id").alias("lead"))
    copies = held.join(lead, "code").filter("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance"))
    step = -(-bits // (most + 1))
    bands = F.array(*[F.struct(F.lit(k).alias("band"), F.substring("code", 1 + k * step, step).alias("part")) for k in range(most + 1)])
    banded = lead.select(F.col("lead").alias("id"), "code", F.inline(bands))
    other = banded.select("band", "part", F.col("id").alias("b"), F.col("code").alias("code_b"))
    pairs = banded.withColumnRenamed("id", "a").join(other, ["band", "part"]).filter("a < b").select("a", "b", hamming(F.col("code"), F.col("code_b")).alias("distance"))
    return copies.unionByName(pairs.filter(F.col("distance") <= most).distinct())


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


#: Query vectors that are sent to all tasks at once; more are taken in blocks of about this size.
BLOCK_QUERIES = 5_000


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, place, score: the k most similar vectors of each query, itself aside, ties by id.

    queries: query_id, query: a stated set that is held against all vectors, in
    blocks of about BLOCK_QUERIES, so that what is broadcast stays bounded.
    Vectors of zeros and null vectors are similar to none.
    """
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = None
    for b in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else queries
        pairs = vectors.filter("embedding is not null").join(F.broadcast(block)).filter("vec_id <> query_id").withColumn("score", cosine(F.col("query"), F.col("embedding")))
        part = pairs.filter("score is not null").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).select("query_id", "vec_id", "place", "score")
        out = part if out is None else out.unionByName(part)
    return out
