"""Ranked retrieval, interleaving across groups, and admission under a budget."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.session import discard, materialise


def words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def retrieve(entries: DataFrame, query_terms: list[str], key: str, heading: str, tags: str, body: str, pinned: Column | None = None) -> DataFrame:
    """key, score of the entries that some term hits, by ln(1 + N / (1 + df)) a term: 4 in the heading, else 2 in the tags, else 1 / (1 + body words / 120).

    df counts the entries that hold the term anywhere. +100 for pinned ones;
    scores of 0 are dropped. The terms are few and stated.
    """
    e = entries.select(
        F.col(key), words(F.coalesce(heading, F.lit(""))).alias("h"), F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower).alias("t"), words(F.coalesce(body, F.lit(""))).alias("b"), (pinned if pinned is not None else F.lit(False)).alias("pin")
    )
    terms = F.array(*[F.lit(q) for q in sorted(set(query_terms))])
    hit = F.filter(
        F.transform(
            terms,
            lambda q: F.struct(
                q.alias("term"),
                F.when(F.array_contains(F.col("h"), q), 4.0).when(F.array_contains(F.col("t"), q), 2.0).when(F.array_contains(F.col("b"), q), 1.0 / (1.0 + F.size("b") / 120.0)).otherwise(0.0).alias("w"),
            ),
        ),
        lambda s: s["w"] > 0,
    )
    hits = e.select(key, "pin", F.explode_outer(hit).alias("hit")).select(key, "pin", "hit.term", "hit.w")
    df = hits.filter("term is not null").groupBy("term").agg(F.countDistinct(key).alias("df"))
    total = entries.agg(F.count(F.lit(1)).alias("total"))
    # one row a term, one row in all: bounded by the query
    weighed = hits.join(F.broadcast(df), "term", "left").join(F.broadcast(total))
    score = F.sum(F.coalesce(F.log(1 + F.col("total") / (1 + F.col("df"))) * F.col("w"), F.lit(0.0))) + F.max(F.when(F.col("pin"), 100.0).otherwise(0.0))
    return weighed.groupBy(key).agg(score.alias("score")).filter("score > 0")


def round_robin(df: DataFrame, group: list[str], order: list, limit: int) -> DataFrame:
    """Rows interleaved: the best of every group, then the second of every group, and so on, up to limit.

    Only rows that can come among the first `limit` are ordered at last.
    """
    w = W.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return ranked.orderBy("rank", *group).limit(limit)


def admit(costs: list[tuple[object, int]], budget: int, most: int) -> list[object]:
    """Keys admitted in order: what doesn't fit is skipped, not an end; at most `most`."""
    out, used = [], 0
    for key, cost in costs:
        if len(out) < most and used + cost <= budget:
            out.append(key)
            used += cost
    return out


def admitted(df: DataFrame, group: list[str], order: list[Column], key: str, cost: str, budget: int, most: int) -> DataFrame:
    """group, admitted keys in order, used: what is taken under a budget and a count per group, the rest skipped.

    Each of at most `most` rounds takes, in every group at once, the first row
    behind the last one taken that still fits: a minimum, gathered on the map
    side, so that a group of any size never comes together. Rows of a negative
    or null cost are left out, and ties in the order are taken as they sort
    with cost and key. Groups may be null; those without a fitting row have none.
    """
    place = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.col(cost).cast("bigint").alias("cost"), F.col(key).alias("key"), F.row_number().over(W.partitionBy(*group, *order, cost, key).orderBy(F.lit(0))).alias("copy"))
    fit = materialise(df.filter((F.col(cost) >= 0) & (F.col(cost) <= budget)).select(*group, place.alias("at")), "fitting")
    state = fit.groupBy(*group).agg(F.min("at").alias("last")).withColumn("keys", F.array("last.key")).withColumn("used", F.col("last.cost"))
    state = materialise(state, "admitted")
    on = lambda a, b: reduce(and_, [a[g].eqNullSafe(b[g]) for g in group])
    for _ in range(most - 1):
        s = state.select(*[F.col(g).alias(f"_{g}") for g in group], "last", "used")
        open_ = fit.join(s, reduce(and_, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]))
        found = open_.filter((F.col("at") > F.col("last")) & (F.col("at.cost") + F.col("used") <= budget)).groupBy(*group).agg(F.min("at").alias("at"))
        found = materialise(found, "next")
        if found.isEmpty():
            break
        joined = state.join(found, on(state, found), "left").select(*[state[g] for g in group], "last", "keys", "used", "at")
        took = F.col("at").isNotNull()
        last = state, found
        state = materialise(
            joined.select(*group, F.coalesce("at", "last").alias("last"), F.when(took, F.array_append("keys", F.col("at.key"))).otherwise(F.col("keys")).alias("keys"), F.when(took, F.col("used") + F.col("at.cost")).otherwise(F.col("used")).alias("used")), "admitted"
        )
        discard(*last)
    return state.select(*group, F.col("keys").alias("admitted"), "used")
