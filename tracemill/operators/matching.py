"""One-to-one matching and order-dependent suppression, per group.

Groups are single pages or drawings of candidates that a join has already
bounded; they are streamed one at a time out of sorted partitions. Pages of
unbounded size are split into the connected parts of their candidate graph
first (`part_of`), since no match or suppression reaches across parts.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators.graph import components


def part_of(pairs: DataFrame, keys: list[str], a: str = "l_id", b: str = "r_id") -> DataFrame:
    """Pairs with `part`: the connected part of the candidate graph that they lie in."""
    name = lambda side, c: F.concat_ws("\x1f", F.lit(side), *[F.col(k).cast("string") for k in keys], F.col(c).cast("string"))
    named = pairs.withColumn("_a", name("l", a)).withColumn("_b", name("r", b))
    parts = components(named.select(F.col("_a").alias("from_node"), F.col("_b").alias("to_node")))
    return named.join(parts.select(F.col("node").alias("_a"), F.col("component").alias("part")), "_a").drop("_a", "_b")


def per_group(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[list[tuple]], list[tuple]], columns: list[str], schema: str) -> DataFrame:
    """Applies `fold` to the rows (tuples of `columns`) of each group, in `order`; groups are streamed out of sorted partitions."""
    names = [x.split()[0] for x in schema.split(", ")]
    at = [columns.index(k) for k in keys]

    def run(batches):
        group: list[tuple] = []
        for b in batches:
            rows: list[tuple] = []
            for r in b[columns].itertuples(index=False, name=None):
                if group and any(r[i] != group[0][i] for i in at):
                    rows += fold(group)
                    group = []
                group.append(r)
            yield pd.DataFrame(rows, columns=names)
        yield pd.DataFrame(fold(group) if group else [], columns=names)

    return df.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def greedy_pairs(rows: list[tuple[object, object]]) -> list[tuple[object, object]]:
    """Takes pairs in their order, each side once."""
    left, right, out = set(), set(), []
    for a, b in rows:
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.append((a, b))
    return out


def most_pairs(rows: list[tuple[object, object]]) -> list[tuple[object, object]]:
    """A matching of as many pairs as there can be; earlier pairs are tried first. Alternating paths, without recursion."""
    options: dict[object, list[object]] = {}
    for a, b in rows:
        options.setdefault(a, []).append(b)
    owner: dict[object, object] = {}
    held: dict[object, object] = {}
    for a in options:
        came: dict[object, object] = {}
        queue, end = [a], None
        while queue and end is None:
            x = queue.pop(0)
            for b in options[x]:
                if b not in came:
                    came[b] = x
                    if b not in owner:
                        end = b
                        break
                    queue.append(owner[b])
        while end is not None:
            x = came[end]
            before = held.get(x)
            owner[end], held[x] = x, end
            end = before
    return sorted(((a, b) for b, a in owner.items()), key=lambda p: (str(p[0]), str(p[1])))


def heaviest_pairs(rows: list[tuple[object, object, float]]) -> list[tuple[object, object, float]]:
    """A matching of greatest total weight."""
    from tracemill.operators.drift import best_matching

    a, b = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    weight = [[0.0] * len(b) for _ in a]
    ia, ib = {x: i for i, x in enumerate(a)}, {x: i for i, x in enumerate(b)}
    for x, y, w in rows:
        weight[ia[x]][ib[y]] = max(weight[ia[x]][ib[y]], w)
    return [(a[i], b[j], weight[i][j]) for i, j in best_matching(weight)]


def suppressed(boxes: list[tuple], threshold: float) -> list[tuple]:
    """(id, kept, owner) of boxes (id, x, y, w, h) in order of preference: one is suppressed by the first kept box with IoU >= threshold."""
    kept: list[tuple] = []
    out = []
    for k, x, y, w, h in boxes:
        owner = None
        for o, u, v, m, n in kept:
            i = max(0, min(x + w, u + m) - max(x, u)) * max(0, min(y + h, v + n) - max(y, v))
            if i and i / (w * h + m * n - i) >= threshold:
                owner = o
                break
        if owner is None:
            kept.append((k, x, y, w, h))
        out.append((k, owner is None, owner))
    return out


def kept_of_pairs(boxes: DataFrame, pairs: DataFrame, keys: list[str], most_rounds: int | None = None) -> DataFrame:
    """Greedy suppression without groups: keys, id, kept. boxes: keys, id; pairs: keys, better, worse ids that overlap.

    A box is kept once all its better neighbours are suppressed, and suppressed
    once one of them is kept; decided round by round, the same result as taking
    the boxes in order of preference, but with no group ever in one task.
    """
    from tracemill.operators.graph import rounds
    from tracemill.session import discard, materialise

    open_ = materialise(boxes.select(*keys, "id").distinct(), "open")
    left = materialise(pairs.select(*keys, "better", "worse").distinct(), "pairs")
    done = None
    for _ in rounds(most_rounds):
        beaten = left.select(*keys, F.col("worse").alias("id")).distinct()
        keep = materialise(open_.join(beaten, [*keys, "id"], "left_anti"), "kept")
        if keep.isEmpty():
            break
        gone = materialise(left.join(keep.withColumnRenamed("id", "better"), [*keys, "better"], "left_semi").select(*keys, F.col("worse").alias("id")).distinct(), "gone")
        part = keep.withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False)))
        done = part if done is None else done.unionByName(part)
        decided = part.select(*keys, "id")
        last = open_, left
        open_ = materialise(open_.join(decided, [*keys, "id"], "left_anti"), "open")
        left = materialise(
            left.join(decided.withColumnRenamed("id", "worse"), [*keys, "worse"], "left_anti").join(gone.withColumnRenamed("id", "better"), [*keys, "better"], "left_anti"), "pairs"
        )
        discard(*last)
    return done if done is not None else boxes.select(*keys, "id").distinct().withColumn("kept", F.lit(True))
