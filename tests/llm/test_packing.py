import os
import random

import pytest

from tracemill.llm import packing as P

pytestmark = pytest.mark.skipif(not os.path.exists(f"/opt/tokenizers/{P.VOCABULARY}"), reason="no tokenizer files")


def check(out, items, capacity):
    held, seen = {}, {}
    for key, part, sequence, at, n in out:
        held.setdefault(sequence, []).append((at, n))
        seen.setdefault(key, []).append((part, n))
    for placed in held.values():
        end = 0
        for at, n in sorted(placed):
            assert at >= end or n == 0
            end = max(end, at + n)
        assert end <= capacity
    want = dict(items)
    assert set(seen) == set(want)
    for key, parts in seen.items():
        parts.sort()
        assert sum(n for _, n in parts) == want[key] and [p for p, _ in parts] == list(range(len(parts)))
        if want[key] <= capacity:
            assert len(parts) == 1
        else:
            assert all(n == capacity for _, n in parts[:-1])


def test_groups_are_packed_whole_and_tight():
    rng = random.Random(2)
    for capacity in (7, 64, 300):
        for _ in range(20):
            items = [(k, rng.choice([0, 1, capacity, capacity + 1, rng.randrange(3 * capacity), rng.randrange(1, capacity)])) for k in range(rng.randrange(60))]
            out = P.pack_group(items, capacity)
            check(out, items, capacity)
    items = [(k, rng.randrange(1, 200)) for k in range(3000)]
    out = P.pack_group(items, 1000)
    used = len({r[2] for r in out})
    assert sum(n for _, n in items) / (used * 1000) > 0.99


def test_lowest_band_with_room_is_taken():
    rng = random.Random(4)
    s, open_ = P.Sequences(50), {}
    for _ in range(600):
        n = rng.randrange(51)
        cost, k, room = s.take(n)
        fitting = sorted((int(c / s.band), r, c, i) for i, (c, r) in open_.items() if r >= n)
        if fitting:
            assert (room, cost, k) == fitting[0][1:] and open_.pop(k) == (cost, room)
        else:
            assert room == 50 and k not in open_
        cost, room = cost + P.text_cost(n), room - n
        open_[k] = (cost, room)
        s.put(cost, k, room)


def test_costs_are_even_and_fill_is_high():
    rng = random.Random(6)
    items = [(k, int(rng.lognormvariate(5.8, 0.8)) + 20) for k in range(8000)]
    for capacity in (1024, 4096):
        cost, held = {}, {}
        for _, _, sequence, _, n in P.pack_group(items, capacity):
            cost[sequence] = cost.get(sequence, 0) + P.text_cost(n)
            held[sequence] = held.get(sequence, 0) + n
        assert sum(held.values()) / (capacity * len(held)) > 0.99
        mean = sum(cost.values()) / len(cost)
        assert (sum((c - mean) ** 2 for c in cost.values()) / len(cost)) ** 0.5 < 0.25 * mean


def test_operator(spark):
    docs = [(1, "some text", "a"), (2, None, "b"), (3, "", "c"), (4, "word " * 3000, "d"), (4, "word " * 3000, "d"), (None, "x", "e")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, tokens string")
    targets = spark.createDataFrame([("s", 100), ("none", 0), (None, 5), ("null", None)], "target_name string, capacity_tokens int")
    out = P.pack(df, targets).collect()
    assert {r["target_name"] for r in out} == {"s"} and {r["doc_id"] for r in out} == {1, 2, 3, 4, None}
    assert sum(r["tokens"] for r in out if r["doc_id"] == 4) == 6002 and max(r["position"] + r["tokens"] for r in out) <= 100
    assert P.pack(df.limit(0), targets).count() == 0 and P.pack(df, targets.limit(0)).count() == 0


def test_counts_are_the_tokenizers(spark):
    texts = ["Route proof failed for LIC-509.", " ¿Cierra la junta?\n\n  x", "ü" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    e = P._encoding("/opt/tokenizers", P.VOCABULARY)
    assert {r["doc_id"]: r["n_tokens"] for r in P.token_counts(df).collect()} == {k: len(e.encode_ordinary(t)) for k, t in enumerate(texts)}
    assert all(e.decode(e.encode_ordinary(t)) == t for t in texts)
