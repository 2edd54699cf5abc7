import random

from tracemill.operators.orphans import orphan_references

REFS, PARENTS = "key string, at bigint, row string, slice string", "key string, begin bigint, end bigint, extra string"


def brute(refs, parents):
    out = []
    for k, t, row, more in refs:
        if not k:
            continue
        held = [(b, e) for key, b, e, _ in parents if key == k]
        if any(b is not None and t is not None and b <= t and (e is None or e > t) for b, e in held):
            continue
        begun = any(b is not None and t is not None and b <= t for b, _ in held)
        out.append((k, t, "dropped" if begun else "later" if held else "missing", row, more))
    return sorted(out, key=str)


def test_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(11)
    keys = ["hot"] * 30 + [f"k{i}" for i in range(30)] + ["", None, "nobody"]
    parents = [(rng.choice(keys[:-1]), rng.choice([None, *range(50)]), rng.choice([None, *range(60)]), "x") for _ in range(200)]
    refs = [(rng.choice(keys), rng.choice([None, *range(55)]), f"r{i}", None) for i in range(600)] * 2
    got = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(refs, parents)


def test_empty_sides(spark):
    r, p = spark.createDataFrame([("a", 1, "x", None)], REFS), spark.createDataFrame([("a", 0, None, None)], PARENTS)
    assert orphan_references(r.limit(0), p).count() == 0
    assert [x["reason"] for x in orphan_references(r, p.limit(0)).collect()] == ["missing"]
    assert orphan_references(r, p).count() == 0
