import random
import string
from collections import defaultdict

import numpy as np
import pytest

from tracemill.llm import queries as Q
from tracemill.llm import spans as S


def brute(docs, least):
    at = defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - least + 1):
            at[t[i : i + least]].add(d)
    out = {}
    for d, t in docs:
        hit = {i + k for i in range(len(t or "") - least + 1) if len(at[t[i : i + least]]) > 1 for k in range(least)}
        if hit and d is not None:
            out[d] = len(hit)
    return out


def corpus(rng, size):
    word = lambda n: "".join(rng.choice(string.ascii_lowercase + " é😀") for _ in range(n))
    shared = [word(rng.randrange(40, 160)) for _ in range(6)]
    docs = []
    for d in range(size):
        t = word(rng.randrange(0, 200))
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared[:1] * 4 + shared)
            cut = rng.randrange(len(s) // 3)
            t += s[cut : len(s) - rng.randrange(len(s) // 3)] + word(rng.randrange(60))
        docs.append((d, t))
    docs += [(size, docs[0][1]), (size + 1, docs[0][1]), (size + 2, None), (size + 3, ""), (size + 4, "a" * 900), (size + 5, "b" * 50 + "a" * 300), (3, docs[3][1])]
    return docs


@pytest.mark.parametrize("paired", [2, 32])
def test_against_brute_force(spark, monkeypatch, paired):
    """Few pairs allowed (windows are counted) and many (chains): both exact."""
    docs = corpus(random.Random(paired), 60)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id bigint, text string, hash string, place int")
    monkeypatch.setattr(S.Shared.__init__, "__defaults__", (60, 20, paired))
    got = {r["doc_id"]: r["shared_chars"] for r in S.shared_chars(df, 60).collect()}
    assert got == brute(docs, 60)


def test_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "_PART", 256)
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice(string.ascii_lowercase) for _ in range(n))
    common = word(700)
    docs = [(1, word(900) + common + word(333)), (2, common[100:]), (3, word(500) + common[:350])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    monkeypatch.setattr(S.Shared.__init__, "__defaults__", (60, 20, 32))
    assert {r["doc_id"]: r["shared_chars"] for r in S.shared_chars(df, 60).collect()} == brute(docs, 60)


def test_empty(spark):
    assert S.shared_chars(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_seeds_meet_in_every_window():
    rng = np.random.default_rng(0)
    a = rng.integers(97, 100, 500).astype(np.uint32)
    b = np.concatenate([rng.integers(97, 100, 77).astype(np.uint32), a[100:260], rng.integers(97, 100, 50).astype(np.uint32)])
    pa, _ = S.chosen_seeds(a, 60, 20)
    pb, _ = S.chosen_seeds(b, 60, 20)
    for i in range(100, 201):
        assert pa[i] - i == pb[i - 100 + 77] - (i - 100 + 77)


def test_chains_are_best():
    rng = random.Random(6)

    def score(chain):
        total = chain[0][2]
        for (a, b, n), (c, d, m) in zip(chain, chain[1:]):
            total += m - 0.5 * (c - a - n + d - b - n)
        return total

    for _ in range(60):
        m = [(rng.randrange(60), rng.randrange(60), rng.randrange(1, 12)) for _ in range(7)]
        got = S.chains(m)
        assert sorted(x for c in got for x in c) == sorted(set(m))
        best = max(score(c) for c in _every(sorted(set(m))))
        assert abs(score(got[0]) - best) < 1e-9


def test_overlapping_matches_are_chained():
    # a double space against one: both sides hold a space, so that the matches overlap by one in b
    assert S.chains([(0, 0, 201), (201, 200, 300)], overlap=True) == [[(0, 0, 201), (202, 201, 299)]]
    assert S.chains([(0, 0, 200), (195, 203, 300)], overlap=True) == [[(0, 0, 200), (200, 208, 295)]]
    rng = random.Random(3)
    for _ in range(200):
        m = [(rng.randrange(60), rng.randrange(60), rng.randrange(1, 20)) for _ in range(8)]
        got = S.chains(m, overlap=True)
        assert sum(map(len, got)) == len(set(m))
        for c in got:
            assert all(n > 0 for *_, n in c)
            assert all(x[0] + x[2] <= y[0] and x[1] + x[2] <= y[1] for x, y in zip(c, c[1:]))


@pytest.mark.parametrize("overlap", [False, True])
def test_the_best_predecessor_within_reach(overlap):
    # the long match lies too far back and must not hide the near one
    assert S.chains([(0, 0, 9_000), (13_000, 13_000, 150), (13_200, 13_200, 400)], overlap=overlap) == [[(0, 0, 9_000)], [(13_000, 13_000, 150), (13_200, 13_200, 400)]]
    assert S.chains([(0, 13_000, 9_000), (8_950, 25_000, 150), (9_150, 25_200, 400)], overlap=overlap)[1:] == [[(8_950, 25_000, 150), (9_150, 25_200, 400)]]


def _every(m):
    def grow(chain, rest):
        yield chain
        for k, x in enumerate(rest):
            if x[0] >= chain[-1][0] + chain[-1][2] and x[1] >= chain[-1][1] + chain[-1][2]:
                yield from grow([*chain, x], rest[k + 1 :])

    for k, x in enumerate(m):
        yield from grow([x], m[k + 1 :])


def test_common_parts():
    assert S.common_before("xxabc", "yabc") == 3 and S.common_after("abcx", "abcy") == 3 and S.common_after("", "a") == 0


def test_fuzzy_passages_are_aligned(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice(string.ascii_lowercase) for _ in range(n))
    x, y, z = word(200), word(150), word(180)
    docs = [(1, word(50) + x + "CHANGED" + y + z + word(40)), (2, word(90) + x + "CHANCED!" + y + "added" + z)]
    found = S.Shared(spark.createDataFrame(docs, "doc_id bigint, text string"), 60, 20)
    rows = found.aligned(found.passages(found.matches())).collect()
    best = max(rows, key=lambda r: r["matched"])
    assert (best["from_a"], best["from_b"], len(best["stretches"])) == (50, 90, 3) or len(best["stretches"]) == 3
    assert best["edits"] == 7 - 5 + 5 and best["to_a"] - best["from_a"] >= 537 - 2
    assert abs(best["identity"] - (1 - best["edits"] / max(best["to_a"] - best["from_a"], best["to_b"] - best["from_b"]))) < 1e-12


def test_crowded_passages_and_copies_are_linked(spark, tmp_path):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice(string.ascii_lowercase) for _ in range(n))
    common, twice, side, copied = word(700), word(450), word(390), word(500)
    docs = [(d, word(100) + side + str(d) * 3 + common + word(80)) for d in range(10, 50)]
    docs += [(60, (twice + "+") * 20), (61, (twice + "-") * 20)]  # one seed 40 times, in two documents
    docs += [(70, copied), (71, copied), (72, copied), (None, copied)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = Q.p10_passages(spark, str(tmp_path)).collect()
    assert all(r["a"] < r["b"] for r in rows)
    star = {r["b"]: r for r in rows if r["a"] == 10 and r["matched"] >= 1080}
    assert set(star) == set(range(11, 50))  # membership of all, with the shorter stretch beside the long one
    covered = {60: set(), 61: set()}
    for r in rows:
        if (r["a"], r["b"]) == (60, 61):
            covered[60].update(range(r["from_a"], r["to_a"]))
            covered[61].update(range(r["from_b"], r["to_b"]))
    assert all(len(c) >= 20 * 450 for c in covered.values())
    assert {(r["a"], r["b"], r["matched"], r["edits"]) for r in rows if r["a"] >= 70} == {(70, 71, 500, 0), (70, 72, 500, 0)}


def test_recall_of_fuzzy_passages(spark):
    """Passages of 1500 characters with a share of characters changed, dropped or added: nearly all come out, aligned over nearly their whole length."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice(string.ascii_lowercase + " ") for _ in range(n))
    docs, planted = [], 40
    for k in range(planted):
        passage = word(1500)
        changed = "".join("" if (r := rng.random()) < 0.001 else c + rng.choice("xyz") if r < 0.002 else "#" if r < 0.003 else c for c in passage)
        docs += [(2 * k, word(300) + passage + word(200)), (2 * k + 1, word(100) + changed + word(400))]
    found = S.Shared(spark.createDataFrame(docs, "doc_id bigint, text string"))
    rows = found.aligned(found.passages(found.matches(), overlap=True)).collect()
    whole = {r["a"] for r in rows if r["b"] == r["a"] + 1 and r["to_a"] - r["from_a"] >= 0.7 * 1500 and r["identity"] > 0.98}
    any_ = {r["a"] for r in rows if r["b"] == r["a"] + 1}
    print("fuzzy passages of", planted, ":", len(any_), "found,", len(whole), "over 70 % of their length")
    assert len(any_) >= 0.9 * planted and len(whole) >= 0.7 * planted
