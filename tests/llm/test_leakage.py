import random

import pytest

from tracemill.llm import leakage as L

ITEM = "Past frost, trim pot FT-1268 scours E-2943B. 32-inch light naphtha joins V-2113 at the sheet edge; 18-inch instrument air joins TK-844 inside the package boundary: which bubble carries slop pump FIC-4809?"
OTHER = "Before priming, balance ring LIC-8385 holds 656 mm following purging; from (3921, 3509) trim nozzle drains T-9417C: which bubble opposes tempering breaker PDT-7132C near the battery limit today?"


def found(text, items=((1, ITEM), (2, OTHER))):
    return {(r[1], r[2] > 0) for r in L.scan_texts(L.Index(list(items)), [(9, "filler words first. " + text + " and more words after that")])}


def words(a, b):
    return " ".join(ITEM.split()[a:b])


@pytest.mark.parametrize(
    "text,want",
    [
        (ITEM, True),
        (ITEM.upper(), True),
        (words(3, 18), True),
        (words(3, 17), False),
        (words(0, 9) + " x " + words(9, 18), True),
        (words(0, 4) + " x y z " + words(4, 16), False),
        (ITEM.replace("-", "‑"), True),
        ("**" + ITEM.replace(" ", "** _") + "_", True),
        ("<p>" + ITEM.replace("; ", ";</p>\n<p>") + "</p>", True),
        ("> " + ITEM.replace(" joins ", " jo-\n> ins "), True),
        (ITEM.replace(" ", "\r\n"), True),
        (ITEM.replace(" ", "   "), True),
        (ITEM.replace(" ", " "), True),
        ("".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in ITEM), True),
    ],
)
def test_forms_of_a_leak(text, want):
    assert ((1, True) in found(text)) is want


def test_one_word_in_eight():
    w = ITEM.split()
    rng = random.Random(1)
    for _ in range(60):
        size = rng.randrange(15, len(w) + 1)
        at = rng.randrange(len(w) - size + 1)
        part = w[at : at + size]
        edits = size // 8
        spots = sorted(rng.sample(range(1, size - 1), edits), reverse=True)
        for s in spots:
            kind = rng.randrange(3)
            if kind == 0:
                part[s] = "changed"
            elif kind == 1:
                del part[s]
            else:
                part.insert(s, "added")
        assert (1, True) in found(" ".join(part)), part


def test_edits_of_hyphenated_words():
    part = words(6, 23).replace("V-2113 ", "").replace("18-inch ", "")
    assert len(part.split()) == 15 and (1, True) in found(part)
    w = ITEM.split()
    rng = random.Random(2)
    for size in (16, 17, 19, 22, len(w)):
        for at in range(len(w) - size + 1):
            spots = [s for s in range(at + 1, at + size - 1) if "-" in w[s]]
            for _ in range(8):
                part = list(w)
                for s in sorted(rng.sample(spots, min(len(spots), size // 8)), reverse=True):
                    part[s : s + 1] = rng.choice(([], ["changed"], ["an-added", w[s]]))
                end = at + size + len(part) - len(w)
                assert (1, True) in found(" ".join(part[at:end])), part[at:end]


def test_punctuation_within_words():
    assert (1, True) in found(words(3, 20).replace("-", ""))
    assert (1, True) in found(words(3, 20).replace("-", "-\n"))


def test_reparameterised_question():
    other = OTHER
    for a, b in (("LIC-8385", "LT-555"), ("656", "11"), ("3921", "16"), ("3509", "77"), ("T-9417C", "P-4"), ("PDT-7132C", "PI-12")):
        other = other.replace(a, b)
    assert found(other) == {(2, False)}
    # one value for two: what stands before the second or behind the first of them is a part of 15 words by itself, with less it is none
    clash = other.replace("77", "16")
    assert found(clash) == {(2, False)}
    assert found(" ".join(clash.split()[3:-2])) == set()
    assert found(other + " later on " + OTHER) == {(2, False), (2, True)}  # the item itself beside it
    assert found(other.replace("11", "7.5").replace("P-4", "P-4-A")) == {(2, False)}  # values with other numbers of pieces


def test_recall_of_reparameterised_questions():
    rng = random.Random(5)
    verbs, parts = "scours rinses drains bypasses reverses starves blankets".split(), "ring loop drum coil tray skid leg nozzle".split()

    def tag():
        return f"{rng.choice(['FIC', 'TI', 'P', 'MOV', 'TK', 'LSH'])}-{rng.randrange(100, 9999)}{rng.choice(['', '', 'A', 'C'])}"

    def sentence():
        return f"{rng.choice(['after', 'before', 'despite'])} {rng.choice(parts)} {rng.choice(verbs)} {tag()} the {rng.choice(parts)} {rng.choice(parts)} holds {rng.randrange(3, 900)} {rng.choice(['mm', 'kg/h', 'percent'])}"

    items = [(k, f"{sentence()}, while {sentence()}; {sentence()}: which line closes {tag()}?") for k in range(200)]
    index = L.Index(items)
    hits = 0
    for k, text in items:
        new = " ".join(w if not any(c.isdigit() for c in w) else (tag() + w[len(w.rstrip(",.;:?")) :] if "-" in w else str(rng.randrange(1000, 99999))) for w in text.split())
        hits += k in {r[1] for r in L.scan_texts(index, [(1, "some words before. " + new + " and after")]) if r[2] == 0}
    assert hits >= 180, hits


def test_parts_with_consistent_slots():
    kinds = [9, L.NAME, 9, L.NAME, 9, L.NAME, 9, L.NAME]
    item = ["w", "a", "w", "b", "w", "a", "w", "c"]
    part = lambda words: L.consistent_span(item, words, kinds, 0, 0, 8, least=3)
    assert part(["w", "x", "w", "y", "w", "x", "w", "z"]) == (8, 4, 4)
    assert part(["w", "x", "w", "y", "w", "y", "w", "z"]) == (5, 2, 2) or part(["w", "x", "w", "y", "w", "y", "w", "z"])[0] == 5
    assert part(item) == (0, 0, 0)


def test_spans_against_brute_force():
    rng = random.Random(8)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(150):
        a = [rng.choice("abcdef") for _ in range(12)]
        b = [rng.choice("abcdef") for _ in range(14)]
        best = max((j - i for i in range(12) for j in range(i + 1, 13) for u in range(14) for v in range(u, 15) if u < v and a[i] == b[u] and a[j - 1] == b[v - 1] and edits(a[i:j], b[u:v]) <= (j - i) // 4), default=0)
        seeds = [(i, j) for i in range(12) for j in range(14) if a[i] == b[j]]
        assert L.longest_span(a, b, seeds, 4)[0] == best


def test_operator_edges(spark):
    docs = [(1, ITEM, "x"), (1, ITEM, "x"), (2, None, None), (3, "", None), (4, "word " * 200_000 + ITEM, None), (5, "😀 \u0000", None), (None, ITEM, None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "too short an item"), (None, ITEM)], "item_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in L.leaks(d, i).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (4, 1)]
    assert L.leaks(d.limit(0), i).count() == 0 and L.leaks(d, i.limit(0)).count() == 0


def test_large_keys_beside_nulls(spark):
    big = 2**62 + 1
    d = spark.createDataFrame([(big, ITEM), (None, ITEM)], "doc_id bigint, text string").coalesce(1)
    i = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    assert sorted(r["doc_id"] or 0 for r in L.leaks(d, i).collect()) == [0, big]


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_BYTES", 10)
    d = spark.createDataFrame([(1, ITEM + " " + OTHER)], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, ITEM), (2, OTHER)], "item_id bigint, text string")
    assert sorted(r["item_id"] for r in L.leaks(d, i).collect()) == [1, 2]
