"""Long exact spans shared between documents.

An exact stretch is a chain of one match, so that chaining adds nothing to the
exact spans; it is what makes fuzzy passages out of them (`Shared.passages`).

Copies of whole texts are set aside first. Of every other text k-mer seeds are
selected by winnowing, so that any stretch of `least` characters holds the same
seed wherever it stands. Seeds that several documents have are joined; their
matches are extended and chained per pair of documents (collinear chaining with
gap costs over a tree of maxima), and the chains' exact stretches are the shared
spans. Seeds of many documents aren't paired: there the windows of `least`
characters are counted by their hash, which finds the same stretches without
any pair.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.session import materialise

#: Characters of a shared span at least, and of a seed.
LEAST_CHARS = 400
SEED_CHARS = 128
#: Seeds with more occurrences aren't paired but counted window by window.
PAIRED_AT_MOST = 32
#: Characters looked at together; longer texts are taken in overlapping parts.
_PART = 1 << 18
_LOW = np.uint64((1 << 22) - 1)
_HIGH = ~_LOW
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def rolling_hash(points: np.ndarray, size: int, first: np.uint64 = _C[0]) -> np.ndarray:
    """64-bit hash of every window of `size` code points, by doubling; another `first` constant gives another hash."""
    out, have = None, 0
    piece = (points.astype(np.uint64) + np.uint64(1)) * first
    piece ^= piece >> np.uint64(31)
    length, rest, level = 1, size, 0
    while True:
        if rest & 1:
            if out is None:
                out, have = piece, length
            else:
                keep = len(out) - length
                out = out[: max(keep, 0)] * _C[4] + piece[have : have + max(keep, 0)]
                out ^= out >> np.uint64(29)
                have += length
        rest >>= 1
        if not rest:
            return out[: max(len(points) - size + 1, 0)]
        keep = max(len(piece) - length, 0)
        piece = piece[:keep] * _C[1 + level % 3] + piece[length : length + keep]
        piece ^= piece >> np.uint64(32)
        length, level = length * 2, level + 1


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every window of `size` values."""
    have = 1
    while have * 2 <= size:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    step = size - have
    return np.minimum(values[: len(values) - step], values[step:]) if step else values


def chosen_seeds(points: np.ndarray, least: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the seed of every window of `least` characters, seed hashes by place). Of equal hashes the last counts."""
    hashes = rolling_hash(points, size)
    marked = (hashes & _HIGH) | (_LOW - np.arange(len(hashes), dtype=np.uint64))
    return (_LOW - (sliding_least(marked, least - size + 1) & _LOW)).astype(np.int64), hashes


def _parts(texts: list[tuple[int, str]], least: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Code points of several texts in one array, with (text, its offset there, offset in the text, length) of each."""
    held, marks, size = [], [], 0
    for k, text in texts:
        points = code_points(text)
        for at in range(0, max(len(points) - least + 1, 0), _PART):
            piece = points[at : at + _PART + least - 1]
            held.append(piece)
            marks.append((k, size, at, len(piece)))
            size += len(piece)
            if size >= _PART:
                yield np.concatenate(held), marks
                held, marks, size = [], [], 0
    if held:
        yield np.concatenate(held), marks


FINGERPRINTS = "doc_id bigint, digest binary, n_chars int, hashes array<bigint>, places array<int>"


def fingerprints(documents: DataFrame, least: int = LEAST_CHARS, size: int = SEED_CHARS) -> DataFrame:
    """doc_id, digest, n_chars and the seeds (hashes, places) of every text of `least` characters or more."""

    def run(batches):
        for b in batches:
            texts = [(k, t) for k, t in enumerate(b["text"]) if t and len(t) >= least]
            found: dict[int, tuple[list, list]] = {k: ([], []) for k, _ in texts}
            for points, marks in _parts(texts, least):
                place, hashes = chosen_seeds(points, least, size)
                for k, start, at, length in marks:
                    p = np.unique(place[start : start + length - least + 1])
                    found[k][0].append(hashes[p].view(np.int64))
                    found[k][1].append((p - start + at).astype(np.int32))
            rows = []
            for k, text in texts:
                h, p = (np.concatenate(x) for x in found[k])
                p, first = np.unique(p, return_index=True)
                rows.append((b["doc_id"].iloc[k], hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), len(text), h[first], p))
            yield pd.DataFrame(rows, columns=["doc_id", "digest", "n_chars", "hashes", "places"])

    return documents.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & (F.length("text") >= least)).mapInPandas(run, FINGERPRINTS)


class Maxima:
    """Maxima of ranges of places, whose values can be taken out again."""

    NONE = (-float("inf"), -1)

    def __init__(self, size: int):
        self.size = size
        self.best = [self.NONE] * (2 * size)

    def put(self, at: int, value: tuple[float, int]) -> None:
        at += self.size
        self.best[at] = value
        while at > 1:
            at //= 2
            self.best[at] = max(self.best[2 * at], self.best[2 * at + 1])

    def most(self, low: int, high: int) -> tuple[float, int]:
        """The best of low <= place < high."""
        out = self.NONE
        low, high = low + self.size, high + self.size
        while low < high:
            if low & 1:
                out = max(out, self.best[low])
                low += 1
            if high & 1:
                high -= 1
                out = max(out, self.best[high])
            low, high = low // 2, high // 2
        return out


def chains(matches: list[tuple[int, int, int]], gap_cost: float = 0.5, far: int = 2_000, overlap: bool = False) -> list[list[tuple[int, int, int]]]:
    """Collinear chains of exact matches (start in a, start in b, length), best first, each match in one chain.

    A match follows another if it begins at or after its end in both texts; with
    `overlap` also if it only ends later in both, and then what both cover is
    cut off its beginning. The score is the characters matched less gap_cost
    for each character between them in either text. Gaps beyond `far` in either
    text part chains. The best predecessor within reach comes from a tree of
    maxima over the ends in b, out of which matches are taken once they end too
    far back in a; those that overlap are looked at one by one.
    """
    order = sorted(set(matches))
    by_end = sorted(range(len(order)), key=lambda k: order[k][1] + order[k][2])
    leaf = {k: x for x, k in enumerate(by_end)}
    ends = [order[k][1] + order[k][2] for k in by_end]
    tree, score, before, cut = Maxima(len(order)), [], [], []
    waiting = sorted(range(len(order)), key=lambda k: order[k][0] + order[k][2])
    at = gone = 0
    held: list[tuple[int, int]] = []  # (end in b, match) of those in the tree, in order
    begun: list[int] = []  # looked at before, not yet in the tree
    for k, (a, b, n) in enumerate(order):
        while at < len(waiting) and order[waiting[at]][0] + order[waiting[at]][2] <= a:
            q = waiting[at]
            qa, qb, qn = order[q]
            tree.put(leaf[q], (score[q] + gap_cost * (qa + qn + qb + qn), q))
            if overlap:
                insort(held, (qb + qn, q))
            at += 1
        while gone < at and order[waiting[gone]][0] + order[waiting[gone]][2] < a - far:
            q = waiting[gone]
            tree.put(leaf[q], Maxima.NONE)
            if overlap:
                del held[bisect_left(held, (order[q][1] + order[q][2], q))]
            gone += 1
        value, came = tree.most(bisect_left(ends, b - far), bisect_left(ends, b + 1))
        value, trim = value - gap_cost * (a + b) + n, 0
        if overlap:
            begun = [q for q in begun if order[q][0] + order[q][2] > a]
            for q in [*begun, *(q for _, q in held[bisect_left(held, (b + 1, -1)) : bisect_left(held, (b + n, -1))])]:
                qa, qb, qn = order[q]
                over = max(qa + qn - a, qb + qn - b)
                gaps = a + b + 2 * over - qa - qb - 2 * qn
                if 0 < over < n and qa < a and qb < b and gaps <= far and score[q] + n - over - gap_cost * gaps > value:
                    value, came, trim = score[q] + n - over - gap_cost * gaps, q, over
            begun.append(k)
        if came >= 0 and value > n:
            score.append(value)
            before.append(came)
            cut.append(trim)
        else:
            score.append(float(n))
            before.append(-1)
            cut.append(0)
    out, used = [], set()
    for k in sorted(range(len(order)), key=lambda k: (-score[k], k)):
        chain = []
        while k >= 0 and k not in used:
            used.add(k)
            a, b, n = order[k]
            c = cut[k] if before[k] not in used else 0
            chain.append((a + c, b + c, n - c))
            k = before[k]
        if chain:
            out.append(chain[::-1])
    return out


def common_before(a: str, b: str) -> int:
    """Characters that two texts have in common at their ends."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[len(a) - mid :] == b[len(b) - mid :]:
            low = mid
        else:
            high = mid - 1
    return low


def common_after(a: str, b: str) -> int:
    """Characters that two texts have in common at their beginnings."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Shared:
    """The stages of one search, written once where several results read them.

    With `linked` the contexts of the seeds of many documents are kept as well, for links().
    """

    def __init__(self, documents: DataFrame, least: int = LEAST_CHARS, size: int = SEED_CHARS, paired: int = PAIRED_AT_MOST, *, linked: bool = False):
        self.documents, self.least, self.size, self.paired, self.linked = documents, least, size, paired, linked
        self.prints = materialise(fingerprints(documents, least, size), "fingerprints")
        self.classes = self.prints.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"))
        first = self.prints.join(self.classes.select("doc_id"), "doc_id", "left_semi")
        seeds = first.select("doc_id", F.inline(F.arrays_zip("hashes", "places"))).toDF("doc_id", "hash", "place")
        counts = seeds.groupBy("hash").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count(F.lit(1)).alias("n"))
        common = seeds.join(counts.filter("a < z").select("hash", (F.col("n") > paired).alias("many")), "hash")
        by_doc = common.groupBy("doc_id").agg(
            F.collect_list(F.when(~F.col("many"), F.col("place"))).alias("few"), F.collect_list(F.when(F.col("many"), F.col("place"))).alias("many")
        )
        # texts move once, only to the few seeds of their own
        marked = documents.select("doc_id", "text").filter(F.length("text") >= least).join(by_doc.hint("shuffle_hash"), "doc_id")
        self.found = materialise(self._surroundings(marked), "surroundings")

    def copies(self) -> DataFrame:
        """doc_id, n_chars of every document whose whole text stands in another document."""
        repeated = self.classes.filter("doc_id < last").select("digest")
        return self.prints.select("doc_id", "digest", "n_chars").join(repeated, "digest").select("doc_id", "n_chars")

    def copy_passages(self) -> DataFrame:
        """A passage over the whole text for every copy (b) and the document that stands for its class (a)."""
        copy = self.prints.select("digest", F.col("doc_id").alias("b"), "n_chars")
        held = copy.join(self.classes.select("digest", F.col("doc_id").alias("a")), "digest").filter("a < b").select("a", "b", "n_chars").distinct()
        n, zero = F.col("n_chars"), F.lit(0)
        whole = F.array(F.struct(zero.alias("at_a"), zero.alias("at_b"), n.alias("length")))
        return held.select("a", "b", zero.alias("from_a"), n.alias("to_a"), zero.alias("from_b"), n.alias("to_b"), n.alias("matched"), whole.alias("stretches"))

    def _surroundings(self, marked: DataFrame) -> DataFrame:
        """What stands around the shared seeds, from one look at each text.

        Of a seed of few documents: hash, doc_id, place, lead and the context
        that the windows of this seed cover, lead characters of it before the
        seed. Of seeds of many documents: a row per window of `least`
        characters, its two hashes (hash and check, 128 bits together), doc_id
        and place; lead and context are null. If
        `linked`, these seeds have rows of the first form too, with many set.
        """
        least, size, linked = self.least, self.size, self.linked
        names = ["hash", "check", "doc_id", "place", "lead", "context", "many"]

        def run(batches):
            for b in batches:
                rows, texts = [], dict(enumerate(b["text"]))
                few, many = [set(x.tolist()) for x in b["few"]], [np.asarray(x, dtype=np.int64) for x in b["many"]]
                for points, marks in _parts(list(texts.items()), least):
                    place, hashes = chosen_seeds(points, least, size)
                    crowds = any(len(many[k]) for k, *_ in marks)
                    whole, check = (rolling_hash(points, least, c) for c in (_C[0], _C[5])) if crowds else (None, None)
                    for k, start, at, length in marks:
                        own = place[start : start + length - least + 1]
                        doc = b["doc_id"].iloc[k]
                        if len(many[k]):
                            of = np.flatnonzero(np.isin(own - start + at, many[k]))
                            yield pd.DataFrame({"hash": whole[start + of].view(np.int64), "check": check[start + of].view(np.int64), "doc_id": doc, "place": of + at, "lead": None, "context": None, "many": True})
                        if few[k] or (linked and len(many[k])):
                            crowd = set(many[k].tolist()) if linked else set()
                            heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                            tails = np.concatenate([heads[1:], [len(own)]]) - 1
                            for q, h, x, y in zip((own[heads] - start + at).tolist(), hashes[own[heads]].view(np.int64).tolist(), (heads + at).tolist(), (tails + at).tolist()):
                                if q in few[k] or q in crowd:
                                    rows.append((h, 0, doc, q, q - x, texts[k][x : y + least], q in crowd))
                yield pd.DataFrame(rows, columns=names)

        return marked.mapInPandas(run, "hash bigint, check bigint, doc_id bigint, place int, lead int, context string, many boolean")

    def matches(self) -> DataFrame:
        """a, b, at_a, at_b, length: exact matches around every seed that a pair of documents has in common, a < b.

        Groups hold at most `paired` occurrences, so pairs are bounded by the
        seeds. Matches are cut to what the seed's windows cover.
        """
        size = self.size
        names = ["a", "b", "at_a", "at_b", "length"]

        def pairs(group: list[tuple]) -> list[tuple]:
            out = []
            group.sort(key=lambda r: (r[1], r[2]))
            for x in range(len(group)):
                _, da, pa, la, ca = group[x]
                for y in range(x + 1, len(group)):
                    _, db, pb, lb, cb = group[y]
                    if da == db:
                        continue
                    right = common_after(ca[la:], cb[lb:])
                    if right < size:
                        continue  # the hashes met, the texts don't
                    left = common_before(ca[:la], cb[:lb])
                    out.append((da, db, pa - left, pb - left, left + right))
            return out

        def run(batches):
            group, rows = [], []
            for b in batches:
                for r in zip(b["hash"], b["doc_id"], b["place"], b["lead"], b["context"]):
                    if group and r[0] != group[0][0]:
                        rows += pairs(group)
                        group = []
                    group.append(r)
                yield pd.DataFrame(rows, columns=names)
                rows = []
            yield pd.DataFrame(pairs(group), columns=names)

        sorted_ = self.found.filter("context is not null and not many").repartition("hash").sortWithinPartitions("hash")
        return sorted_.mapInPandas(run, "a bigint, b bigint, at_a int, at_b int, length int")

    def _star(self, rows: DataFrame) -> DataFrame:
        """Every row (hash, check, doc_id, place, ..) of a hash that two documents have, as `x`, with one row of another document, as `y`.

        That document is the one of lowest doc_id, for its own rows the one of
        highest. The k-th row meets the k-th there, counted round, so that what
        repeats within texts keeps to few diagonals. Links are as many as rows.
        """
        w = W.partitionBy("hash", "check", "doc_id")
        ranked = rows.distinct().withColumn("k", F.row_number().over(w.orderBy("place")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
        ends = ranked.groupBy("hash", "check").agg(F.min(F.struct("doc_id", "n")).alias("low"), F.max(F.struct("doc_id", "n")).alias("high")).filter("low.doc_id < high.doc_id")
        own = F.col("doc_id") == F.col("low.doc_id")
        to = F.when(own, F.col("high")).otherwise(F.col("low"))
        # the first rows of the lowest document are met from the highest
        held = ranked.join(ends, ["hash", "check"]).filter(~own | (F.col("k") >= F.col("high.n")))
        x = held.select("hash", "check", to["doc_id"].alias("to_doc"), (F.col("k") % to["n"]).alias("to_k"), F.struct(*rows.columns).alias("x"))
        y = ranked.select("hash", "check", F.col("doc_id").alias("to_doc"), F.col("k").cast("bigint").alias("to_k"), F.struct(*rows.columns).alias("y"))
        return x.withColumn("to_k", F.col("to_k").cast("bigint")).join(y, ["hash", "check", "to_doc", "to_k"]).select("x", "y")

    def links(self) -> DataFrame:
        """a, b, at_a, at_b, length as in matches(), for what stands in more places than are paired.

        Every window and every seed of many documents is linked to one
        occurrence in another document, so that all who share it come out, by
        as many links as there are occurrences. The windows give each stretch
        of `least` characters, the seeds shorter ones beside them.
        """
        size = self.size
        many = self.found.filter("many")

        def extended(batches):
            for b in batches:
                rows = []
                for x, y in zip(b["x"].tolist(), b["y"].tolist()):
                    if x["doc_id"] > y["doc_id"]:
                        x, y = y, x
                    right = common_after(x["context"][x["lead"] :], y["context"][y["lead"] :])
                    if right >= size:
                        left = common_before(x["context"][: x["lead"]], y["context"][: y["lead"]])
                        rows.append((x["doc_id"], y["doc_id"], x["place"] - left, y["place"] - left, left + right))
                yield pd.DataFrame(rows, columns=["a", "b", "at_a", "at_b", "length"])

        seeds = self._star(many.filter("context is not null").select("hash", "check", "doc_id", "place", "lead", "context"))
        windows = self._star(many.filter("context is null").select("hash", "check", "doc_id", "place"))
        first, last = F.least("x", "y"), F.greatest("x", "y")
        # the hashes of both are equal, so that the documents decide
        whole = windows.select(first["doc_id"].alias("a"), last["doc_id"].alias("b"), first["place"].alias("at_a"), last["place"].alias("at_b"), F.lit(self.least).alias("length"))
        return whole.unionByName(seeds.mapInPandas(extended, "a bigint, b bigint, at_a int, at_b int, length int"))

    def passages(self, matches: DataFrame, overlap: bool = False) -> DataFrame:
        """a, b, from_a, to_a, from_b, to_b, matched, stretches: chained passages of pairs of documents.

        Matches of one diagonal that touch are one stretch; stretches are
        chained, with `overlap` those too that overlap, cut at their beginning.
        `stretches` are the exact ones as struct(at_a, at_b, length).
        The matches of a pair are bounded by the seeds of its texts.
        """
        names = ["a", "b", "from_a", "to_a", "from_b", "to_b", "matched", "stretches"]

        def one(a: int, b: int, found: list[tuple[int, int, int]]) -> list[tuple]:
            merged: list[tuple[int, int, int]] = []
            for d, x, n in sorted((y - x, x, n) for x, y, n in found):
                if merged and merged[-1][0] == d and x <= merged[-1][1] + merged[-1][2]:
                    last = merged[-1]
                    merged[-1] = (d, last[1], max(last[2], x + n - last[1]))
                else:
                    merged.append((d, x, n))
            out = []
            for chain in chains([(x, x + d, n) for d, x, n in merged], overlap=overlap):
                (x, y, _), (u, v, n) = chain[0], chain[-1]
                out.append((a, b, x, u + n, y, v + n, sum(m[2] for m in chain), [{"at_a": p, "at_b": q, "length": m} for p, q, m in chain]))
            return out

        def run(batches):
            key, found, rows = None, [], []
            for batch in batches:
                for a, b, x, y, n in zip(*[batch[c] for c in ("a", "b", "at_a", "at_b", "length")]):
                    if (a, b) != key:
                        if found:
                            rows += one(*key, found)
                        key, found = (a, b), []
                    found.append((x, y, n))
                yield pd.DataFrame(rows, columns=names)
                rows = []
            yield pd.DataFrame(one(*key, found) if found else [], columns=names)

        sorted_ = matches.repartition("a", "b").sortWithinPartitions("a", "b")
        return sorted_.mapInPandas(
            run,
            "a bigint, b bigint, from_a int, to_a int, from_b int, to_b int, matched int, stretches array<struct<at_a:int,at_b:int,length:int>>",
        )

    def aligned(self, passages: DataFrame) -> DataFrame:
        """The passages with `edits` and `identity`: what stands between their stretches, aligned.

        The gaps of every chain are cut out of both texts and aligned by edit
        distance; identity is the share of the longer side that needs no edit.
        Only texts with gaps are read again.
        """
        keys = ["a", "b", "from_a", "from_b"]
        held = materialise(passages, "passages")
        steps = F.transform(F.sequence(F.lit(1), F.size("stretches") - 1), lambda i: F.struct(F.get("stretches", i - 1).alias("x"), F.get("stretches", i).alias("y")))
        gaps = held.filter("size(stretches) > 1").select(*keys, F.posexplode(steps).alias("gap", "s"))
        cut = lambda side: (F.col(f"s.x.at_{side}") + F.col("s.x.length"), F.col(f"s.y.at_{side}"))
        (a0, a1), (b0, b1) = cut("a"), cut("b")
        gaps = gaps.select(*keys, "gap", a0.alias("a0"), a1.alias("a1"), b0.alias("b0"), b1.alias("b1"))
        texts = self.documents.select(F.col("doc_id"), "text").filter("doc_id is not null and text is not null").dropDuplicates(["doc_id"])
        piece = lambda p, q: F.substring("text", F.col(p) + 1, F.col(q) - F.col(p))
        left = gaps.join(texts, F.col("a") == F.col("doc_id")).withColumn("left", piece("a0", "a1")).drop("doc_id", "text")
        both = left.join(texts, F.col("b") == F.col("doc_id")).withColumn("right", piece("b0", "b1"))
        edits = both.groupBy(*keys).agg(F.sum(F.levenshtein("left", "right")).alias("edits"))
        longer = F.greatest(F.col("to_a") - F.col("from_a"), F.col("to_b") - F.col("from_b"))
        return held.join(edits, keys, "left").withColumn("edits", F.coalesce("edits", F.lit(0))).withColumn("identity", 1 - F.col("edits") / longer)

    def crowded(self) -> DataFrame:
        """doc_id, start, length: stretches that stand in other documents too, around the seeds of many documents."""
        windows = self.found.filter("context is null").select("doc_id", F.col("place").alias("start"), "hash", "check")
        shared = windows.groupBy("hash", "check").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("a < z").select("hash", "check")
        held = windows.join(shared, ["hash", "check"])
        w = W.partitionBy("doc_id").orderBy("start")
        runs = held.withColumn("run", F.col("start") - F.dense_rank().over(w))
        return runs.groupBy("doc_id", "run").agg(F.min("start").alias("start"), (F.max("start") - F.min("start") + self.least).cast("int").alias("length")).drop("run")


def stretches(passages: DataFrame, least: int) -> DataFrame:
    """doc_id, start, length of the exact stretches of at least `least` characters in either document of every passage."""
    s = passages.select("a", "b", F.explode("stretches").alias("s")).filter(F.col("s.length") >= least)
    both = F.array(F.struct(F.col("a").alias("doc_id"), F.col("s.at_a").alias("start")), F.struct(F.col("b").alias("doc_id"), F.col("s.at_b").alias("start")))
    return s.select(F.explode(both).alias("x"), F.col("s.length").alias("length")).select("x.doc_id", "x.start", "length").distinct()


def shared_chars(documents: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """doc_id, shared_chars: characters of each document that lie in a stretch of `least` or more that another document has too.

    Only documents with such a stretch. Characters are code points, all count.
    Null, empty and shorter texts have none, rows without doc_id are left out;
    a doc_id that comes twice with one text isn't another document.
    """
    found = Shared(documents, least)
    spans = stretches(found.passages(found.matches()), least).unionByName(found.crowded())
    copies = found.copies().distinct()
    before = F.max(F.col("start") + F.col("length")).over(W.partitionBy("doc_id").orderBy("start", "length").rowsBetween(W.unboundedPreceding, -1))
    end = F.col("start") + F.col("length")
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    covered = spans.withColumn("fresh", fresh).groupBy("doc_id").agg(F.sum("fresh").alias("shared_chars"))
    return covered.join(copies.select("doc_id"), "doc_id", "left_anti").unionByName(copies.select("doc_id", F.col("n_chars").cast("bigint").alias("shared_chars")))
