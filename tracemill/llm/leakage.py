"""Evaluation texts leaking into training text.

Both sides are canonicalised into templates: numbers, names (tags) and units
become typed placeholders, other words stay. Template windows of WINDOW words
are hash-joined; the items are a stated, bounded query set whose window index
goes to every task, so documents never move. Wherever two template windows
meet, their slots are compared. A window whose slots hold the same values is
verbatim: a pair of document and item with two of them is aligned word by word,
and a span counts as leaked if at most one word in eight is changed, dropped or
added. Where the slots hold other values, but each value stands for one other
value throughout, the item is re-parameterised.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.session import materialise

#: With one edit in eight words every span of 15 or more words keeps five in a row.
WINDOW = 5
LEAST_WORDS = 15
WORDS_PER_EDIT = 8
#: Bytes of item text that one index holds; more items are taken in blocks of this size.
BLOCK_BYTES = 16_000_000

# Unit words of the domain, as they stand after canonicalisation.
UNITS = frozenset("kw mw kg h min m3 nm3 mm cm inch bar barg mbar kpa mpa percent rpm hz degc".split())
_MARKUP = re.compile(r"</?[a-z][^<>\n]{0,200}>|&(?:nbsp|amp|lt|gt|quot|#\d+);")
_BREAK = re.compile(r"(?<=\w)[-\u2010\u2011\u00ad]\s*\n[\s>|*#]*(?=\w)")
_BROKEN = ("-\n", "- \n", "\u2010\n", "\u2011\n", "\u00ad\n")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_SPLIT = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_BLANKS = bytes(32 if chr(c).isspace() else c for c in range(256))
_PUNCTUATION = bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122 or chr(c).isspace()))
_OTHER = re.compile(r"[\W_]+")
_INNER = re.compile(r"[^\w\s]+|_+")
_DIGIT = re.compile(rb"\d")
_NAME = re.compile(r"(?<![^\W_])([a-z]{1,5})[-\u2010\u2011\s]?\d")


def plain(text: str) -> str:
    """Lower case, compatibility forms folded, markup and hyphenation at line ends gone."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    text = text.casefold()
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    if "\n" in text:
        if "\r" in text:
            text = text.replace("\r", "")
        if any(x in text for x in _BROKEN):
            text = _BREAK.sub("", text)
    return text


def pieces(text: str) -> list[bytes]:
    """Runs of letters and digits of plain text, as bytes."""
    if text.isascii():
        return text.encode("ascii").translate(_SPLIT).split()
    return _OTHER.sub(" ", text).encode("utf-8", "replace").split()


def spaced_words(text: str) -> list[bytes]:
    """White-space separated words of plain text without their punctuation."""
    if text.isascii():
        return text.encode("ascii").translate(_BLANKS, _PUNCTUATION).split()
    return [w.encode("utf-8", "replace") for w in _INNER.sub("", text).split()]


NUMBER, NAME, UNIT = 1, 2, 3
_STEP = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(ids: np.ndarray) -> np.ndarray:
    """Hash of every window of WINDOW ids; the wrap-around polynomial of small ids, mixed."""
    size = len(ids) - WINDOW + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    wide = ids.astype(np.uint64)
    out = np.zeros(size, dtype=np.uint64)
    for k in range(WINDOW):
        out = (out ^ (out >> np.uint64(29))) * _STEP + wide[k : k + size]
    return out


class _Numbers(dict):
    """Numbers of words; those of no item are classified once, as many as MOST_WORDS are remembered."""

    MOST_WORDS = 1_000_000
    paired = False

    def __missing__(self, w: bytes) -> int:
        if w[0] < 58:
            n = 1
        elif self.paired:
            n = 2 if len(w) < 5 else 0
        else:
            n = 2 if _DIGIT.search(w) else 0
        if len(self) < self.MOST_WORDS:
            self[w] = n
        return n


class Reading:
    """One way to read words, with the template windows of all items in it.

    number: the number of words in the item; 0 stands for words of no item, 1
    for other numbers, 2 for other words that are names, or in `paired` readings
    (a name's letters and digits are two words) are where a number follows.
    """

    def __init__(self, words: list[list[bytes]], kind: Callable[[bytes], int], paired: bool):
        self.ids: dict[bytes, int] = {}
        self.paired = paired
        self.memo: _Numbers | None = None  # made where texts are read
        template = [0, NUMBER, 0 if paired else NAME]
        for w in [w for held in words for w in held]:
            if w not in self.ids:
                self.ids[w] = len(template)
                template.append(kind(w) or len(template) + 4)
        self.template = np.array(template, dtype=np.int64)
        self.words = words
        self.items = [[self.ids[w] for w in held] for held in words]
        #: the items' words one after another, and where each item begins
        self.flat = np.array([n for held in self.items for n in held], dtype=np.int64)
        self.starts = np.cumsum([0, *map(len, self.items)])[:-1].astype(np.int64)
        windows = [window_hashes(self.shape(np.array(held, dtype=np.int64))) for held in self.items]
        hashes = np.concatenate([*windows, np.zeros(0, dtype=np.uint64)])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.of = np.repeat(np.arange(len(windows)), [len(w) for w in windows])[order]
        self.places = np.concatenate([*(np.arange(len(w)) for w in windows), np.zeros(0, dtype=np.int64)])[order].astype(np.int64)

    def numbers(self, words: list[bytes]) -> list[int]:
        if self.memo is None:
            self.memo = _Numbers(self.ids)
            self.memo.paired = self.paired
        return list(map(self.memo.__getitem__, words))

    def shape(self, numbers: np.ndarray) -> np.ndarray:
        """Template tokens of numbered words; 0 where a word is of no item and no slot."""
        out = self.template[numbers]
        if self.paired:
            out[:-1][(numbers[:-1] == 2) & (out[1:] == NUMBER)] = NAME
        return out

    def meet(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in the item, place in the text, whether all slots are filled alike) for every template window that both have."""
        none = np.zeros(0, dtype=np.int64)
        if len(numbers) < WINDOW or not len(self.hashes):
            return none, none, none, none.astype(bool)
        shape = self.shape(numbers)
        at = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(shape > 0, WINDOW).all(axis=1))
        hashes = window_hashes(shape)[at]
        low = np.searchsorted(self.hashes, hashes, side="left")
        hit = self.hashes[np.minimum(low, len(self.hashes) - 1)] == hashes
        low, at, hashes = low[hit], at[hit], hashes[hit]
        count = np.searchsorted(self.hashes, hashes, side="right") - low
        which = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        item, place, at = self.of[which], self.places[which], np.repeat(at, count)
        here = self.starts[item] + place
        same = self.flat[here] == numbers[at]
        for k in range(1, WINDOW):
            same &= self.flat[here + k] == numbers[at + k]
        return item, place, at, same


class Index:
    """Template windows of one block of items, once for pieces of letters and digits, once for white-space words."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = [plain(t) for _, t in items]
        self.keys = [i for i, _ in items]
        kinds: dict[bytes, int] = {u.encode(): UNIT for u in UNITS}
        for t in texts:
            for m in _NAME.finditer(t):
                kinds.setdefault(m[1].encode(), NAME)
        unit = {u.encode() for u in UNITS}
        self.pieces = Reading([pieces(t) for t in texts], lambda w: NUMBER if w[0] < 58 else kinds.get(w, 0), True)
        self.spaced = Reading([spaced_words(t) for t in texts], lambda w: NUMBER if w[0] < 58 else NAME if _DIGIT.search(w) else UNIT if w in unit else 0, False)
        # the white-space word that each piece stands in, for counting words
        self.weight = [[n for n, x in enumerate(w for w in t.split() if pieces(w)) for _ in pieces(x)] for t in texts]


def _reaches(item: list, words: list, most: int) -> list[tuple[int, int]]:
    """By number of edits: (item words, text words) of the longest common beginning that ends with a word of both.

    The furthest-reaching place of each diagonal is kept for every number of edits.
    """
    n, m = len(item), len(words)
    out = []
    reach = {0: 0}
    for _ in range(most + 1):
        best, slid = (0, 0), {}
        for d, x in reach.items():
            while x < n and 0 <= x + d < m and item[x] == words[x + d]:
                x += 1
            slid[d] = x
            if x > best[0] and 0 < x + d <= m and item[x - 1] == words[x + d - 1]:
                best = (x, x + d)
        out.append(best)
        reach = {}
        for d, x in slid.items():
            for to, y in ((d, x + 1), (d + 1, x), (d - 1, x + 1)):
                if y <= n and 0 <= y + to <= m and y > reach.get(to, -1):
                    reach[to] = y
    return out


def longest_span(item: list, words: list, seeds: list[tuple[int, int]], per_edit: int = WORDS_PER_EDIT) -> tuple[int, int, int, int, int]:
    """(words, edits, item start, text start, text end) of the longest item span through one of the seeds.

    A seed is a place that both have in common. From the start of its exact run
    the span is extended both ways; a span of n item words may have n /
    per_edit edits (rounded down), and it begins and ends with a word of both.
    """
    best = (0, 0, 0, 0, 0)
    n, m = len(item), len(words)
    most, wide = n // per_edit, 2 * n
    starts = set()
    for i, j in seeds:
        if i < n and j < m and item[i] == words[j]:
            while i > 0 and j > 0 and item[i - 1] == words[j - 1]:
                i, j = i - 1, j - 1
            starts.add((i, j))
    for i, j in sorted(starts):
        ahead = _reaches(item[i:], words[j : j + wide], most)
        back = _reaches(item[:i][::-1], words[max(0, j - wide) : j][::-1], most)
        for e, (x, y) in enumerate(ahead):
            for f, (u, v) in enumerate(back[: most - e + 1]):
                if x + u > best[0] and (e + f) * per_edit <= x + u:
                    best = (x + u, e + f, i - u, j - v, j + y)
    return best


def consistent_span(item: list, words: list, kinds: list[int], start: int, at: int, size: int, words_of=None, least: int = LEAST_WORDS) -> tuple[int, int, int]:
    """(words, slots, changed slots) of the longest re-parameterised part of a stretch whose templates agree, zeros if there is none.

    The stretch is `size` words from `start` in the item and `at` in the text.
    In the part every slot value stands for one value of the text throughout,
    and back; it has `least` words, and more changed slots than a leak may have
    edits. Where a value is inconsistent, the part begins behind its last use.
    words_of(a, b): words that item[a:b] counts for.
    """
    words_of = words_of or (lambda a, b: b - a)
    best = (0, 0, 0)
    slots = [k for k in range(start, start + size) if kinds[k] in (NUMBER, NAME, UNIT)]
    there: dict[tuple, tuple] = {}
    back: dict[tuple, tuple] = {}
    low = start

    def closed(high: int) -> tuple[int, int, int]:
        inside = [k for k in slots if low <= k < high]
        changed = sum(item[k] != words[at + k - start] for k in inside)
        n = words_of(low, high) if high > low else 0
        return (n, len(inside), changed) if n >= least and changed * WORDS_PER_EDIT > n else (0, 0, 0)

    for k in slots:
        a, b = (kinds[k], item[k]), (kinds[k], words[at + k - start])
        clash = max(there[a][1] if a in there and there[a][0] != b and there[a][1] >= low else -1, back[b][1] if b in back and back[b][0] != a and back[b][1] >= low else -1)
        if clash >= 0:
            best = max(best, closed(k))
            low = clash + 1
        there[a], back[b] = (b, k), (a, k)
    return max(best, closed(start + size))


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in order of their keys, in blocks of bounded size, one at a time."""
    block, size = [], 0
    for r in items.select("item_id", "text").filter("item_id is not null and text is not null").orderBy("item_id").toLocalIterator():
        if size + len(r[1]) > BLOCK_BYTES and block:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    yield block


LEAKS = "doc_id bigint, item_id bigint, words int, edits int, slots int, changed_slots int"
_COLUMNS = ["doc_id", "item_id", "words", "edits", "slots", "changed_slots"]
#: Texts that are looked at together.
_TOGETHER = 2_000_000


def leaks(documents: DataFrame, items: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, item_id, words, edits, slots, changed_slots of every leaked or re-parameterised item.

    documents: doc_id, text; items: item_id, text, a stated query set that is
    taken in blocks of BLOCK_BYTES. words and edits are those of the longest
    leaked span, counted in the item's white-space words. A row with words = 0
    is a re-parameterised question: its template stands there over at least
    `least` words with consistent slots, of which more are changed than a leak
    may have edits; a document may have rows of both kinds for an item. Null and empty texts
    leak nothing, nor do items shorter than `least` words. Repeated documents
    come out as often as they go in.
    """
    parts: list[DataFrame] = []
    for block in _blocks(items):
        if len(parts) == 1:
            parts[0] = materialise(parts[0], "leaks")
        part = _leaks_of(documents, block, least)
        # with more than one block each is worked off by itself, so that one index at a time is held
        parts.append(part if not parts else materialise(part, "leaks"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _leaks_of(documents: DataFrame, block: list[tuple[int, str]], least: int) -> DataFrame:
    # bounded by BLOCK_BYTES of item text
    shared = documents.sparkSession.sparkContext.broadcast(Index([x for x in block if len(x[1].split()) >= least]))

    def scan(batches):
        index = shared.value
        for b in batches:
            held: list[tuple[int, str]] = []
            size = 0
            for doc, text in zip(b["doc_id"], b["text"]):
                if text:
                    held.append((doc, text))
                    size += len(text)
                    if size > _TOGETHER:
                        yield pd.DataFrame(scan_texts(index, held, least), columns=_COLUMNS)
                        held, size = [], 0
            yield pd.DataFrame(scan_texts(index, held, least), columns=_COLUMNS)

    # keys as text, since a null would turn a batch's keys into floats
    keyed = documents.filter("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return keyed.mapInPandas(scan, LEAKS.replace("doc_id bigint", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("bigint"))


def _verbatim(item: np.ndarray, place: np.ndarray, at: np.ndarray, doc: np.ndarray, begin: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """By (text, item): places in both of the windows with unchanged slots, where those are two or more."""
    _, back, count = np.unique(doc * (1 << 32) + item, return_inverse=True, return_counts=True)
    jobs: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for k in np.flatnonzero((count >= 2)[back]):
        jobs[int(doc[k]), int(item[k])].append((int(place[k]), int(at[k] - begin[doc[k]])))
    return jobs


def _diagonals(item: np.ndarray, place: np.ndarray, at: np.ndarray, doc: np.ndarray, begin: np.ndarray, windows: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, start in the item, start in the text, words) of every run of `windows` or more windows one after another on one diagonal."""
    if not len(item):
        return
    line = at - place
    order = np.lexsort((place, line, item))
    item, place, at, line, doc = (x[order] for x in (item, place, at, line, doc))
    new = np.concatenate([[True], (item[1:] != item[:-1]) | (line[1:] != line[:-1]) | (place[1:] != place[:-1] + 1) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [len(item)]]))
    for k, n in zip(first[size >= windows].tolist(), size[size >= windows].tolist()):
        yield int(doc[k]), int(item[k]), int(place[k]), int(at[k] - begin[doc[k]]), n + WINDOW - 1


def scan_texts(index: Index, texts: list[tuple[int, str]], least: int = LEAST_WORDS) -> list[tuple]:
    """Leaks of some texts: their words are numbered, template windows are met for all at once, slots decide what is aligned.

    A span of n words with n / 8 edits keeps two whole windows at least (q-gram
    lemma), so a text and an item with fewer windows of unchanged slots have no
    leak. A re-parameterised span keeps all its template windows on one
    diagonal. Both readings of what a word is, pieces and white-space words,
    have windows of their own, as an edit of one is several of the other, and a
    value may have one piece in the item and two in the text.
    """
    found: dict[tuple[int, int], tuple[int, int]] = {}
    changed: dict[tuple[int, int], tuple[int, int, int]] = {}
    cleaned = [plain(text) for _, text in texts]
    for reading, split in ((index.pieces, pieces), (index.spaced, spaced_words)):
        numbers: list[int] = []
        starts = []
        for clean in cleaned:
            starts.append(len(numbers))
            numbers += reading.numbers(split(clean))
            numbers.append(0)
        begin, ends = np.array(starts, dtype=np.int64), [*starts[1:], len(numbers)]
        item, place, at, same = reading.meet(np.array(numbers, dtype=np.int64))
        doc = np.searchsorted(begin, at, side="right") - 1
        paired = reading.paired
        for (d, i), seeds in sorted(_verbatim(item[same], place[same], at[same], doc[same], begin).items()):
            if (d, i) not in found:
                size, edits, start, *_ = longest_span(reading.items[i], numbers[starts[d] : ends[d] - 1], seeds)
                count = _words(index.weight[i], start, start + size) if paired else size
                if count >= least:
                    found[d, i] = count, edits
        for d, i, start, there, size in _diagonals(item, place, at, doc, begin, least - WINDOW + 1):
            words = split(cleaned[d])[there : there + size]
            own = reading.words[i]
            kinds = reading.template[reading.items[i]].tolist()
            weigh = (lambda a, b, i=i: _words(index.weight[i], a, b)) if paired else None
            best = consistent_span(own, words, kinds, start, 0, size, weigh, least)
            changed[d, i] = max(changed.get((d, i), (0, 0, 0)), best)
    rows = [(texts[d][0], index.keys[i], *span, 0, 0) for (d, i), span in sorted(found.items())]
    return rows + [(texts[d][0], index.keys[i], 0, 0, *span[1:]) for (d, i), span in sorted(changed.items()) if span[0]]


def _words(weight: list[int], start: int, end: int) -> int:
    """White-space words that the pieces from start to end stand in."""
    return weight[end - 1] - weight[start] + 1 if end > start else 0
