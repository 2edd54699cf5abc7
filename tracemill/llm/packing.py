"""Filling containers of fixed token capacity with whole texts.

Cost-balanced packing: the cost of a text is linear plus quadratic in its
tokens (what attention over it takes); texts are assigned, longest first, to
the sequence of lowest cost that has room. Costs are compared in bands of a
sixteenth of a full sequence's cost, and within the lowest band with room the
tightest sequence is taken: costs stay within a band of each other, and rooms
close without rest. Texts are spread over groups of bounded size by a hash of
their row, so that groups pack independently and every group sees the whole
range of lengths.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.session import materialise, parallelism, tokenizer_dir

#: Capacities that one call packs for; more are an error.
MOST_TARGETS = 1_000
#: Texts that one group holds about; more give tighter containers, fewer more parallel work.
GROUP_ITEMS = 20_000
#: Cost of a text of n tokens: n + n * n / QUADRATIC.
QUADRATIC = 2048.0
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's texts are split into pieces before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(folder: str, name: str):
    import tiktoken

    with open(f"{folder}/{name}", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ship_vocabulary(spark: SparkSession, folder: str, vocabulary: str) -> None:
    """Sends the vocabulary's file to the executors, if the driver has it, so that they needn't have the folder."""
    if os.path.exists(f"{folder}/{vocabulary}"):
        spark.sparkContext.addFile(f"{folder}/{vocabulary}")


def _folder_of(folder: str, vocabulary: str) -> str:
    """Where a worker finds the vocabulary: what was sent along, else the folder itself."""
    try:
        sent = SparkFiles.get(vocabulary)
    except Exception:  # noqa: BLE001 - outside of a Spark worker
        return folder
    return os.path.dirname(sent) if os.path.exists(sent) else folder


def token_counts(documents: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens of every text by a public tokenizer; null and empty texts have 0. Repeated rows and rows without doc_id stay."""
    place = folder or tokenizer_dir()
    ship_vocabulary(documents.sparkSession, place, vocabulary)

    def run(batches):
        encode = _encoding(_folder_of(place, vocabulary), vocabulary).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b["text"]]
            yield pd.DataFrame({"key": b["key"], "n_tokens": pd.Series(n, dtype="int32")})

    # as text, since a null would turn a batch's keys into floats
    keyed = documents.select(F.col("doc_id").cast("string").alias("key"), "text")
    return keyed.mapInPandas(run, "key string, n_tokens int").select(F.col("key").cast("bigint").alias("doc_id"), "n_tokens")


def text_cost(tokens: int) -> float:
    return tokens + tokens * tokens / QUADRATIC


#: Bands of cost, up to that of a sequence filled by one text, within which sequences count as equally cheap.
COST_BANDS = 16


class Sequences:
    """Open sequences by bands of their cost, each band sorted by room."""

    def __init__(self, capacity: int, bands: int = COST_BANDS):
        self.capacity = capacity
        self.band = text_cost(capacity) / bands
        self.bands: list[list[tuple[int, float, int]]] = [[] for _ in range(bands + 1)]
        self.count = 0

    def put(self, cost: float, sequence: int, room: int) -> None:
        insort(self.bands[int(cost / self.band)], (room, cost, sequence))

    def open(self, number: int) -> None:
        """So many new sequences without any text."""
        self.bands[0] += [(self.capacity, 0.0, k) for k in range(self.count, self.count + number)]
        self.count += number

    def take(self, tokens: int) -> tuple[float, int, int]:
        """(cost, sequence, room): of the lowest band with room for so many tokens the tightest, of those the cheapest; a new one if there is none."""
        for held in self.bands:
            if held and held[-1][0] >= tokens:
                room, cost, sequence = held.pop(bisect_left(held, (tokens, -1.0, -1)))
                return cost, sequence, room
        self.count += 1
        return 0.0, self.count - 1, self.capacity


def pack_group(items: list[tuple[int | None, int]], capacity: int) -> list[tuple[int | None, int, int, int, int]]:
    """(item, part, sequence, offset, tokens) for items (key, tokens).

    An item over the capacity is cut into full parts, each a sequence of its
    own, and a rest that is packed like any item. As many sequences are open
    from the start as the tokens fill; more open when nothing has room. Ties go
    to the lower key (none last), then the lower sequence.
    """
    whole, rest = [], []
    for key, tokens in items:
        for part in range(tokens // capacity if tokens > capacity else 0):
            whole.append((key, part, len(whole), 0, capacity))
        if tokens <= capacity:
            rest.append((tokens, key, 0))
        elif tokens % capacity:
            rest.append((tokens % capacity, key, tokens // capacity))
    rest.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
    held = Sequences(capacity)
    held.open(-(-sum(r[0] for r in rest) // capacity))
    out = []
    for tokens, key, part in rest:
        cost, sequence, room = held.take(tokens)
        out.append((key, part, len(whole) + sequence, capacity - room, tokens))
        held.put(cost + text_cost(tokens), sequence, room - tokens)
    return whole + out


PACKED = "target_name string, container string, position int, doc_id bigint, part int, tokens int, capacity int"


def pack(documents: DataFrame, targets: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """One row per part of a text and target: container, position (tokens before it there), doc_id, part, tokens, capacity.

    targets: target_name, capacity_tokens (a few rows; those without a positive
    capacity are left out). No text is split unless it exceeds the capacity.
    Empty and null texts take a place of 0 tokens. Containers never span
    groups; a container's name is its group and number. Repeated rows are
    packed as often as they come, rows without doc_id like any other.
    """
    sizes = [(r[0], r[1]) for r in targets.select("target_name", "capacity_tokens").filter("capacity_tokens > 0 and target_name is not null").distinct().orderBy("target_name", "capacity_tokens").take(MOST_TARGETS + 1)]
    if len(sizes) > MOST_TARGETS:
        raise ValueError("targets are a short list")
    # rows are numbered once, in the written table, so that one key's rows fall into many groups and stay there
    counts = materialise(token_counts(documents, folder, vocabulary).withColumn("row", F.monotonically_increasing_id()), "token-counts")
    groups = max(1, -(-counts.count() // group_items))
    names = ["target_name", "container", "position", "doc_id", "part", "tokens", "capacity"]

    def packed(group: int, items: list[tuple[int | None, int]]):
        for name, capacity in sizes:
            rows = [(name, f"{group}-{s}", at, None if doc is None else str(doc), part, n, capacity) for doc, part, s, at, n in pack_group(items, capacity)]
            for k in range(0, len(rows), 50_000):
                yield pd.DataFrame(rows[k : k + 50_000], columns=names)

    def run(batches):
        # one group at a time, out of sorted partitions
        now, items = None, []
        for b in batches:
            for group, doc, tokens in zip(b["group"].tolist(), b["key"].tolist(), b["n_tokens"].tolist()):
                if group != now:
                    if items:
                        yield from packed(now, items)
                    now, items = group, []
                items.append((None if doc is None else int(doc), tokens))
        if items:
            yield from packed(now, items)

    grouped = counts.select(F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("group"), F.col("doc_id").cast("string").alias("key"), "n_tokens", "row")
    placed = grouped.repartition(min(groups, 8 * parallelism(documents.sparkSession)), "group").sortWithinPartitions("group", "row").drop("row")
    return placed.mapInPandas(run, PACKED.replace("doc_id bigint", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("bigint"))


def fill_report(packed: DataFrame) -> DataFrame:
    """Per target: containers, tokens, fill (tokens of the capacity), and the greatest, mean and standard deviation of a container's cost.

    The cost of a container is the sum of its texts' costs; parts of texts over
    the capacity fill containers of their own and are the greatest.
    """
    cost = F.col("tokens") + F.col("tokens") * F.col("tokens") / F.lit(QUADRATIC)
    each = packed.groupBy("target_name", "container").agg(F.sum("tokens").alias("tokens"), F.sum(cost).alias("cost"), F.max("capacity").alias("capacity"))
    return each.groupBy("target_name").agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("tokens").alias("tokens"),
        F.round(F.sum("tokens") / F.sum("capacity"), 6).alias("fill"),
        F.round(F.max("cost"), 3).alias("greatest_cost"),
        F.round(F.avg("cost"), 3).alias("mean_cost"),
        F.round(F.stddev_pop("cost"), 3).alias("cost_spread"),
    )
