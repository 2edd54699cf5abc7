"""One consistent table out of files whose layout drifts, and a list of the changes.

Every column of every file is profiled where its lines stand: rows, types, and
a value sketch, which is the values' hashes of the SKETCH records of lowest key
hash. As all sketches of a series prefer the same records, two of them tell how
often two columns hold the same value in the same record; in files of up to
SKETCH records they are exact. Successive files of a series are compared by
their profiles, and columns that went are matched with columns that came: a
maximum-weight bipartite matching over value agreement, types and name
similarity decides which were renamed. Matched columns are then unified.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions.jsonwalk import clean, complete_json, kind_of, leaves, scalar_text

#: Records that a sketch holds; agreement of larger files is estimated from so many (standard error under 1.6 points).
SKETCH = 1024
#: Kinds in the order that ties follow.
KINDS = ("string", "number", "boolean", "array")
PROFILES = "file_series string, file_name string, written bigint, path string, rows bigint, " + ", ".join(f"{k}s bigint" for k in KINDS) + ", sketch array<bigint>"
_NAMES = [x.split()[0] for x in PROFILES.split(", ")]
#: Values held before a part of the profiles is handed on; input partitions whose parts are merged at once, and in how many groups those of more are merged first.
_HELD, _AT_ONCE, _FOLDS = 400_000, 512, 64
#: An entry of a sketch is the record's hash and, in its last bits, the mark of its value, 0 for null.
MARK_BITS = 24
_MARKS = (1 << MARK_BITS) - 1


def value_text(value) -> str | None:
    """A value as text: arrays as their canonical JSON, 1 and 1.0 alike, None for null."""
    if isinstance(value, list):
        return clean(json.dumps(value, sort_keys=True, ensure_ascii=False))
    return scalar_text(value)


def record_key(held: dict, source: str | None) -> str:
    """What identifies a record between files: `id`, or `trial` in results; '' for a record without one."""
    key = held.get("trial" if source == "results" else "id")
    return "" if key is None or isinstance(key, (list, dict)) else scalar_text(key)


def _lines(files: DataFrame) -> DataFrame:
    return files.filter("file_series is not null and file_name is not null and written_at is not null and body is not null")


def mark_of(value) -> int:
    """The mark of a value: a hash of its kind and text between 1 and _MARKS, 0 for null."""
    if value is None:
        return 0
    kind = type(value)
    if kind is str:
        text, seed = value, 1
    elif kind is bool:
        text, seed = ("true" if value else "false"), 2
    elif kind is int:
        text, seed = scalar_text(value), 3
    else:
        text, seed = value_text(value), 4 if kind is list else 3
    return 1 + crc32(text.encode("utf-8", "replace"), seed) % _MARKS


_KIND_AT = {str: 1, int: 2, float: 2, bool: 3, list: 4}


def column_profiles(files: DataFrame) -> DataFrame:
    """One row per file and path: file_series, file_name, written, path, rows, rows by kind, sketch array<bigint>.

    Lines that aren't a complete JSON object give nothing. Nulls count as rows
    of no kind and have mark 0; of a record that comes twice the greater mark
    counts. Records without key aren't in sketches. Lines are profiled where
    they stand and only profiles move; where the input has many partitions,
    parts of one column are merged in two steps, so that a file of any size
    stays bounded in each.
    """

    def read(batches):
        held: dict[tuple, list] = {}
        values = 0

        def out():
            rows = []
            for (series, name), (written, columns) in held.items():
                for path, (n, strings, numbers, booleans, arrays, sketch) in columns.items():
                    if len(sketch) > SKETCH:
                        sketch = sorted(set(sketch))[:SKETCH]
                    rows.append((series, name, written, clean(path), n, strings, numbers, booleans, arrays, sketch))
            return pd.DataFrame(rows, columns=_NAMES)

        for b in batches:
            for series, name, source, written, body in zip(b.file_series, b.file_name, b.source_kind, b.written, b.body):
                whole, record = complete_json(body)
                if not whole or not isinstance(record, dict):
                    continue
                file = held.get((series, name))
                if file is None:
                    file = held[series, name] = [written, {}]
                elif written < file[0]:
                    file[0] = written
                columns = file[1]
                key = record_key(record, source)
                lead = crc32(key.encode()) << MARK_BITS if key else None
                for path, value in leaves(record):
                    at = columns.get(path)
                    if at is None:
                        at = columns[path] = [0, 0, 0, 0, 0, []]
                    at[0] += 1
                    if value is not None:
                        at[_KIND_AT[type(value)]] += 1
                    if lead is not None:
                        at[5].append(lead | mark_of(value))
                    values += 1
            if values > _HELD:
                yield out()
                held, values = {}, 0
        yield out()

    lines = _lines(files).select("file_series", "file_name", "source_kind", F.unix_micros("written_at").alias("written"), "body")
    parts = lines.mapInPandas(read, PROFILES)
    sums = [F.min("written").alias("written"), *[F.sum(c).alias(c) for c in ("rows", *(f"{k}s" for k in KINDS))]]
    lowest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sketch")))), 1, SKETCH).alias("sketch")
    keys = ["file_series", "file_name", "path"]
    # the same result either way: the lowest of all are the lowest of the groups' lowest
    if files.rdd.getNumPartitions() > _AT_ONCE:
        parts = parts.withColumn("fold", F.spark_partition_id() % _FOLDS).groupBy(*keys, "fold").agg(*sums, lowest)
    return parts.groupBy(*keys).agg(*sums, lowest)


def file_order(profile: DataFrame) -> DataFrame:
    """Every file with the file of its series written just before (ties by name); null for the first."""
    files = profile.groupBy("file_series", "file_name").agg(F.min("written").alias("written"))
    w = W.partitionBy("file_series").orderBy("written", "file_name")
    return files.withColumn("before", F.lag("file_name").over(w)).withColumn("next", F.lead("file_name").over(w))


def main_kind() -> Column:
    """The kind that most non-null values have (ties in the order of KINDS), null where all are null."""
    top = F.greatest(*[F.col(f"{k}s") for k in KINDS])
    kind = F.when(top == 0, F.lit(None).cast("string"))
    for k in KINDS:
        kind = kind.when(F.col(f"{k}s") == top, k)
    return kind


def name_similarity(a: str, b: str) -> float:
    """Share of common character pairs of two paths, case and separators aside, between 0 and 1."""

    def pairs(x: str) -> set[str]:
        words = re.findall(r"[a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", x.rsplit(".", 1)[-1]).lower())
        return {w[i : i + 2] for w in words for i in range(max(1, len(w) - 1))}

    p, q = pairs(a), pairs(b)
    return len(p & q) / len(p | q) if p | q else 0.0


def best_matching(weight: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs of a maximum-weight bipartite matching; only pairs of positive weight. Augmenting by shortest paths over potentials."""
    if not weight or not weight[0]:
        return []
    turned = len(weight) > len(weight[0])
    w = [list(r) for r in zip(*weight)] if turned else weight
    n, m = len(w), len(w[0])
    high = max(max(r) for r in w)
    cost = [[high - x for x in r] for r in w]
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        low, came, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, step, j1 = owner[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < low[j]:
                        low[j], came[j] = c, j0
                    if low[j] < step:
                        step, j1 = low[j], j
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    low[j] -= step
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[came[j0]]
            j0 = came[j0]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if turned else (a, b) for a, b in pairs if w[a][b] > 0)


#: A pair of columns may be one renamed column if this share of the common records agrees; more than chance would give.
LEAST_AGREEMENT = 0.45
LEAST_KAPPA = 0.45
CHANGES = "file_name string, change_kind string, old_path string, new_path string"


def agreement(a: list[int], b: list[int]) -> tuple[float, float] | None:
    """(share of records with the same value, the same beyond chance) of two sketches; None without common records.

    Counted over records that both have and where either value isn't null.
    """
    # beyond the last record of a full sketch nothing is known of its column
    known = min((x[-1] for x in (a, b) if len(x) >= SKETCH), default=1 << 62) >> MARK_BITS
    left, right = ({e >> MARK_BITS: e & _MARKS for e in x if e >> MARK_BITS <= known} for x in (a, b))
    pairs = [(m, right[r]) for r, m in left.items() if r in right and (m or right[r])]
    if not pairs:
        return None
    n = len(pairs)
    share = sum(x == y for x, y in pairs) / n
    first, second = Counter(x for x, _ in pairs), Counter(y for _, y in pairs)
    chance = sum(c * second[x] for x, c in first.items()) / (n * n)
    return share, (share - chance) / (1 - chance) if chance < 1 else 1.0


def renames(gone: list, come: list) -> list[tuple[str, str]]:
    """(old path, new path) of the columns (path, kind, sketch) that were renamed.

    Pairs need LEAST_AGREEMENT and, where values vary, LEAST_KAPPA above chance;
    the matching maximises agreement, equal types and name similarity decide
    between equals.
    """
    weight = [[0.0] * len(come) for _ in gone]
    left, right = ([[int(e) for e in c["sketch"]] for c in side] for side in (gone, come))
    for i, (a, x) in enumerate(zip(gone, left)):
        for j, (b, y) in enumerate(zip(come, right)):
            got = agreement(x, y)
            if got and got[0] >= LEAST_AGREEMENT and (got[1] >= LEAST_KAPPA or got[0] == 1):
                weight[i][j] = got[0] + 0.5 * got[1] + 0.1 * (a["kind"] == b["kind"]) + 0.3 * name_similarity(a["path"], b["path"])
    return [(gone[i]["path"], come[j]["path"]) for i, j in best_matching(weight)]


def layout_changes(profile: DataFrame) -> DataFrame:
    """file_name, change_kind, old_path, new_path against the file written just before.

    profile: the rows of `column_profiles`, read more than once (hand in a
    written table). A first file of a series has no changes. Every profile
    stands once for its own file and once for the next; only columns that went
    or came are looked up with their sketches.
    """
    order = file_order(profile)
    shape = profile.select("file_series", "file_name", "path", main_kind().alias("kind")).join(order.select("file_series", "file_name", "before", "next"), ["file_series", "file_name"])
    side = lambda name, new: F.when(F.col("before" if new else "next").isNotNull(), F.struct(F.col(name).alias("pair"), F.lit(new).alias("new")))
    sides = shape.select("file_series", "file_name", "path", "kind", F.inline(F.filter(F.array(side("file_name", True), side("next", False)), lambda s: s.isNotNull())))
    of = lambda new: F.max(F.when(F.col("new") == new, F.struct("file_name", "kind")))
    both = sides.groupBy("file_series", "pair", "path").agg(of(True).alias("now"), of(False).alias("was"))
    retyped = both.filter("now is not null and was is not null and now.kind is not null and was.kind is not null and now.kind <> was.kind").select(
        F.col("pair").alias("file_name"), F.lit("retyped").alias("change_kind"), F.col("path").alias("old_path"), F.col("path").alias("new_path")
    )
    moved = both.filter("now is null or was is null").select(
        "file_series", "pair", "path", F.col("was").isNotNull().alias("gone"), F.coalesce("was.file_name", "now.file_name").alias("file_name"), F.coalesce("was.kind", "now.kind").alias("kind")
    )
    held = moved.join(profile.select("file_series", "file_name", "path", "sketch"), ["file_series", "file_name", "path"])
    column = F.struct("path", "kind", "sketch")
    sorted_ = lambda x: F.array_sort(F.collect_list(x), lambda p, q: F.when(p["path"] < q["path"], -1).when(p["path"] > q["path"], 1).otherwise(0))
    files = held.groupBy("file_series", "pair").agg(sorted_(F.when(F.col("gone"), column)).alias("gone"), sorted_(F.when(~F.col("gone"), column)).alias("come"))

    def match(batches):
        for b in batches:
            rows = []
            for name, gone, come in zip(b.pair, b.gone, b.come):
                gone, come = list(gone), list(come)
                named = renames(gone, come)
                old, new = {x for x, _ in named}, {y for _, y in named}
                rows += [(name, "renamed", x, y) for x, y in named]
                rows += [(name, "removed", c["path"], "") for c in gone if c["path"] not in old]
                rows += [(name, "added", "", c["path"]) for c in come if c["path"] not in new]
            yield pd.DataFrame(rows, columns=["file_name", "change_kind", "old_path", "new_path"])

    return files.select("pair", "gone", "come").mapInPandas(match, CHANGES).unionByName(retyped)


def unified_paths(profile: DataFrame, changes: DataFrame) -> DataFrame:
    """file_series, file_name, names map<path, unified path>, kinds map<unified path, kind>: what each file's columns are called in the end.

    Renames are followed file by file: a column's final name is the name at the
    end of its chain of renames after the file that it stands in. Its kind is
    the one of the last file of the series that has it with values.
    """
    order = file_order(profile).select("file_series", "file_name", "written")
    moves = changes.filter("change_kind = 'renamed'").join(order, "file_name").select("file_series", "written", "file_name", "old_path", "new_path")
    chains = moves.groupBy("file_series").agg(F.array_sort(F.collect_list(F.struct("written", "file_name", "old_path", "new_path"))).alias("moves"))
    none = F.array().cast("array<struct<written:bigint,file_name:string,old_path:string,new_path:string>>")
    shape = profile.select("file_series", "file_name", "path", main_kind().alias("kind")).join(order, ["file_series", "file_name"]).join(chains, "file_series", "left")
    later = F.filter(F.coalesce("moves", none), lambda m: (m["written"] > F.col("written")) | ((m["written"] == F.col("written")) & (m["file_name"] > F.col("file_name"))))
    final = F.aggregate(later, F.col("path"), lambda p, m: F.when(m["old_path"] == p, m["new_path"]).otherwise(p))
    named = shape.select("file_series", "file_name", "written", "path", "kind", final.alias("unified_path"))
    last = named.filter("kind is not null").groupBy("file_series", "unified_path").agg(F.max(F.struct("written", "file_name", "kind"))["kind"].alias("kind"))
    kinds = last.groupBy("file_series").agg(F.map_from_entries(F.collect_list(F.struct("unified_path", "kind"))).alias("kinds"))
    names = named.groupBy("file_series", "file_name").agg(F.map_from_entries(F.collect_list(F.struct("path", "unified_path"))).alias("names"))
    return names.join(kinds, "file_series", "left")


def as_kind(value, kind: str | None):
    """(text of a value as that kind, whether it could be made one). Nulls stay null; what can't keeps its own text."""
    own, text = kind_of(value), value_text(value)
    if own is None or kind is None or own == kind or kind == "string":
        return text, True
    if kind == "array":
        return value_text([value]), True
    if isinstance(value, str):
        bare = value.strip()
        if kind == "boolean" and bare.lower() in ("true", "false"):
            return bare.lower(), True
        if kind == "number":
            whole, number = complete_json(bare)
            if whole and kind_of(number) == "number":
                return scalar_text(number), True
    elif kind == "number" and isinstance(value, bool):
        return str(int(value)), True
    elif kind == "boolean" and value in (0, 1):
        return "true" if value else "false", True
    return text, False


UNIFIED = "file_series string, file_name string, line_no int, record string, fields map<string,string>, unfit array<string>"


def unified(files: DataFrame, paths: DataFrame) -> DataFrame:
    """The one consistent table: a row per line, its fields under their unified names, as text of their unified kind.

    files: the lines; paths: the rows of `unified_paths`, one per file. Fields
    whose value can't be made the column's kind keep their text and are named
    in `unfit`. Where two columns of a file end as one, the one already so
    named counts. Lines that aren't a complete JSON object give none; lines
    that come twice give two rows.
    """

    def rename(batches):
        for b in batches:
            rows = []
            for series, name, source, line, body, names, kinds in zip(b.file_series, b.file_name, b.source_kind, b.line_no, b.body, b.names, b.kinds):
                whole, held = complete_json(body)
                if not whole or not isinstance(held, dict):
                    continue
                to, kinds = dict(names or {}), dict(kinds or {})
                fields, unfit = {}, []
                for path, value in leaves(held):
                    final = to.get(path, path)
                    if final in fields and path != final:
                        continue
                    text, fits = as_kind(value, kinds.get(final))
                    fields[clean(final)] = text
                    if not fits:
                        unfit.append(clean(final))
                rows.append((series, name, None if line is None or line != line else int(line), record_key(held, source), fields, unfit))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in UNIFIED.split(", ")])

    lines = _lines(files).select("file_series", "file_name", "source_kind", "line_no", "body")
    return lines.join(paths, ["file_series", "file_name"]).mapInPandas(rename, UNIFIED)
