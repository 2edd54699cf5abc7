"""Flat related tables out of deeply nested records.

Every record is read once, as a stream of path-value-ordinal triples. Triples
of one owner (the object that repeats) are grouped and pivoted into one row of
that owner's table; arrays inside it become child rows that keep its key.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.jsonwalk import clean, complete_json, kind_of, rows_of, scalar_text, triples


def record_triples(records: DataFrame, key: str, body: str, wanted: Iterable[str] | None = None) -> DataFrame:
    """One row per scalar and owner: key, owner, path, ordinal, value, kind.

    wanted: paths (from the owner) to keep, all where None, of any depth. A body
    that isn't complete JSON (null, '', truncated, followed by more text, NaN or
    Infinity) gives no row at all; JSON within a string counts as what it holds.
    value is text, null for a JSON null; kind is string, number, boolean or
    null. Records with a null key come out with a null key.
    """
    keep = None if wanted is None else frozenset(wanted)
    # an owner stands at most as many objects above as the longest path has steps
    reach = None if keep is None else max((p.count(".") + 1 for p in keep), default=1)
    schema = T.StructType(
        [records.schema[key]]
        + [T.StructField("owner", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("ordinal", T.IntegerType())]
        + [T.StructField("value", T.StringType()), T.StructField("kind", T.StringType())]
    )
    names = schema.names

    def walk(batches):
        for batch in batches:
            rows = []
            for k, text in zip(batch[key], batch[body]):
                whole, value = complete_json(text)
                if whole:
                    rows += [(k, o, p, n, scalar_text(v), kind_of(v)) for o, p, n, v in triples(value, reach) if keep is None or p in keep]
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return records.select(key, body).mapInPandas(walk, schema)


def pivot_owners(rows: DataFrame, key: str, fields: dict[str, str], lists: dict[str, list[str]]) -> DataFrame:
    """One row per owner: `fields` (column -> path) as text, `lists` (column -> paths) as ordered arrays of struct(ordinal, value).

    has_<column> tells whether the path is there at all, null values included.
    """
    aggs: list[Column] = []
    for c, p in fields.items():
        aggs += [F.max(F.when(F.col("path") == p, F.col("value"))).alias(c), F.max(F.col("path") == p).alias(f"has_{c}")]
    for c, paths in lists.items():
        held = F.when(F.col("path").isin(paths), F.struct("ordinal", "value"))
        aggs.append(F.array_sort(F.collect_list(held)).alias(c))
    return rows.groupBy(key, "owner").agg(*aggs)


#: The paths, from their owner, that nodes and actions are made of.
NODE_FIELDS = {"id": "id", "kind": "kind", "box_x": "bbox_global.x"}
NODE_LISTS = {"annotations": ["source_annotation_ids", "source_annotation_ids[]", "source_annotation_ids[].id"], "box": ["bbox_global[]"]}
ACTION_FIELDS = {"op": "op", "seq": "seq", "edge_id": "new_edge.id", "gt_added": "new_edge.attributes.gt_added", "from_node": "before.from_node"}
#: Type of the array of links that an entity gives.
LINKS = "array<struct<link_kind:string,parent_key:string,child_key:string>>"
#: Texts that stand for true, whatever type they were written in.
TRUE_TEXTS = ("true", "1", "yes", "y", "t")


def entity_tables(records: DataFrame, key: str, body: str) -> DataFrame:
    """Nodes and actions of every record, one row each with their children as arrays."""
    wanted = {*NODE_FIELDS.values(), *ACTION_FIELDS.values(), *[p for ps in NODE_LISTS.values() for p in ps]}
    return pivot_owners(record_triples(records, key, body, wanted), key, NODE_FIELDS | ACTION_FIELDS, NODE_LISTS)


TABLES = [
    ("table_path", T.StringType()),
    ("row", T.IntegerType()),
    ("parent_row", T.IntegerType()),
    ("fields", T.MapType(T.StringType(), T.StringType())),
    ("lists", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
]


def record_rows(records: DataFrame, key: str, body: str) -> DataFrame:
    """Rows of all derived tables: key, table_path, row, parent_row, fields (path -> text), lists (path -> texts in order).

    Paths are grouped by their repeated ancestor (`rows_of`): each group is one
    table, a row is one element, and parent_row names the row of the table that
    holds it (0 the record itself, -1 of that). Nulls are left out, so a field
    is there or not; an element without any scalar of its own has no row. Where
    a key comes twice in one object the last counts. Damaged bodies give none.
    """
    schema = T.StructType([records.schema[key], *[T.StructField(n, t) for n, t in TABLES]])

    def read(batches):
        for batch in batches:
            out = []
            for k, text in zip(batch[key], batch[body]):
                whole, value = complete_json(text)
                if not whole:
                    continue
                held: dict[int, tuple] = {}
                for table, row, parent, path, ordinal, v in rows_of(value):
                    if v is None or (not path and row == 0):
                        continue
                    _, _, fields, lists = held.setdefault(row, (table, parent, {}, {}))
                    if ordinal < 0:
                        fields[clean(path)] = scalar_text(v)
                    else:
                        lists.setdefault(clean(path), []).append(scalar_text(v))
                out += [(k, clean(t), r, p, f, a) for r, (t, p, f, a) in held.items()]
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=schema.names)
                    out = []
            yield pd.DataFrame(out, columns=schema.names)

    return records.select(key, body).mapInPandas(read, schema)


def derived_table(rows: DataFrame, key: str, table_path: str, columns: dict[str, str], lists: dict[str, str] | None = None) -> DataFrame:
    """One flat table: key, row, parent_row, a text column per path of `columns` and an array column per path of `lists`."""
    cols = [F.col("fields")[p].alias(c) for c, p in columns.items()] + [F.col("lists")[p].alias(c) for c, p in (lists or {}).items()]
    return rows.filter(F.col("table_path") == table_path).select(key, "row", "parent_row", *cols)


def table_layouts(rows: DataFrame, key: str) -> DataFrame:
    """table_path, column_path, is_list, rows, records: the columns of every derived table and how often each is filled."""
    names = F.concat(
        F.transform(F.map_keys("fields"), lambda p: F.struct(p.alias("column_path"), F.lit(False).alias("is_list"))),
        F.transform(F.map_keys("lists"), lambda p: F.struct(p.alias("column_path"), F.lit(True).alias("is_list"))),
    )
    per_record = rows.select(key, "table_path", F.inline(names)).groupBy("table_path", "column_path", "is_list", key).agg(F.count(F.lit(1)).alias("n"))
    return per_record.groupBy("table_path", "column_path", "is_list").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("records"))


def integer_text(text: Column) -> Column:
    """A number's text as integer text, rounded half up; null if it is no number."""
    number = F.trim(text).try_cast("decimal(38,9)")
    return F.floor(number + F.lit("0.5").cast("decimal(2,1)")).cast("string")


def child_links(entities: DataFrame, key: str) -> DataFrame:
    """key, link_kind, parent_key, child_key: the flat child tables in one.

    Null and absent parents or children give no row; a box array counts only
    with four entries; repeated links of a record come out once.
    """
    node = F.col("has_id") & F.col("has_kind") & F.col("id").isNotNull()
    action = F.col("has_op") & F.col("has_seq") & F.col("seq").isNotNull()
    corner = F.coalesce(F.col("box_x"), F.when(F.size("box") == 4, F.element_at(F.filter("box", lambda b: b["ordinal"] == 0), 1)["value"]))

    def link(kind: str, when: Column, parent: Column, child: Column) -> Column:
        return F.struct(F.lit(kind).alias("link_kind"), parent.alias("parent_key"), F.when(when, child).alias("child_key"))

    nodes = F.transform(F.when(node, F.col("annotations")), lambda a: link("node_annotation", F.lit(True), F.col("id"), a["value"]))
    one = F.array(
        link("node_box", node, F.col("id"), integer_text(corner)),
        link("added_edge", action & F.lower(F.trim("gt_added")).isin(*TRUE_TEXTS), F.col("seq"), F.col("edge_id")),
        link("revised_from", action, F.col("seq"), F.col("from_node")),
    )
    links = entities.select(key, F.inline(F.concat(F.coalesce(nodes, F.array().cast(LINKS)), one)))
    return links.filter(F.col("parent_key").isNotNull() & F.col("child_key").isNotNull()).distinct()

