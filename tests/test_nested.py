import json

from tracemill.functions.jsonwalk import complete_json, leaves, triples
from tracemill.operators import nested


def links(spark, bodies):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "record_id bigint, body string")
    return {tuple(r) for r in nested.child_links(nested.entity_tables(df, "record_id", "body"), "record_id").collect()}


def test_links_of_all_layouts(spark):
    node = {"id": "n1", "kind": "x", "bbox_global": {"x": "12", "y": 1}, "source_annotation_ids": ["a", None, {"id": "b", "page_index": 0}]}
    deep = {"a": {"b": [{"c": [[node]]}]}}
    listed = {"id": "n2", "kind": None, "bbox_global": [7, 8, 9, 10], "source_annotation_ids": "solo"}
    short = {"id": "n3", "kind": "x", "bbox_global": [7, 8, 9], "source_annotation_ids": None}
    actions = [
        {"op": "edge_add", "seq": 1, "new_edge": {"id": "e1", "attributes": {"gt_added": "true"}}},
        {"op": "edge_add", "seq": 2, "new_edge": {"id": "e2", "attributes": {"gt_added": 1}}},
        {"op": "edge_add", "seq": 3, "new_edge": {"id": "e3", "attributes": {"gt_added": False}}},
        {"op": "edge_revise", "seq": 4, "before": {"from_node": "n9"}},
        {"op": "edge_revise", "seq": None, "before": {"from_node": "n8"}},
        {"op": "edge_revise", "seq": 5, "before": None},
    ]
    bodies = [json.dumps(deep), json.dumps([listed, short, {"id": None, "kind": "x", "source_annotation_ids": ["z"]}]), json.dumps({"actions": actions}), json.dumps({"actions": actions[0]}), None, "", "{", '{"id":"q","kind":"k","source_annotation_ids":["a"]} x', '{"id":"q","kind":"k","bbox_global":{"x":NaN}}', "null", "3"]
    assert links(spark, bodies) == {
        (0, "node_annotation", "n1", "a"),
        (0, "node_annotation", "n1", "b"),
        (0, "node_box", "n1", "12"),
        (1, "node_annotation", "n2", "solo"),
        (1, "node_box", "n2", "7"),
        (2, "added_edge", "1", "e1"),
        (2, "added_edge", "2", "e2"),
        (2, "revised_from", "4", "n9"),
        (3, "added_edge", "1", "e1"),
    }


def test_empty_table(spark):
    df = spark.createDataFrame([], "record_id bigint, body string")
    assert nested.child_links(nested.entity_tables(df, "record_id", "body"), "record_id").count() == 0


def test_deep_and_damaged_json():
    depth = 200_000
    whole, value = complete_json("[" * depth + "1" + "]" * depth)
    assert whole
    assert sum(1 for _ in triples(value)) == 0  # no object owns it
    for bad in ("[1,]", '{"a":1,}', "[1 2]", '{"a" 1}', "[1]]", "tru", "[" * depth, '{"a":1'):
        assert complete_json(bad) == (False, None)
    nest = '{"a":' * 5000 + "1" + "}" * 5000
    assert complete_json(nest)[0]
    assert len(list(leaves(complete_json(nest)[1]))) == 1


def test_triples_keep_order_and_owner():
    got = list(triples({"a": [{"b": 1}, {"b": [2, 3]}], "c": None}))
    assert (2, "b", -1, 1) in got and (3, "b[]", 0, 2) in got and (3, "b[]", 1, 3) in got and (1, "c", -1, None) in got
    assert (1, "a[].b[]", 1, 3) in got


def test_json_in_strings_is_walked(spark):
    action = {"op": "edge_add", "seq": 7, "new_edge": json.dumps({"id": "e7", "attributes": {"gt_added": "true"}})}
    node = {"id": "n7", "kind": "k", "label": "[draft", "source_annotation_ids": json.dumps(["a", "b"]), "bbox_global": "[4, 5, 6, 7]"}
    bodies = [json.dumps({"actions": json.dumps([action])}), json.dumps(json.dumps({"deep": json.dumps([node])})), '{"actions": "[{"}']
    assert links(spark, bodies) == {(0, "added_edge", "7", "e7"), (1, "node_annotation", "n7", "a"), (1, "node_annotation", "n7", "b"), (1, "node_box", "n7", "4")}


def test_tables_by_repeated_ancestor(spark):
    body = {"v": 1, "meta": {"by": "x"}, "nodes": [{"id": "a", "box": {"x": 1}, "tags": ["p", None, "q"], "parts": [{"k": 1}, {"k": 2}]}, {"id": "b"}], "log": json.dumps([{"id": "c"}])}
    deep = {"id": "leaf"}
    for _ in range(40):
        deep = {"in": deep}
    df = spark.createDataFrame([(1, json.dumps(body)), (2, "{"), (None, None), (3, json.dumps({"nodes": [deep]}))], "record_id bigint, body string")
    rows = nested.record_rows(df, "record_id", "body")
    got = {(r.record_id, r.table_path, r.row, r.parent_row): (dict(r.fields), dict(r.lists)) for r in rows.collect()}
    assert got[1, "", 0, -1] == ({"v": "1", "meta.by": "x"}, {})
    assert got[1, "nodes[]", 1, 0] == ({"id": "a", "box.x": "1"}, {"tags[]": ["p", "q"]})
    assert got[1, "nodes[].parts[]", 3, 1] == ({"k": "2"}, {})
    assert got[1, "log[]", 5, 0] == ({"id": "c"}, {})
    assert got[3, "nodes[]", 1, 0] == ({"in." * 40 + "id": "leaf"}, {})
    flat = nested.derived_table(rows, "record_id", "nodes[]", {"id": "id", "x": "box.x"}, {"tags": "tags[]"}).orderBy("record_id", "row").collect()
    assert [tuple(r) for r in flat[:2]] == [(1, 1, 0, "a", "1", ["p", "q"]), (1, 4, 0, "b", None, None)]
    assert nested.table_layouts(rows, "record_id").filter("table_path = 'nodes[].parts[]'").collect()[0].asDict() == {"table_path": "nodes[].parts[]", "column_path": "k", "is_list": False, "rows": 2, "records": 1}
