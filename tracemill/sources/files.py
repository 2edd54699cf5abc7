"""Reading the file formats of drawings and evaluations: CSV facts, JSON graphs, JSONL annotations, GraphML, YAML catalogues, HTML cells, run folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX = "struct<x:int,y:int,w:int,h:int>"
GRAPH = f"""schema_version string, source_path string,
 nodes array<struct<id:string,kind:string,label:string,bbox_global:{BOX},page_index:int,attributes:string,confidence:string,source_quote:string,alternate_readings:array<string>,source_annotation_ids:array<string>,system_confidence:double>>,
 edges array<struct<id:string,from_node:string,to_node:string,line_type:string,polyline_global:array<array<int>>,cross_sheet:boolean,confidence:string,source_annotation_ids:array<string>,attributes:string>>,
 per_page_status map<string,string>"""
ANNOTATION = f"id string, page_index int, kind string, source_view string, tile_id string, bbox_local {BOX}, bbox_global {BOX}, line_type string, label string, attributes string, confidence string, source_quote string"
RESULTS = (
    "run_id string, condition string, fixture string, phase int, metric_kind string, family string, query_id string, scoring string, score double, detail string, trial int, cost_usd double, "
    "input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint, image_tokens bigint, n_steps bigint, n_tool_calls bigint, tool_call_counts_json string, "
    "retries bigint, wall_clock_s double, source_type string, domain string, entity_count_truth double"
)
#: Columns that older files lack, with what they hold there.
BACKFILLED = {"cache_read_tokens": 0, "cache_write_tokens": 0, "image_tokens": 0, "n_steps": 0, "n_tool_calls": 0, "tool_call_counts_json": "", "retries": 0}
MANIFEST_DEFAULTS = {"source_type": "vector", "annotation_level": "full", "role": "eval"}


def _schema(spark: SparkSession, ddl: str) -> T.StructType:
    return spark.createDataFrame([], ddl).schema


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The evaluation fact table: by the file's own header, missing observability columns backfilled; other missing columns are an error."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    schema = _schema(spark, RESULTS)
    lacking = [f.name for f in schema if f.name not in raw.columns and f.name not in BACKFILLED]
    if lacking:
        raise ValueError(f"results lack the columns {lacking}")
    held = lambda f: F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(BACKFILLED[f.name]).cast(f.dataType)
    return raw.select(*[held(f).alias(f.name) for f in schema])


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    """One row per graph file, nested; damaged files come with their text in _corrupt_record."""
    schema = _schema(spark, GRAPH).add("_corrupt_record", T.StringType())
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.input_file_name())


def graph_nodes(graphs: DataFrame) -> DataFrame:
    return graphs.select("file", F.inline("nodes"))


def graph_edges(graphs: DataFrame) -> DataFrame:
    return graphs.select("file", F.inline("edges"))


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines) of JSONL annotations."""
    schema = _schema(spark, ANNOTATION).add("_corrupt_record", T.StringType())
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value").filter("trim(value) <> ''")
    read = lines.withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    good = read.filter("row._corrupt_record is null").select("file", "row.*").drop("_corrupt_record")
    return good, read.filter("row._corrupt_record is not null").select("file", F.col("value").alias("line"))


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, issues) of GraphML: data keys as maps; duplicate ids and edges without their ends are issues."""
    data = "array<struct<_key:string,_VALUE:string>>"
    of = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(_schema(spark, schema)).load(path).withColumn("file", F.input_file_name())
    as_map = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast(data)), lambda x: F.struct(x["_key"], x["_VALUE"]))).alias("data")
    nodes = of("node", f"_id string, data {data}").select("file", F.col("_id").alias("id"), as_map)
    edges = of("edge", f"_source string, _target string, data {data}").select("file", F.col("_source").alias("source"), F.col("_target").alias("target"), as_map)
    twice = nodes.groupBy("file", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("file", F.lit("duplicate_id").alias("issue"), "id")
    known = nodes.select("file", "id").distinct()
    ends = edges.select("file", F.explode(F.array("source", "target")).alias("id"))
    loose = ends.join(known, ["file", "id"], "left_anti").select("file", F.lit("dangling_edge").alias("issue"), "id").distinct()
    return nodes, edges, twice.unionByName(loose)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The fixture catalogue (YAML list of maps, or under `fixtures`), defaults filled in per row. A catalogue is one small file."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    held = yaml.safe_load(text) or []
    rows = held.get("fixtures", []) if isinstance(held, dict) else held
    names = ["stem", "pdf", "domain", "source_type", "annotation_level", "role"]
    filled = [tuple(str(r[n]) if r.get(n) is not None else MANIFEST_DEFAULTS.get(n) for n in names) for r in rows]
    return spark.createDataFrame(filled, ", ".join(f"{n} string" for n in names))


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """file, id, kind, heading, tags, body of YAML entries, one file each; files that don't parse come with null id."""
    import pandas as pd

    def parse(batches):
        import yaml

        for b in batches:
            rows = []
            for file, text in zip(b["file"], b["value"]):
                try:
                    e = yaml.safe_load(text) or {}
                    e = e if isinstance(e, dict) else {}
                except yaml.YAMLError:
                    e = {}
                get = lambda k: None if e.get(k) is None else str(e[k])
                rows.append((file, get("id"), get("kind"), get("heading"), [str(t) for t in e.get("tags") or []], get("body")))
            yield pd.DataFrame(rows, columns=["file", "id", "kind", "heading", "tags", "body"])

    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return raw.select("file", "value").mapInPandas(parse, "file string, id string, kind string, heading string, tags array<string>, body string")


def html_cells(html: Column) -> Column:
    """Texts of the table cells of a page: tags dropped, entities of the common kind replaced, white space collapsed."""
    cells = F.regexp_extract_all(html, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1)
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), "&nbsp;|&#160;", " "), r"\s+", " "))
    return F.filter(F.transform(cells, lambda c: F.regexp_replace(plain(c), "&amp;", "&")), lambda c: c != "")


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, bytes, modified, sha256 of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def recent_runs(spark: SparkSession, path: str, limit: int = 50) -> DataFrame:
    """The newest runs by the moment in their folder's name; files that don't parse are left out. A top-k report."""
    from tracemill.functions.text import run_moment

    runs = spark.read.schema("question string, status string, cost_usd double, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.input_file_name())
    named = runs.filter("_corrupt_record is null").withColumn("run_id", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1))
    return named.withColumn("moment", run_moment(F.col("run_id"))).orderBy(F.desc_nulls_last("moment"), F.desc("run_id")).limit(limit).select("run_id", "moment", "question", "status", "cost_usd")
