"""Graphs from files: JSON documents, GraphML, node and relationship CSVs, and Parquet tables."""

from __future__ import annotations

import json
import math
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessergraph.graph import EDGE_SCHEMA, HYPEREDGE_SCHEMA, NODE_SCHEMA, Graph, GraphError
from tessergraph.sources.writers import EDGE_ATTRIBUTES, JSON_BREAKS, JSON_LINES, NODE_ATTRIBUTES, XML_LINES

_NODE_KEYS = set("id label type file_type description importance source_file source_location source_url community is_god god".split())
_EDGE_KEYS = set("source target relation weight confidence confidence_score".split())
_RICH = set("type description importance file_type source_file community".split())
#: Where a graph is looked for if none is named.
USUAL_PLACES = ("graph.json", "graphify-out/graph.json", ".graphify/graph.json", ".tessergraph/graph.json")


def as_float(value: Any, default: float) -> float:
    """A finite number or the default."""
    try:
        x = float(default if value in (None, "") else value)
    except (TypeError, ValueError):
        return default
    return x if math.isfinite(x) else default


def as_int(value: Any) -> int | None:
    """Numbers are cut to integers, strings must be whole numbers; None for anything else."""
    try:
        return None if value in (None, "") else int(value)
    except (TypeError, ValueError, OverflowError):
        return None


def as_bool(value: Any) -> bool:
    """Of strings only true, 1, yes and y hold."""
    return value.strip().lower() in ("true", "1", "yes", "y") if isinstance(value, str) else bool(value)


def _text(value: Any, default: str = "") -> str:
    return str(value or default)


def _maybe(value: Any) -> str | None:
    return None if value is None else str(value)


def node_record(raw: dict[str, Any]) -> dict[str, Any]:
    """A row of the node schema, without ``ord``, from a JSON object; keys without a column go to ``extra`` as JSON."""
    if raw.get("id") in (None, ""):
        raise GraphError("node is missing required 'id' field")
    return {
        "id": str(raw["id"]), "label": _text(raw.get("label")), "type": _text(raw.get("type")), "file_type": _text(raw.get("file_type"), "concept"),
        "description": _text(raw.get("description")), "importance": as_float(raw.get("importance"), 0.0),
        **{k: _maybe(raw.get(k)) for k in ("source_file", "source_location", "source_url")},
        "community": as_int(raw.get("community")), "is_god": bool(raw.get("is_god", raw.get("god", False))),
        "extra": {k: json.dumps(v) for k, v in raw.items() if k not in _NODE_KEYS},
    }


def edge_record(raw: dict[str, Any]) -> dict[str, Any] | None:
    """The same for an edge; None without both ends."""
    ends = raw.get("source"), raw.get("target")
    if any(x in (None, "") for x in ends):
        return None
    return {
        "src": str(ends[0]), "dst": str(ends[1]), "relation": _text(raw.get("relation")), "weight": as_float(raw.get("weight"), 1.0),
        "confidence": _text(raw.get("confidence"), "EXTRACTED"), "confidence_score": as_float(raw.get("confidence_score"), 1.0),
        "extra": {k: json.dumps(v) for k, v in raw.items() if k not in _EDGE_KEYS},
    }


def hyperedge_record(raw: dict[str, Any]) -> dict[str, Any]:
    if raw.get("id") in (None, ""):
        raise GraphError("hyperedge is missing required 'id' field")
    return {"id": str(raw["id"]), "label": _text(raw.get("label")), "nodes": [str(n) for n in raw.get("nodes") or []], "relation": _text(raw.get("relation")), "confidence_score": as_float(raw.get("confidence_score"), 1.0)}


def detect_format(data: dict[str, Any]) -> str:
    """``graphify`` for documents with links, hyperedges or a node with one of the richer keys, else ``generic``."""
    rich = data.get("links") or data.get("hyperedges") or any(isinstance(n, dict) and _RICH & n.keys() for n in data.get("nodes") or [])
    return "graphify" if rich else "generic"


def parse_json(text: str) -> Iterator[tuple[str, dict[str, Any]]]:
    """(table, record) of each node, edge and hyperedge of a JSON document."""
    try:
        data = json.loads(text)
    except ValueError as e:
        raise GraphError(f"invalid JSON ({e})") from e
    if not isinstance(data, dict):
        raise GraphError("the document must be an object with a 'nodes' array")
    nodes = data.get("nodes")
    if not nodes:
        raise GraphError("graph has no nodes")
    if not isinstance(nodes, list):
        raise GraphError("'nodes' must be an array")
    for raw in nodes:
        if not isinstance(raw, dict):
            raise GraphError("every node must be an object")
        yield "nodes", node_record(raw)
    for raw in data.get("links") or data.get("edges") or []:
        record = edge_record(raw) if isinstance(raw, dict) else None
        if record:
            yield "edges", record
    for raw in data.get("hyperedges") or []:
        if isinstance(raw, dict):
            yield "hyperedges", hyperedge_record(raw)


_CASTS = {"boolean": as_bool, "int": int, "long": int, "float": float, "double": float}


def parse_graphml(text: str) -> Iterator[tuple[str, dict[str, Any]]]:
    """The same for GraphML; ``name``, ``kind`` and ``desc`` stand in for missing node attributes, ``label`` for an edge's
    relation."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise GraphError(f"could not parse GraphML ({e})") from e
    keys, defaults = graphml_keys(root)
    yield from _graphml_records(root, keys, defaults)


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def graphml_keys(root: ET.Element) -> tuple[dict[str, Any], dict[str, dict[str, Any]]]:
    """(name, cast) of each key, and the defaults of nodes and edges."""
    keys, defaults = {}, {"node": {}, "edge": {}}
    for k in (e for e in root.iter() if _local(e) == "key"):
        cast, name = _CASTS.get(k.get("attr.type", "string"), str), k.get("attr.name") or k.get("id")
        keys[k.get("id")] = (name, cast)
        for d in k:
            for kind in ("node", "edge"):
                if _local(d) == "default" and k.get("for") in (kind, "all"):
                    defaults[kind][name] = cast(d.text or "")
    return keys, defaults


def _graphml_records(root: ET.Element, keys: dict[str, Any], defaults: dict[str, dict[str, Any]]) -> Iterator[tuple[str, dict[str, Any]]]:
    def values(element: ET.Element) -> dict[str, Any]:
        out = dict(defaults[_local(element)])
        for d in element:
            if _local(d) == "data":
                name, cast = keys.get(d.get("key"), (d.get("key"), str))
                try:
                    out[name] = cast(d.text or "")
                except ValueError:
                    out[name] = d.text or ""
        return out

    for e in root.iter():
        if _local(e) == "node":
            v = values(e)
            aliases = {"label": v.pop("name", ""), "type": v.pop("kind", ""), "description": v.pop("desc", "")}
            v |= {k: v.get(k) or alias for k, alias in aliases.items()}
            god = as_bool(v.pop("is_god", False))
            record = node_record(v | {"id": e.get("id"), "is_god": god})
            yield "nodes", record
    for e in root.iter():
        if _local(e) == "edge":
            v = values(e)
            v["relation"] = v.get("relation") or v.get("label") or ""
            v.pop("label", None)
            record = edge_record(v | {"source": e.get("source"), "target": e.get("target")})
            if record:
                yield "edges", record


def _located(spark: SparkSession, path: str) -> str:
    """The path with a scheme, if something is there."""
    full = path if "://" in path else f"file://{Path(path).absolute()}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(full)
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        raise GraphError(f"{path}: file not found")
    return full


_PARSERS = {"json": parse_json, "graphml": parse_graphml}


def _begins(spark: SparkSession, full: str, text: str) -> bool:
    """Whether the file's first line is ``text``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(full)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        return bytes(stream.readNBytes(len(text) + 1)) == f"{text}\n".encode()
    finally:
        stream.close()


def _row_schema() -> str:
    flat = lambda schema: schema.replace(" ", ":").replace(",:", ",")
    return f"bad string, kind string, node struct<{flat(NODE_SCHEMA)}>, edge struct<{flat(EDGE_SCHEMA)}>, hyper struct<{flat(HYPEREDGE_SCHEMA)}>"


def _finite(x: Column, default: float) -> Column:
    x = x.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), default).otherwise(x)


def _rows(kind: Column, node: dict[str, Column], edge: dict[str, Column], hyper: dict[str, Column] | None, ord_: Column) -> list[Column]:
    """Columns of the document table from the values of a line, defaults applied as for single records."""
    text = lambda x, default="": F.coalesce(F.nullif(x, F.lit("")), F.lit(default))
    no_extra = F.create_map().cast("map<string,string>").alias("extra")
    n = F.struct(
        node["id"].alias("id"), *[text(node[c]).alias(c) for c in ("label", "type")], text(node["file_type"], "concept").alias("file_type"), text(node["description"]).alias("description"),
        _finite(node["importance"], 0.0).alias("importance"), *[node[c].alias(c) for c in ("source_file", "source_location", "source_url")],
        node["community"].try_cast("bigint").alias("community"), F.coalesce(node["is_god"].try_cast("boolean"), F.lit(False)).alias("is_god"), no_extra, ord_.alias("ord"),
    )
    e = F.struct(
        edge["source"].alias("src"), edge["target"].alias("dst"), text(edge["relation"]).alias("relation"), _finite(edge["weight"], 1.0).alias("weight"),
        text(edge["confidence"], "EXTRACTED").alias("confidence"), _finite(edge["confidence_score"], 1.0).alias("confidence_score"), no_extra, ord_.alias("ord"),
    )
    out = [F.when((kind == "nodes") & (text(node["id"]) == ""), "node is missing required 'id' field").alias("bad"), kind.alias("kind"), F.when(kind == "nodes", n).alias("node"), F.when(kind == "edges", e).alias("edge")]
    if hyper is None:
        return [*out, F.lit(None).cast(_row_schema().rpartition("hyper ")[2]).alias("hyper")]
    h = F.struct(hyper["id"].alias("id"), text(hyper["label"]).alias("label"), F.coalesce(hyper["nodes"], F.array().cast("array<string>")).alias("nodes"), text(hyper["relation"]).alias("relation"), _finite(hyper["confidence_score"], 1.0).alias("confidence_score"), ord_.alias("ord"))
    return [*out, F.when(kind == "hyperedges", h).alias("hyper")]


def _one_by_one(lines: DataFrame, parse) -> DataFrame:
    """Rows of the document table from ``lines(i, kind, value)`` that have attributes without a column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = {"nodes": 2, "edges": 3, "hyperedges": 4}
        for batch in batches:
            rows = []
            for i, kind, value in batch[["i", "kind", "value"]].itertuples(index=False):
                row = [None, kind, None, None, None]
                try:
                    record = parse(kind, value)
                    if record is None:
                        continue
                    row[place[kind]] = record | {"ord": i}
                except (GraphError, ValueError, ET.ParseError) as e:
                    row = [str(e) or "bad line", None, None, None, None]
                rows.append(row)
            yield pd.DataFrame(rows, columns=["bad", "kind", "node", "edge", "hyper"])

    return lines.mapInPandas(run, _row_schema())


def _line_table(spark: SparkSession, full: str) -> DataFrame:
    """``(i, value)``: the lines of a file in parallel. The parts of one file are read in its order, so ``i`` grows with it."""
    return spark.read.text(full).select(F.monotonically_increasing_id().alias("i"), "value")


def _json_lines(spark: SparkSession, full: str) -> DataFrame | None:
    """The rows of a document as :func:`tessergraph.sources.writers.write_json` lays it out; None for other ones."""
    if not _begins(spark, full, JSON_LINES):
        return None
    lines = _line_table(spark, full)
    regular = F.col("value").rlike(r'"is_god":(true|false|null)\}$') | F.col("value").rlike(r'"confidence_score":[^,{}\[\]]*\}$')
    marks = {JSON_LINES, *JSON_BREAKS}
    mark = F.col("value").isin(*marks)
    facts = lines.agg(F.array_sort(F.collect_list(F.when(mark, F.struct("i", "value")))).alias("marks"), F.count_if(~mark & ~regular).alias("odd"), F.max("i").alias("last")).first()
    if [m["value"] for m in facts["marks"]] != [JSON_LINES, *JSON_BREAKS] or facts["marks"][-1]["i"] != facts["last"]:
        return None
    _, links, hyper, _ = (m["i"] for m in facts["marks"])
    kind = F.when(F.col("i") < links, "nodes").when(F.col("i") < hyper, "edges").otherwise("hyperedges")
    lines = lines.filter(~mark).select("i", kind.alias("kind"), F.regexp_replace("value", "^,", "").alias("value"))
    n, e, h = (F.from_json("value", schema) for schema in (
        "id string, label string, type string, file_type string, description string, importance string, source_file string, source_location string, source_url string, community string, is_god string",
        "source string, target string, relation string, weight string, confidence string, confidence_score string",
        "id string, label string, nodes array<string>, relation string, confidence_score string",
    ))
    ready = lines.filter(regular) if facts["odd"] else lines
    ready = ready.select("i", "kind", F.when(F.col("kind") == "nodes", n).alias("n"), F.when(F.col("kind") == "edges", e).alias("e"), F.when(F.col("kind") == "hyperedges", h).alias("h"))
    of = lambda c: _Fields(c)
    rows = ready.select(*_rows(F.col("kind"), of("n"), of("e"), of("h"), F.col("i")))
    rows = rows.filter("kind <> 'edges' or edge.src <> '' and edge.dst <> ''")
    if not facts["odd"]:
        return rows
    parse = {"nodes": node_record, "edges": edge_record, "hyperedges": hyperedge_record}
    return rows.unionByName(_one_by_one(lines.filter(~regular), lambda kind, value: parse[kind](json.loads(value))))


class _Fields:
    """Fields of a struct column by name."""

    def __init__(self, column: str):
        self.column = column

    def __getitem__(self, name: str) -> Column:
        return F.col(f"{self.column}.{name}")


def _xml_lines(spark: SparkSession, full: str) -> DataFrame | None:
    """The same for :func:`tessergraph.sources.writers.write_graphml`."""
    if not _begins(spark, full, XML_LINES):
        return None
    lines, value = _line_table(spark, full), F.col("value")
    data = lambda letter, attributes: "".join(f'<data key="{letter}{i}s?">[^<]*</data>' for i in range(len(attributes)))
    shapes = {"nodes": f'^<node id="[^"]*">{data("n", NODE_ATTRIBUTES)}</node>$', "edges": f'^<edge source="[^"]*" target="[^"]*">{data("e", EDGE_ATTRIBUTES)}</edge>$'}
    kind = F.when(value.startswith("<node "), "nodes").when(value.startswith("<edge "), "edges")
    regular = F.when(kind == "nodes", value.rlike(shapes["nodes"])).otherwise(value.rlike(shapes["edges"]))
    other = lines.filter(kind.isNull()).orderBy("i").select("value").limit(4).collect()
    if len(other) != 3 or other[0][0] != XML_LINES or not other[1][0].startswith("<graphml ") or other[2][0] != "</graph></graphml>":
        return None
    keys, defaults = graphml_keys(ET.fromstring(other[1][0] + other[2][0]))
    lines = lines.select("i", kind.alias("kind"), "value").filter("kind is not null")
    odd = lines.filter(~regular)

    def plain(text: Column) -> Column:
        for mark, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#09;"), ("&", "&amp;")):
            text = F.replace(text, F.lit(name), F.lit(mark))
        return text

    def parse(kind: str, value: str) -> dict[str, Any] | None:
        return next((record for _, record in _graphml_records(ET.fromstring(value), keys, defaults)), None)

    cell = lambda i: plain(F.substring_index(F.get("d", F.lit(i)), ">", -1))
    quoted = lambda i: plain(F.get(F.split("value", '"', i + 2), F.lit(i)))
    ready = lines.filter(regular).select("i", "kind", "value", F.split("value", "</data>").alias("d"))
    node = {"id": quoted(1)} | {c: cell(i) for i, c in enumerate(NODE_ATTRIBUTES)}
    edge = {"source": quoted(1), "target": quoted(3)} | {c: cell(i) for i, c in enumerate(EDGE_ATTRIBUTES)}
    rows = ready.select(*_rows(F.col("kind"), node, edge, None, F.col("i"))).filter("kind <> 'edges' or edge.src <> '' and edge.dst <> ''")
    return rows if odd.isEmpty() else rows.unionByName(_one_by_one(odd, parse))


_LINES = {"json": _json_lines, "graphml": _xml_lines}


def _document(spark: SparkSession, path: str, kind: str) -> Graph:
    """What is in a document is a table from then on. One that has a record a line, as ours have, is parsed in parallel; others
    by one task, where they lie."""
    full = _located(spark, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["value"]:
                rows, place = [], {"nodes": 2, "edges": 3, "hyperedges": 4}
                try:
                    for i, (table, record) in enumerate(_PARSERS[kind](text)):
                        row = [None, table, None, None, None]
                        row[place[table]] = record | {"ord": i}
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=["bad", "kind", "node", "edge", "hyper"])
                            rows = []
                except GraphError as e:
                    rows.append([str(e), None, None, None, None])
                yield pd.DataFrame(rows, columns=["bad", "kind", "node", "edge", "hyper"])

    from tessergraph.session import materialise

    found = _LINES[kind](spark, full)
    rows = materialise(found if found is not None else spark.read.text(full, wholetext=True).mapInPandas(run, _row_schema()), "document")
    bad = rows.filter("bad is not null").select("bad").first()
    if bad is not None:
        raise GraphError(f"{path}: {bad['bad']}")
    if found is not None and rows.filter("kind = 'nodes'").isEmpty() and kind == "json":
        raise GraphError(f"{path}: graph has no nodes")
    part = lambda table, column: rows.filter(F.col("kind") == table).select(f"{column}.*")
    return Graph.build(part("nodes", "node"), part("edges", "edge"), part("hyperedges", "hyper"))


def load_json(spark: SparkSession, path: str) -> Graph:
    return _document(spark, path, "json")


def load_graphml(spark: SparkSession, path: str) -> Graph:
    return _document(spark, path, "graphml")


_ID = (":ID", "nodeId", "id", "_id")
_LABELS, _NAMES = (":LABEL", "labels", "label"), ("name", "label")
_START, _END = (":START_ID", "startNodeId", "start", "source"), (":END_ID", "endNodeId", "end", "target")
_TYPE = (":TYPE", "type", "relation", "label")


def _first(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first non-empty of those columns that exist."""
    have = [F.nullif(F.col(f"`{n}`"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def _number(df: DataFrame, name: str, default: float) -> Column:
    x = _first(df, (name,)).try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), default).otherwise(x)


def _rest(df: DataFrame, known: set[str]) -> Column:
    """Other non-empty columns as JSON values."""
    more = [n for n in df.columns if n not in known and n != "_ord"]
    if not more:
        return F.create_map().cast("map<string,string>")
    both = F.create_map(*[x for n in more for x in (F.lit(n), F.to_json(F.array(F.nullif(F.col(f"`{n}`"), F.lit("")))))])
    bare = F.transform_values(both, lambda k, v: F.substring(v, F.lit(2), F.length(v) - 2))
    return F.map_filter(bare, lambda k, v: v != "null")


def _table(spark: SparkSession, path: str) -> DataFrame:
    # A file of which no line has an odd number of quotes has no value of several lines, so it is read in parallel.
    full = _located(spark, path)
    spans = not spark.read.text(full).filter(F.regexp_count("value", F.lit('"')) % 2 == 1).isEmpty()
    df = spark.read.option("header", True).option("multiLine", spans).option("escape", '"').csv(full)
    return df.withColumn("_ord", F.monotonically_increasing_id())


def load_neo4j(spark: SparkSession, nodes_path: str, relationships_path: str | None = None) -> Graph:
    """A node CSV and a relationship CSV, with the columns of bulk imports (``:ID``, ``:START_ID``...) or simpler ones
    (``nodeId``, ``startNodeId``...). Rows without an id or without both ends, and relationships between unknown nodes,
    are skipped."""
    n = _table(spark, nodes_path)
    if not any(c in n.columns for c in _ID):
        raise GraphError(f"{nodes_path}: no node-id column found (one of {list(_ID)})")
    if n.isEmpty():
        raise GraphError(f"{nodes_path}: nodes CSV has no data rows")
    column = lambda c: _first(n, (c,))
    god = F.lower(F.trim(F.coalesce(_first(n, ("is_god", "god")), F.lit("")))).isin("true", "1", "yes", "y")
    known = {*_ID, *_LABELS, *_NAMES, *_NODE_KEYS}
    nodes = n.select(
        _first(n, _ID).alias("id"), F.coalesce(_first(n, _NAMES), _first(n, _LABELS)).alias("label"), F.coalesce(_first(n, _LABELS), F.lit("")).alias("type"),
        F.coalesce(column("file_type"), F.lit("concept")).alias("file_type"), F.coalesce(column("description"), F.lit("")).alias("description"),
        _number(n, "importance", 0.0).alias("importance"), *[column(c).alias(c) for c in ("source_file", "source_location", "source_url")],
        F.trim(column("community")).try_cast("bigint").alias("community"), god.alias("is_god"), _rest(n, known - {"type"}).alias("extra"), F.col("_ord").alias("ord"),
    ).filter("id is not null")
    nodes = nodes.withColumn("community", F.when(F.trim(F.col("community").cast("string")).rlike(r"^[+-]?\d+$"), F.col("community")))
    if relationships_path is None:
        return Graph.build(nodes, spark.createDataFrame([], EDGE_SCHEMA))
    r = _table(spark, relationships_path)
    edges = r.select(
        _first(r, _START).alias("src"), _first(r, _END).alias("dst"), F.coalesce(_first(r, _TYPE), F.lit("")).alias("relation"), _number(r, "weight", 1.0).alias("weight"),
        F.coalesce(_first(r, ("confidence",)), F.lit("EXTRACTED")).alias("confidence"), _number(r, "confidence_score", 1.0).alias("confidence_score"),
        _rest(r, {*_START, *_END, *_TYPE, "weight", "confidence", "confidence_score"}).alias("extra"), F.col("_ord").alias("ord"),
    )
    return Graph.build(nodes, edges)


def find_relationships(nodes_path: str) -> str | None:
    """The relationship CSV beside a node CSV, by its name."""
    p = Path(nodes_path)
    names = ["relationships", f"{p.stem}_relationships"] + ([f"{p.stem[:-6]}_relationships"] if p.stem.endswith("_nodes") else [])
    return next((str(q) for q in (p.parent / f"{n}.csv" for n in names) if q.exists()), None)


def load_tables(spark: SparkSession, path: str) -> Graph:
    """A graph stored by :func:`tessergraph.sources.writers.save_tables`; the form for graphs too large for one file."""
    return Graph(*(spark.read.parquet(f"{path}/{t}") for t in ("nodes", "edges", "hyperedges")))


def load_graph(spark: SparkSession, path: str) -> Graph:
    """By extension: ``.json``, ``.graphml``, ``.csv`` (nodes, with the relationships found beside them), ``.parquet``."""
    kind = Path(str(path)).suffix.lower()
    if kind == ".json":
        return load_json(spark, str(path))
    if kind == ".graphml":
        return load_graphml(spark, str(path))
    if kind == ".csv":
        _located(spark, str(path))
        return load_neo4j(spark, str(path), find_relationships(str(path)))
    if kind == ".parquet":
        return load_tables(spark, str(path))
    raise GraphError(f"{path}: unsupported extension '{kind}' (.json, .graphml, .csv or .parquet)")


def find_graph(folder: str = ".") -> str | None:
    """The first of the usual places that has a graph."""
    return next((str(p) for p in (Path(folder) / x for x in USUAL_PLACES) if p.exists()), None)
