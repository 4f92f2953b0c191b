"""Graphs to files."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessergraph.graph import Graph, GraphError
from tessergraph.session import put_lines

#: How documents begin that have one record a line; the readers take those apart in parallel.
JSON_LINES = '{"layout":"one record a line","nodes":['
JSON_BREAKS = ('],"links":[', '],"hyperedges":[', "]}")
XML_LINES = "<?xml version='1.0' encoding='utf-8'?><!--one element a line-->"
#: Attributes in the order of their keys ``n0``, ``n1``... and ``e0``, ``e1``..., with their types.
NODE_ATTRIBUTES = {c: "string" for c in ("label", "type", "file_type", "description")} | {"importance": "double"} | {c: "string" for c in ("source_file", "source_location", "source_url")} | {"community": "long", "is_god": "boolean"}
EDGE_ATTRIBUTES = {"relation": "string", "weight": "double", "confidence": "string", "confidence_score": "double"}


def save_tables(graph: Graph, path: str) -> None:
    """As Parquet tables, written in parallel; the form for graphs of any size."""
    for name in ("nodes", "edges", "hyperedges"):
        getattr(graph, name).write.mode("overwrite").parquet(f"{path}/{name}")


def _json(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``,{...}`` for each row in order, extras after the columns."""
    record = F.to_json(F.struct(*[F.col(c).alias(name) for name, c in columns.items()]), {"ignoreNullFields": "false"})
    if "extra" in df.columns:
        key = lambda x: F.regexp_replace(F.to_json(F.array(x["key"])), r"^\[|\]$", "")
        more = F.transform(F.map_entries("extra"), lambda x: F.concat(F.lit(","), key(x), F.lit(":"), F.translate(x["value"], "\r\n", "  ")))
        more = F.concat(F.substring(record, F.lit(1), F.length(record) - 1), F.array_join(more, ""), F.lit("}"))
        record = F.when(F.size("extra") > 0, more).otherwise(record)
    return df.orderBy("ord").select(F.concat(F.lit(","), record).alias("value"))


def write_json(graph: Graph, path: str | Path) -> str:
    """What :meth:`Graph.to_dict` gives, one record a line."""
    n = ["id", *NODE_ATTRIBUTES]
    tables = [
        _json(graph.nodes, dict(zip(n, n))), _json(graph.edges, {"source": "src", "target": "dst"} | {c: c for c in EDGE_ATTRIBUTES}),
        _json(graph.hyperedges, {c: c for c in ("id", "label", "nodes", "relation", "confidence_score")}),
    ]
    pieces = [x for table, end in zip(tables, JSON_BREAKS) for x in (table, end + "\n")]
    return put_lines(graph.spark, str(path), [JSON_LINES + "\n", *pieces], skip=1)


def _renamed(path: str | Path, ending: str) -> str:
    """The path with another ending; it may have a scheme."""
    folder, slash, name = str(path).rpartition("/")
    return folder + slash + (name.rpartition(".")[0] or name) + ending


def _scalar(value: Any) -> tuple[str, str]:
    """GraphML type and text; containers become JSON, None an empty string."""
    if isinstance(value, bool):
        return "boolean", str(value).lower()
    if isinstance(value, int):
        return "long", str(value)
    if isinstance(value, float):
        return "double", repr(value)
    return "string", "" if value is None else value if isinstance(value, str) else json.dumps(value, default=str)


def _escaped(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#09;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def _kinds(df: DataFrame) -> list[tuple[str, str]]:
    """Names and GraphML types of the extras that occur."""
    v = F.col("value")
    kind = F.when(v.isin("true", "false"), "boolean").when(v.rlike(r"^-?\d+$"), "long").when(v.rlike(r"^-?(\d|Infinity|NaN)") | (v == "NaN"), "double").otherwise("string")
    return sorted(tuple(r) for r in df.select(F.explode("extra").alias("key", "value")).select("key", kind).distinct().collect())


def _elements(df: DataFrame, start: Column, end: str, letter: str, attributes: dict[str, str], extras: list[tuple[str, str]]) -> DataFrame:
    data = lambda key, text: F.concat(F.lit('<data key="'), key, F.lit('">'), text, F.lit("</data>"))
    parts = []
    for i, (c, kind) in enumerate(attributes.items()):
        key = F.lit(f"{letter}{i}") if kind == "string" else F.when(F.col(c).isNull(), f"{letter}{i}s").otherwise(f"{letter}{i}")
        parts.append(data(key, F.coalesce(_escaped(F.col(c).cast("string")), F.lit(""))))
    if extras:
        keys = {e: f"{letter}x{i}" for i, e in enumerate(extras)}

        @F.pandas_udf("string")
        def rest(extra: pd.Series) -> pd.Series:
            def one(values) -> str:
                out = []
                for k, v in dict(values or {}).items():
                    kind, text = _scalar(json.loads(v))
                    text = quoteattr(text, {'"': "&quot;", "'": "&apos;"})[1:-1]
                    out.append(f'<data key="{keys[k, kind]}">{text}</data>')
                return "".join(out)

            return extra.map(one)

        parts.append(rest("extra"))
    return df.orderBy("ord").select(F.concat(start, *parts, F.lit(end)).alias("value"))


def write_graphml(graph: Graph, path: str | Path) -> str:
    """One GraphML file with all attributes of nodes and edges, one element a line; the format has no hyperedges. Values that
    are null are empty strings."""
    head = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'
    tables = []
    for df, what, letter, attributes in ((graph.nodes, "node", "n", NODE_ATTRIBUTES), (graph.edges, "edge", "e", EDGE_ATTRIBUTES)):
        extras = _kinds(df)
        for i, (name, kind) in enumerate(attributes.items()):
            for key, typ in {f"{letter}{i}": kind, **({} if kind == "string" else {f"{letter}{i}s": "string"})}.items():
                head += f'<key id="{key}" for="{what}" attr.name="{name}" attr.type="{typ}" />'
        for i, (name, typ) in enumerate(extras):
            head += f'<key id="{letter}x{i}" for="{what}" attr.name={quoteattr(name)} attr.type="{typ}" />'
        ends = {"id": "id"} if what == "node" else {"source": "src", "target": "dst"}
        start = F.concat(F.lit(f"<{what}"), *[x for name, c in ends.items() for x in (F.lit(f' {name}="'), _escaped(F.col(c)), F.lit('"'))], F.lit(">"))
        tables.append(_elements(df, start, f"</{what}>", letter, attributes, extras))
    return put_lines(graph.spark, _renamed(path, ".graphml"), [f'{XML_LINES}\n{head}<graph edgedefault="directed">\n', *tables, "</graph></graphml>\n"])


def write_neo4j(graph: Graph, path: str | Path) -> list[str]:
    """``*_nodes.csv`` and ``*_relationships.csv`` for bulk import; sources, extras and hyperedges have no columns there."""
    tables = {
        "nodes": (graph.nodes, {":ID": "id", "name": "label", ":LABEL": "type", "file_type": "file_type", "description": "description", "importance": "importance", "community": "community", "is_god": "is_god"}),
        "relationships": (graph.edges, {":START_ID": "src", ":END_ID": "dst", ":TYPE": "relation", "weight": "weight", "confidence_score": "confidence_score"}),
    }
    paths = []
    for name, (df, columns) in tables.items():
        cells = []
        for c in columns.values():
            x = F.coalesce(F.col(c).cast("string"), F.lit(""))
            cells.append(F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x))
        rows = df.orderBy("ord").select(F.concat_ws(",", *cells).alias("value"))
        paths.append(put_lines(graph.spark, _renamed(path, f"_{name}.csv"), [",".join(columns) + "\n", rows]))
    return paths


def convert_graph(graph: Graph, path: str | Path, format: str) -> list[str]:
    """Write in a format of another tool, ``graphml`` or ``neo4j``; returns the files."""
    if format == "graphml":
        return [write_graphml(graph, path)]
    if format == "neo4j":
        return write_neo4j(graph, path)
    raise GraphError(f"unknown format {format!r}; there are 'graphml' and 'neo4j'")
