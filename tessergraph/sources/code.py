"""The source text behind a node."""

from __future__ import annotations

from itertools import takewhile
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessergraph.graph import Graph, source_path

MAX_LINES, MAX_NODES = 100, 30
_BRACES = (".ts", ".tsx", ".js", ".jsx", ".go")


def safe_path(root: str | Path, source_file: str) -> Path | None:
    """The file below ``root``, links resolved; None if it would lie outside. Graphs are untrusted: nothing outside the
    root may be read, whatever a node claims."""
    base = Path(root).resolve()
    try:
        full = (base / source_file).resolve()
    except (OSError, ValueError):
        return None
    return full if full.is_relative_to(base) else None


def line_number(location: Column) -> Column:
    """``L42`` or ``42`` as 42; null for anything else and for numbers below 1."""
    n = F.regexp_replace(F.trim(location.cast("string")), "^[Ll]", "")
    n = F.when(F.trim(n).rlike(r"^[+]?\d+$"), F.trim(n).try_cast("int"))
    return F.when(n >= 1, n)


def parse_line(location) -> int | None:
    """The same for a Python value; a bool is no line."""
    if isinstance(location, bool) or location is None:
        return None
    try:
        n = int(location) if isinstance(location, int) else int(location.strip().removeprefix("L").removeprefix("l") if location.strip()[:1] in "Ll" else location)
    except ValueError:
        return None
    return n if n >= 1 else None


def code_block(text: str, line: int, braces: bool, max_lines: int = MAX_LINES) -> str | None:
    """The definition that starts on a line: all deeper indented lines after it, or, with ``braces``, all up to the line
    that closes the first brace, or the line alone if none opens. None for a line beyond the end."""
    lines = text.splitlines()[line - 1 :]
    if not lines or line < 1:
        return None
    if braces:
        depth, opened, end = 0, False, 1
        for i, s in enumerate(lines, 1):
            opened, depth = opened or "{" in s, depth + s.count("{") - s.count("}")
            if opened and depth <= 0:
                end = i
                break
        else:
            end = len(lines) if opened else 1
        return "\n".join(lines[: min(end, max_lines)])
    width = lambda s: len(s) - len(s.lstrip())
    body = list(takewhile(lambda s: not s.strip() or width(s) > width(lines[0]), lines[1:]))
    while body and not body[-1].strip():
        body.pop()
    return "\n".join([lines[0], *body][:max_lines])


def code_blocks(graph: Graph, root: str | Path, max_lines: int = MAX_LINES) -> DataFrame:
    """``(id, code)`` of the nodes that name a readable file below ``root`` and a line in it; read where the tasks run,
    each file once."""
    base = str(Path(root).resolve())
    wanted = graph.nodes.select("id", source_path().alias("file"), "source_location").filter("file is not null and source_location is not null")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        file, rows = safe_path(base, part["file"].iloc[0]), []
        try:
            text = file.read_text(encoding="utf-8") if file is not None else None
        except (OSError, UnicodeDecodeError):
            text = None
        if text is not None:
            for node, location in zip(part["id"], part["source_location"]):
                line = parse_line(location)
                block = code_block(text, line, file.suffix.lower() in _BRACES, max_lines) if line else None
                if block is not None:
                    rows.append((node, block))
        return pd.DataFrame(rows, columns=["id", "code"])

    return wanted.groupBy("file").applyInPandas(run, "id string, code string")


def inject_code(graph: Graph, root: str | Path, max_nodes: int = MAX_NODES) -> Graph:
    """The graph with a ``code_block`` extra on each node that has one. A graph of more than ``max_nodes`` stays unchanged, and
    blocks end after MAX_LINES lines: a rendering is for a reader, and both limits belong to the feature."""
    if graph.nodes.count() > max_nodes:
        return graph
    blocks = code_blocks(graph, root)
    text = F.substring(F.to_json(F.array("code")), F.lit(2), F.length(F.to_json(F.array("code"))) - 2)
    extra = F.when(F.col("code").isNull(), F.col("extra")).otherwise(F.map_concat(F.map_filter("extra", lambda k, v: k != "code_block"), F.create_map(F.lit("code_block"), text)))
    nodes = graph.nodes.join(F.broadcast(blocks), "id", "left").withColumn("extra", extra).select(*graph.nodes.columns)
    return Graph(nodes, graph.edges, graph.hyperedges)
