"""A graph from a tree of source code."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from pathlib import Path, PurePosixPath
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessergraph.graph import EDGE_SCHEMA, NODE_SCHEMA, Graph
from tessergraph.session import materialise
from tessergraph.sources.parsers import PARSERS, module_id
from tessergraph.sources.readers import edge_record, node_record

SKIPPED = frozenset(".git __pycache__ node_modules .venv venv dist build .mypy_cache .ruff_cache .pytest_cache .tessergraph".split())
_PARSED = "source_file string, file_no long, hash string, kind string, pos int, record string"


def source_files(root: str | Path) -> list[str]:
    """Paths below ``root``, sorted folder by folder, of files in a known language. Symbolic links are neither followed
    nor indexed, so no file outside the root is ever read."""

    def walk(folder: Path) -> Iterator[str]:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            if e.is_symlink():
                continue
            if e.is_dir():
                if e.name not in SKIPPED and not e.name.endswith(".egg-info"):
                    yield from walk(Path(e.path))
            elif e.is_file() and Path(e.name).suffix.lower() in PARSERS:
                yield Path(e.path).relative_to(root).as_posix()

    return list(walk(Path(root)))


def _parse(root: str, parent: str, strict: bool, order: dict[str, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                rel = PurePosixPath(unquote(urlsplit(path).path)).relative_to(root).as_posix()
                digest = hashlib.sha256(content).hexdigest()
                try:
                    nodes, edges = PARSERS[PurePosixPath(rel).suffix.lower()](content.decode("utf-8"), rel, module_id(rel, parent, strict), strict)
                except UnicodeDecodeError:
                    nodes, edges = [], []
                found = [("node", n) for n in nodes] + [("edge", e) for e in edges]
                rows += [(rel, order[rel], digest, kind, i, json.dumps(r)) for i, (kind, r) in enumerate(found)] or [(rel, order[rel], digest, "none", 0, "{}")]
            yield pd.DataFrame(rows, columns=["source_file", "file_no", "hash", "kind", "pos", "record"])

    return run


def parse_project(spark: SparkSession, root: str | Path, strict_ids: bool = False, files: list[str] | None = None, order: dict[str, int] | None = None) -> DataFrame:
    """``(source_file, file_no, hash, kind, pos, record)``: what each file declares, one task a group of files. Files
    that are not UTF-8 or do not parse declare nothing."""
    base = Path(root).resolve()
    files = source_files(base) if files is None else files
    if not files:
        return spark.createDataFrame([], _PARSED)
    order = order or {f: i for i, f in enumerate(files)}
    content = spark.read.format("binaryFile").load([f"file://{base}/{f}" for f in files]).select("path", "content")
    return content.mapInPandas(_parse(base.as_posix(), base.name, strict_ids, order), _PARSED)


def assemble(parsed: DataFrame, ignore: Callable[[dict, str], bool] | None = None) -> Graph:
    """One graph of all files: the first node of an id stays, ignored nodes go, edges need both ends and count once for
    each relation, of which the last stays for a pair of nodes. ``ignore`` takes a node's record and id."""
    place = F.struct("file_no", "pos")

    def to_nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            records = [json.loads(r) for r in batch["record"]]
            rows = [node_record(r) | {"ord": o} for r, o in zip(records, batch["ord"]) if ignore is None or not ignore(r, r["id"])]
            yield pd.DataFrame(rows, columns=_columns(NODE_SCHEMA))

    def to_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([edge_record(json.loads(r)) | {"ord": o} for r, o in zip(batch["record"], batch["ord"])], columns=_columns(EDGE_SCHEMA))

    order = (F.col("file_no") * F.lit(1 << 24) + F.col("pos")).alias("ord")
    first = parsed.filter("kind = 'node'").groupBy(F.get_json_object("record", "$.id").alias("id")).agg(F.min(place).alias("at"), F.min_by("record", place).alias("record"))
    nodes = first.select("record", (F.col("at.file_no") * F.lit(1 << 24) + F.col("at.pos")).alias("ord")).mapInPandas(to_nodes, NODE_SCHEMA)
    edges = parsed.filter("kind = 'edge'").select("record", order)
    edges = edges.groupBy("record").agg(F.min("ord").alias("ord")).mapInPandas(to_edges, EDGE_SCHEMA)
    return Graph.build(nodes, edges)


def _columns(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.replace("map<string,string>", "map").split(",")]


def clashes(parsed: DataFrame) -> DataFrame:
    """``(id, kept, dropped)``: ids that several files declare, with the file that keeps it and the others."""
    rows = parsed.filter("kind = 'node'").select(F.get_json_object("record", "$.id").alias("id"), "source_file", "file_no")
    g = rows.groupBy("id").agg(F.min_by("source_file", "file_no").alias("kept"), F.collect_set("source_file").alias("all")).filter("size(all) > 1")
    return g.select("id", "kept", F.explode(F.array_except("all", F.array("kept"))).alias("dropped"))


def index_project(spark: SparkSession, root: str | Path, ignore: Callable[[dict, str], bool] | None = None, strict_ids: bool = False) -> Graph:
    return assemble(materialise(parse_project(spark, root, strict_ids), "parsed"), ignore)


def index_project_incremental(spark: SparkSession, root: str | Path, snapshot: str, ignore: Callable[[dict, str], bool] | None = None, strict_ids: bool = False) -> Graph:
    """The same, reading and parsing only files whose content differs from the ``snapshot``, a Parquet folder that is
    then replaced. A snapshot of the other id scheme, or a broken one, is not used."""
    base = Path(root).resolve()
    files = source_files(base)
    order = {f: i for i, f in enumerate(files)}
    path = f"{snapshot}/{'strict' if strict_ids else 'plain'}"
    try:
        old = spark.read.schema(_PARSED).parquet(path)
        known = {r["source_file"]: r["hash"] for r in old.select("source_file", "hash").distinct().collect()}
    except Exception:  # any unreadable snapshot counts as none
        old, known = None, {}
    same = [f for f in files if f in known and known[f] == _digest(base / f)]
    fresh = parse_project(spark, base, strict_ids, [f for f in files if f not in set(same)], order)
    if old is not None and same:
        place = spark.createDataFrame([(f, order[f]) for f in same], "source_file string, file_no long")
        kept = old.drop("file_no").join(place, "source_file").select(*fresh.columns)
        fresh = fresh.unionByName(kept)
    parsed = materialise(fresh, "parsed")
    parsed.write.mode("overwrite").parquet(path)
    return assemble(parsed, ignore)


def _digest(path: Path) -> str | None:
    try:
        return hashlib.sha256(path.read_bytes()).hexdigest()
    except OSError:
        return None
