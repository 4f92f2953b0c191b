"""The log of queries: JSON lines."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

FOLDER, FILE, TOP = ".tessergraph", "audit.jsonl", 10
SCHEMA = "timestamp string, query string, graph string, nodes_selected long, nodes_total long, tokens_used long, tokens_budget long, top_nodes array<string>"


def log_query(query: str, graph: str, stats: dict[str, Any], top_nodes: list[str], folder: str | Path = FOLDER) -> None:
    """Append one record with the first ten top nodes; a log that cannot be written never fails the query."""
    counted = {k: stats.get(k) for k in ("nodes_selected", "nodes_total", "tokens_used", "tokens_budget")}
    record = {"timestamp": datetime.now(UTC).isoformat(), "query": query, "graph": str(graph), **counted, "top_nodes": list(top_nodes[:TOP])}
    try:
        Path(folder).mkdir(parents=True, exist_ok=True)
        with (Path(folder) / FILE).open("a", encoding="utf-8") as out:
            out.write(json.dumps(record, default=str) + "\n")
    except OSError:
        return


def parse_audit(lines: DataFrame, *keep: str) -> DataFrame:
    """The records in ``lines(value)``; blank lines, broken JSON and anything but an object are skipped. The order of
    the lines in a file is not part of the result; ``timestamp`` is."""
    kept = lines.select(F.trim("value").alias("v"), *keep).filter(F.col("v").startswith("{") & F.expr("try_parse_json(v)").isNotNull())
    return kept.select(F.from_json("v", SCHEMA).alias("r"), *keep).select("r.*", *keep)


def read_audit(spark: SparkSession, folder: str | Path = FOLDER) -> DataFrame:
    """All records of a folder's log; none if there is no log."""
    path = Path(folder) / FILE
    if not path.exists():
        return spark.createDataFrame([], SCHEMA)
    return parse_audit(spark.read.text(f"file://{path.absolute()}"))


def last_records(spark: SparkSession, folder: str | Path = FOLDER, n: int = 20) -> list[Row]:
    """The last n records in the order of the file."""
    path = Path(folder) / FILE
    if not path.exists():
        return []
    lines = spark.read.text(f"file://{path.absolute()}").select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return parse_audit(lines, "block", "line").orderBy(F.desc("block"), F.desc("line")).limit(n).drop("block", "line").collect()[::-1]


def top_nodes(records: DataFrame, n: int = 10) -> DataFrame:
    """``(id, count)``: the n nodes that occur most often among ``top_nodes``; ties go to the smaller id."""
    return records.select(F.explode("top_nodes").alias("id")).filter("id is not null").groupBy("id").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "id").limit(n)
