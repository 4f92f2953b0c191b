"""What queries on one graph share, kept in a folder named by the graph's fingerprint."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessergraph.graph import Graph
from tessergraph.operators.lexical import BM25Index
from tessergraph.operators.scoring import Artifacts
from tessergraph.operators.selection import token_costs

VERSION = 3


def artifacts_path(graph: Graph, folder: str, max_iter: int = 100) -> str:
    """By what the artifacts depend on: the graph, and how far ranks are iterated."""
    return f"{folder}/{graph.fingerprint()}-{max_iter}-v{VERSION}"


def save_artifacts(artifacts: Artifacts, path: str) -> None:
    artifacts.index.save(f"{path}/index")
    for name in ("links", "global_rank", "costs"):
        if (df := getattr(artifacts, name)) is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_artifacts(spark: SparkSession, path: str) -> Artifacts | None:
    """None if anything is missing or cannot be read."""
    try:
        index = BM25Index.load(spark, f"{path}/index")
        return Artifacts(index, *(spark.read.parquet(f"{path}/{t}") for t in ("links", "global_rank", "costs")))
    except Exception:  # a broken or partial folder counts as none and is built again
        return None


def load_or_build(graph: Graph, folder: str | None = None, max_iter: int = 100) -> Artifacts:
    """From ``folder`` if the same graph was seen before, else built and, where possible, stored there. A changed
    graph has another fingerprint, so nothing stale is ever read."""
    path = artifacts_path(graph, folder, max_iter) if folder else None
    found = read_artifacts(graph.spark, path) if path else None
    if found is not None:
        return found
    built = Artifacts.build(graph, max_iter)
    built = Artifacts(built.index, built.links, built.global_rank, token_costs(graph))
    if path:
        try:
            save_artifacts(built, path)
        except Exception:  # a read-only folder must not fail the query
            return built
        return read_artifacts(graph.spark, path) or built
    return built
