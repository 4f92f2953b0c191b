"""One graph, ready for queries: what the command line and the server share."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessergraph.functions.text import bpe_tokens, estimated_tokens
from tessergraph.graph import Graph
from tessergraph.operators.scoring import Artifacts, score_nodes_detailed
from tessergraph.operators.selection import Selection, select_subgraph, token_costs
from tessergraph.operators.traverse import neighbours, shortest_path
from tessergraph.session import materialise
from tessergraph.sources.artifacts import load_or_build
from tessergraph.sources.code import code_blocks, inject_code


@dataclass(frozen=True)
class Answer:
    selection: Selection
    scores: DataFrame
    detailed: DataFrame


def counter(model: str):
    """A tiktoken encoding or model by name; ``estimate`` needs no vocabulary."""
    return estimated_tokens if model == "estimate" else bpe_tokens(model)


class Engine:
    """A graph with its artifacts."""

    def __init__(self, graph: Graph, folder: str | None = None, max_iter: int = 100):
        self.graph, self.max_iter = graph, max_iter
        self.artifacts: Artifacts = load_or_build(graph, folder, max_iter)

    def ask(self, query: str, budget: int = 4000, backend: str = "bm25", model: str = "estimate", code_root: str | Path | None = None, semantic: DataFrame | None = None, **options) -> Answer:
        """Score, select and, with ``code_root``, add source text, whose tokens count against the budget."""
        detailed = materialise(score_nodes_detailed(self.graph, query, backend, self.artifacts, semantic=semantic, max_iter=self.max_iter), "detailed")
        scores = detailed.select("id", F.col("final").alias("score"))
        count = counter(model)
        costs = self.artifacts.costs if model == "estimate" else token_costs(self.graph, count)
        if code_root is not None:
            costs = with_code(costs, code_blocks(self.graph, code_root), count)
        selection = select_subgraph(self.graph, scores, budget, costs=costs, **options)
        if code_root is not None:
            selection = Selection(inject_code(selection.graph, code_root, max_nodes=selection.stats["nodes_selected"]), selection.chosen, selection.stats)
        return Answer(selection, scores, detailed)

    def explain(self, node: str) -> str:
        """A node and its neighbours as Markdown; KeyError if there is no such node."""
        row = self.graph.nodes.filter(F.col("id") == node).first()
        if row is None:
            raise KeyError(node)
        out = [f"# {row['label']} ({row['type']})" if row["type"] else f"# {row['label']}", "", f"- id: {node}"]
        out += [f"- community: {row['community']}"] if row["community"] is not None else []
        out += ["- god node: yes"] if row["is_god"] else []
        out += ["", row["description"]] if row["description"] else []
        out += ["", f"-> File: {row['source_file']}"] if row["source_file"] else []
        found = neighbours(self.graph, node).orderBy("id").collect()
        for title, way in (("Predecessors", "in"), ("Successors", "out")):
            out += ["", f"## {title}"]
            lines = []
            for r in (r for r in found if r["direction"] == way):
                arrow = f"-[{r['relation']}]->" if r["relation"] else "->"
                other = f"{r['label']} ({r['id']})"
                lines.append(f"- {other} {arrow} {row['label']}" if way == "in" else f"- {row['label']} {arrow} {other}")
            out += lines or ["- (none)"]
        return "\n".join(out) + "\n"

    def summary(self, node: str) -> str:
        """The same in short, as the command line shows it, neighbours in the order of the edges; KeyError if there is no such node."""
        row = self.graph.nodes.filter(F.col("id") == node).first()
        if row is None:
            raise KeyError(node)
        out = [f"# {row['label']}  ({row['type'] or row['file_type'] or 'node'})"]
        out += [row["description"]] if row["description"] else []
        out += [f"→ {row['source_file']} {row['source_location'] or ''}".rstrip()] if row["source_file"] else []
        found = neighbours(self.graph, node).orderBy("ord").collect()
        for title, way in (("Used by", "in"), ("Depends on", "out")):
            near = [r for r in found if r["direction"] == way]
            out += [f"\n## {title}"] if near else []
            out += [(f"- {r['label']} → {r['relation']}" if way == "in" else f"- {r['relation']} → {r['label']}").strip() for r in near]
        return "\n".join(out) + "\n"

    def path(self, source: str, target: str) -> str:
        """A shortest path as text; KeyError for unknown ids."""
        found = shortest_path(self.graph, source, target)
        if found is None:
            return f"No path between {source!r} and {target!r}.\n"
        ids, directed = found
        labels = {r["id"]: r["label"] for r in self.graph.nodes.filter(F.col("id").isin(ids)).select("id", "label").collect()}
        return f"Shortest {'directed' if directed else 'undirected'} path ({len(ids) - 1} hop(s)):\n\n" + " -> ".join(f"{labels[i]} ({i})" for i in ids) + "\n"

    def stats(self) -> str:
        r = self.graph.stats().first().asDict()
        return "# Graph stats\n\n" + "".join(f"- {k.replace('_', ' ')}: {v}\n" for k, v in r.items() if k != "god_nodes") + f"- god nodes: {r['god_nodes']}\n"


def with_code(costs: DataFrame, codes: DataFrame, count) -> DataFrame:
    """Costs plus the tokens of each node's source text."""
    more: Column = F.coalesce(count(F.col("code")), F.lit(0))
    return costs.join(codes, "id", "left").select("id", (F.col("cost") + more).cast("int").alias("cost"))
