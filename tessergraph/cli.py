"""The command line: ``python -m tessergraph.cli "question" -b 4000``, or a command first."""

from __future__ import annotations

import argparse
import difflib
import json
import os
import sys
import tempfile
import webbrowser
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessergraph.engine import Engine
from tessergraph.graph import Graph, GraphError
from tessergraph.operators.diff import affected_subgraph, diff_graphs
from tessergraph.operators.evaluation import run_benchmark, summarise
from tessergraph.operators.ignore import Ignore, apply_ignore
from tessergraph.operators.scoring import score_nodes
from tessergraph.operators.selection import Selection, select_subgraph
from tessergraph.plans import render
from tessergraph.server import VERSION, serve
from tessergraph.sources.audit import last_records, log_query, read_audit, top_nodes
from tessergraph.sources.project import index_project, index_project_incremental
from tessergraph.sources.readers import find_graph, load_graph
from tessergraph.sources.writers import convert_graph, write_json

COMMANDS = ("index", "serve", "stats", "explain", "path", "diff", "export", "audit", "benchmark", "init", "convert")
IGNORE_FILE, SIDECAR = ".tessergraphignore", ".tessergraph"
IGNORE_TEXT = "# gitignore syntax; matched with node ids and source files\n*/tests/*\n*/__pycache__/*\n*.test.ts\n*.spec.ts\n"


def _positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessergraph", description="The most relevant part of a knowledge graph within a token budget.")
    p.add_argument("--version", action="version", version=f"tessergraph {VERSION}")
    sub = p.add_subparsers(dest="command")
    make = {name: sub.add_parser(name) for name in ("query", *COMMANDS)}
    for name in ("query", "serve", "stats", "explain", "path", "export", "benchmark", "convert"):
        make[name].add_argument("--graph", "-g")
    for name in ("query", "export"):
        make[name].add_argument("query")
        make[name].add_argument("--budget", "-b", type=_positive, default=4000)
    q = make["query"]
    q.add_argument("--format", "-f", choices=["markdown", "json", "yaml"], default="markdown")
    q.add_argument("--model", "-m", default="estimate")
    q.add_argument("--min-score", type=float, default=0.05)
    q.add_argument("--redundancy-weight", type=float, default=0.3)
    q.add_argument("--connectivity-bonus", type=float, default=0.2)
    q.add_argument("--project-root")
    q.add_argument("--strategy", choices=["greedy", "exact"], default="greedy")
    q.add_argument("--backend", choices="bm25 local openai voyage".split(), default="bm25")
    q.add_argument("--ignore-file", default=IGNORE_FILE)
    for flag in ("explain", "inject-code", "connected", "no-cache", "no-audit", "viz"):
        q.add_argument(f"--{flag}", action="store_true")
    make["export"].add_argument("--format", "-f", choices=["claude", "chatgpt", "claudemd"], default="claude")
    make["export"].add_argument("--output", "-o")
    make["explain"].add_argument("node")
    make["path"].add_argument("source")
    make["path"].add_argument("target")
    make["index"].add_argument("root", nargs="?", default=".")
    make["index"].add_argument("--output", "-o")
    make["index"].add_argument("--incremental", action="store_true")
    make["index"].add_argument("--strict-ids", action="store_true")
    d = make["diff"]
    d.add_argument("old")
    d.add_argument("new")
    d.add_argument("--hops", type=int, default=2)
    d.add_argument("--budget", "-b", type=_positive)
    d.add_argument("--viz", action="store_true")
    make["audit"].add_argument("--top-nodes", type=int, default=10)
    make["audit"].add_argument("--audit-dir")
    b = make["benchmark"]
    b.add_argument("--query", "-q", action="append", required=True)
    b.add_argument("--budget", "-b", action="append", type=_positive)
    b.add_argument("--k-relevant", type=int, default=10)
    b.add_argument("--output", "-o")
    make["convert"].add_argument("output")
    make["convert"].add_argument("--to", choices=["graphml", "neo4j"], required=True)
    return p


def routed(args: list[str]) -> list[str]:
    """A first word that is no command is a query, unless it looks like a mistyped command."""
    if not args or args[0].startswith("-") or args[0] in (*COMMANDS, "query"):
        return args
    near = difflib.get_close_matches(args[0], COMMANDS, n=1, cutoff=0.8) if " " not in args[0] else []
    if near:
        raise GraphError(f"no command {args[0]!r}; did you mean {near[0]!r}?")
    return ["query", *args]


def _load(spark: SparkSession, path: str | None) -> tuple[str, Graph]:
    path = path or find_graph()
    if path is None:
        raise GraphError("no graph found; name one with --graph")
    return path, load_graph(spark, path)


def _show(html: str) -> None:
    fd, name = tempfile.mkstemp(suffix=".html")
    with os.fdopen(fd, "w", encoding="utf-8") as out:
        out.write(html)
    webbrowser.open(f"file://{name}")


def _query(spark: SparkSession, a: argparse.Namespace) -> None:
    if not a.query.strip():
        raise GraphError("the query is empty")
    path, graph = _load(spark, a.graph)
    home = Path(path).parent
    engine = Engine(apply_ignore(graph, Ignore.load(a.ignore_file)), None if a.no_cache else f"file://{(home / SIDECAR).absolute()}")
    root = (a.project_root or home) if a.inject_code else None
    answer = engine.ask(a.query, a.budget, a.backend, a.model, root, min_score=a.min_score, redundancy=a.redundancy_weight, connectivity=a.connectivity_bonus, strategy=a.strategy, connected=a.connected)
    print(render.format_subgraph(answer.selection, a.format, answer.scores, a.query))
    if not answer.selection.stats["nodes_selected"] and a.format == "markdown":
        print(f"No node scores {a.min_score} or more; try other words or a lower --min-score.", file=sys.stderr)
    if not a.no_audit:
        best = answer.selection.chosen.join(answer.scores, "id").join(graph.nodes.select("id", "ord"), "id").orderBy(F.desc("score"), "ord").limit(10)
        log_query(a.query, path, answer.selection.stats, [r["id"] for r in best.collect()], home / SIDECAR)
    if a.explain and a.format == "markdown":
        print(render.explain_scores(answer.selection.graph, answer.detailed.join(answer.selection.chosen.select("id"), "id", "left_semi"), answer.selection.stats["nodes_selected"], a.backend != "bm25"))
    if a.viz:
        _show(render.build_html(answer.selection, answer.scores, a.query))


def _diff(spark: SparkSession, a: argparse.Namespace) -> None:
    old, new = load_graph(spark, a.old), load_graph(spark, a.new)
    changes = diff_graphs(old, new)
    print(render.format_diff(changes, new))
    if a.budget is None and not a.viz:
        return
    near = affected_subgraph(changes, new, a.hops)
    if a.budget is not None and not near.nodes.isEmpty():
        first = changes.filter("entity = 'node' and kind <> 'removed'").join(new.nodes.select("id", "label"), "id").orderBy("kind", "id").limit(5)
        words = " ".join(r["label"] for r in first.collect()) or "diff"
        scores = score_nodes(near, words)
        print("\n## Affected part within the budget\n")
        print(render.format_subgraph(select_subgraph(near, scores, a.budget), query=words))
    if a.viz:
        chosen = near.nodes.select("id")
        stats = dict(nodes_selected=chosen.count(), nodes_total=new.nodes.count(), tokens_used=0, tokens_budget=0, coverage_pct=0.0)
        _show(render.build_html(Selection(near, chosen, stats), query="diff"))


def _audit(spark: SparkSession, a: argparse.Namespace) -> None:
    found = find_graph()
    folder = a.audit_dir or (Path(found).parent / SIDECAR if found else SIDECAR)
    log, last = read_audit(spark, folder), last_records(spark, folder)
    if not last:
        print("No audit entries found.")
        return
    for i, r in enumerate(last, 1):
        print(i, (r["timestamp"] or "")[:19], r["query"], r["nodes_selected"], r["tokens_used"], sep="  ")
    print(f"\nTop {a.top_nodes} nodes")
    for i, r in enumerate(top_nodes(log, a.top_nodes).collect(), 1):
        print(i, r["id"], r["count"], sep="  ")


def run(spark: SparkSession, args: list[str]) -> int:
    """Exit code 0, or 1 after a message on standard error."""
    try:
        words = routed(args)
        a = parser().parse_args(words)
        match a.command:
            case None:
                parser().print_help()
            case "query":
                _query(spark, a)
            case "diff":
                _diff(spark, a)
            case "audit":
                _audit(spark, a)
            case "init":
                if Path(IGNORE_FILE).exists():
                    print(f"{IGNORE_FILE} exists and stays as it is.")
                else:
                    Path(IGNORE_FILE).write_text(IGNORE_TEXT, encoding="utf-8")
                    print(f"Created {IGNORE_FILE}")
            case "index":
                root = Path(a.root)
                out = Path(a.output or root / SIDECAR / "graph.json")
                snapshot = f"file://{(out.parent / 'snapshot').absolute()}"
                graph = index_project_incremental(spark, root, snapshot, strict_ids=a.strict_ids) if a.incremental else index_project(spark, root, strict_ids=a.strict_ids)
                write_json(graph, out)
                r = graph.stats().first()
                print(f"Indexed {graph.nodes.select('source_file').distinct().count()} files: {r['nodes']} nodes, {r['edges']} edges -> {out}")
            case _:
                path, graph = _load(spark, a.graph)
                _on_graph(spark, a, path, graph)
    except (GraphError, KeyError, ImportError, ValueError) as e:
        print(f"Error: {f'node {e.args[0]!r} not found' if isinstance(e, KeyError) else e}", file=sys.stderr)
        return 1
    return 0


def _on_graph(spark: SparkSession, a: argparse.Namespace, path: str, graph: Graph) -> None:
    if a.command == "convert":
        print(*convert_graph(graph, a.output, a.to), sep="\n")
        return
    engine = Engine(graph, f"file://{(Path(path).parent / SIDECAR).absolute()}")
    match a.command:
        case "serve":
            serve(engine)
        case "stats":
            print(engine.stats())
        case "explain":
            print(engine.summary(a.node))
        case "path":
            print(engine.path(a.source, a.target))
        case "export":
            answer = engine.ask(a.query, a.budget)
            text = render.export_context(answer.selection, a.query, a.format, answer.scores)
            if a.output:
                Path(a.output).write_text(text, encoding="utf-8")
            else:
                print(text)
        case "benchmark":
            rows = run_benchmark(graph, a.query, a.budget or (2000, 4000, 8000), a.k_relevant, artifacts=engine.artifacts)
            print(render.format_benchmark(rows))
            if a.output:
                data = {"rows": [r.asDict() for r in rows.collect()], **summarise(rows).first().asDict()}
                Path(a.output).write_text(json.dumps(data, indent=2), encoding="utf-8")


def main() -> None:
    spark = SparkSession.builder.appName("tessergraph").getOrCreate()
    sys.exit(run(spark, sys.argv[1:]))


if __name__ == "__main__":
    main()
