"""Leaving nodes out by patterns in the gitignore dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessergraph.graph import Graph


def pattern_regex(line: str) -> tuple[str, bool] | None:
    """A regular expression for one pattern line and whether it is negated; None for comments and blank lines. It is
    valid in Python and Java alike and matches from the start of a path to the end of one of its parts."""
    line = line.rstrip("\r\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    line = line[1:] if line.startswith(("\\#", "\\!")) else line
    only_dir = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = "" if anchored else "(?:.*/)?", 0
    while i < len(line):
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.+", i + 3
        elif line[i] == "*":
            while line[i : i + 1] == "*":
                i += 1
            out += "[^/]*"
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and (end := line.find("]", i + 2)) > 0:
            inner = line[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out, i = out + "[" + ("^/" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        else:
            i += line[i] == "\\" and i + 1 < len(line)
            out, i = out + re.sub(r"([^A-Za-z0-9_])", r"\\\1", line[i]), i + 1
    return f"^{out}" + ("/.*$" if only_dir else "(?:/.*)?$"), negated


@dataclass(frozen=True)
class Ignore:
    """Compiled patterns; the last that matches a path decides."""

    rules: tuple[tuple[str, bool], ...]

    @staticmethod
    def from_lines(lines: list[str]) -> Ignore:
        return Ignore(tuple(r for r in map(pattern_regex, lines) if r))

    @staticmethod
    def load(path: str | Path) -> Ignore | None:
        """From a file; None if there is none."""
        p = Path(path)
        return Ignore.from_lines(p.read_text(encoding="utf-8").splitlines()) if p.exists() else None

    def matches(self, path: str) -> bool:
        path = path.replace("\\", "/")
        path = path[2:] if path.startswith("./") else path.lstrip("/")
        hit = False
        for regex, negated in self.rules:
            if re.search(regex, path):
                hit = not negated
        return hit

    def column(self, path: Column) -> Column:
        """The same as a Spark expression, false for null."""
        clean = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:\./|/+)", "")
        hit = reduce(lambda acc, r: F.when(clean.rlike(r[0]), not r[1]).otherwise(acc), self.rules, F.lit(False))
        return F.coalesce(path.isNotNull() & hit, F.lit(False))

    def should_ignore(self, node: dict, node_id: str) -> bool:
        """Whether a node's id or source file matches."""
        return self.matches(node_id) or bool(node.get("source_file")) and self.matches(str(node["source_file"]))


def _hit(ignore: Ignore) -> Column:
    return ignore.column(F.col("id")) | ((F.coalesce("source_file", F.lit("")) != "") & ignore.column(F.col("source_file")))


def ignored(graph: Graph, ignore: Ignore) -> DataFrame:
    """The nodes whose id or source file a pattern matches."""
    return graph.nodes.filter(_hit(ignore))


def apply_ignore(graph: Graph, ignore: Ignore | None) -> Graph:
    """The graph induced by the nodes whose id and source file no pattern matches. Ids are unique, so the nodes need no join."""
    if ignore is None:
        return graph
    kept = graph.nodes.filter(~_hit(ignore))
    return graph._between(kept.select("id"), kept)
