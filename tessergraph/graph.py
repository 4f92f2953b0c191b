"""The graph: three lazy DataFrames and the operations that only need them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessergraph.session import materialise

FILE_TYPES = tuple("code document paper image rationale concept".split())
NODE_SCHEMA = (
    "id string, label string, type string, file_type string, description string, importance double, source_file string, "
    "source_location string, source_url string, community bigint, is_god boolean, extra map<string,string>, ord bigint"
)
EDGE_SCHEMA = "src string, dst string, relation string, weight double, confidence string, confidence_score double, extra map<string,string>, ord bigint"
HYPEREDGE_SCHEMA = "id string, label string, nodes array<string>, relation string, confidence_score double, ord bigint"
#: Edges that one task sorts.
SORTED = 500_000
_NODE_CORE = "label type file_type description importance source_file source_location source_url".split()
_EDGE_CORE = ["relation", "weight", "confidence", "confidence_score"]


class GraphError(Exception):
    """A graph that cannot be loaded or an argument that makes no sense for it."""


def _merged_extra() -> Column:
    """Extras of all rows of a key in order: later keys replace earlier ones, others stay."""
    rows = F.array_sort(F.collect_list(F.when(F.col("extra").isNotNull(), F.struct("ord", F.map_entries("extra").alias("e")))))
    start = F.create_map().cast("map<string,string>")

    def add(older: Column, row: Column) -> Column:
        newer = F.map_from_entries(row["e"])
        return F.map_concat(F.map_filter(older, lambda k, v: ~F.array_contains(F.map_keys(newer), k)), newer)

    return F.aggregate(rows, start, add)


def merge_nodes(rows: DataFrame) -> DataFrame:
    """One row per id: the last core attributes at the first position. A community once given stays unless replaced, and a
    god flag once given stays."""
    newest = F.max_by(F.struct(*_NODE_CORE), "ord").alias("last")
    return rows.groupBy("id").agg(
        newest,
        F.max_by(F.when(F.col("community").isNotNull(), F.col("community")), F.when(F.col("community").isNotNull(), F.col("ord"))).alias("community"),
        F.coalesce(F.max("is_god"), F.lit(False)).alias("is_god"), _merged_extra().alias("extra"), F.min("ord").alias("ord"),
    ).select("id", *[F.col(f"last.{c}").alias(c) for c in _NODE_CORE], "community", "is_god", "extra", "ord")


def merge_edges(rows: DataFrame) -> DataFrame:
    """One row per (src, dst): the last core attributes at the first position, extras merged."""
    return rows.groupBy("src", "dst").agg(F.max_by(F.struct(*_EDGE_CORE), "ord").alias("last"), _merged_extra().alias("extra"), F.min("ord").alias("ord")).select(
        "src", "dst", *[F.col(f"last.{c}").alias(c) for c in _EDGE_CORE], "extra", "ord"
    )


def tidy_nodes(rows: DataFrame) -> DataFrame:
    """Defaults: an empty label becomes the id, an unknown file type ``concept``, nulls the field's default."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(
        "id",
        F.coalesce(F.nullif("label", F.lit("")), "id").alias("label"),
        text("type").alias("type"),
        F.when(F.col("file_type").isin(*FILE_TYPES), F.col("file_type")).otherwise("concept").alias("file_type"),
        text("description").alias("description"),
        F.coalesce("importance", F.lit(0.0)).alias("importance"),
        "source_file", "source_location", "source_url", "community",
        F.coalesce("is_god", F.lit(False)).alias("is_god"),
        F.coalesce("extra", F.create_map().cast("map<string,string>")).alias("extra"),
        "ord",
    )


def node_text() -> Column:
    """Label, type and description, the empty ones left out."""
    return F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in ("label", "type", "description")])


def source_path() -> Column:
    """The node's file: ``source_file``, else the extra ``file_path``; null without either."""
    other = F.get_json_object(F.concat(F.lit('{"v":'), F.try_element_at("extra", F.lit("file_path")), F.lit("}")), "$.v")
    return F.coalesce(F.nullif("source_file", F.lit("")), F.nullif(other, F.lit("")))


def transition_weight() -> Column:
    return F.greatest("weight", F.lit(0.0)) * F.greatest("confidence_score", F.lit(0.0))


def by_source(lists: DataFrame) -> DataFrame:
    """``lists(src, dsts, w)`` with the rows of a source together, over more tasks than usual, as lists become many rows."""
    return lists.repartition(4 * int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src")


@dataclass(frozen=True)
class Graph:
    """``nodes``, ``edges`` and ``hyperedges`` in the schemas above; ids are unique, edges unique per (src, dst)."""

    nodes: DataFrame
    edges: DataFrame
    hyperedges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @staticmethod
    def build(nodes: DataFrame, edges: DataFrame, hyperedges: DataFrame | None = None, dangling: str = "drop") -> Graph:
        """Merge duplicates, apply defaults and drop edges whose ends are unknown (``dangling="keep"`` skips that)."""
        n = tidy_nodes(merge_nodes(nodes))
        e = edges.filter("src is not null and src <> '' and dst is not null and dst <> ''")
        if dangling == "drop":
            for end in ("src", "dst"):
                e = e.join(n.select(F.col("id").alias(end)), end, "left_semi")
        e = merge_edges(e.select("src", "dst", F.coalesce("relation", F.lit("")).alias("relation"), F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("confidence", F.lit("EXTRACTED")).alias("confidence"), F.coalesce("confidence_score", F.lit(1.0)).alias("confidence_score"), "extra", "ord"))
        h = hyperedges if hyperedges is not None else nodes.sparkSession.createDataFrame([], HYPEREDGE_SCHEMA)
        return Graph(n, e, h)

    @staticmethod
    def from_records(spark: SparkSession, nodes: Iterable[dict], edges: Iterable[dict] = (), hyperedges: Iterable[dict] = ()) -> Graph:
        """From Python dicts with the field names of the schemas (``source``/``target`` also name the ends)."""
        blank = {"importance": 0.0, "is_god": False}
        rows = [tuple({**blank, **n}.get(f) if f != "ord" else i for f in _names(NODE_SCHEMA)) for i, n in enumerate(nodes)]
        links = [tuple({"src": e.get("source"), "dst": e.get("target"), **e}.get(f) if f != "ord" else i for f in _names(EDGE_SCHEMA)) for i, e in enumerate(edges)]
        hyper = [(h["id"], h.get("label", ""), list(h["nodes"]), h.get("relation", ""), float(h.get("confidence_score", 1.0)), i) for i, h in enumerate(hyperedges)]
        return Graph.build(spark.createDataFrame(rows, NODE_SCHEMA), spark.createDataFrame(links, EDGE_SCHEMA), spark.createDataFrame(hyper, HYPEREDGE_SCHEMA))

    def stored(self) -> Graph:
        """The same graph with its tables written to the shared folder, for work that reads them many times."""
        return Graph(materialise(self.nodes, "nodes"), materialise(self.edges, "edges"), materialise(self.hyperedges, "hyperedges"))

    def with_text(self) -> DataFrame:
        return self.nodes.select("id", node_text().alias("text"), "ord")

    def clique_lists(self) -> DataFrame:
        """``(src, dsts, w)``, a row for each known member of a hyperedge with the other known ones; the weight counts all members."""
        h = self.hyperedges.filter(F.size("nodes") >= 2).select("ord", (F.col("confidence_score") / (F.size("nodes") - 1)).alias("w"), F.posexplode("nodes").alias("p", "id"))
        h = h.join(self.nodes.select("id"), "id", "left_semi").groupBy("ord").agg(F.first("w").alias("w"), F.collect_list(F.struct("p", "id")).alias("m"))
        h = h.filter(F.size("m") >= 2).select("w", "m", F.inline("m"))
        return h.select(F.col("id").alias("src"), F.transform(F.filter("m", lambda x: x["p"] != F.col("p")), lambda x: x["id"]).alias("dsts"), "w")

    def clique_edges(self) -> DataFrame:
        """``(src, dst, w)``, both directions of each pair of a hyperedge's known members. Rows of one source are together, and
        come there as lists, so grouping them by (src, dst) shuffles no pairs."""
        return by_source(self.clique_lists()).select("src", F.explode("dsts").alias("dst"), "w")

    def induced(self, keep: DataFrame) -> Graph:
        """The nodes in ``keep(id)``, edges between them, and hyperedges all of whose members are kept."""
        k = keep.select("id").distinct()
        return self._between(k, self.nodes.join(k, "id", "left_semi"))

    def _between(self, k: DataFrame, nodes: DataFrame) -> Graph:
        """``nodes``, whose distinct ids are ``k``, with what lies between them. The edges are counted, so that a task sorts
        ``SORTED`` of them, however many there are."""
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1 + self.edges.count() // SORTED)
        k, e = k.repartition(parts, "id"), self.edges
        for end in ("src", "dst"):
            e = e.repartition(parts, end).join(k.select(F.col("id").alias(end)), end, "left_semi")
        member = self.hyperedges.select("ord", F.explode_outer("nodes").alias("id"))
        lost = member.join(k, "id", "left_anti").filter("id is not null").select("ord")
        return Graph(nodes, e.select(*self.edges.columns), self.hyperedges.join(lost, "ord", "left_anti").select(*self.hyperedges.columns))

    def stats(self) -> DataFrame:
        """One row: nodes, edges, hyperedges, communities, god_nodes."""
        n = self.nodes.agg(F.count("*").alias("nodes"), F.countDistinct("community").alias("communities"), F.count_if("is_god").alias("god_nodes"))
        e, h = self.edges.agg(F.count("*").alias("edges")), self.hyperedges.agg(F.count("*").alias("hyperedges"))
        return n.crossJoin(e).crossJoin(h).select("nodes", "edges", "hyperedges", "communities", "god_nodes")

    def fingerprint(self) -> str:
        """A hash of everything that scores and costs depend on, order apart. Hashing a struct keeps its fields apart and tells
        nulls from empty strings."""
        some = lambda *c: F.xxhash64(F.to_json(F.struct(*c), {"ignoreNullFields": "false"})).alias("x")
        n = self.nodes.select(some("id", "label", "type", "description", "importance", "community", "is_god", source_path().alias("path")))
        e = self.edges.select(some("src", "dst", F.format_number(F.col("weight"), 9).alias("w"), F.format_number(F.col("confidence_score"), 9).alias("c")))
        h = self.hyperedges.select(some("id", F.array_sort("nodes").alias("nodes"), "confidence_score"))
        parts = [df.agg(F.count("*"), F.sum(F.col("x").cast("decimal(38,0)")), F.bit_xor("x")).first() for df in (n, e, h)]
        return hashlib.sha256(repr([tuple(p) for p in parts]).encode()).hexdigest()

    def to_dict(self) -> dict[str, Any]:
        """Plain records in order; for graphs that fit on the driver."""
        value = lambda v: json.loads(v)
        nodes, links = [], []
        for r in self.nodes.orderBy("ord").toLocalIterator():
            d = r.asDict()
            nodes.append({k: v for k, v in d.items() if k not in ("extra", "ord")} | {k: value(v) for k, v in (d["extra"] or {}).items()})
        for r in self.edges.orderBy("ord").toLocalIterator():
            d = r.asDict()
            links.append({"source": d["src"], "target": d["dst"]} | {k: d[k] for k in _EDGE_CORE} | {k: value(v) for k, v in (d["extra"] or {}).items()})
        hyper = [{k: v for k, v in r.asDict().items() if k != "ord"} for r in self.hyperedges.orderBy("ord").toLocalIterator()]
        return dict(nodes=nodes, links=links, hyperedges=hyper)

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, ensure_ascii=False)


def _names(schema: str) -> list[str]:
    return [f.strip().split(" ")[0] for f in schema.replace("map<string,string>", "map").split(",")]
