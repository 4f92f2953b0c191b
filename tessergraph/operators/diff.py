"""What changed between two graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessergraph.graph import Graph
from tessergraph.operators.traverse import k_hop

#: A node counts as modified if one of these differs; importance and community do not count.
SIGNATURE = ["label", "description", "type", "source_location"]


def diff_nodes(old: Graph, new: Graph) -> DataFrame:
    """``(kind, id)`` with the kinds added, removed and modified, by one full outer join."""
    a = old.nodes.select("id", F.struct(*SIGNATURE).alias("was"))
    b = new.nodes.select("id", F.struct(*SIGNATURE).alias("now"))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "modified")
    return a.join(b, "id", "full_outer").select(kind.alias("kind"), "id").filter("kind is not null")


def diff_edges(old: Graph, new: Graph) -> DataFrame:
    """``(kind, src, dst)`` with the kinds added and removed."""
    a = old.edges.select("src", "dst", F.lit(True).alias("was"))
    b = new.edges.select("src", "dst", F.lit(True).alias("now"))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed")
    return a.join(b, ["src", "dst"], "full_outer").select(kind.alias("kind"), "src", "dst").filter("kind is not null")


def diff_graphs(old: Graph, new: Graph) -> DataFrame:
    """``(entity, kind, id, src, dst)`` of all changes."""
    n = diff_nodes(old, new).select(F.lit("node").alias("entity"), "kind", "id", F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"))
    e = diff_edges(old, new).select(F.lit("edge").alias("entity"), "kind", F.lit(None).cast("string").alias("id"), "src", "dst")
    return n.unionByName(e)


def affected_subgraph(diff: DataFrame, new: Graph, hops: int = 2) -> Graph:
    """The part of ``new`` within so many steps of an added or modified node."""
    return new.induced(k_hop(new, diff.filter("entity = 'node' and kind <> 'removed'").select("id"), hops))
