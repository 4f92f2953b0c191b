"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessergraph.llm.common import HOT, attach, drop, save


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges(a, b)`` with the smallest node it can reach: ``(node, component)``.

    Ids are longs. Edges with a null end and loops are ignored; repeated and reversed edges count once; an empty
    input gives an empty output. Each round is two grouped minima and two equi-joins, and its result is written to
    the shared folder, so the number of rounds never lengthens the lineage. Rounds grow with the logarithm of the
    component's size. The hub of a large component is joined by broadcast (:func:`attach`). Raises if
    ``max_rounds`` pass without a fixpoint.
    """
    e = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))
    e = e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = save(e, "edges"), None
    total = e.count()
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = attach(both, low, "u", 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        large = save(large, "edges") if total > HOT else large
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = attach(large, low, "u", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = save(small, "edges")
        drop(e)
        e = after
        state = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, total = state, state[0]
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
