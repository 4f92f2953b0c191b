"""Near-duplicates among embeddings by random-hyperplane signs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessergraph.llm.buckets import FULL, NIBBLES, Alike, compared, document_classes, leaves_of, payloads, routes, task_pairs, task_result
from tessergraph.llm.common import attach, save

#: Signs in the sketch by which members of a bucket are told apart before exact verification.
SIGNS = 256


def bits_needed(vectors: int) -> int:
    """Signs in a bucket's code: one more each time the vectors double, so that about 64 unrelated ones share a bucket at any
    size; their sketches are compared quickly."""
    return max(8, math.ceil(math.log2(max(vectors, 2))) - 6)


def tables_needed(threshold: float, bits: int, recall: float) -> int:
    """Tables after which a pair at the threshold shares a bucket with probability ``recall``: a hyperplane parts it with
    probability angle / pi."""
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-same))) if same < 1 else 1


def alike_signs(threshold: float) -> Alike:
    """Signs of the sketch that agree at least: five standard deviations below the mean of a pair at the threshold."""
    p = 1 - math.acos(threshold) / math.pi
    return Alike("bits", max(0, int(SIGNS * p - 5 * math.sqrt(SIGNS * p * (1 - p)))))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """The vectors at unit length; all are finite and none is zero."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _buckets(dim: int, tables: int, bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).normal(size=(dim, tables * bits))
        place = 1 << np.arange(bits, dtype=np.int64)
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                x = _unit(np.asarray(batch.column("v").flatten()).reshape(-1, dim))
                code = (x @ planes > 0).reshape(len(x), tables, bits).astype(np.int64) @ place
                for t in range(tables):
                    yield pa.record_batch({"bucket": code[:, t] | t << 48, "g": batch.column("g")})

    return run


def _sketches(dim: int, seed: int):
    """SIGNS further signs of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed + 1).normal(size=(dim, SIGNS))
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                signs = np.packbits(_unit(np.asarray(batch.column("v").flatten()).reshape(-1, dim)) @ planes > 0, axis=1).view(np.int64)
                yield pa.record_batch({"g": batch.column("g"), **{c: np.ascontiguousarray(signs[:, i]) for i, c in enumerate(NIBBLES)}})

    return run


def _compare(threshold: float, dim: int, alike: Alike, pairs: bool):
    def run(member: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        keys, left, right = task_pairs(member, alike)
        row = dict(zip(sets["g"], sets["v"]))
        x = _unit(np.stack([np.asarray(row[k]) for k in keys.tolist()])) if len(keys) else np.zeros((0, dim))
        cos = np.zeros(len(left))
        for lo in range(0, len(left), 50_000):
            cos[lo : lo + 50_000] = np.einsum("ij,ij->i", x[left[lo : lo + 50_000]], x[right[lo : lo + 50_000]])
        good = cos >= threshold
        return task_result(member, sets, keys, left[good], right[good], np.minimum(1.0, cos[good]), pairs)

    return run


def _found(vectors: DataFrame, threshold: float, bits: int | None, recall: float, seed: int, pairs: bool) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Records ``(g, doc_id)``, a null g for vectors that cannot be compared; groups ``(g, rep, size)`` of equal vectors; and what
    their comparison gives, see :func:`tessergraph.llm.buckets.compared`."""
    kind = vectors.schema["v"].dataType.simpleString()
    v = F.col("v") if kind == "array<float>" else F.col("v").cast("array<double>")
    rows = vectors.select(F.col("id").cast("long").alias("doc_id"), v.alias("v")).filter("doc_id is not null")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    dim = rows.filter(fine).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    usual = fine & (F.size("v") == (dim["n"] if dim else -1))
    rows = rows.withColumn("g", F.when(F.coalesce(usual, F.lit(False)), F.xxhash64("v")))
    records = save(rows.select("g", "doc_id").distinct(), "records")
    groups = records.filter("g is not null").groupBy("g").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.lit(8 * (dim["n"] if dim else 0)).cast("long").alias("bytes"))
    groups = save(groups, "groups")
    count = groups.count()
    if not count:
        return records, groups.select("g", "rep", "size"), None
    # One vector of each group: that of its representative.
    first = rows.filter("g is not null").groupBy("g").agg(F.first("v").alias("v")) if count < records.count() else rows.filter("g is not null").select("g", "v")
    first = save(first, "vectors")
    bits = bits_needed(count) if bits is None else bits
    member = first.mapInArrow(_buckets(dim["n"], tables_needed(threshold, bits, recall), bits, seed), "bucket long, g long")
    sketches = first.mapInArrow(_sketches(dim["n"], seed), "g long, n0 long, n1 long, n2 long, n3 long")
    leaves, alike = leaves_of(member, sketches, ["g"], FULL), alike_signs(threshold)
    routed = routes(leaves, groups, alike)
    columns = "x long, y long, value double" if pairs else "g long, root long, rep long, n long"
    found = compared(leaves, sketches, ["g"], routed, lambda sets: payloads(sets, first, routed), _compare(threshold, dim["n"], alike, pairs), columns)
    return records, groups.select("g", "rep", "size"), found


def embedding_pairs(vectors: DataFrame, threshold: float = 0.9, bits: int | None = None, recall: float = 0.99, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b, cosine)``, a < b, of class representatives, and the membership ``(id, representative)``.

    A class holds the ids of one vector of ``vectors(id, v)``; its representative is the smallest of them. All pairs of
    classes with a cosine of at least ``threshold`` are returned; see :func:`embedding_near_dedup`.
    """
    records, groups, found = _found(vectors, threshold, bits, recall, seed, True)
    members = records.join(groups.select("g", F.col("rep").alias("representative")), "g").select(F.col("doc_id").alias("id"), "representative")
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "x long, y long, value double")
    return found.select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("value").alias("cosine")), members


def embedding_near_dedup(vectors: DataFrame, threshold: float = 0.9, bits: int | None = None, recall: float = 0.99, seed: int = 11) -> DataFrame:
    """``(vec_id, component, size, links, kept)`` of every embedding in ``vectors(vec_id, embedding)``.

    Each of several tables hashes a vector by the signs of random projections; ``bits`` of them make a bucket, as many as
    the number of vectors asks for unless given. Vectors that share a bucket in any table and agree in enough of another 256
    signs are compared exactly. The number of tables follows from ``recall``, the chance of finding a pair right at the
    threshold. Full buckets are cut into cells, so no task grows with the fullest bucket and no candidate is dropped.

    ``links`` is the number of ids with a cosine of at least ``threshold``; ``component`` is the smallest id that chains of
    links reach, ``size`` the number of ids in the component, and ``kept`` holds for its smallest id. Vectors that cannot be
    compared (null, with a null, NaN or infinite element, without length, or of another size than most) are components of
    their own. Repeated rows count once; an id with several vectors has the links of all. Each id is returned once; a null
    id is left out; an empty table gives an empty result. Other columns are ignored.
    """
    v = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    ids = save(document_classes(*_found(v, threshold, bits, recall, seed, False)), "classes")
    sizes = ids.groupBy("class_id").agg(F.count("*").alias("size"))
    out = attach(ids, sizes, "class_id", ids.count())
    return out.select(F.col("doc_id").alias("vec_id"), F.col("class_id").alias("component"), "size", "links", (F.col("doc_id") == F.col("class_id")).alias("kept"))


ORACLE = """
with recursive e as (select vec_id, embedding::double[] as v from embeddings),
p as materialized (select a.vec_id as a, b.vec_id as b from e a join e b on a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.9),
r(id, other) as (select vec_id, vec_id from e union select r.id, p.b from r join p on p.a = r.other),
c as (select id, min(other) as component, count(*) as size from r group by id), l as (select a, count(*) as links from p group by a)
select id as vec_id, component, size, coalesce(links, 0) as links, id = component as kept from c left join l on a = id
"""
