"""Sets that share a bucket: their likely pairs, which buckets belong together, and the pairs of one task.

Rows are ``bucket long, g long, n0..n3 long``: a set's handle in one bucket, and a sketch of 32 bytes. Pairs are formed
in tasks only, never shuffled, so that shuffles grow with the sets and not with their pairs. A result has one row for
each document: its class, and how many links it has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessergraph.llm.common import HOT, attach, save
from tessergraph.llm.components import connected_components

SKETCH = 64
NIBBLES = ["n0", "n1", "n2", "n3"]
MEMBER = "bucket long, g long, n0 long, n1 long, n2 long, n3 long"
#: A cell, the unit of comparison, has about so many sets, and payloads of about so many bytes.
CELL, CELL_BYTES = 2_000, 16 << 20
#: Larger buckets are cut into cells of about so many sets, where their sketches only are compared.
FULL = 4_000
#: So many handles of sets are broadcast at most (about 16 MB) to find their payloads; beyond it the join shuffles both sides.
BROADCAST_ROWS = 1_000_000
#: A broadcast bitmap has 16 bits for each of its handles, in so many words of 64 at most; beyond it more rows pass it in vain.
BITMAP_WORDS = 1 << 20
#: Components that would be cut into more blocks than this are compared bucket by bucket instead.
BLOCKS = 20
U = np.uint64
_BYTE = np.arange(256)
#: How much two sketches agree in a byte, by its XOR.
_AGREE = {"nibbles": ((_BYTE >> 4 == 0).astype(np.uint8) + (_BYTE & 15 == 0)).astype(np.uint8), "bits": np.array([8 - bin(b).count("1") for b in _BYTE], np.uint8)}


@dataclass(frozen=True)
class Alike:
    """Whether sketches agree in ``least`` nibbles or bits or more."""

    unit: str
    least: int

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _AGREE[self.unit][a ^ b].sum(axis=1, dtype=np.uint16) >= self.least


def nibbles(mixed: np.ndarray) -> np.ndarray:
    """(rows, 4) int64 from (rows, 64) well-mixed hashes."""
    x = ((mixed >> U(7)) & U(15)).astype(np.uint8)
    return np.ascontiguousarray(x[:, ::2] << 4 | x[:, 1::2]).view(np.int64)


def alike_nibbles(threshold: float) -> Alike:
    """Nibbles that agree at least: four standard deviations below the mean of a pair at the threshold. Unequal hashes
    agree in a nibble by chance once in 16."""
    p = threshold + (1 - threshold) / 16
    return Alike("nibbles", max(1, int(SKETCH * p - 4 * math.sqrt(SKETCH * p * (1 - p)))))


def likely(bucket: np.ndarray, side: np.ndarray, sketch: np.ndarray, alike: Alike) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of equal bucket, in rows sorted by bucket, with alike sketches. Where rows have a ``side`` other than 0, only
    those of different sides make pairs."""
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    end = np.repeat(np.concatenate([start[1:], [len(bucket)]]), np.diff(np.concatenate([start, [len(bucket)]])))
    later = end - np.arange(len(bucket)) - 1
    upto, split = np.cumsum(later), bool(side.any())
    lo = 0
    while lo < len(bucket):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + 400_000, "right")))
        n = later[lo:hi]
        a = np.repeat(np.arange(lo, hi), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        if split:
            across = (side[a] == 0) | (side[a] != side[b])
            a, b = a[across], b[across]
        same = alike(sketch[a], sketch[b])
        yield a[same], b[same]
        lo = hi


def forest(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each node's root: the smallest node that the edges connect it with."""
    root = np.arange(nodes)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def sketch_bytes(batch) -> np.ndarray:
    return np.ascontiguousarray(np.stack([np.asarray(batch[c]) for c in NIBBLES], axis=1)).view(np.uint8)


def cells(rows: DataFrame, limit: int) -> DataFrame:
    """``MEMBER`` and ``side`` from ``MEMBER`` and the bucket's number of rows ``n``: a bucket of more than ``limit`` rows is cut
    into blocks, and each two blocks, or one with itself, make a cell in its place, so that each two rows meet in one."""
    small = rows.filter(F.col("n") <= limit).select("bucket", "g", *NIBBLES, F.lit(0).cast("byte").alias("side"))
    cut = _paired(rows.filter(F.col("n") > limit), F.ceil(F.col("n") * 2 / limit).cast("int"))
    return small.unionByName(cut.select(F.xxhash64("bucket", "_lo", "_hi").alias("bucket"), "g", *NIBBLES, "side"))


def sifted(rows: DataFrame, mine: str, handles: DataFrame, count: int) -> DataFrame:
    """``rows`` whose long ``mine`` is among the ``count`` longs of ``handles``, the column ``handle``, and a few others: those that
    a broadcast bitmap can't tell from them. What it drops has no partner, so that it needn't be shuffled to be joined."""
    words = min(BITMAP_WORDS, 1 << (count // 4).bit_length())
    place = lambda c: F.pmod(F.xxhash64(c, F.lit(5)), F.lit(64 * words)).alias("_place")
    bits = handles.select(place("handle")).select(F.expr("_place >> 6").alias("_word"), F.expr("1L << cast(_place & 63 as int)").alias("_bit"))
    bits = F.broadcast(bits.groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    placed = rows.select("*", place(mine)).join(bits, F.expr("_place >> 6 = _word"))
    return placed.filter("(_bits >> cast(_place & 63 as int)) & 1 = 1").select(*rows.columns)


def leaves_of(member: DataFrame, sketches: DataFrame, keys: list[str], limit: int, lone: bool = False) -> DataFrame:
    """:func:`cells` of the buckets of ``member(bucket, *keys)`` that have several rows, with the sketches ``(*keys, n0..n3)``. Only
    the handles of the other buckets' rows are shuffled; if they are the most, as ``lone`` says, they are sifted out before.
    Full buckets get their counts by broadcast."""
    counts = save(member.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "counts")
    if lone:
        member = sifted(member, "bucket", counts.select(F.col("bucket").alias("handle")), counts.count())
    hot = counts.filter(F.col("n") > HOT)  # at most one for every HOT rows
    if hot.isEmpty():
        rows = member.join(counts, "bucket")
    else:
        cold = member.join(F.broadcast(hot.select("bucket")), "bucket", "left_anti").join(counts, "bucket")
        rows = cold.unionByName(member.join(F.broadcast(hot), "bucket"))
    return save(cells(rows.join(sketches, keys).select("bucket", "g", *NIBBLES, "n"), limit), "leaves")


def _paired(rows: DataFrame, blocks) -> DataFrame:
    """Each row once for every pair of blocks ``(_lo, _hi)`` that has its own, with the ``side`` it is on there."""
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("g", F.lit(77)), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    side = F.when(F.col("_own") == F.col("_other"), 0).when(F.col("_own") < F.col("_other"), 1).otherwise(2)
    return rows.withColumn("_lo", F.least("_own", "_other")).withColumn("_hi", F.greatest("_own", "_other")).withColumn("side", side.cast("byte"))


def _spanning(alike: Alike):
    """Spanning edges (a, b) of each bucket's likely pairs; the input is sorted by bucket, a bucket may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _ended(batches):
            if batch is None:
                table, held = held, None
            else:
                table = pa.Table.from_batches(([*held.to_batches()] if held is not None else []) + [batch])
                bucket = np.asarray(table["bucket"])
                cut = int(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[-1])
                held, table = table.slice(cut), table.slice(0, cut)
            if table is None or not table.num_rows:
                continue
            bucket, g = np.asarray(table["bucket"]), np.asarray(table["g"])
            for a, b in likely(bucket, np.asarray(table["side"]), sketch_bytes(table), alike):
                rows, both = np.unique(np.concatenate([a, b]), return_inverse=True)
                root = forest(len(rows), both[: len(a)], both[len(a) :])
                far = root != np.arange(len(rows))
                yield pa.record_batch({"a": g[rows[far]], "b": g[rows[root[far]]]})

    return run


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from (b for b in batches if b.num_rows)
    yield None


def routes(leaves: DataFrame, groups: DataFrame, alike: Alike) -> DataFrame:
    """``(g, rep, size, bytes, component, blocks, huge)`` of every set of ``groups(g, rep, size, bytes)`` that has a likely pair: the
    component of likely pairs that it is in, and into how many blocks that is cut."""
    edges = leaves.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_spanning(alike), "a long, b long")
    parts = connected_components(edges).select(F.col("node").alias("g"), "component")
    parts = save(parts.join(groups.select("g", "rep", "size", "bytes"), "g"), "components")
    sizes = parts.groupBy("component").agg(F.count("*").alias("m"), F.sum("bytes").alias("b"))
    need = F.ceil(F.greatest(F.col("m") / CELL, F.col("b") / CELL_BYTES) * 2).cast("int")
    sizes = sizes.select("component", F.when((F.col("m") <= CELL) & (F.col("b") <= CELL_BYTES), 1).otherwise(need).alias("blocks"))
    return save(attach(parts, sizes, "component", parts.count()).withColumn("huge", F.col("blocks") > BLOCKS), "routes")


def payloads(sets: DataFrame, table: DataFrame, routed: DataFrame) -> DataFrame:
    """``sets`` with the columns of ``table`` for their ``g``."""
    few = routed.count() <= BROADCAST_ROWS
    return sets.join(table.join(F.broadcast(routed.select("g")), "g", "left_semi") if few else table, "g")


def _tasks(cost) -> int:
    return max(1, math.ceil(max(cost["m"] / CELL, cost["b"] / CELL_BYTES)))


def compared(leaves: DataFrame, sketches: DataFrame, keys: list[str], routed: DataFrame, payload, compare, columns: str = "g long, root long, rep long, n long") -> DataFrame | None:
    """The union of ``compare`` over all tasks, each with the sketches of some cells and the payloads of their sets.

    ``payload(sets)`` gives ``(block, g, rep, size, buckets, ...)`` for ``sets(block, g, rep, size, buckets)``. A component stays whole
    as a cell or is cut into blocks, each two of which make one, and all sketches ``(*keys, n0..n3)`` of a cell are compared;
    tasks take cells of about CELL sets and CELL_BYTES in all. Huge components are compared bucket by bucket instead; there
    ``buckets`` lists all buckets of the set, by which a pair that meets in several tasks is counted in one of them only.
    """
    found = None
    for huge in (False, True):
        route = routed.filter("huge" if huge else "not huge")
        copies = F.lit(1) if huge else F.col("blocks")
        cost = route.agg(F.sum(copies).alias("m"), F.sum(F.col("bytes") * copies).alias("b")).first()
        if not cost["m"]:
            continue
        if huge:
            rows = leaves.join(route.select("g", "rep", "size", "bytes"), "g")
            total = rows.agg(F.count("*").alias("m"), F.sum("bytes").alias("b")).first()
            block = F.pmod(F.xxhash64("bucket"), F.lit(_tasks(total))).cast("int")
            rows = rows.select(block.alias("block"), "bucket", "g", "rep", "size", *NIBBLES, F.lit(0).cast("byte").alias("side"))
            lists = rows.groupBy("g").agg(F.array_sort(F.collect_set("bucket")).alias("buckets"))
            sets = rows.select("block", "g", "rep", "size").distinct().join(lists, "g")
        else:
            place = _paired(route, F.col("blocks")).withColumn("cell", F.xxhash64("component", "_lo", "_hi"))
            place = place.select("g", "rep", "size", F.pmod("cell", F.lit(_tasks(cost))).cast("int").alias("block"), "cell", "side")
            rows = payloads(place.select("g", "block", "cell", "side"), sketches, routed).withColumn("bucket", F.xxhash64("cell", *keys[1:]))
            sets = place.select("block", "g", "rep", "size", F.lit(None).cast("array<long>").alias("buckets"))
        rows = rows.select("block", "bucket", "g", *NIBBLES, "side")
        # Both tables are cogrouped, so the second must not carry the first one's attributes.
        sets = sets.select(*[F.col(c).alias(c) for c in ("block", "g", "rep", "size", "buckets")])
        part = rows.groupBy("block").cogroup(payload(sets).groupBy("block")).applyInPandas(compare, columns)
        found = part if found is None else found.unionByName(part)
    return found


def task_pairs(member: pd.DataFrame, alike: Alike) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Handles, and each likely pair of them once, as indices."""
    member = member.sort_values("bucket", kind="stable")
    keys, node = np.unique(member["g"].to_numpy(), return_inverse=True)
    seen = [np.zeros(0, np.int64)]
    for a, b in likely(member["bucket"].to_numpy(), member["side"].to_numpy(), sketch_bytes(member), alike):
        x, y = node[a], node[b]
        seen.append(np.unique((np.minimum(x, y) * len(keys) + np.maximum(x, y))[x != y]))
        if len(seen) > 32:
            seen = [np.unique(np.concatenate(seen))]
    left, right = np.divmod(np.unique(np.concatenate(seen)), max(1, len(keys)))
    return keys, left, right


def task_result(member: pd.DataFrame, sets: pd.DataFrame, keys: np.ndarray, left: np.ndarray, right: np.ndarray, value: np.ndarray, pairs: bool) -> pd.DataFrame:
    """``(g, root, rep, n)`` of each set in a verified pair: the documents of the sets that it is paired with, and the
    representative of its part of the task's pairs; or, as ``pairs``, ``(x, y, value)`` of representatives."""
    row = dict(zip(sets["g"], zip(sets["rep"], sets["size"], sets["buckets"])))
    info = [row[k] for k in keys.tolist()]
    if info and info[0][2] is not None:
        here = set(member["bucket"].tolist())
        lists = [frozenset(x[2].tolist()) for x in info]
        own = np.array([min(lists[a] & lists[b]) in here for a, b in zip(left.tolist(), right.tolist())], bool)
        left, right, value = left[own], right[own], value[own]
    rep, size = np.array([x[0] for x in info], np.int64), np.array([x[1] for x in info], np.int64)
    if pairs:
        return pd.DataFrame({"x": np.minimum(rep[left], rep[right]), "y": np.maximum(rep[left], rep[right]), "value": value})
    n = np.bincount(left, size[right], len(keys)) + np.bincount(right, size[left], len(keys))
    root, some = forest(len(keys), left, right), n > 0
    return pd.DataFrame({"g": keys, "root": rep[root], "rep": rep, "n": n.astype(np.int64)})[some]


def document_classes(records: DataFrame, groups: DataFrame, found: DataFrame | None) -> DataFrame:
    """``(doc_id, class_id, links)`` of every document of ``records(g, doc_id)``.

    ``groups(g, rep, size)`` has the smallest document of each set and how many there are, ``found`` the result of
    :func:`compared`. ``class_id`` is the smallest document that chains of links reach; a link is a pair of records of
    different documents, or of one with several texts, whose sets are paired or the same. Records without a set have
    no link.
    """
    inside, total = records.filter("g is not null"), records.count()
    several = save(inside.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select("doc_id"), "several")
    links = groups.select("g", "rep", (F.col("size") - 1).alias("own"))
    edges = inside.join(several, "doc_id", "left_semi").join(groups.select("g", "rep"), "g").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    if found is not None:
        found = save(found, "found")
        edges = edges.unionByName(found.filter("root <> rep").select(F.col("root").alias("a"), F.col("rep").alias("b")))
        links = links.join(found.groupBy("g").agg(F.sum("n").alias("n")), "g", "left").select("g", "rep", (F.col("own") + F.coalesce("n", F.lit(0))).alias("own"))
    parts = connected_components(edges).select(F.col("node").alias("rep"), "component")
    values = links.join(parts, "rep", "left").filter("own > 0 or component is not null").select("g", F.coalesce("component", "rep").alias("class_id"), F.col("own").alias("links"))
    hit = attach(inside, values, "g", total, "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    rest = records.filter("g is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return hit.unionByName(rest).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"))
