"""Packing documents into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessergraph.llm.bpe import VOCABULARY, count_tokens
from tessergraph.llm.common import save

#: A shard holds about so many windows' worth of tokens and is packed in one task.
SHARD_WINDOWS = 64


def kk_partition(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: k lists of item indices with nearly equal sums.

    Every item starts as a partial partition with one filled part. The two partials with the widest gap between their
    fullest and emptiest parts are merged, the fullest part of one with the emptiest of the other, until one is left.
    Of equal gaps the partial made first goes first.
    """
    if k == 1:
        return [list(range(len(sizes)))]
    # A part is (sum, items); only parts that hold something are stored, fullest first, and the rest are empty.
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        _, _, x = heapq.heappop(heap)
        _, _, y = heapq.heappop(heap)
        if len(x) + len(y) <= k:
            parts = x + y
        else:
            # Fullest of x meets emptiest of y: y's parts, emptiest last, lie against x's from the front.
            parts = x[: k - len(y)] + [(a + b, p + q) for (a, p), (b, q) in zip(x[k - len(y) :], y[::-1][: len(x) + len(y) - k])] + y[: k - len(x)]
        parts.sort(key=lambda t: -t[0])
        low = parts[-1][0] if len(parts) == k else 0
        heapq.heappush(heap, (low - parts[0][0], made, parts))
        made += 1
    return [p for _, p in heap[0][2]] if heap else []


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of item indices with near-equal sums of at most ``capacity``; starts with the fewest that could do and
    adds windows as long as one overflows. No size may exceed the capacity."""
    k = max(1, math.ceil(sum(sizes) / capacity))
    while True:
        windows = [w for w in kk_partition(sizes, k) if w]
        over = max((sum(sizes[i] for i in w) for w in windows), default=0)
        if over <= capacity:
            return windows
        k += max(1, k // 50)


def _pack_shard(capacity: int):
    def run(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["n", "doc_id", "row", "first"], ascending=[False, True, True, True], kind="stable")
        n, ids, first = (pieces[c].tolist() for c in ("n", "doc_id", "first"))
        windows = pack(n, capacity)
        rows = []
        for number, w in enumerate(windows):
            w = sorted(w)
            rows.append((key[0], number, [ids[i] for i in w], [first[i] for i in w], [n[i] for i in w], sum(n[i] for i in w)))
        return pd.DataFrame(rows, columns=["shard", "window", "doc_ids", "first_tokens", "lengths", "n_tokens"])

    return run


def pack_documents(docs: DataFrame, capacity: int = 2048, length: Column | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pack whole documents into windows of at most ``capacity`` tokens.

    Returns one row for each window: ``shard`` and ``window``, which together identify it; ``doc_ids``,
    ``first_tokens`` and ``lengths``, the pieces in it; and ``n_tokens``, their sum. Tokens are those of byte-level BPE with the
    ``vocabulary``, unless ``length`` counts a row's tokens; a null or negative length counts as 0. A document longer than a window is cut: its full
    windows stand alone, with shard -1 and numbered by a hash, and the rest is packed like a document. Each shard,
    rows alike in a hash of their id and place, holds about SHARD_WINDOWS windows' worth of tokens, so tasks do not
    grow with the table, and its windows are nearly equally full.

    Rows with a null id or no token are in no window. Repeated rows are packed each for itself; of equal lengths the
    smaller id goes first. Texts of any length are packed whole. Other columns are ignored. An empty table gives an empty
    result.
    """
    if length is None:
        counted = count_tokens(docs.filter("doc_id is not null"), vocabulary).select("doc_id", F.col("n_tokens").alias("n"))
    else:
        counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), length.cast("long").alias("n"))
    rows = counted.filter("doc_id is not null and n > 0")
    # Equal rows differ in their number among equals only.
    rows = rows.groupBy("doc_id", "n").agg(F.count("*").alias("c")).select("doc_id", "n", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))).alias("row"))
    rows = save(rows, "lengths")
    total = rows.agg(F.sum(F.col("n") % capacity)).first()[0] or 0
    shards = max(1, math.ceil(total / (SHARD_WINDOWS * capacity)))
    whole = rows.filter(F.col("n") >= capacity).select("doc_id", "n", "row", F.explode(F.sequence(F.lit(1).cast("long"), F.expr(f"n div {capacity}"))).alias("k"))
    first = (F.col("k") - 1) * capacity
    alone = whole.select(
        F.lit(-1).alias("shard"), F.xxhash64("doc_id", "n", "row", "k").alias("window"), F.array("doc_id").alias("doc_ids"),
        F.array(first).alias("first_tokens"), F.array(F.lit(capacity).cast("long")).alias("lengths"), F.lit(capacity).cast("long").alias("n_tokens"),
    )
    rest = rows.filter(F.col("n") % capacity > 0).select(
        F.pmod(F.xxhash64("doc_id", "n", "row"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "row", (F.col("n") % capacity).alias("n"), (F.expr(f"n div {capacity}") * capacity).alias("first")
    )
    packed = rest.groupBy("shard").applyInPandas(_pack_shard(capacity), "shard int, window long, doc_ids array<long>, first_tokens array<long>, lengths array<long>, n_tokens long")
    return alone.unionByName(packed)
