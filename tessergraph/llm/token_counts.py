"""Token counts per document without token ids."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessergraph.llm import bpe
from tessergraph.llm.common import id_text

#: Chunks whose counts every executor holds, and documents sampled to choose them; see token_counts.
HEAD, HEAD_SAMPLE = 400_000, 20_000


class _Head(dict):
    """Piece counts of frequent chunks; 0 for others, which it notes."""

    def __init__(self, items):
        super().__init__(items)
        self.rest: list[str] = []

    def __missing__(self, key: str) -> int:
        self.rest.append(key)
        return 0


_HEADS: dict[str, tuple[_Head, dict[str, int]]] = {}


def _heads(key: str, shared) -> tuple[_Head, dict[str, int]]:
    """Counts by chunk without the leading space, and of first chunks, which have none; held by each worker process until
    another table comes."""
    if key not in _HEADS:
        _HEADS.clear()
        items = list(zip(*shared.value))
        _HEADS[key] = _Head((c[1:], n) for c, n in items if c[:1] == " "), {c: n for c, n in items if c[:1] != " "}
    return _HEADS[key]


def _keyed(text: str) -> list[str]:
    """All chunks; a leading space marks all but the first, which has none."""
    first, *rest = bpe.chunks(text)
    return [first, *(" " + c for c in rest)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if text is not None:
                seen.update(_keyed(text))
    yield pa.record_batch({"chunk": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})


def _pieces(raw):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(raw.value)
        for batch in batches:
            counts = [len(enc.plain(c)) // 4 for c in batch.column("chunk").to_pylist()]
            yield pa.record_batch({"chunk": batch.column("chunk"), "pieces": pa.array(counts, pa.int32())})

    return run


_KEY = ["doc_id", "h1", "h2"]


def _frequencies(shared, key: str):
    """Per row: the tokens of its head chunks, as one row without chunk, and the frequencies of its other chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, firsts = _heads(key, shared)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                at, keys, ns = [], [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    if text is None:
                        at.append(i), keys.append(None), ns.append(None)
                        continue
                    first, *rest = bpe.chunks(text)
                    known.rest = []
                    total = sum(map(known.__getitem__, rest))
                    tail = [(" " + c, n) for c, n in Counter(known.rest).items()]
                    if first in firsts:
                        total += firsts[first]
                    else:
                        tail.append((first, 1))
                    at += [i] * (len(tail) + 1)
                    keys += [None, *(c for c, _ in tail)]
                    ns += [total, *(n for _, n in tail)]
                rows = pa.array(at, pa.int64())
                yield pa.record_batch({**{c: batch.column(c).take(rows) for c in _KEY}, "chunk": pa.array(keys, pa.string()), "n": pa.array(ns, pa.int64())})

    return run


def _add_up(raw):
    """Rows of one chunk are next to each other: its pieces are counted once, then multiplied with its frequencies. Rows
    without chunk pass as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(raw.value)
        for batch in batches:
            keys = batch.column("chunk").dictionary_encode()
            per = np.array([len(enc.plain(k)) // 4 for k in keys.dictionary.to_pylist()] + [1], np.int64)
            known = batch.column("chunk").is_valid()
            at = np.asarray(keys.indices.fill_null(len(per) - 1))
            n = pa.array(per[at] * np.asarray(batch.column("n").fill_null(0)), pa.int64(), mask=np.asarray(batch.column("n").is_null()))
            copies = (~np.asarray(known)).astype(np.int64)
            yield pa.record_batch({**{c: batch.column(c) for c in _KEY}, "n": n, "copies": pa.array(copies)})

    return run


def token_counts(docs: DataFrame, vocabulary: str = bpe.VOCABULARY, head: int = HEAD, sample: int = HEAD_SAMPLE) -> DataFrame:
    """``(doc_id, n_tokens)``: how many byte-level BPE tokens each text has, without making ids.

    The pre-tokens are the chunks of :mod:`tessergraph.llm.bpe`. The ``head`` most frequent chunks of about ``sample``
    documents are counted first and broadcast, a bounded table; a text's head chunks are added up in the scan. All its
    other chunks go, as frequencies, to the partition of the chunk, where pieces are counted once for each distinct
    chunk and joined to them. The choice of the head decides only which way a chunk is counted, never the result. Every
    text is split once.

    Row for row: null ids and repeated rows are kept; rows are told apart by their id and 128 bits of hashes of the text. A null
    text has a null count, an empty text 0. Texts of any length are counted whole. Other columns are ignored. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    raw = spark.sparkContext.broadcast(bpe.read_vocabulary(vocabulary))
    docs = id_text(docs)
    total = docs.count()
    some = docs.sample(min(1.0, sample / total), seed=1) if total else docs
    seen = some.mapInArrow(_count_words, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n")).filter("n > 1")
    top = seen.orderBy(F.desc("n"), "chunk").limit(head).select("chunk").mapInArrow(_pieces(raw), "chunk string, pieces int").toPandas()
    table = top["chunk"].tolist(), top["pieces"].tolist()
    shared = spark.sparkContext.broadcast(table)
    key = hashlib.blake2b(repr(table).encode("utf-8", "surrogatepass")).hexdigest()
    text = F.col("text")
    keyed = docs.select("doc_id", *[F.when(text.isNotNull(), F.xxhash64(F.lit(seed), text)).alias(h) for h, seed in (("h1", 1), ("h2", 2))], "text")
    rows = keyed.mapInArrow(_frequencies(shared, key), "doc_id long, h1 long, h2 long, chunk string, n long")
    # Rows without chunk need no company and stay spread as they were read.
    rows = rows.withColumn("place", F.when(F.col("chunk").isNotNull(), F.xxhash64("chunk")).otherwise(F.spark_partition_id()))
    rows = rows.repartition("place").sortWithinPartitions("chunk").drop("place")
    parts = rows.mapInArrow(_add_up(raw), "doc_id long, h1 long, h2 long, n long, copies long")
    sums = parts.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.sum("copies").alias("copies"))
    # Rows alike in id and text were added up together.
    each = F.explode(F.array_repeat(F.expr("n div copies"), F.col("copies").cast("int"))).alias("n_tokens")
    return sums.select("doc_id", each)
