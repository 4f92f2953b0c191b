"""N-gram Jaccard self-join by chosen paths.

Every text becomes the set of its word n-grams, sketched by MinHash. A run starts with all sets in one bucket and
splits recursively: a set goes to a child bucket for each of its sketch tokens that a path-seeded hash samples, on
average 1/threshold of them, so two similar sets tend to share a child. Buckets of at most ``brute`` sets are compared
pair by pair. One run finds a pair at the threshold with a probability that the theory of branching processes gives;
runs are repeated until the target recall holds for such a pair at the depth limit.

Families of thousands of copies have millions of pairs, so pairs are never shuffled. Buckets first yield only a
spanning forest of their likely pairs; its connected components say which buckets belong together. All buckets of a
component then meet in one task, or in one for each two blocks of a large one, with one copy of each text, where pairs
are formed, made distinct, verified and counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessergraph.llm import hashing as H
from tessergraph.llm.buckets import FULL, MEMBER, NIBBLES, SKETCH, alike_nibbles, cells, compared, document_classes, nibbles, routes, task_pairs, task_result
from tessergraph.llm.common import id_text, save, unused

#: So many ids of documents to verify are broadcast at most (about 30 MB); beyond it the join shuffles both sides.
BROADCAST_ROWS = 1_000_000
U = np.uint64


def runs_needed(recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold is found with probability ``recall``, if its buckets split ``depth`` times.

    The common tokens sampled in one split are Poisson with mean 1, so the chance q of having lost the pair after d
    splits obeys q(d) = exp(q(d-1) - 1), q(0) = 0.
    """
    lost = 0.0
    for _ in range(depth):
        lost = math.exp(lost - 1)
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def depth_needed(sets: int) -> int:
    """Splits until a token's bucket is small: more as the corpus grows, each for a factor of 64."""
    return max(3, math.ceil(math.log(max(sets, 2)) / math.log(64)))


def _scan(n: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in H.slices(batch.column("text")):
                h, bounds = H.words(texts)
                g = H.sequence_ids(h, bounds).view(np.int64)
                sig = H.minhash(*H.ngrams(h, bounds, n), SKETCH)
                none = bounds[1:] == bounds[:-1]
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(start, len(texts)),
                        "g": pa.array(g, mask=none),
                        "bytes": pa.array(np.diff(bounds), pa.int64()),
                        "sketch": pa.array([None if x else r.tobytes() for x, r in zip(none.tolist(), sig)], pa.binary()),
                    }
                )

    return scan


def _split(rate: float, runs: int | None):
    """Children of each row: at the root for every run, else below the row's own bucket. The run stays in the top bits."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = U(min(0xFFFFFFFF, int(rate * 2**32)))
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                mixed = _mixed(batch)
                packed = nibbles(mixed)
                g = np.asarray(batch.column("g"))
                if runs is None:
                    parents = [np.asarray(batch.column("bucket")).view(U)]
                else:
                    parents = [np.full(batch.num_rows, r, U) << U(56) for r in range(runs)]
                for parent in parents:
                    drawn = H.mix(mixed ^ H.mix(parent + U(0xABCD))[:, None])
                    rows, cols = np.nonzero((drawn >> U(32)) < limit)
                    child = (parent[rows] & (U(0xFF) << U(56))) | (H.mix(drawn[rows, cols] + U(1)) >> U(8))
                    yield pa.record_batch({"bucket": child.view(np.int64), "g": g[rows], **{c: np.ascontiguousarray(packed[rows, k]) for k, c in enumerate(NIBBLES)}})

    return split


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sketches that members of a bucket are told apart by."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 4096):
            batch = whole.slice(lo, 4096)
            packed = nibbles(_mixed(batch))
            yield pa.record_batch({"g": batch.column("g"), **{c: np.ascontiguousarray(packed[:, k]) for k, c in enumerate(NIBBLES)}})


def _mixed(batch: pa.RecordBatch) -> np.ndarray:
    """The tokens of each sketch, told apart by their place."""
    tokens = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, SKETCH)
    return H.mix(tokens.astype(U) ^ H.seeds(SKETCH, 3)[None, :])


def _leaves(sketches: DataFrame, threshold: float, runs: int, depth: int, brute: int) -> DataFrame:
    """``MEMBER`` and ``side``: the sets to compare in each final bucket. Buckets still too large at the depth limit are cut into
    cells, so that each two of their sets meet in one cell."""
    rate = 1 / (threshold * SKETCH)
    member = sketches.mapInArrow(_split(rate, runs), MEMBER)
    out = None
    for level in range(1, depth + 1):
        counts = member.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
        member = member.join(counts, "bucket")
        if level == depth:
            here = cells(member, FULL)
            return save(here if out is None else out.unionByName(here), "leaves")
        member = save(member, "members")
        here = member.filter(F.col("n") <= brute).drop("n").withColumn("side", F.lit(0).cast("byte"))
        out = here if out is None else out.unionByName(here)
        large = member.filter(F.col("n") > brute).select("bucket", "g")
        if large.isEmpty():
            return out
        member = large.join(sketches, "g").mapInArrow(_split(rate, None), MEMBER)
    return out


def _verify(n: int, threshold: float, alike, pairs: bool):
    def verify(member: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        sets: dict[int, np.ndarray] = {}
        texts = texts.drop_duplicates(["g", "text"])
        for _, part in H.slices(pa.array(texts["text"], pa.string())):
            h, bounds = H.words(part)
            grams, at = H.ngrams(h, bounds, n)
            for i, key in enumerate(H.sequence_ids(h, bounds).view(np.int64).tolist()):
                if key not in sets:
                    sets[key] = np.unique(grams[at[i] : at[i + 1]])
        keys, left, right = task_pairs(member, alike)
        arrays, js = [sets[k] for k in keys.tolist()], np.zeros(len(left))
        for at, (i, k) in enumerate(zip(left.tolist(), right.tolist())):
            x, y = arrays[i], arrays[k]
            if len(x) > len(y):
                x, y = y, x
            if len(x) >= threshold * len(y):
                common = int(np.count_nonzero(y.take(np.searchsorted(y, x), mode="clip") == x))
                js[at] = common / (len(x) + len(y) - common)
        good = js >= threshold
        return task_result(member, texts, keys, left[good], right[good], js[good], pairs)

    return verify


def _found(docs: DataFrame, n: int, threshold: float, recall: float, depth: int | None, brute: int, pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Records ``(g, doc_id)``, a null g for texts without words; groups ``(g, rep, size)`` of documents of one word sequence; and
    what their comparison gives, see :func:`tessergraph.llm.buckets.compared`."""
    docs = id_text(docs).filter("doc_id is not null")
    scanned = save(docs.mapInArrow(_scan(n), "doc_id long, g long, bytes long, sketch binary"), "sketches")
    records = save(scanned.select("g", "doc_id").distinct(), "records")
    sizes = records.filter("g is not null").groupBy("g").agg(F.count("*").alias("size"))
    # The payload of a word is some 8 bytes of text and as many of a hash.
    groups = scanned.filter("g is not null").groupBy("g").agg(F.min("doc_id").alias("rep"), F.max(F.col("bytes") * 16).alias("bytes"), F.first("sketch").alias("sketch"))
    groups = save(groups.join(sizes, "g"), "groups")
    depth = depth_needed(groups.count()) if depth is None else depth
    leaves = _leaves(groups.select("g", "sketch"), threshold, runs_needed(recall, depth), depth, brute)
    alike = alike_nibbles(threshold)
    routed = routes(leaves, groups, alike)
    count = routed.count()

    def texts(sets: DataFrame) -> DataFrame:
        needed = routed.select("rep").distinct()
        some = docs.join(F.broadcast(needed) if count <= BROADCAST_ROWS else needed, docs.doc_id == F.col("rep"), "left_semi")
        return sets.join(some, sets.rep == some.doc_id).select("block", "g", "rep", "size", "buckets", "text")

    columns = "x long, y long, value double" if pairs else "g long, root long, rep long, n long"
    return records, groups.select("g", "rep", "size"), compared(leaves, groups.select("g", "sketch").mapInArrow(_packed, "g long, n0 long, n1 long, n2 long, n3 long"), ["g"], routed, texts, _verify(n, threshold, alike, pairs), columns)


def ngram_jaccard_pairs(docs: DataFrame, n: int = 3, threshold: float = 0.5, recall: float = 0.99, depth: int | None = None, brute: int = 256) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(doc_a, doc_b, jaccard)`` of class representatives, and the membership ``(doc_id, representative)``.

    A class holds the documents of one word sequence; its representative is the smallest of them. All pairs of classes whose
    sets of word n-grams have a Jaccard similarity of ``threshold`` or more are returned, each with doc_a < doc_b. An id
    with several texts is in a class for each. Otherwise as :func:`ngram_jaccard_join`.
    """
    records, groups, found = _found(docs, n, threshold, recall, depth, brute, True)
    members = records.join(groups.select("g", F.col("rep").alias("representative")), "g").select("doc_id", "representative")
    if found is None:
        found = docs.sparkSession.createDataFrame([], "x long, y long, value double")
    return found.select(F.col("x").alias("doc_a"), F.col("y").alias("doc_b"), F.col("value").alias("jaccard")), members


def ngram_jaccard_join(docs: DataFrame, n: int = 3, threshold: float = 0.5, recall: float = 0.99, depth: int | None = None, brute: int = 256) -> DataFrame:
    """``(doc_id, class_id, links)``: one row for each document of the self-join of documents whose sets of word n-grams have a
    Jaccard similarity of ``threshold`` or more.

    ``links`` is the number of documents that a document is joined with, ``class_id`` the smallest id that chains of
    joined documents reach, its own without any. Words are the lower-cased runs between ASCII white space.
    Similarities are exact, on 64-bit n-gram hashes; each pair at the threshold is found with probability ``recall`` or
    more. Documents with equal word sequences are joined once as one set and counted at the end, so copies cost nothing,
    and none is dropped. ``depth`` follows from the number of sets unless given.

    A null id has no row. A null text and one without a word have no link. A text of fewer than n words has one gram, the
    whole text; texts of any length are read whole. Repeated rows count once; an id with several texts has the links of
    all of them, those among its own texts included. Other columns are ignored. An empty table gives an empty result.
    """
    return document_classes(*_found(docs, n, threshold, recall, depth, brute, False))


def drop_near_duplicates(docs: DataFrame, n: int = 3, threshold: float = 0.5, recall: float = 0.99, depth: int | None = None, brute: int = 256) -> DataFrame:
    """Keep, of each class of :func:`ngram_jaccard_join`, the rows with the smallest id.

    Rows with a null id, and ids whose texts are all null or without a word, are kept; exact repeats of a row are reduced to one. Texts of any length are read whole. All columns of ``docs`` are
    returned, whatever their names. An empty table gives an empty result.
    """
    key = unused(docs, "key")
    found = ngram_jaccard_join(docs, n, threshold, recall, depth, brute)
    gone = found.filter("doc_id <> class_id").select(F.col("doc_id").alias(key))
    kept = docs.join(gone, docs["doc_id"].cast("long") == F.col(key), "left_anti")
    # Exact repeats share their id; only ids that occur more than once need comparing.
    again = save(id_text(docs).filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias(key)), "again")
    if again.isEmpty():
        return kept
    match = docs["doc_id"].cast("long") == F.col(key)
    return kept.join(again, match, "left_anti").unionByName(kept.join(again, match, "left_semi").dropDuplicates())
