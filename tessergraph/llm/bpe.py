"""Byte-level BPE encoding with a hierarchical-bitmap rank queue, and decoding."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessergraph.llm.common import id_text
from tessergraph.llm.hashing import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens of byte-level BPE: contractions, letters, digits, other marks, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ADJACENT = re.compile(r"\s\s")
#: At least what _ADJACENT finds, for RE2.
_MAY_ADJOIN = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]{2}"
_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


class Cache(dict):
    """A mapping that computes what it lacks and holds at most twice ``limit`` entries: when full, everything not used
    since the last time it was full goes. Keys longer than LONGEST are computed each time, so its bytes are bounded too."""

    LONGEST = 200

    def __init__(self, compute, limit: int):
        super().__init__()
        self._compute, self._limit, self._old = compute, limit, {}

    def __missing__(self, key):
        value = self._old.pop(key, None)
        if value is None:
            value = self._compute(key)
            if len(key) > self.LONGEST:
                return value
        if len(self) >= self._limit:
            self._old = dict(self)
            self.clear()
        self[key] = value
        return value


class RankQueue:
    """Merges one pre-token.

    Every adjacent pair that may merge sits in the bucket of its merge rank, as the position of its left part in a
    linked list of tokens. A bitmap of two levels of 256-bit words marks buckets with entries; find-first-set on each
    level gives the lowest rank, and a heap its leftmost position. Entries whose pair changed since are skipped when
    they come up. A merge costs a constant number of word operations at any length, so a pre-token of n bytes takes
    O(n log n) at worst.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        missing = [i for i in range(256) if bytes([i]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.byte = [ranks[bytes([i])] for i in range(256)]
        self.pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left = ranks.get(token[:cut])
                if left is not None and (right := ranks.get(token[cut:])) is not None:
                    self.pairs[left << 24 | right] = rank
        self.low = [0] * ((max(ranks.values()) >> 8) + 1)

    def merge(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, low, get = len(piece), self.low, self.pairs.get
        tokens = [self.byte[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets: dict[int, list[int]] = {}
        top = 0
        for i in range(n - 1):
            r = get(tokens[i] << 24 | tokens[i + 1])
            if r is not None:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    low[r >> 8] |= 1 << (r & 255)
                    top |= 1 << (r >> 8)
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            first = bits & -bits
            rank = (word << 8) + first.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = buckets.pop(rank)[0]
                low[word] = bits ^ first
                if bits == first:
                    top ^= 1 << word
            j = after[i]
            if tokens[i] < 0 or j >= n or get(tokens[i] << 24 | tokens[j]) != rank:
                continue
            tokens[i], tokens[j] = rank, -1
            k = after[i] = after[j]
            h = before[i]
            if k < n:
                before[k] = i
                r = get(rank << 24 | tokens[k])
                if r is not None:
                    if r in buckets:
                        heappush(buckets[r], i)
                    else:
                        buckets[r] = [i]
                        low[r >> 8] |= 1 << (r & 255)
                        top |= 1 << (r >> 8)
            if h >= 0:
                r = get(tokens[h] << 24 | rank)
                if r is not None:
                    if r in buckets:
                        heappush(buckets[r], h)
                    else:
                        buckets[r] = [h]
                        low[r >> 8] |= 1 << (r & 255)
                        top |= 1 << (r >> 8)
        return [t for t in tokens if t >= 0]


class Encoder:
    """Encodes texts, keeping the ids of frequent chunks.

    A chunk is a run that starts at a single space between two other characters. The pre-token pattern never matches
    across such a space, so chunks can be encoded apart.
    """

    def __init__(self, ranks: dict[bytes, int], limit: int = 400_000):
        self.queue = RankQueue(ranks)
        self.split = regex.compile(PATTERN).findall
        self.pieces = Cache(lambda p: array("i", self.queue.merge(p.encode("utf-8", "surrogatepass"))).tobytes(), limit)
        self.chunks = Cache(self._chunk, limit)
    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return self.pieces[" " + chunk]
        return self.plain(" " + chunk)

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> bytes:
        """Ids as bytes of int32."""
        first, *rest = chunks(text)
        return self.plain(first) + b"".join(map(self.chunks.__getitem__, rest))


def chunks(text: str) -> list[str]:
    """The first chunk, then all others without their leading space."""
    return _BOUNDARY.split(text) if _ADJACENT.search(text) else text.split(" ")


class Counter:
    """Counts the ids that :class:`Encoder` gives, without them; a library's merging, compiled and by the same ranks, is enough
    for that."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 400_000):
        encode = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.plain = lambda text: len(encode(text))
        self.sizes = Cache(lambda c: len(encode(" " + c)), limit)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text, 0 for null. Chunks are cut and made distinct as Arrow arrays, and each distinct one
        is looked up once."""
        texts = pc.fill_null(texts, "")
        other = np.asarray(pc.match_substring_regex(texts, _MAY_ADJOIN))
        out = np.zeros(len(texts), np.int64)
        for i in np.flatnonzero(other).tolist():
            first, *rest = chunks(texts[i].as_py())
            out[i] = self.plain(first) + sum(map(self.sizes.__getitem__, rest))
        plain = np.flatnonzero(~other)
        if len(plain):
            parts = pc.split_pattern(texts.take(pa.array(plain)), " ")
            offsets, found = np.asarray(parts.offsets), parts.values.dictionary_encode()
            each = np.array([self.sizes[c] for c in found.dictionary.to_pylist()], np.int64)[np.asarray(found.indices)]
            total = np.concatenate([[0], np.cumsum(each)])
            # The first chunk has no leading space.
            firsts = found.indices.take(pa.array(offsets[:-1]))
            own = np.array([self.plain(c) for c in found.dictionary.take(firsts).to_pylist()], np.int64)
            out[plain] = total[offsets[1:]] - total[offsets[:-1] + 1] + own
        return out


_HERE: dict[tuple, Encoder | Counter] = {}


def encoder(raw: bytes, make: type = Encoder):
    """One encoder, or counter, per worker process and vocabulary."""
    key = (make, len(raw), hash(raw))
    if key not in _HERE:
        _HERE.clear()
        _HERE[key] = make(parse_ranks(raw))
    return _HERE[key]


def read_vocabulary(path: str) -> bytes:
    return Path(path).read_bytes()


def bpe_encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens, ids)``: the byte-level BPE token ids of every text; no shuffle.

    ``vocabulary`` is a file of base64 tokens and ranks on the driver; executors get its content by broadcast. Null
    ids and repeated rows are kept, row for row. A null text has null ``ids`` and ``n_tokens``, an empty text an empty
    list. Texts of any length are encoded whole. Other columns are ignored. An empty table gives an empty result.
    """
    raw = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                texts = batch.column("text")
                encoded = [None if t is None else enc.encode(t) for t in texts.to_pylist()]
                sizes = np.array([len(e) // 4 if e is not None else 0 for e in encoded])
                null = pa.array([e is None for e in encoded])
                values = np.frombuffer(b"".join(e for e in encoded if e), np.int32)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                ids = pa.ListArray.from_arrays(offsets, pa.array(values), mask=null) if len(encoded) else pa.array([], pa.list_(pa.int32()))
                yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(sizes, pa.int64(), mask=np.array(null)), "ids": ids})

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens)`` as of :func:`bpe_encode`, without ids and without a shuffle: each worker process counts on its own and
    remembers frequent chunks."""
    raw = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value, Counter)
        for batch in batches:
            for start, texts in slices(batch.column("text"), 4 << 20):
                counts = pa.array(enc.counts(texts), pa.int64(), mask=np.asarray(texts.is_null()))
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(start, len(texts)), "n_tokens": counts})

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long")


def bpe_decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``: the inverse of :func:`bpe_encode`, row for row.

    Null ``ids`` give a null text, an empty list an empty text. Bytes that are not UTF-8, which only cut id lists
    have, become U+FFFD. An id outside the vocabulary is an error, a null id in a list too.
    """
    raw = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {i: t for t, i in parse_ranks(raw.value).items()}
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                texts = [None if x is None else b"".join(map(token.__getitem__, x)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
                yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def bpe_round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens, ids, lossless)``: encodes every text and decodes the ids again in the same pass;
    ``lossless`` tells whether that gave the text, and is null for a null text. Otherwise as :func:`bpe_encode`."""
    raw = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        token = [b""] * (max(enc.queue.ranks.values()) + 1)
        for t, i in enc.queue.ranks.items():
            token[i] = t
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                encoded, same = [], []
                for t in batch.column("text").to_pylist():
                    e = None if t is None else enc.encode(t)
                    encoded.append(e)
                    same.append(None if e is None else b"".join(map(token.__getitem__, np.frombuffer(e, np.int32).tolist())) == t.encode("utf-8", "surrogatepass"))
                sizes = np.array([len(e) // 4 if e is not None else 0 for e in encoded])
                null = np.array([e is None for e in encoded])
                values = np.frombuffer(b"".join(e for e in encoded if e), np.int32)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values), mask=pa.array(null))
                yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(sizes, pa.int64(), mask=null), "ids": ids, "lossless": pa.array(same, pa.bool_())})

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, lossless boolean")
