"""Vectorised word, n-gram and MinHash hashing over Arrow string buffers; no per-word Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P, _B1 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _POWERS[base] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def _segments(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of each values[start:end]; it depends on the content only, not on the position."""
    power, inverse = _powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * inverse[starts]


def slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Cut a column into runs of whole texts of about ``limit`` bytes (one text may exceed it); bounds memory."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    total, start = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, texts.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(texts):
        yield start, texts.slice(start)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased, white-space separated words of all texts, and each text's bounds among them."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    low = pa.concat_arrays([low]) if low.offset else low
    kind = np.int64 if pa.types.is_large_string(low.type) else np.int32
    offsets = np.frombuffer(low.buffers()[1], kind)[low.offset : low.offset + len(low) + 1].astype(np.int64)
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    h = _segments(data.astype(U) + U(1), starts, ends, _P)
    return mix(h + (ends - starts).astype(U)), np.searchsorted(starts, offsets)


def sequence_ids(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text's word sequence."""
    return mix(_segments(mix(h ^ U(1)), bounds[:-1], bounds[1:], _B1) + (bounds[1:] - bounds[:-1]).astype(U))


def ngrams(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hashes (repeats kept) and each text's bounds; a text of 1 to n-1 words has one short gram."""
    counts = bounds[1:] - bounds[:-1]
    made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out = np.concatenate([[0], np.cumsum(made)])
    at = np.repeat(bounds[:-1] - out[:-1], made) + np.arange(out[-1])
    last = np.repeat(bounds[1:], made)
    g = np.zeros(len(at), dtype=U)
    padded = np.concatenate([h, np.zeros(n, dtype=U)])
    for k in range(n):
        g = g * U(_B1) + np.where(at + k < last, padded[at + k], U(0))
    return mix(g), out


def seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(_P) + U(salt))


def minhash(values: np.ndarray, bounds: np.ndarray, perms: int, salt: int = 7) -> np.ndarray:
    """(texts, perms) 32-bit MinHash; rows of texts without values are all ones."""
    out = np.full((len(bounds) - 1, perms), 0xFFFFFFFF, dtype=np.uint32)
    filled = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(filled):
        x, at, s = (values >> U(32)).astype(np.uint32), bounds[:-1][filled], seeds(perms, salt)
        flip, factor = (s >> U(32)).astype(np.uint32), s.astype(np.uint32) | np.uint32(1)
        for k in range(perms):
            out[filled, k] = np.minimum.reduceat((x ^ flip[k]) * factor[k], at)
    return out
