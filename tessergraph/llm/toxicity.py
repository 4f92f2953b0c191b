"""Toxicity by subword-bag embeddings averaged into a linear softmax."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessergraph.llm.bpe import Cache
from tessergraph.llm.common import id_text, unused

BUCKETS, DIM, WINDOW, EPOCHS, RATE = 1 << 20, 6, 2, 40, 0.03
#: How sharply the highest window of a text is favoured in the last epoch; the scale of the fit's start; and how many standard
#: errors a bucket's log-odds must lie from 0 to start elsewhere.
SHARPEST, START, CHANCE = 16.0, 4.0, 1.0
#: Buckets in fewer training texts stay at zero, and the penalty on embeddings: both keep chance words from being learnt.
MIN_TEXTS, DECAY = 4, 2e-5
#: Labelled documents of either class that the model is fitted on, at most.
SAMPLE = 1500
_CUT = re.compile(r"[\W_]+")


def subwords(word: str) -> list[int]:
    """Buckets of a word and of the 3-, 5- and 7-grams of its UTF-8 bytes between marks of its ends; the long ones tell
    stems of accented letters, of two bytes each, apart."""
    w = f"<{word}>".encode("utf-8", "surrogatepass")
    n, mask = len(w), BUCKETS - 1
    out = [crc32(w) & mask]
    out += [crc32(w[i : i + 3]) & mask for i in range(n - 2)]
    out += [crc32(w[i : i + 5]) & mask for i in range(n - 4)]
    return out + [crc32(w[i : i + 7]) & mask for i in range(n - 6)]


def clean(token: str) -> str:
    """A token's letters and digits: marks around and inside it are dropped."""
    return token if token.isalnum() else _CUT.sub("", token)


def words(text: str, cleaned=clean) -> list[str]:
    """The lower-case words of a text; one right after itself counts once, so repetition makes no evidence."""
    found = [w for w in map(cleaned, text.lower().split()) if w]
    return [w for w, before in zip(found, ["", *found]) if w != before]


def window_starts(n: int) -> np.ndarray:
    """Windows of WINDOW words, each half a window after the one before, the last one ending with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, max(1, WINDOW // 2)), n - WINDOW)


@dataclass
class Model:
    """Two classes need the difference of the two softmax rows only; with it each bucket's embedding reduces to one
    number, so a window's log-odds are the bias plus the mean of its words' means."""

    weight: dict[int, float]
    bias: float
    threshold: float

    def word(self, w: str) -> float:
        found = subwords(w)
        return sum([self.weight.get(b, 0.0) for b in found]) / len(found)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """The buckets with a weight, and the bias, the threshold and the weights."""
        return np.fromiter(self.weight, np.int32, len(self.weight)), np.array([self.bias, self.threshold, *self.weight.values()])


def _sums(values: np.ndarray, index: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Row i is the sum of values[index[j]] over all j with at[j] = i; by columns and parts, to keep memory low."""
    out = np.zeros((size, values.shape[1]))
    for k in range(values.shape[1]):
        column = np.ascontiguousarray(values[:, k])
        for lo in range(0, len(at), 1 << 21):
            out[:, k] += np.bincount(at[lo : lo + (1 << 21)], column[index[lo : lo + (1 << 21)]], size)
    return out


def train(texts: list[str], toxic: list[int], epochs: int = EPOCHS, seed: int = 0) -> Model:
    """Fit embeddings and softmax jointly by Adam on the windows of the texts, classes weighted alike. A text's label is that
    of its most toxic window: at first all windows share its gradient, then more and more those that score highest.
    The threshold is set on a fifth of the texts, held out from the fit, midway through the best cut between the
    classes. Without both classes the model rejects nothing.
    """
    y = np.array(toxic)
    if len(set(toxic)) < 2:
        return Model({}, -1.0, float("inf"))
    held = np.array([crc32(t.encode("utf-8", "surrogatepass")) % 5 == 0 for t in texts])
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(texts), bool)
    model = _fit([t for t, h in zip(texts, held) if not h], y[~held], epochs, seed)
    judged = held if held.any() else ~held
    scores = np.array([score(model.word, model.bias, t) for t, h in zip(texts, judged) if h])
    order = np.argsort(scores)
    s, good = scores[order], y[judged][order] == 0
    # Rejecting a clean text costs five times as much as keeping a toxic one.
    cost = np.concatenate([[0], np.cumsum(~good)]) + 5 * (good.sum() - np.concatenate([[0], np.cumsum(good)]))
    best = np.flatnonzero(cost == cost.min())[-1]
    lo, hi = (s[best - 1] if best else s[0] - 1), (s[best] if best < len(s) else s[-1] + 1)
    return Model(model.weight, model.bias, float((lo + hi) / 2))


def _fit(texts: list[str], y: np.ndarray, epochs: int, seed: int) -> Model:
    """All is linear up to the softmax, so windows need the two logits of their words only, as differences of running sums."""
    number: dict[str, int] = {}
    flat, bounds, label = array("i"), [0], []
    for text, toxic in zip(texts, y):
        flat.extend([number.setdefault(w, len(number)) for w in words(text)])
        if len(flat) > bounds[-1]:
            bounds.append(len(flat))
            label.append(int(toxic))
    if len(set(label)) < 2:
        return Model({}, -1.0, float("inf"))
    word, label, parts = np.frombuffer(flat, np.int32), np.array(label), [window_starts(hi - lo) + lo for lo, hi in zip(bounds, bounds[1:])]
    first = np.cumsum([0, *map(len, parts[:-1])])
    lo, text_of = np.concatenate(parts), np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    hi = np.minimum(lo + WINDOW, np.array(bounds[1:])[text_of])
    flat, per = array("i"), []
    for w in number:
        found = subwords(w)
        flat.extend(found)
        per.append(len(found))
    del number, parts
    per = np.array(per)
    sub = np.frombuffer(flat, np.int32)
    ends, seen = np.cumsum(per), np.zeros((2, BUCKETS))
    for start, end, toxic in zip(bounds, bounds[1:], label):
        ids = np.unique(word[start:end])
        at = np.repeat(ends[ids] - np.cumsum(per[ids]), per[ids]) + np.arange(per[ids].sum())
        seen[toxic, np.unique(sub[at])] += 1
    learnt = np.flatnonzero(seen.sum(axis=0) >= MIN_TEXTS)
    # Where the fit starts: how much more often a bucket is in toxic texts than chance explains, as log-odds.
    of = np.array([(label == 0).sum(), (label == 1).sum()])[:, None]
    ratio, noise = np.diff(np.log((seen + 1) / (of + 2)), axis=0)[0, learnt], np.sqrt((1 / (seen + 1)).sum(axis=0))[learnt]
    ratio = np.sign(ratio) * np.maximum(0, np.abs(ratio) - CHANCE * noise)
    del seen
    # Buckets that are not learnt stay at zero.
    place = np.full(BUCKETS, -1, np.int32)
    place[learnt] = np.arange(len(learnt))
    owner, sub = np.repeat(np.arange(len(per), dtype=np.int32), per), place[sub]
    owner, sub = owner[sub >= 0], sub[sub >= 0]
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.01, (len(learnt), DIM))
    out, bias = rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    emb[:, 0], out[0] = ratio, (-START, START)
    weight = np.where(label == 1, 0.5 / (label == 1).sum(), 0.5 / (label == 0).sum())
    params = [emb, out, bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    target = np.eye(2)[label]
    for step in range(1, epochs + 1):
        vec = _sums(emb, sub, owner, len(per)) / per[:, None]
        z = _windows((vec @ out)[word], lo, hi) / WINDOW + bias
        odds = z[:, 1] - z[:, 0]
        # The share of each window in its text: almost equal at first, then by its odds.
        share = np.exp(SHARPEST * step / epochs * (odds - np.maximum.reduceat(odds, first)[text_of]))
        share /= np.add.reduceat(share, first)[text_of]
        z = np.add.reduceat(z * share[:, None], first)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        error = ((z / z.sum(axis=1, keepdims=True) - target) * weight[:, None])[text_of] * share[:, None]
        # The error at each place in the texts is that of all windows over it; a word has that of all its places.
        change = np.stack([np.bincount(lo, error[:, k], len(word) + 1) - np.bincount(hi, error[:, k], len(word) + 1) for k in (0, 1)], axis=1)
        places = np.cumsum(change, axis=0)[:-1]
        back = np.stack([np.bincount(word, places[:, k], len(per)) for k in (0, 1)], axis=1) / WINDOW
        grads = [_sums(back @ out.T / per[:, None], owner, sub, len(learnt)) + DECAY * emb, vec.T @ back, error.sum(axis=0)]
        for p, g, a, b in zip(params, grads, m, v):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-9)
    odds = emb @ (out[:, 1] - out[:, 0])
    return Model(dict(zip(learnt.tolist(), odds.tolist())), float(bias[1] - bias[0]), 0.0)


def _windows(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of values[lo:hi]."""
    total = np.zeros((len(values) + 1, values.shape[1]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[hi] - total[lo]


def score(word, bias: float, text: str, cleaned=clean) -> float:
    """Log-odds of the most toxic window, the windows as in the fit; ``bias`` for a text without words. A window of fewer than
    WINDOW words is filled up with words of no weight, so brevity makes no evidence."""
    values = np.fromiter(map(word, words(text, cleaned)), float)
    if not len(values):
        return bias
    total = np.concatenate([[0.0], np.cumsum(values)])
    lo = window_starts(len(values))
    return bias + float((total[np.minimum(lo + WINDOW, len(values))] - total[lo]).max()) / WINDOW


_HERE: dict[str, tuple[Cache, Cache]] = {}


def _caches(key: str, shared) -> tuple[Cache, Cache]:
    """Values of words and clean forms of tokens, held by each worker process until another model comes."""
    if key not in _HERE:
        _HERE.clear()
        buckets, numbers = shared.value
        model = Model(dict(zip(buckets.tolist(), numbers[2:].tolist())), numbers[0], numbers[1])
        _HERE[key] = Cache(model.word, 300_000), Cache(clean, 300_000)
    return _HERE[key]


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents of each class, whole texts, picked by a hash of the id.

    Labels with a null id or class, and documents without text, are left out. Of several labels of one id the highest
    counts, of several texts of one id the first in order.
    """
    l = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter("toxic in (0, 1)")
    l = l.groupBy("id").agg(F.max("toxic").alias("toxic"))
    have = l.join(id_text(docs).filter("text is not null").select(F.col("doc_id").alias("id")), "id", "left_semi")
    ids = have.filter("toxic = 1").orderBy(F.xxhash64("id"), "id").limit(sample).unionByName(have.filter("toxic = 0").orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = id_text(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("id")).groupBy("id", "toxic").agg(F.min("text").alias("text"))
    got = rows.toPandas().sort_values("id")
    return train(got["text"].tolist(), got["toxic"].tolist())


def score_toxicity(docs: DataFrame, model: Model, columns: list[str] | None = None, names: tuple[str, str] = ("toxic_score", "toxic")) -> DataFrame:
    """``columns`` of ``docs`` (by default ``doc_id``), then ``toxic_score``, the log-odds of the most toxic window of the
    text, and ``toxic``, whether they exceed the model's threshold; other ``names`` can be given to both. Row for row and
    without a shuffle: null ids and repeated rows are kept. A null text has a null score and is not toxic, as is a score
    right at the threshold; a text without words has the bias as score. Texts of any length are read whole. An empty table
    gives an empty result.
    """
    arrays = model.arrays()
    shared = docs.sparkSession.sparkContext.broadcast(arrays)
    keep = columns or ["doc_id"]
    key = hashlib.blake2b(b"".join(a.tobytes() for a in arrays)).hexdigest()
    bias, threshold = model.bias, model.threshold
    schema = docs.select(*keep, F.lit(None).cast("double").alias(names[0]), F.lit(None).cast("boolean").alias(names[1])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, cleaned = (c.__getitem__ for c in _caches(key, shared))
        for batch in batches:
            scores = [None if t is None else score(word, bias, t, cleaned) for t in batch.column("text").to_pylist()]
            toxic = [s is not None and s > threshold for s in scores]
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(scores, pa.float64()), pa.array(toxic, pa.bool_())], names=[*keep, *names])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, toxic_score, toxic)`` of every document by a model fitted on ``labels``; see :func:`fit_toxicity` and
    :func:`score_toxicity`. Empty tables are allowed; without labels nothing is toxic."""
    return score_toxicity(docs, fit_toxicity(docs, labels))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, with all their columns, whatever their names. Rows with a
    null text are kept; those with a null id are judged like others. Repeated rows are all kept or all dropped. Texts of any
    length are read whole. Empty tables are allowed."""
    names = unused(docs, "toxic_score"), unused(docs, "toxic")
    judged = score_toxicity(docs, fit_toxicity(docs, labels), docs.columns, names)
    return judged.filter(~F.col(names[1])).select(*docs.columns)
