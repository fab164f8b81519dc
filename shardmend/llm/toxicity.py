"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the sets of its words, word pairs and pairs with one word between, hashed into
2**BITS places. Words also count by their stems. Training is online, with a learning rate for each coordinate and L1 sparsity, so the
weights that remain are few and their number is bounded by 2**BITS: they are broadcast whole.

Labels: rows whose label is null, or whose document is missing, teach nothing; rows that repeat a
doc_id all count. Null and empty texts have the bias feature alone and get the score it gives. With
no usable labels at all the weights are empty and every score is 0.5. Texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, crc_of_id, fit_in_one_task, small_batches, spare_name

BITS, STEM = 20, 4
#: Labelled rows learned from (a documented bound; all of the text of each), passes, and the learner's constants.
TRAIN_ROWS, PASSES = 12_000, 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 6.0, 0.1
THRESHOLD = 0.7
#: Bounds of a task's memo of words: entries, and characters in all (some 25 MB).
MEMO_WORDS, MEMO_CHARS = 100_000, 2 << 20

_WORD = re.compile(r"[^\W\d_]+")
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


class _Places(dict):
    """Word -> its row in two arrays of hashes, of the word and of its stem; remembered up to a bound, by one task."""

    def __init__(self):
        self.chars = 0
        self.word, self.stem = np.zeros(MEMO_WORDS, np.uint64), np.zeros(MEMO_WORDS, np.uint64)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.chars += len(word)
        self.word[n], self.stem[n] = (xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in (word, word[:STEM]))
        return n

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) + len(words) > MEMO_WORDS or self.chars > MEMO_CHARS:
            self.clear()
            self.chars = 0
        if len(words) > MEMO_WORDS:
            halves = [self.of(words[: len(words) // 2]), self.of(words[len(words) // 2 :])]
            return tuple(np.concatenate(x) for x in zip(*halves, strict=True))
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.word[at], self.stem[at]


def places(text: str | None, known: _Places | None = None) -> np.ndarray:
    """Feature places of a text, repeats included; place 0 is the bias.

    A word stands for itself and for its stem, its first STEM letters, so that inflected forms never
    seen before still count.
    """
    words = _WORD.findall((text or "").lower())
    h, stem = (_Places() if known is None else known).of(words)
    shift = np.uint64(64 - BITS)
    with np.errstate(over="ignore"):
        parts = [
            (h * _MIX[0]) >> shift,
            (stem * _MIX[3]) >> shift,
            (h[:-1] * _MIX[1] + h[1:] * _MIX[2]) * _MIX[0] >> shift,
            (h[:-2] * _MIX[2] + h[2:] * _MIX[3]) * _MIX[0] >> shift,
        ]
    return np.concatenate([np.zeros(1, np.uint64), *parts]).astype(np.int64)


def features(text: str | None, known: _Places | None = None) -> np.ndarray:
    """Sorted distinct feature places."""
    return np.unique(places(text, known))


class Ftrl:
    """Per-coordinate FTRL-proximal for sets of features."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, label: int) -> float:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        return p


def fit(examples: list[tuple[np.ndarray, int]], passes: int = PASSES, seed: int = 1, **constants) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) that are not zero, scaled so that the scores of rows not learned from are calibrated.

    A fifth of the rows is kept from learning; slope and offset are fitted to their sums (with the
    usual smoothed targets, so that separable rows do not ask for an endless slope).
    """
    model, rng = Ftrl(**constants), np.random.default_rng(seed)
    order = rng.permutation(len(examples)).tolist()
    apart, learned = order[: len(order) // 5], order[len(order) // 5 :]
    for _ in range(passes):
        for k in rng.permutation(learned).tolist():
            model.learn(*examples[k])
    w = model.weights(slice(None))
    slope, offset = platt(np.array([w[examples[k][0]].sum() for k in apart]), np.array([examples[k][1] for k in apart]))
    w *= slope
    w[0] += offset
    at = np.flatnonzero(w)
    return at, w[at]


def platt(sums: np.ndarray, labels: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope (positive) and offset of a logistic curve through the sums, by Newton's method; (1, 0) where a class is missing."""
    ones = int(labels.sum())
    if not 0 < ones < len(labels):
        return 1.0, 0.0
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    # each class counts alike: the rarer one is the one to find
    weight = np.where(labels == 1, len(labels) / (2 * ones), len(labels) / (2 * (len(labels) - ones)))
    x = np.stack([sums, np.ones(len(sums))], 1)
    b = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + 1e-6 * np.eye(2), x.T @ (weight * (p - target)) + 1e-6 * b)
        b = b - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return (float(b[0]), float(b[1])) if b[0] > 0 else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Weights learned from about `rows` labelled rows at most, the held-out third (crc32 of doc_id mod 3 = 1) left aside."""
    small_batches(docs.sparkSession)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = bounded_sample(known.where(crc_of_id() % 3 != 1), rows)
    # The sample's size is bounded, so it may be broadcast.
    examples = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic").limit(2 * rows)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got, words = [], _Places()
        for pdf in (b for b in batches if len(b)):
            found = [features(t, words) for t in pdf.text]
            # one array for a batch: many small ones would stay with the worker when the task has ended
            whole, ends = np.concatenate(found).astype(np.int32), np.cumsum([len(x) for x in found])
            got += zip(pdf.doc_id, np.split(whole, ends[:-1]), pdf.toxic, strict=True)
        got.sort(key=lambda x: (x[0], x[2], x[1].tobytes()))  # the order of rows must not matter
        at, w = fit([x[1:] for x in got])
        yield pd.DataFrame({"place": at, "weight": w})

    model = fit_in_one_task(examples, learn, "place long, weight double")
    return np.array([r[0] for r in model], np.int64), np.array([r[1] for r in model])


def total(at: np.ndarray, w: np.ndarray, live: np.ndarray) -> float:
    """Sum of the weights of the distinct places; only the few whose weight lives are sorted."""
    return float(w[np.unique(at[live[at]])].sum())


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", name: str = "score") -> DataFrame:
    """docs with its toxicity (0 to 1) in a new column `name` (with leading underscores where docs has one of that name)."""
    small_batches(docs.sparkSession)
    name = spare_name(docs, name)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = np.zeros(1 << BITS)
        w[shared.value[0]] = shared.value[1]
        live, known = w != 0, _Places()
        for texts in batches:
            sums = np.array([total(places(t, known), w, live) for t in texts], np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums, -35, 35))))

    return docs.withColumn(name, score(F.col(text)))


def kept(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """docs whose toxicity is below the threshold, with its own columns."""
    name = spare_name(docs, "toxicity")
    return scored(docs, model, name=name).where(F.col(name) < threshold).drop(name)
