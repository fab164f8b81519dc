"""Quality by co-training two views of a document.

One classifier sees the text's content (hashed words, stems and the make-up of its tokens), the other
only metadata (language, source, length and layout). Both start from the labelled rows; in each round
each view's confident guesses on unlabelled documents become labels of the other's training set. The
two calibrated views are then combined, and score every document. Combination and threshold are fitted
on a fifth of the labelled sample that neither view has learned from; held-out rows have no part in either.

Learning uses a bounded sample of labelled and of unlabelled rows, of each the whole text; scoring
covers all. Held-out rows (crc32 of doc_id mod 5 = 3) teach nothing. Null or empty texts have the
metadata and bias features alone. With no labels, every score is 0.5. Null language, source and
n_chars are values of their own; n_chars is measured, so the column may be missing or wrong. Texts of
any length are read whole; rows are independent, so repeated rows and ties need no care.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, crc_of_id, fit_in_one_task, small_batches, spare_name

#: Bounds of the labelled and unlabelled rows learned from; rounds; labels a view gives in a round, of each class.
LABELLED_ROWS, UNLABELLED_ROWS, ROUNDS, GIVEN = 6000, 4000, 3, 300
CONFIDENT = 0.95
BITS = 18
#: The threshold that is learned is the largest of these at which at most LOST of the clean rows kept from learning fall below it.
THRESHOLDS, LOST = (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05, 0.02), 0.005
#: Bounds of a worker's memo of words: entries, and characters in all (some 12 MB).
MEMO_WORDS, MEMO_CHARS = 60_000, 1 << 20
_MASK = (1 << BITS) - 1


class _Word(dict):
    """Token -> place, remembered up to a bound."""

    chars = 0

    def __missing__(self, token: str) -> int:
        if len(self) >= MEMO_WORDS or self.chars > MEMO_CHARS:
            self.clear()
            self.chars = 0
        self.chars += len(token)
        n = self[token] = 64 + xxhash.xxh32_intdigest(token.encode("utf-8", "surrogatepass")) % ((1 << BITS) - 64)
        return n


_word = _Word()


def _level(x: float, steps: int = 12) -> int:
    """A share as a step of a scale."""
    return min(steps - 1, int(x * steps))


def content_view(text: str | None) -> np.ndarray:
    """Places of the content features; 0 is the bias, below 64 are none of the words'."""
    text = text or ""
    words = text.split()
    if not words:
        return np.array([0, 1], np.int64)
    distinct = dict.fromkeys(words)
    n = len(text)
    letters = sum(map(str.isalpha, text)) / n
    lines = text.split("\n")
    made = {
        "letters": letters,
        "distinct": len(distinct) / len(words),
        "lines": len(set(lines)) / len(lines),
        "stops": sum(w[-1] in ".!?" for w in words) / len(words) * 4,
        "signs": sum(not w[-1].isalnum() and w[-1] not in ".,;:!?" for w in words) / len(words),
        "short": sum(len(w) < 2 for w in words) / len(words),
    }
    extra = [_word[f"\0{k}={_level(v)}"] for k, v in made.items()]
    return np.unique(np.fromiter([0, *extra, *(_word[w.lower()] for w in distinct), *(_word[f"\1{w[-3:]}"] for w in distinct)], np.int64))


def metadata_view(lang: str | None, source: str | None, text: str | None) -> np.ndarray:
    """Places of the metadata features: language, source, length in characters, words and lines; nothing of what the text says."""
    text = text or ""
    n, lines = len(text), text.count("\n") + 1
    words = text.count(" ") + lines
    size = n.bit_length()
    values = (
        f"lang={lang}",
        f"source={source}",
        f"size={size}",
        f"lines={min(lines, 64).bit_length()}",
        f"line={(n // lines).bit_length()}",
        f"words={words.bit_length()}",
        f"spaced={min(40, 2 * n // words)}",
        f"blank={_level(sum(not x.strip() for x in text.splitlines()) / lines)}",
        f"lang,size={lang},{size}",
        f"source,size={source},{size}",
    )
    return np.unique(np.array([0, *(_word[f"\2{v}"] for v in values)], np.int64))


class View:
    """Logistic regression on sets of features, per-coordinate (AdaGrad) steps; scores calibrated on rows apart."""

    def __init__(self):
        self.w, self.g = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2)
        self.slope, self.offset = 1.0, 0.0

    def sums(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.w[r].sum() / np.sqrt(len(r)) for r in rows])

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return _sigmoid(self.slope * self.sums(rows) + self.offset)

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator, passes: int = 4, rate: float = 0.5, decay: float = 1e-4) -> View:
        self.__init__()
        ones = max(1, int(labels.sum()))
        weight = np.where(labels == 1, len(labels) / (2 * ones), len(labels) / (2 * max(1, len(labels) - ones)))  # classes count alike
        order = rng.permutation(len(rows))
        apart, learned = order[: len(rows) // 5], order[len(rows) // 5 :]
        for _ in range(passes):
            for k in rng.permutation(learned).tolist():
                r = rows[k]
                x = 1 / np.sqrt(len(r))
                w = self.w[r]
                step = weight[k] * (_sigmoid(w.sum() * x) - labels[k]) * x + decay * w
                self.g[r] += step * step
                self.w[r] = w - rate * step / np.sqrt(self.g[r])
        self.slope, self.offset = calibrate(self.sums([rows[k] for k in apart]), labels[apart], weight[apart])
        return self


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def calibrate(sums: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the sums, lightly regularised; (1, 0) where a class is missing."""
    if len(set(labels.tolist())) < 2:
        return 1.0, 0.0
    x, b = np.stack([sums, np.ones(len(sums))], 1), np.array([1.0, 0.0])
    for _ in range(60):
        p = _sigmoid(x @ b)
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + 0.05 * np.eye(2), x.T @ (weight * (p - labels)) + 0.05 * b)
        b = b - np.clip(step, -1, 1)
    return (float(b[0]), float(b[1])) if b[0] > 0 else (1.0, 0.0)


def cotrain(content: list[np.ndarray], meta: list[np.ndarray], labels: np.ndarray, rounds: int = ROUNDS, seed: int = 3) -> tuple[View, View, tuple[float, float, float, float], list[int]]:
    """(content view, metadata view, weights of both and offset in the combination and its threshold, pseudo-labels given in each round).

    labels: 0, 1, or -1 for unlabelled rows.
    """
    rng = np.random.default_rng(seed)
    views = [content, meta]
    known = rng.permutation(np.flatnonzero(labels >= 0))
    apart = known[: len(known) // 5]
    if len(set(labels[apart].tolist())) < 2:
        apart = known[:0]
    own = [labels.copy(), labels.copy()]  # what each view is taught: labels and the other's guesses
    for taught in own:
        taught[apart] = -2
    models = [View(), View()]
    given = []
    for turn in range(rounds + 1):
        for v in range(2):
            at = np.flatnonzero(own[v] >= 0)
            models[v].fit([views[v][k] for k in at], own[v][at], rng)
        if turn == rounds:
            break
        new = 0
        for v in range(2):
            other = 1 - v
            open_ = np.flatnonzero(own[other] == -1)
            if not len(open_):
                continue
            p = models[v].scores([views[v][k] for k in open_])
            for label, sure in ((1, p), (0, 1 - p)):
                best = np.argsort(-sure, kind="stable")[:GIVEN]
                best = best[sure[best] >= CONFIDENT]
                own[other][open_[best]] = label
                new += len(best)
        given.append(new)
        if not new:
            break
    # the combination is fitted to true labels alone, in their own proportions: keeping a clean document comes first
    at = apart if len(apart) else np.sort(known)
    x = _logits(models, content, meta, at)
    y, c = labels[at], np.array([0.5, 0.5, 0.0])
    if 0 < y.sum() < len(y):
        for _ in range(40):
            p = _sigmoid(x @ c)
            step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.eye(3), x.T @ (p - y) + (c - np.array([0.5, 0.5, 0.0])))
            c = c - np.clip(step, -1, 1)
    clean = np.sort(_sigmoid(x @ c)[y == 1])
    threshold = next((t for t in THRESHOLDS if (clean < t).sum() <= LOST * len(clean)), THRESHOLDS[-1])
    return models[0], models[1], (*c.tolist(), threshold), given


def _logits(models: list[View], content: list[np.ndarray], meta: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Calibrated logits of both views and a one, of the rows at these places."""
    a, b = (m.slope * m.sums([rows[k] for k in at]) + m.offset for m, rows in zip(models, (content, meta), strict=True))
    return np.stack([a, b, np.ones(len(at))], 1)


def _views_of(pdf: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [content_view(t) for t in pdf.text], [metadata_view(*x) for x in zip(pdf.lang, pdf.source, pdf.text, strict=True)]


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED_ROWS, unlabelled: int = UNLABELLED_ROWS) -> dict:
    """Both views' weights, scaled and added into one array each, from bounded samples."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "lang", "source", "text")
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(crc_of_id() % 5 != 3)
    known = bounded_sample(known, labelled)
    # Bounded by `labelled`, so it may be broadcast. Unlabelled rows are picked by hash, whatever their labels, which are not looked at.
    taught = rows.join(F.broadcast(known), "doc_id").limit(2 * labelled)
    free = bounded_sample(rows.where(crc_of_id() % 5 != 3), unlabelled, salt=29).withColumn("quality", F.lit(-1))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = []
        for pdf in batches:
            got += zip(pdf.doc_id, pdf.quality, *_views_of(pdf), strict=True)
        got.sort(key=lambda r: (r[1], -1 if pd.isna(r[0]) else r[0], r[2].tobytes(), r[3].tobytes()))
        y = np.array([r[1] for r in got], np.int64)
        if not {0, 1} <= {*y.tolist()}:
            return
        one, two, (a, b, c, threshold), given = cotrain([r[2] for r in got], [r[3] for r in got], y)
        for view, m, k in ((0, one, a), (1, two, b)):
            at = np.flatnonzero(m.w)
            yield pd.DataFrame({"view": view, "place": at, "weight": m.w[at] * m.slope * k})
        yield pd.DataFrame({"view": [2, 3], "place": [sum(given), 0], "weight": [a * one.offset + b * two.offset + c, threshold]})

    got = fit_in_one_task(taught.unionByName(free.select(taught.columns)), learn, "view int, place long, weight double")
    out = {"views": [np.zeros(1 << BITS), np.zeros(1 << BITS)], "offset": 0.0, "given": 0, "threshold": 0.5}
    for v, place, weight in got:
        if v == 2:
            out["offset"], out["given"] = weight, place
        elif v == 3:
            out["threshold"] = weight
        else:
            out["views"][v][place] = weight
    return out


def scored(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """docs with its quality (0 to 1) in a new column `name` (with leading underscores where docs has one of that name)."""
    small_batches(docs.sparkSession)
    name = spare_name(docs, name)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        (wc, wm), offset = shared.value["views"], shared.value["offset"]
        for lang, source, text in batches:
            content, meta = _views_of(pd.DataFrame({"lang": lang, "source": source, "text": text}, dtype=object))
            sums = [wc[c].sum() / np.sqrt(len(c)) + wm[m].sum() / np.sqrt(len(m)) for c, m in zip(content, meta, strict=True)]
            yield pd.Series(_sigmoid(np.array(sums, np.float64) + offset))

    return docs.withColumn(name, score(F.col("lang"), F.col("source"), F.col("text")))


def kept(docs: DataFrame, model: dict) -> DataFrame:
    """docs whose quality reaches the threshold learned, with its own columns."""
    name = spare_name(docs, "quality_score")
    return scored(docs, model, name).where(F.col(name) >= model["threshold"]).drop(name)
