"""Language identification: script ranges narrow the candidates, Viterbi labels spans of words.

Each word gets a score for every language from smoothed character n-grams (naive Bayes, clipped so
that no single word decides alone); languages that do not use the word's script are out. Viterbi with
a penalty for each switch labels the words; runs of equal labels are the spans. A test that costs one
pass of array operations shows for most texts that one label throughout is the best path; only the
others are walked word by word, with the same result.

A word is a run of letters, with their marks, of one script; scripts that are written without spaces are
read sign by sign. Texts and words of any length are read whole. Rows are independent, so ties, repeated
rows and extra columns need no care.

Null texts and texts without a letter are `und` with score 0. Words of a script that no learned
language uses say nothing. With nothing to learn from, every text is `und`.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, fit_in_one_task, small_batches, spare_name

#: Rows learned from for each language and in all at most (their whole texts), and languages at most (the most frequent; more than
#: any labelled corpus has): bounds of the labelled sample.
ROWS_PER_LANG, TRAIN_ROWS, MAX_LANGS = 1200, 20_000, 2000
#: Places of the n-gram table (fewer where places x languages would pass CELLS), length of n-grams, smoothing, bound of a word's score differences, cost of a switch.
BUCKETS, CELLS, ORDER, SMOOTH, CLIP, SWITCH = 1 << 16, 1 << 24, 3, 0.5, 4.0, 9.0
#: A language is a candidate for a script that at least this share of its learned words use.
SCRIPT_SHARE = 0.01
#: Bounds of a task's memos: words whose scores are kept (and bytes of their scores), n-grams, and letters of a word that is kept.
MEMO_WORDS, MEMO_BYTES, MEMO_GRAMS, MEMO_LETTERS = 100_000, 16 << 20, 100_000, 40
UND = "und"

# Words that begin the names of letters but name no script, and scripts that go by another name here.
NO_SCRIPT = frozenset("FULLWIDTH HALFWIDTH MODIFIER MATHEMATICAL SUPERSCRIPT SUBSCRIPT CIRCLED SQUARED PARENTHESIZED DOUBLE-STRUCK SCRIPT BLACK-LETTER TURNED ROTATED FEMININE MASCULINE MICRO OHM KELVIN ANGSTROM COMBINING VARIATION".split())
ALIASES = {"CJK": "Han", "IDEOGRAPHIC": "Han", "HIRAGANA": "Kana", "KATAKANA": "Kana", "KATAKANA-HIRAGANA": "Kana"}
#: Scripts written without spaces between words.
UNSPACED = frozenset("Han Kana THAI LAO MYANMAR KHMER TIBETAN JAVANESE BALINESE YI NUSHU TANGUT BOPOMOFO".split())

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_PLAIN_WORD = re.compile(r"[^\W\d_]+")
#: A sign beyond the Latin ranges: only texts with one are looked at for scripts.
_BEYOND = re.compile(r"[^\x00-\u02ff\u1e00-\u1eff\u2000-\u20cf]")


@lru_cache(maxsize=20_000)
def script_of(char: str) -> str:
    """Script of a letter: the first word of its name that names one."""
    if char < "\u0250":
        return "LATIN"
    for word in unicodedata.name(char, "OTHER").split():
        if word not in NO_SCRIPT:
            return ALIASES.get(word, word)
    return "OTHER"


def pieces(word: str) -> list[str]:
    """A run of letters and marks cut where its script changes; scripts written without spaces sign by sign."""
    out, start, had = [], 0, None
    for k, c in enumerate(word):
        if unicodedata.category(c)[0] == "M":
            continue  # a mark goes with its letter
        s = script_of(c)
        if had is not None and (s != had or s in UNSPACED):
            out.append(word[start:k])
            start = k
        had = s
    return [*out, word[start:]]


def words_of(text: str) -> list[str]:
    low = text.lower()
    if not _BEYOND.search(low):
        return _PLAIN_WORD.findall(low)
    return [p for w in _WORD.findall(low) for p in ((w,) if w.isascii() else pieces(w))]


class _Grams(dict):
    """n-gram -> place, remembered up to a bound, by one task."""

    def __missing__(self, gram: str) -> int:
        if len(self) >= MEMO_GRAMS:
            self.clear()
        n = self[gram] = xxhash.xxh32_intdigest(gram.encode("utf-8", "surrogatepass")) % BUCKETS
        return n

    def of(self, word: str) -> list[int]:
        """Places of the word's n-grams, its edges marked."""
        w = f"<{word}>"
        return [self[w[k : k + ORDER]] for k in range(len(w) - ORDER + 1)]


def fit(texts: list[tuple[str, str]]) -> dict:
    """Model of (language, text) rows: log probabilities of n-gram places and the scripts of each language."""
    langs, grams = sorted({lang for lang, _ in texts}), _Grams()
    places = places_for(len(langs))
    logp, scripts = np.zeros((places, len(langs)), np.float32), {}
    by_lang: dict[str, list[str]] = {lang: [] for lang in langs}
    for lang, text in texts:
        by_lang[lang].append(text)
    for k, lang in enumerate(langs):
        words: Counter[str] = Counter()
        for text in by_lang[lang]:
            words.update(words_of(text))
        counts, used = np.full(places, SMOOTH), Counter()
        for w, n in words.items():
            np.add.at(counts, np.array(grams.of(w)) % places, n)
            used[script_of(w[0])] += n
        logp[:, k] = np.log(counts / counts.sum())
        for s, n in used.items():
            if n >= SCRIPT_SHARE * used.total():
                scripts.setdefault(s, []).append(k)
    return {"langs": langs, "logp": logp, "scripts": scripts}


def places_for(langs: int) -> int:
    """Places of the table for so many languages: a power of two, so that a hash is cut alike."""
    return min(BUCKETS, 1 << max(8, (CELLS // max(1, langs)).bit_length() - 1))


class Labeller:
    def __init__(self, model: dict):
        self.langs, self.logp = model["langs"], model["logp"]
        self.out = {s: np.setdiff1d(np.arange(len(self.langs)), ks) for s, ks in model["scripts"].items()}
        self.memo: dict[str, int] = {}
        self.grams = _Grams()
        self.room = max(1, min(MEMO_WORDS, MEMO_BYTES // (8 * max(1, len(self.langs)))))
        self.rows = np.zeros((self.room, len(self.langs)))

    def new_scores(self, words: list[str]) -> np.ndarray:
        """Log scores of the languages, one row for each word: the best language's 0, others at least -CLIP."""
        at = [self.grams.of(w) for w in words]
        starts = np.r_[0, np.cumsum([len(a) for a in at])[:-1]]
        at = np.fromiter((x for a in at for x in a), np.int64) % max(1, len(self.logp))
        ends, s = np.r_[starts[1:], len(at)], np.empty((len(words), len(self.langs)))
        step = max(1, (4 << 20) // max(1, len(self.langs)))  # n-grams looked up at once
        k = 0
        while k < len(words):
            z = max(k + 1, int(np.searchsorted(ends, starts[k] + step, "right")))
            if ends[z - 1] - starts[k] <= step:
                s[k:z] = np.add.reduceat(self.logp[at[starts[k] : ends[z - 1]]].astype(np.float64), starts[k:z] - starts[k], axis=0)
            else:  # a single word of very many letters
                s[k] = sum(self.logp[at[x : min(x + step, ends[k])]].astype(np.float64).sum(axis=0) for x in range(starts[k], ends[k], step))
            k = z
        for k, w in enumerate(words):
            out = self.out.get(script_of(w[0]))
            if out is None:
                s[k] = 0.0
            elif len(out):
                s[k, out] = -np.inf
        return np.maximum(s - s.max(axis=1, keepdims=True), -CLIP)

    def scores(self, words: list[str]) -> np.ndarray:
        """One row for each word."""
        memo = self.memo
        if len(memo) + len(words) > self.room:
            memo.clear()
        if len(words) > self.room or max(map(len, words)) > MEMO_LETTERS:
            distinct = list(dict.fromkeys(words))
            at, found = dict(zip(distinct, range(len(distinct)), strict=True)), self.new_scores(distinct)
            return found[np.fromiter(map(at.__getitem__, words), np.int64, len(words))]
        new = [w for w in dict.fromkeys(words) if w not in memo]
        if new:
            self.rows[len(memo) : len(memo) + len(new)] = self.new_scores(new)
            memo.update(zip(new, range(len(memo), len(memo) + len(new)), strict=True))
        return self.rows[np.fromiter(map(memo.__getitem__, words), np.int64, len(words))]

    def path(self, s: np.ndarray) -> np.ndarray:
        """Best labels of words with scores s (words x languages)."""
        top = int(s.sum(axis=0).argmax())
        if one_label_is_best(s, top):
            return np.full(len(s), top)
        return viterbi(s)

    def label(self, text: str | None) -> tuple[str, float, list[tuple[str, int, int]]]:
        """(language, score, spans): the language that most letters are labelled with, their share, and runs (label, start, end of word numbers)."""
        words = words_of(text) if text else []
        if not words or not self.langs:
            return UND, 0.0, []
        path = self.path(self.scores(words))
        edges = np.flatnonzero(np.r_[True, path[1:] != path[:-1], True])
        spans = [(self.langs[path[a]], int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        if len(spans) == 1:
            return spans[0][0], 1.0, spans
        letters = np.bincount(path, weights=np.fromiter(map(len, words), np.float64, len(words)), minlength=len(self.langs))
        best = int(letters.argmax())
        return self.langs[best], float(letters[best] / letters.sum()), spans


def one_label_is_best(s: np.ndarray, top: int) -> bool:
    """True only if no path scores more than label `top` throughout.

    Any other path leaves the label for stretches of words. Such a stretch gains at most the sum of
    each word's best score over the label's, and costs two switches, or one at either end of the text.
    """
    gain = np.r_[0.0, (s.max(axis=1) - s[:, top]).cumsum()]
    if gain[-1] <= SWITCH:
        return True  # each stretch gains at most this
    total = s.sum(axis=0)
    if (total > total[top]).any():
        return False
    # tighter: for each other language alone, Kadane's sum; sums over stretches of several languages only cost more switches
    d = np.vstack([np.zeros(s.shape[1]), (s - s[:, [top]]).cumsum(axis=0)])
    low = np.minimum.accumulate(d, axis=0)
    inner = (d - low).max(axis=0)
    ahead, behind = d.max(axis=0), (d[-1] - d).max(axis=0)
    # a path of m stretches apart from `top` pays m + 1 switches inside the text, m at an end, m - 1 if it never has `top`
    return bool(inner.max() <= SWITCH and ahead.max() + behind.max() <= SWITCH)


def viterbi(s: np.ndarray) -> np.ndarray:
    n, k = s.shape
    back = np.empty((n, k), np.int16)
    own = np.arange(k)
    best = s[0].copy()
    for t in range(1, n):
        top = int(best.argmax())
        jump = best[top] - SWITCH
        stay = best >= jump
        back[t] = np.where(stay, own, top)
        best = np.where(stay, best, jump) + s[t]
    path = np.empty(n, np.int64)
    path[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def train(docs: DataFrame, rows: int = ROWS_PER_LANG) -> dict:
    """Model of the documents that are not held out (crc32 of doc_id mod 4 = 2) and have text and language."""
    small_batches(docs.sparkSession)
    known = docs.select("doc_id", "lang", "text").where("lang is not null and text is not null").where(crc_of_id() % 4 != 2)
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    if not counts:
        return {"langs": [], "logp": np.zeros((BUCKETS, 0), np.float32), "scripts": {}}
    rows = min(rows, max(1, TRAIN_ROWS // len(counts)))
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1 << 30, int((1 << 30) * rows / r["count"]))) for r in counts], "lang string, share long")
    sample = known.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(1 << 30)) < F.col("share")).select("lang", "text").limit(2 * rows * len(counts))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = [(lang, text) for pdf in batches for lang, text in zip(pdf.lang, pdf.text, strict=True)]
        model = fit(texts)
        scripts = "\n".join(f"{s} {' '.join(map(str, ks))}" for s, ks in model["scripts"].items())
        for k, lang in enumerate(model["langs"]):
            yield pd.DataFrame({"lang": [lang], "logp": [np.ascontiguousarray(model["logp"][:, k]).tobytes()], "scripts": [scripts]})

    got = sorted(fit_in_one_task(sample, learn, "lang string, logp binary, scripts string"), key=lambda r: r["lang"])
    if not got:
        return {"langs": [], "logp": np.zeros((BUCKETS, 0), np.float32), "scripts": {}}
    scripts = {x.split()[0]: [int(k) for k in x.split()[1:]] for x in got[0]["scripts"].split("\n") if x}
    return {"langs": [r["lang"] for r in got], "logp": np.stack([np.frombuffer(r["logp"], np.float32) for r in got], 1), "scripts": scripts}


def identified(docs: DataFrame, model: dict, text: str = "text", name: str = "language", with_spans: bool = True) -> DataFrame:
    """docs with a struct column `name` of lang_pred, score and spans (label, first word, end); it has leading underscores where docs has one of that name."""
    small_batches(docs.sparkSession)
    name = spare_name(docs, name)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CELLS floats at most

    @F.pandas_udf("lang_pred string, score double" + ", spans array<struct<lang:string,start:int,end:int>>" * with_spans)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value)
        for texts in batches:
            rows = [labeller.label(t) for t in texts]
            out = {"lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows]}
            if with_spans:
                out["spans"] = [[{"lang": x, "start": a, "end": b} for x, a, b in r[2]] for r in rows]
            yield pd.DataFrame(out)

    return docs.withColumn(name, label(F.col(text)))
