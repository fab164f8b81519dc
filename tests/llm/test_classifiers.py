"""Toxicity, language and quality: held-out accuracy on small made texts, and odd rows."""

import random
import zlib

import numpy as np
from shardmend.llm import langid, quality, toxicity

EN = "the of and to in is that it was for on are with as his they at be this from have or by one had not but".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus".split()
RU = "и в не на я быть он с что а по это она этот к но они мы весь который из у то за".split()


def crc(i):
    return zlib.crc32(str(i).encode())


def toxic_rows(n=900):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        bad = rng.random() < 0.2
        words = [rng.choice(EN) for _ in range(rng.randint(5, 80))]
        if bad:
            words.insert(rng.randrange(len(words)), "vilest" + rng.choice(["", "a", "en", "ish", "o", "um"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity(spark, docs_of):
    rows = toxic_rows()
    docs = docs_of([(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (None, "vilest"), (1, rows[1][1])], score="x")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (7, 1, None), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.t for r in toxicity.scored(docs, model, name="t").collect()}
    held = [(got[i] >= 0.7, y) for i, _, y in rows if crc(i) % 3 == 1]
    assert len(held) > 200 and np.mean([a == bool(b) for a, b in held]) > 0.97
    assert all(0 <= v <= 1 for v in got.values()) and got[5000] == got[5001] < 0.7
    kept = toxicity.kept(docs, model)
    assert kept.columns == docs.columns and {5000, 5001} <= {r.doc_id for r in kept.collect()}
    nothing = toxicity.train(docs, labels.limit(0))
    assert {r.t for r in toxicity.scored(docs, nothing, name="t").collect()} == {0.5}
    assert toxicity.scored(docs.limit(0), model, name="t").count() == 0


def test_only_the_training_fold_teaches(spark, docs_of):
    rows = toxic_rows(300)
    docs = docs_of([(i, t) for i, t, _ in rows])
    full = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    flipped = spark.createDataFrame([(i, 1, 1 - y if crc(i) % 3 == 1 else y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    a, b = toxicity.train(docs, full), toxicity.train(docs, flipped)
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])


def test_ftrl_is_sparse_and_learns():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(800):
        y = int(rng.random() < 0.5)
        rows.append((np.unique(np.r_[0, rng.integers(10, 2000, 30), [5 if y else 6]]), y))
    at, w = toxicity.fit(rows, bits=11)
    weight = dict(zip(at.tolist(), w.tolist(), strict=True))
    assert weight[5] > 0 and len(at) < 500


def test_platt_needs_both_classes():
    assert toxicity.platt(np.array([1.0, 2.0]), np.array([1, 1])) == (1.0, 0.0)


def language_rows(n=400):
    rng = random.Random(6)
    out = []
    for i in range(n):
        lang, words = rng.choice((("en", EN), ("de", DE), ("ru", RU)))
        out.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 60))), lang))
    return out


def test_language(spark):
    rows = language_rows()
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "12 - 34!", "en"), (None, "the of and", None), (1003, "λόγος και", None), (1004, "the " * 30_000, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows + odd], "doc_id long, text string, lang string, lang_pred string")
    model = langid.train(docs)
    got = {r.doc_id: r.language for r in langid.identified(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003].lang_pred in ("en", "de", "ru") and got[1004].lang_pred == "en"
    assert langid.identified(docs, langid.train(docs.limit(0))).where("language.lang_pred <> 'und'").count() == 0
    held = [(i, t, lang if crc(i) % 4 != 2 else "xx") for i, t, lang in rows]
    again = langid.train(spark.createDataFrame(held, "doc_id long, text string, lang string"))
    assert "xx" not in again["langs"]


def test_mixed_text_spans():
    model = langid.fit([(lang, t) for _, t, lang in language_rows()])
    lab = langid.Labeller(model)
    lang, score, spans = lab.label(" ".join(EN[:20] + DE[:12] + RU[:20]))
    assert [s[0] for s in spans] == ["en", "de", "ru"] and 0 < score < 1 and lang in ("en", "ru")
    assert abs(spans[0][2] - 20) <= 1 and spans[1][2] == 32


def test_shortcut_and_viterbi_are_the_best_path():
    rng = np.random.default_rng(1)

    def brute(s):
        best = {k: s[0, k] for k in range(s.shape[1])}
        for row in s[1:]:
            best = {k: row[k] + max(v - langid.SWITCH * (j != k) for j, v in best.items()) for k in range(len(row))}
        return max(best.values())

    for _ in range(2000):
        s = rng.normal(0, 3, (rng.integers(1, 30), rng.integers(1, 5)))
        s = np.maximum(s - s.max(axis=1, keepdims=True), -langid.CLIP)
        p = langid.viterbi(s)
        value = s[np.arange(len(s)), p].sum() - langid.SWITCH * (p[1:] != p[:-1]).sum()
        assert abs(value - brute(s)) < 1e-9
        top = int(s.sum(axis=0).argmax())
        if langid.one_label_is_best(s, top):
            assert value <= s[:, top].sum() + 1e-9


def test_quality(spark):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(1200):
        good = rng.random() < 0.7
        words = [rng.choice(EN) for _ in range(rng.randint(20, 90))]
        text = ". ".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9)) + "." if good else " | ".join(w + rng.choice(["###", "$$$", ""]) for w in words)
        rows.append((i, text, "en", rng.choice(["a", "b"] if good else ["b", "c"]), len(text)))
        if i % 3 == 0:
            labels.append((i, int(good), 0))
    rows += [(5000, None, None, None, None), (5001, "", "en", "a", 0), (None, "the of", "en", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, known)
    assert model["given"] > 0  # the views did teach each other
    got = {r.doc_id: r.q for r in quality.scored(docs, model, "q").collect()}
    held = [(got[i] >= 0.5, y) for i, y, _ in labels if crc(i) % 5 == 3]
    assert np.mean([a == bool(b) for a, b in held]) > 0.97 and len(got) == len(rows)
    assert quality.kept(docs, model).columns == docs.columns
    nothing = quality.train(docs, known.limit(0))
    assert {r.q for r in quality.scored(docs, nothing, "q").collect()} == {0.5}


def test_letters_are_counted_over_whole_texts():
    """A share of a quarter, also where every fourth character is a letter."""
    places = quality.content_view("a1. " * 4000)
    assert quality._word["\0letters=3"] in places and quality._word["\0letters=11"] not in places


def test_scripts_and_whole_words():
    """Scripts are told apart by the names of letters, runs are cut where they change, marks stay with their letters, and no word is cut short."""
    for text, want in (("ગુજરાતી ਪੰਜਾਬੀ తెలుగు ಕನ್ನಡ മലയാളം", ["GUJARATI", "GURMUKHI", "TELUGU", "KANNADA", "MALAYALAM"]), ("ភាសា አማርኛ ᏣᎳᎩ ພາສາ ၏", ["KHMER", "ETHIOPIC", "CHEROKEE", "LAO"])):
        assert [s for s in dict.fromkeys(langid.script_of(w[0]) for w in langid.words_of(text))][: len(want)] == want
    assert langid.words_of("हिन्दी") == ["हिन्दी"]
    assert langid.words_of("Spark数据です123") == ["spark", "数", "据", "で", "す"]
    assert len(langid._Grams().of("ab" * 500)) == 1000
    model = langid.fit([("aa", "ab" * 30), ("bb", "xy" * 30)])
    assert langid.Labeller(model).label("z" * 60 + "xy" * 4000)[0] == "bb"


def test_many_languages_are_kept(spark):
    rows = [(k, f"w{chr(97 + k % 26)}{chr(97 + k // 26)} " * 5, f"l{k // 2}") for k in range(640)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model["langs"]) == {lang for i, _, lang in rows if crc(i) % 4 != 2} and model["logp"].size <= langid.CELLS


def test_columns_of_the_same_name_stay(spark):
    docs = spark.createDataFrame([(1, "the of and", "en", "a", 0.25, "kept")], "doc_id long, text string, lang string, source string, score double, language string")
    none = langid.train(docs.limit(0))
    for out, new in (
        (toxicity.scored(docs, (np.array([], np.int64), np.array([]))), "_score"),
        (quality.scored(docs, quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))), "_score"),
        (langid.identified(docs, none), "_language"),
    ):
        assert out.columns == [*docs.columns, new] and out.first()["score"] == 0.25 and out.first()["language"] == "kept"


def test_metadata_view_sees_no_content():
    a, b = "one two three.\nfour", "##1 $w| thr&e|\nfo*r"
    assert (quality.metadata_view("en", "s", a) == quality.metadata_view("en", "s", b)).all()


def test_ftrl_against_brute_force():
    """Each coordinate's z and n kept in plain numbers."""
    rng = np.random.default_rng(4)
    rows = [(np.unique(np.r_[0, rng.integers(1, 60, 8)]), int(rng.integers(2))) for _ in range(400)]
    model = toxicity.Ftrl(bits=6)
    z, n = {}, {}

    def weight(i):
        a = abs(z.get(i, 0.0))
        return 0.0 if a <= toxicity.L1 else -np.sign(z[i]) * (a - toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for at, y in rows:
        g = 1 / (1 + np.exp(-sum(weight(i) for i in at.tolist()))) - y
        for i, w in [(i, weight(i)) for i in at.tolist()]:
            old = n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / toxicity.ALPHA * w
            n[i] = old + g * g
        model.learn(at, y)
    assert np.allclose([weight(i) for i in range(64)], model.weights(slice(None)))


def test_cotraining_exchanges_labels():
    """Two views of which each tells half: rows without labels are taught by the other view, held-apart rows choose the threshold."""
    rng = np.random.default_rng(5)
    n = 900
    y = rng.integers(0, 2, n)
    content = [np.unique(np.r_[0, 70 + rng.integers(0, 200, 6), 300 + y[k] if rng.random() < 0.97 else 70]) for k in range(n)]
    meta = [np.unique(np.r_[0, 700 + rng.integers(0, 50, 3), 900 + y[k] if rng.random() < 0.97 else 700]) for k in range(n)]
    labels = np.where(np.arange(n) < 120, y, -1)
    one, two, (a, b, c, threshold), given = quality.cotrain(content, meta, labels)
    assert sum(given) > 100 and threshold in quality.THRESHOLDS
    score = quality._sigmoid(quality._logits([one, two], content, meta, np.arange(n)) @ np.array([a, b, c]))
    assert np.mean((score[120:] >= 0.5) == y[120:]) > 0.9
