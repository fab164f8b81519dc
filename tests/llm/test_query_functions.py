"""The opN_ queries themselves on the smallest tables, against brute force that shares no code with the operators."""

import hashlib
import html
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from shardmend.llm import queries
from tokenizers import Tokenizer

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"  # fifty labelled rows teach no classifier, some three hundred do
pytestmark = pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables here")


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "pages", "labels")}


@pytest.fixture(scope="module")
def larger(spark):
    return {t: spark.read.parquet(f"{LARGER}/{t}.parquet").collect() for t in ("documents", "labels")}


def run(spark, name, sf=SF):
    return queries.QUERIES[name](spark, sf).collect()


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op1(spark, tables):
    """These pages mark their article: its blocks, read with two patterns."""
    got = {r.page_id: r for r in run(spark, "op1_html")}
    assert len(got) == len(tables["pages"])
    for p in tables["pages"]:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", p.html or "", re.S)
        blocks = re.split(r"</?(?:h1|p|article)\b[^>]*>", article[1]) if article else []
        texts = [" ".join(html.unescape(re.sub(r"<br\s*/?>", " ", b, flags=re.I) and re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", b))).split()) for b in blocks]
        want = "\n\n".join(t for t in texts if t)
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (want, len(want), p.url)


def test_op2(spark, larger):
    toxic = {r.doc_id: r.toxic for r in larger["labels"]}
    rows = run(spark, "op2_toxicity", LARGER)
    assert sorted(r.doc_id for r in rows) == sorted(d.doc_id for d in larger["documents"])
    assert all(r.held_out == (remainder(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.score, toxic[r.doc_id]) for r in rows if r.held_out and toxic.get(r.doc_id) is not None]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    assert not bad or np.mean([b > g for b in bad for g in good]) > 0.85


def test_op3(spark, tables):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )
    got = {r.doc_id: r for r in run(spark, "op3_pii")}
    for d in tables["documents"]:
        base = [(k, *m.span()) for k, p, fine in rules for m in re.finditer(p, d.text or "") if fine(m[0])]
        r = got[d.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k, *_ in rules]
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))


def test_op5(spark, tables):
    lang = {d.doc_id: d.lang for d in tables["documents"]}
    rows = run(spark, "op5_langid")
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows) and len(rows) == len(lang)
    letters = {d.doc_id: any(c.isalpha() for c in d.text or "") for d in tables["documents"]}
    assert all((r.lang_pred == "und") == (not letters[r.doc_id]) for r in rows)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id] and letters[r.doc_id]]
    assert np.mean(held) > 0.95


def test_op7(spark, tables):
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    theirs.no_truncation()
    theirs.no_padding()
    got = {r.doc_id: r for r in run(spark, "op7_bpe")}
    for d in tables["documents"]:
        ids = theirs.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op9(spark, tables):
    def fingerprint(text):
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {d.doc_id: fingerprint(d.text) for d in tables["documents"]}
    root = {i: i for i in fps}
    for _ in fps:
        new = {i: min(root[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 3) for i in fps}
        if new == root:
            break
        root = new
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in run(spark, "op9_simhash")} == {(i, f"{fps[i]:016x}", root[i]) for i in fps}


def test_op10(spark, larger):
    quality = {r.doc_id: r.quality for r in larger["labels"]}
    rows = run(spark, "op10_quality", LARGER)
    assert len(rows) == len(larger["documents"]) and all(r.held_out == (remainder(r.doc_id, 5) == 3) and 0 <= r.score <= 1 for r in rows)
    low, high = (max((r.score for r in rows if not r.keep), default=0), min((r.score for r in rows if r.keep), default=1))
    assert low < high  # one threshold
    held = [(r.score, quality[r.doc_id]) for r in rows if r.held_out and quality.get(r.doc_id) is not None]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert not bad or not good or np.mean([g > b for g in good for b in bad]) > 0.85
