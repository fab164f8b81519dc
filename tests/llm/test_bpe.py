import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from shardmend.llm import bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
OURS, THEIRS = bpe.ByteBpe(bpe.load_tables(PATH)), Tokenizer.from_file(PATH)
BITS = st.sampled_from([" ", "  ", "\n", " \n", "\t", " ", "\x1c", "\x85", " ", "the", "It's", "we'LL", "é", "日本", "١٢", "½", "12", "!?", "<|endoftext|>", "<|end", "a" * 70, "́", "😀", "_", "'"])


def same(text):
    want = THEIRS.encode(text, add_special_tokens=False).ids
    got = OURS.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == want
    assert OURS.decode(got).decode() == THEIRS.decode(want, skip_special_tokens=False)


@given(st.lists(BITS, max_size=14).map("".join))
@settings(max_examples=400, deadline=None)
def test_pieces(text):
    same(text)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    same(text)


def test_long_texts():
    same("word " * 5000)
    same("x" * 20000)
    same("ab cd\n" * 3000 + " ")


def test_bad_bytes_are_replaced():
    ids = np.array([OURS.byte_ids[0xE9], OURS.byte_ids[65]], "<u4").tobytes()
    assert OURS.decode(ids).decode() == THEIRS.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_frame(docs_of):
    docs = docs_of([(1, "Hello there"), (1, "Hello there"), (None, None), (3, "")], bpe="x")
    rows = bpe.encode_column(docs, PATH).select("doc_id", "bpe", "_bpe.*").collect()
    assert len(rows) == 4 and {r["bpe"] for r in rows} == {"x"}
    for r in rows:
        want = THEIRS.encode("Hello there", add_special_tokens=False).ids if r["doc_id"] == 1 else []
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded"] == ("Hello there" if want else "")
    assert bpe.encode_column(docs.limit(0), PATH).count() == 0
