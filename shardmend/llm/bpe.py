"""Byte-level BPE encoding and decoding.

Encoding: the text is split into pre-tokens, each pre-token's bytes become a doubly linked list of
symbols, and a priority queue of (merge rank, position) joins the lowest rank first; entries whose
pair has changed since they were queued are stale and skipped. Decoding concatenates the vocabulary
strings of the ids. The merge table is broadcast: its size is that of the vocabulary file (about
50,000 entries), whatever the corpus holds.

Nulls encode as the empty text (0 ids). Any text length will do: a pre-token of n bytes costs
O(n log n). Rows are independent, so ties, repeated rows and empty tables need no care.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spare_name

#: Entries of a task's memo of chunks already encoded (some 60 MB).
MEMO_ENTRIES = 300_000
#: Chunks longer than this are encoded afresh each time.
MEMO_CHARS = 40

#: Bits of an id in the key of a pair, and signs that often follow a word.
ID_BITS, SIGNS = 24, frozenset(".,;:!?")

# The pre-token pattern of this byte-level vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where it is a visible Latin-1 sign, else the next free code from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


def load_tables(path: str) -> dict:
    """Read a tokenizer file of the driver's machine into plain tables fit for a broadcast."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    model, vocab = spec["model"], spec["model"]["vocab"]
    if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer"):
        raise ValueError(f"{path}: not a byte-level BPE without normalizer")
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    back = {s: b for b, s in enumerate(byte_symbols())}
    pieces: dict[int, bytes] = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
    special = {}
    for t in spec.get("added_tokens", []):
        if t["lstrip"] or t["rstrip"] or t["single_word"]:
            raise ValueError(f"added token {t['content']!r}: only plain ones are supported")
        special[t["content"]] = t["id"]
        pieces[t["id"]] = t["content"].encode()
    return {
        "left": np.array([vocab[a] for a, _ in pairs], np.int32),
        "right": np.array([vocab[b] for _, b in pairs], np.int32),
        "joined": np.array([vocab[a + b] for a, b in pairs], np.int32),
        "bytes": np.array([vocab[s] for s in byte_symbols()], np.int32),
        "pieces": pieces,
        "special": special,
    }


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class ByteBpe:
    def __init__(self, tables: dict):
        left, right, self.joined = (tables[k].tolist() for k in ("left", "right", "joined"))
        self.rank = {a << ID_BITS | b: rank for rank, (a, b) in enumerate(zip(left, right, strict=True))}
        self.byte_ids = tables["bytes"].tolist()
        self.first = [self.rank.get(x << ID_BITS | y, -1) for x in self.byte_ids for y in self.byte_ids]
        self.pieces = tables["pieces"]
        self.special = tables["special"]
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pre_tokens = regex.compile(PRE_TOKEN).findall
        self.odd_space = re.compile(r" (?:\s|$)").search
        self.after_boundary = re.compile(r"(?= \S)").split
        self.spaced: dict[str, bytes] = {}  # chunk without its leading space -> ids of " " + chunk
        self.words: dict[str, bytes] = {}
        self.old_spaced: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        data = word.encode("utf-8", "surrogatepass")
        ids = [self.byte_ids[c] for c in data]
        n, rank, joined, first = len(ids), self.rank.get, self.joined, self.first
        # the rank of the pair that starts at each place; an entry of the queue is a rank and a place in one number
        now = [first[x << 8 | y] for x, y in zip(data, data[1:], strict=False)]
        bits = n.bit_length()
        queue = [r << bits | i for i, r in enumerate(now) if r >= 0]
        if not queue:
            return ids
        now.append(-1)
        place = (1 << bits) - 1
        before, after = [*range(-1, n - 1)], [*range(1, n + 1)]
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            i, r = entry & place, entry >> bits
            if now[i] != r:
                continue  # stale: one side has been merged since
            j = after[i]
            ids[i] = a = joined[r]
            ids[j] = now[j] = -1
            after[i] = k = after[j]
            now[i] = -1
            if k < n:
                before[k] = i
                now[i] = r = rank(a << ID_BITS | ids[k], -1)
                if r >= 0:
                    push(queue, r << bits | i)
            h = before[i]
            if h >= 0:
                now[h] = r = rank(ids[h] << ID_BITS | a, -1)
                if r >= 0:
                    push(queue, r << bits | h)
        return [x for x in ids if x >= 0]

    def remember(self, memo: dict[str, bytes], key: str, ids: bytes) -> bytes:
        """Two generations: when the young one is full, it takes the place of the old one, from which what is asked for again comes back."""
        if len(key) <= MEMO_CHARS:
            if len(self.words) + len(self.spaced) >= MEMO_ENTRIES // 2:
                self.old_words, self.old_spaced = self.words.copy(), self.spaced.copy()
                self.words.clear()
                self.spaced.clear()
            memo[key] = ids
        return ids

    def word(self, word: str) -> bytes:
        """Ids of a pre-token; one after a space is remembered as the chunk that it would be alone."""
        apart = len(word) > 1 and word[0] == " " and not word[1].isspace()
        memo, old, key = (self.spaced, self.old_spaced, word[1:]) if apart else (self.words, self.old_words, word)
        got = memo.get(key)
        return self.remember(memo, key, old.get(key) or _packed(self.merge(word))) if got is None else got

    def chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.word, self.pre_tokens(chunk)))

    def spaced_chunk(self, rest: str) -> bytes:
        got = self.spaced.get(rest)
        if got is not None:
            return got
        if got := self.old_spaced.get(rest):
            return self.remember(self.spaced, rest, got)
        # letters alone are one pre-token, and so is a sign after them: such chunks are made of what is remembered of the word
        if rest.isalpha():
            if max(rest) < "\u0250":
                return self.remember(self.spaced, rest, _packed(self.merge(" " + rest)))
        elif rest[-1:] in SIGNS and (word := rest[:-1]).isalpha() and max(word) < "\u0250":
            return (self.spaced.get(word) or self.spaced_chunk(word)) + self.word(rest[-1])
        return self.remember(self.spaced, rest, self.chunk(" " + rest))

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens, as little-endian 32-bit integers.

        No pre-token holds a space before its last place but at its start, and a single space before
        other text always starts one. So the text may be cut before such spaces, and each piece remembered.
        """
        if self.odd_space(text):
            out = []
            for piece in self.after_boundary(text):
                if len(piece) > 1 and piece[0] == " " and not piece[1].isspace():
                    out.append(self.spaced_chunk(piece[1:]))
                elif piece:
                    out.append(self.chunk(piece))
            return b"".join(out)
        first, *rest = text.split(" ")
        known = self.spaced.get
        parts = [known(p) or self.spaced_chunk(p) for p in rest]
        return self.chunk(first) + b"".join(parts)

    def encode(self, text: str) -> bytes:
        if not self.split_special or not self.split_special.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += [self.plain(text[at : m.start()]), int(self.special[m[0]]).to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 bytes of the decoded text; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()
        return raw


#: What encode_column can return of a text.
FIELDS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>", "decoded": "string"}


def encode_column(docs: DataFrame, tokenizer_path: str, text: str = "text", fields: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
    """docs with a struct column `bpe` of the fields asked for.

    The column takes another name (leading underscores) where docs already has a `bpe`.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tables = spark.sparkContext.broadcast(load_tables(tokenizer_path))

    @F.pandas_udf(", ".join(f"{f} {FIELDS[f]}" for f in fields))
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = ByteBpe(tables.value)  # its memos end with the task
        make = {
            "n_tokens": lambda ids: len(ids) // 4,
            "ids_sha256": lambda ids: hashlib.sha256(ids).hexdigest(),
            "decoded_sha256": lambda ids: hashlib.sha256(bpe.decode(ids)).hexdigest(),
            "ids": lambda ids: np.frombuffer(ids, "<i4"),
            "decoded": lambda ids: bpe.decode(ids).decode(),
        }
        for texts in batches:
            coded = [bpe.encode(t or "") for t in texts]
            yield pd.DataFrame({f: pd.Series([make[f](ids) for ids in coded], dtype="int64" if f == "n_tokens" else object) for f in fields})

    return docs.withColumn(spare_name(docs, "bpe"), encoded(F.col(text)))
