import random
import re

import numpy as np
import xxhash
from shardmend.llm import simhash


def brute_fp(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    for t in (None, "", " \n", "One", "one two", "A b c", "a b c d É e É", "x\x1cy z q\x0br\x0cs", "word " * 5000, "a\xa0b c d"):
        assert simhash.fingerprint(t) & (1 << 64) - 1 == brute_fp(t), t


def clusters(rng, n):
    out = []
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.choice((1, 1, 2, 40))):
            x = base
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return out[:n]


def test_trie_is_all_pairs():
    rng = random.Random(1)
    for n, radius in ((0, 3), (1, 3), (700, 3), (500, 6), (300, 0), (400, 12)):
        x = np.unique(np.array(clusters(rng, n), np.uint64))
        want = {(i, j) for j in range(len(x)) for i in range(j) if int(x[i] ^ x[j]).bit_count() <= radius}
        got = simhash.trie_pairs(x, radius) if len(x) else []
        assert len(got) == len(set(got)) and set(got) == want
        if len(x):
            assert simhash.trie_components(x, radius).tolist() == brute_components(x.tolist(), radius)


def test_masks_lose_nothing():
    rng = random.Random(2)
    for radius in simhash.BLOCKS:
        ms = [m & (1 << 64) - 1 for m in simhash.masks(radius)]
        for _ in range(300):
            d = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not d & m for m in ms)


def test_components_on_a_frame(spark, docs_of, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT_AT", 32)  # so that groups of this small table are split, too
    monkeypatch.setattr(simhash, "SAMPLE", 2)
    rng = random.Random(4)
    fps = clusters(rng, 900)
    fps += [fps[0]] * 20  # exact copies
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    ids = list(range(len(fps)))
    rng.shuffle(ids)
    for radius in (3, 6):
        got = simhash.classes(spark.createDataFrame([*zip(ids, signed, strict=True), (None, signed[0])], "doc_id long, fp long"), radius).collect()
        root = brute_components(fps, radius)
        least = {}
        for i, r in zip(ids, root, strict=True):
            least[r] = min(least.get(r, i), i)
        want = {(i, f"{x:016x}", least[r]) for i, x, r in zip(ids, fps, root, strict=True)} | {(None, f"{fps[0]:016x}", least[root[0]])}
        assert len(got) == len(want) and set(map(tuple, got)) == want


def test_chain_of_links(spark):
    """A path graph and a hub: components must close over many rounds."""
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + k) for k in range(1, 200)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 61 + 200 and len({got[i] for i in range(61)}) == 1 and len({got[1000 + k] for k in range(200)}) == 1 and len(set(got.values())) == 2
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(docs_of):
    base = " ".join(f"w{k}" for k in range(300))
    near = base.replace("w150", "other")
    rows = [(5, base), (3, near), (7, base), (7, base), (9, "quite another text of words here"), (None, base), (1, None), (2, ""), (4, "one"), (4, "one"), (8, "One")]
    docs = docs_of(rows, fp="x", component_id="y")
    got = simhash.near_duplicates(docs).collect()
    fps = [brute_fp(t) for _, t in rows]
    root = brute_components(fps, 3)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = sorted(((i, f"{x:016x}", least[r]) for (i, _), x, r in zip(rows, fps, root, strict=True)), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted({least[r] for r in root} | {None}, key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.one_of_each(docs.limit(0)).count() == 0
