"""SimHash near-duplicates: a binary trie self-join under a Hamming error budget, and its components.

1. Each text's fingerprint: word shingles, XXH64 with seed 42 each, majority of every bit.
2. Distinct fingerprints are dealt by masks: with the 64 bits cut into `blocks` blocks, two
   fingerprints within `radius` bits agree on blocks - radius whole blocks at least, so each choice of
   that many blocks is a key. Nothing within the radius is lost, whatever the data.
3. The fingerprints of a key form a binary trie (a sorted array, nodes being ranges). Node pairs are
   walked together, differing bits accumulate, and a pair is dropped once they exceed the radius. A
   task returns a spanning star of each component it finds, never all pairs.
   Keys that many fingerprints share are found by a sample and dealt as pairs of sub-blocks, so no
   task holds an unbounded group, and every pair still meets.
4. Components of the links: alternating large and small stars, each round written to the shared folder.

one_of_each, which drops documents, takes fingerprints of a text's distinct words (an edit changes one
word, but as many shingles as a shingle has words) for candidates, and links distinct texts only if
their exact five-word similarity is VERIFIED or more. Each pair of near fingerprints is looked at in
one group; pairs already joined are skipped; the rest is filtered by sketches, then verified.

Null and empty texts have fingerprint zero and are linked like any other. Texts of any length are read whole. Rows that repeat a doc_id
each get a row. Null doc_ids are never a component's name unless all its documents have none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, spare_name

SHINGLE_WORDS, SEED, RADIUS = 3, 42, 3
#: Blocks of the 64 bits for a radius: enough that radius + 2 or more blocks make selective keys.
BLOCKS = {3: 5, 4: 6, 5: 8, 6: 9}
#: A key with about this many fingerprints is split; one row in SAMPLE is counted to find such keys.
SPLIT_AT, SAMPLE = 1024, 16
LEAF = 64
#: Words of the shingles, and the Jaccard similarity, by which near texts are verified before one is dropped.
VERIFIED_WORDS, VERIFIED = 5, 0.8
#: Rounds in which each text proposes one candidate, of so many neighbours on either side, before all pairs left are verified.
BEST_ROUNDS, WINDOW = 2, 16
#: Bits of a sketch of a text's five-word shingles, and how many must agree before a pair is verified exactly. At a
#: similarity of 0.8 nine tenths agree; the bound is 3.5 standard deviations below, so about one such pair in 4,000 is missed.
SKETCH_BITS, SKETCH_LEAST = 512, 437
#: Ids up to which a list of dropped documents is broadcast.
BROADCAST_ROWS = 500_000

_SKETCH_FACTORS = np.random.default_rng(11).integers(0, 1 << 63, SKETCH_BITS, np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the shingles, repeats included. bytes.split() parts words at \\x20 and \\x09-\\x0D alone."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return np.empty(0, np.uint64)
    one = xxhash.xxh64_intdigest
    parts = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.fromiter((one(p, SEED) for p in parts), np.uint64)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, distinct: bool = False) -> int:
    """As a signed 64-bit integer; of distinct shingles, or with repeats."""
    h = shingle_hashes(text, words)
    if distinct:
        h = np.unique(h)
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(h), bitorder="little")
    return int(bits.view(np.int64)[0])


def with_fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, distinct: bool = False, text: str = "text", name: str = "fp") -> DataFrame:
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, words, distinct) for t in texts], dtype="int64")

    return docs.withColumn(name, fp(F.col(text)))


def masks(radius: int) -> list[int]:
    """Bit masks, as signed integers, one of which any two fingerprints within the radius agree on."""
    n = BLOCKS[radius]
    cuts = [round(64 * k / n) for k in range(n + 1)]
    block = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    out = [sum(c) for c in combinations(block, n - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


# --- the trie, within a task ----------------------------------------------------------------------


def leaf_pairs(x: np.ndarray, radius: int, done=lambda a, b, c, d: False) -> Iterator[tuple[int, int, int, int]]:
    """Pairs of small nodes (ranges of the sorted array x) that may hold fingerprints within the radius.

    done(lo, hi, lo2, hi2) may tell that a pair of nodes needs no look.
    """

    def depth(lo: int, hi: int) -> int:
        """Bits that all of a node share, from the top."""
        return 64 - int(x[lo] ^ x[hi - 1]).bit_length()

    def halves(lo: int, hi: int, bit: int) -> tuple:
        """A node's children at this bit; one that has no fork there stays whole."""
        value = (int(x[hi - 1]) >> (63 - bit) << (63 - bit)) if bit < 64 else 0
        mid = lo + int(np.searchsorted(x[lo:hi], np.uint64(value)))
        return ((lo, mid), (mid, hi)) if lo < mid else ((lo, hi),)

    stack = [(0, len(x), 0, len(x))]
    while stack:
        lo, hi, lo2, hi2 = stack.pop()
        if done(lo, hi, lo2, hi2):
            continue
        if (hi - lo) * (hi2 - lo2) <= LEAF * LEAF:
            yield lo, hi, lo2, hi2
            continue
        if (lo, hi) == (lo2, hi2):
            a = halves(lo, hi, depth(lo, hi))
            if len(a) == 1:  # equal fingerprints: cut by place
                mid = (lo + hi) // 2
                a = ((lo, mid), (mid, hi))
            (l0, h0), (l1, h1) = a
            stack += [(l0, h0, l0, h0), (l1, h1, l1, h1)]
            pairs = [(l0, h0, l1, h1)]
        else:
            d, d2 = depth(lo, hi), depth(lo2, hi2)
            bit = min(d, d2)
            if bit >= 64:
                yield lo, hi, lo2, hi2
                continue
            first = halves(lo, hi, bit) if d == bit else ((lo, hi),)
            second = halves(lo2, hi2, bit) if d2 == bit else ((lo2, hi2),)
            pairs = [(*p, *q) for p in first for q in second]
        for p in pairs:
            shared = min(depth(p[0], p[1]), depth(p[2], p[3]))
            differ = int(x[p[0]] ^ x[p[2]]) >> (64 - shared) if shared else 0
            if differ.bit_count() <= radius:
                stack.append(p)


def trie_pairs(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Places i < j of the sorted distinct fingerprints that are within the radius."""
    out = []
    for lo, hi, lo2, hi2 in leaf_pairs(fps, radius):
        i, j = np.nonzero(np.bitwise_count(fps[lo:hi, None] ^ fps[None, lo2:hi2]) <= radius)
        i, j = i + lo, j + lo2
        keep = i < j if (lo, hi) == (lo2, hi2) else np.ones(len(i), bool)
        out += zip(np.minimum(i, j)[keep].tolist(), np.maximum(i, j)[keep].tolist(), strict=True)
    return out


def trie_components(fps: np.ndarray, radius: int) -> np.ndarray:
    """Of each place of the sorted array, the first place of its component. Nodes already in one component are not compared."""
    label = np.arange(len(fps))

    def done(lo: int, hi: int, lo2: int, hi2: int) -> bool:
        t = label[lo]
        return bool((label[lo:hi] == t).all() and (label[lo2:hi2] == t).all()) and hi - lo + hi2 - lo2 > 2

    for lo, hi, lo2, hi2 in leaf_pairs(fps, radius, done):
        near = np.bitwise_count(fps[lo:hi, None] ^ fps[None, lo2:hi2]) <= radius
        while True:
            open_ = near & (label[lo:hi, None] != label[None, lo2:hi2])
            k = int(open_.argmax())
            i, j = divmod(k, hi2 - lo2)
            if not open_[i, j]:
                break
            a, b = label[lo + i], label[lo2 + j]
            label[label == max(a, b)] = min(a, b)
    return label


def _stars(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Spanning stars of the components in each group of equal keys (rows are sorted by key)."""
    a, b = [], []
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    size = np.diff(edges)
    two = edges[:-1][size == 2]  # most groups: compared all at once
    x, y = fps[two], fps[two + 1]
    near = (np.bitwise_count(x ^ y) <= radius) & (x != y)
    a.append(np.maximum(x, y)[near])
    b.append(np.minimum(x, y)[near])
    for lo, n in zip(edges[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
        x = np.unique(fps[lo : lo + n])
        label = trie_components(x, radius)
        far = label != np.arange(len(x))
        a.append(x[far])
        b.append(x[label[far]])
    return a, b


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), links between distinct fingerprints of column fp that span the components within the radius."""
    def made(keys: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        a, b = map(np.concatenate, _stars(keys, fp, radius))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)}).drop_duplicates()

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, pdf in _whole_groups(batches):
            yield made(keys, pdf.fp.to_numpy().view(np.uint64))

    return _dealt(fps.select("fp"), radius).mapInPandas(join, "a long, b long").distinct()


def _whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, pd.DataFrame]]:
    """Batches sorted by g, cut so that no group of equal g is parted."""
    held = None
    for pdf in batches:
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        keys = held.g.to_numpy()
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last group may go on in the next batch
        if cut:
            yield keys[:cut], held[:cut]
            held = held[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield held.g.to_numpy(), held


def _dealt(fps: DataFrame, radius: int) -> DataFrame:
    """Rows of fps (column fp, others go along) with a group g for each mask t, in partitions sorted by g.

    Keys that many rows share are cut into sub-blocks: each pair of them is a group, so that no task holds
    an unbounded group and every pair still meets. `sub` is a row's own block, `apart` whether its group is of two blocks.
    """
    spark = fps.sparkSession
    others = [c for c in fps.columns if c != "fp"]
    keyed = lambda df: df.select("fp", *others, F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(radius)])).alias("t", "key"))
    named = [c for c in others if c != "sketch"]
    sampled = keyed(fps.where(F.pmod(F.xxhash64(F.lit(5), "fp", *named), F.lit(SAMPLE)) == 0))
    # Groups this large are few (distinct fingerprints x masks / SPLIT_AT at most); Spark broadcasts them only below its threshold.
    hot = sampled.groupBy("t", "key").count().where(F.col("count") >= SPLIT_AT * 3 // (SAMPLE * 4)).select("t", "key", F.ceil(F.col("count") * SAMPLE / SPLIT_AT).cast("int").alias("parts"))
    hot = materialize(hot, "hot")
    rows = keyed(fps).join(hot, ["t", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    sub = F.pmod(F.xxhash64(F.lit(7), "fp", *named), F.col("parts")).cast("int")
    rows = rows.withColumn("sub", sub).select("fp", *others, "t", "key", "sub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    group = F.xxhash64("t", "key", F.least("sub", "other"), F.greatest("sub", "other"))  # two groups that share a hash are compared in vain, no more
    rows = rows.select("fp", *others, "t", "sub", (F.col("sub") != F.col("other")).alias("apart"), group.alias("g"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "g").sortWithinPartitions("g")


# --- near duplicates verified by their shingles ---------------------------------------------------


def sketch(shingles: np.ndarray) -> bytes:
    """SKETCH_BITS one-bit min-wise hashes of a set: of two sets of Jaccard similarity j, (1 + j) / 2 of the bits agree."""
    if not len(shingles):
        return bytes(SKETCH_BITS // 8)
    h = shingles.view(np.uint64)
    with np.errstate(over="ignore"):
        least = np.array([(h * a).min() for a in _SKETCH_FACTORS], np.uint64)
        return np.packbits(((least * _SKETCH_MIX) >> np.uint64(63)).astype(bool)).tobytes()


def _first_mask(x: np.ndarray, radius: int) -> np.ndarray:
    """Of differences of fingerprints, the number of the first mask on which they agree: the one group in which a pair is looked at."""
    found = np.full(len(x), -1)
    for t, m in reversed([*enumerate(masks(radius))]):
        found[(x & np.uint64(m & (1 << 64) - 1)) == 0] = t
    return found


def _candidates(nodes: DataFrame, radius: int, best: bool) -> DataFrame:
    """(a, b, la, lb), a < b: pairs of nodes (fp, node, label, sketch) within the radius, of different labels and with sketches near enough.

    All of them; or, where only the best are asked for, of each node the one with the nearest sketch of
    WINDOW neighbours on either side in the order of the trie, which costs no square of a group.
    """

    def checked(pdf: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        """Pairs of places that qualify, once in all groups."""
        fp, label, node = pdf.fp.to_numpy().view(np.uint64), pdf.label.to_numpy(), pdf.node.to_numpy()
        x = fp[i] ^ fp[j]
        ok = (np.bitwise_count(x) <= radius) & (label[i] != label[j]) & (node[i] != node[j])
        ok &= ~pdf.apart.to_numpy()[i] | (pdf["sub"].to_numpy()[i] != pdf["sub"].to_numpy()[j])
        i, j, x = i[ok], j[ok], x[ok]
        if len(i):
            first = _first_mask(x, radius) == pdf["t"].to_numpy()[i]
            i, j = i[first], j[first]
        agree = np.zeros(len(i), np.int64)
        for at in range(0, len(i), 1 << 16):
            part = slice(at, at + (1 << 16))
            u, v = (np.frombuffer(b"".join(pdf.sketch.iloc[k[part]]), np.uint64).reshape(-1, SKETCH_BITS // 64) for k in (i, j))
            agree[part] = SKETCH_BITS - np.bitwise_count(u ^ v).sum(axis=1, dtype=np.int64)
        ok = agree >= SKETCH_LEAST
        i, j = i[ok], j[ok]
        return pd.DataFrame({"u": node[i], "v": node[j], "lu": label[i], "lv": label[j], "agree": agree[ok]})

    def neighbours(keys: np.ndarray, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        order = np.lexsort((pdf.fp.to_numpy().view(np.uint64), keys))
        pdf, keys, out = pdf.iloc[order].reset_index(drop=True), keys[order], []
        for s in range(1, WINDOW + 1):
            i = np.flatnonzero(keys[s:] == keys[:-s])
            if not len(i):
                break
            out.append(checked(pdf, i, i + s))
        if out:
            found = pd.concat(out, ignore_index=True)
            both = pd.concat([found, found.rename(columns={"u": "v", "v": "u", "lu": "lv", "lv": "lu"})[found.columns]], ignore_index=True)
            yield both.sort_values(["u", "agree", "v"], ascending=[True, False, True]).drop_duplicates("u")

    def all_of(keys: np.ndarray, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        order = np.lexsort((pdf.fp.to_numpy().view(np.uint64), keys))
        pdf, keys = pdf.iloc[order].reset_index(drop=True), keys[order]
        fp, label = pdf.fp.to_numpy().view(np.uint64), pdf.label.to_numpy()
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        size = np.diff(edges)
        i, j = [edges[:-1][size == 2]], [edges[:-1][size == 2] + 1]  # most groups: compared all at once
        held = len(i[0])
        for lo, n in zip(edges[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = label[lo : lo + n]
            done = lambda a, z, a2, z2, own=own: bool((own[a:z] == own[a]).all() and (own[a2:z2] == own[a]).all())
            for a, z, a2, z2 in leaf_pairs(fp[lo : lo + n], radius, done):
                step = max(1, (1 << 20) // (z2 - a2))  # a node of equal fingerprints may be large
                for at in range(a, z, step):
                    to = min(z, at + step)
                    x, y = np.nonzero((np.bitwise_count(fp[lo + at : lo + to, None] ^ fp[None, lo + a2 : lo + z2]) <= radius) & (own[at:to, None] != own[None, a2:z2]))
                    x, y = x + lo + at, y + lo + a2
                    once = x < y if (a, z) == (a2, z2) else np.ones(len(x), bool)
                    i.append(x[once])
                    j.append(y[once])
                    held += len(i[-1])
                    if held > 1 << 18:
                        yield checked(pdf, np.concatenate(i), np.concatenate(j))
                        i, j, held = [], [], 0
        if i:
            yield checked(pdf, np.concatenate(i), np.concatenate(j))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, pdf in _whole_groups(batches):
            yield from (neighbours if best else all_of)(keys, pdf)

    pairs = _dealt(nodes.select("fp", "node", "label", "sketch"), radius).mapInPandas(join, "u long, v long, lu long, lv long, agree int")
    if best:
        top = F.max(F.struct("agree", (-F.col("v")).alias("_"), "v", "lu", "lv")).alias("p")
        pairs = pairs.groupBy("u").agg(top).select("u", "p.v", "p.lu", "p.lv")
    turned = F.col("u") > F.col("v")
    of = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    return pairs.select(of("u", "v").alias("a"), of("v", "u").alias("b"), of("lu", "lv").alias("la"), of("lv", "lu").alias("lb")).distinct()


def _described(texts: DataFrame) -> DataFrame:
    """(node, shingles, sketch) of each (node, text): the distinct hashes of its five-word shingles, and their sketch."""

    @F.pandas_udf("shingles array<long>, sketch binary")
    def described(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in batches:
            sets = [np.unique(shingle_hashes(t, VERIFIED_WORDS)) for t in part]
            yield pd.DataFrame({"shingles": pd.Series([x.view(np.int64) for x in sets], dtype=object), "sketch": pd.Series([sketch(x) for x in sets], dtype=object)})

    return texts.select("node", described("text").alias("d")).select("node", "d.*")


def _verified(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """The pairs (a, b, la, lb) whose texts are similar enough."""
    of = lambda n: shingles.select(F.col("node").alias(n), F.col("shingles").alias(f"of_{n}"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    similar = both >= F.lit(VERIFIED) * (F.size("of_a") + F.size("of_b") - both)
    return pairs.join(of("a"), "a").join(of("b"), "b").where(similar).select("a", "b", "la", "lb")


def verified_components(texts: DataFrame, nodes: DataFrame, radius: int) -> DataFrame:
    """(node, root) of the components of nodes (fp, node), linked by pairs within the radius whose texts (node, text) are similar enough.

    The links of near_duplicates tell which nodes have a near one at all; only those go on. Rounds in
    which each node proposes its best neighbour join most of a family of copies; the last round looks at
    all pairs that are still apart.
    """
    shared = nodes.groupBy("fp").count().where("count > 1").select("fp")
    linked = materialize(links(nodes.select("fp").distinct(), radius), "links")
    near = linked.select(F.col("a").alias("fp")).union(linked.select("b")).union(shared).distinct()
    near = materialize(nodes.join(near, "fp", "left_semi"), "near")
    described = materialize(_described(texts.join(near.select("node"), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))), "described")
    nodes = materialize(near.join(described.select("node", "sketch"), "node").select("fp", "node", F.col("node").alias("label"), "sketch"), "nodes")
    tried = None
    for best in [*[True] * BEST_ROUNDS, False]:
        pairs = _candidates(nodes, radius, best)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "candidates")
        if pairs.isEmpty():
            continue
        tried = pairs.select("a", "b") if tried is None else tried.union(pairs.select("a", "b"))
        found = materialize(_verified(pairs, described).select(F.col("la").alias("a"), F.col("lb").alias("b")), "verified")
        if found.isEmpty():
            continue
        # the graph is contracted: its nodes are the labels so far
        roots = components(found).select(F.col("node").alias("label"), "root")
        nodes = materialize(nodes.join(roots, "label", "left").select("fp", "node", F.coalesce("root", "label").alias("label"), "sketch"), "nodes")
    return nodes.select("node", F.col("label").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is one node of its component, the same for all.

    Alternating large-star and small-star: a logarithmic number of rounds in practice, each of them
    aggregations with partial results and joins that AQE can split at a hub; no node's neighbours
    are ever gathered.
    """

    def linked(df: DataFrame, a, b) -> DataFrame:
        return df.select(a.alias("a"), b.alias("b")).where("a <> b").distinct()

    e = materialize(linked(edges, F.greatest("a", "b"), F.least("a", "b")), "links")
    state = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = linked(both.join(low, "u").where("v > u"), F.col("v"), F.col("m"))
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        near = large.withColumnRenamed("a", "u").join(low, "u")
        small = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
        e = materialize(linked(small, F.greatest("a", "b"), F.least("a", "b")), "links")
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state or not now[0]:
            break
        state = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of docs."""
    marked = materialize(with_fingerprints(docs.select("doc_id", "text"), words).select("doc_id", "fp"), "fingerprints")
    return classes(marked, radius)


def classes(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of rows (doc_id, fp), fp from with_fingerprints."""
    firsts = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(links(firsts.select("fp"), radius)).withColumnRenamed("node", "fp")
    roots = materialize(roots, "roots")
    names = roots.join(firsts, "fp").groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = roots.join(names, "root").select("fp", "component_id")
    named = firsts.join(named, "fp", "left").select(F.col("fp").alias("fp_"), F.coalesce("component_id", "first_id").alias("component_id"))
    # A fingerprint that many documents share is one row on the right; AQE splits its rows on the left,
    # which it does only where both sides of the join are read right after their exchange.
    named = materialize(named, "named")
    out = marked.join(named.hint("merge"), F.col("fp") == F.col("fp_"), "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one document of each component of verified near duplicates: its smallest doc_id (of rows that repeat it, one). Documents without doc_id stay.

    Null and empty texts are copies of each other. Texts of any length are compared whole; extra columns go along.
    """
    texts = with_nodes(docs.select("doc_id", "text"))
    marked = materialize(with_fingerprints(texts, 1, distinct=True).select("doc_id", "node", "fp"), "fingerprints")
    firsts = materialize(marked.groupBy("node", "fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = verified_components(texts.select("node", "text"), firsts.select("fp", "node"), radius)
    names = roots.join(firsts, "node").groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = roots.join(names, "root").select("node", "component_id")
    named = firsts.join(named, "node", "left").select(F.col("node").alias("node_"), F.coalesce("component_id", "first_id").alias("component_id"))
    named = materialize(named, "named")  # as in classes
    found = marked.join(named.hint("merge"), F.col("node") == F.col("node_"), "left")
    gone = spare_name(docs, "gone_id")
    drop = materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct(), "dropped")
    # Rows that repeat a kept doc_id: all but one of them go, too.
    twice = marked.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(gone))
    twice = materialize(twice.join(drop, gone, "left_anti"), "repeated")
    kept = docs.join(_sized(drop.union(twice)), docs["doc_id"] == F.col(gone), "left_anti")
    if twice.isEmpty():
        return kept
    return kept.unionByName(docs.join(_sized(twice), docs["doc_id"] == F.col(gone), "left_semi").dropDuplicates(["doc_id"]))


def with_nodes(docs: DataFrame) -> DataFrame:
    """docs with a column node: a hash of the words of its text, the same for all copies."""
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.withColumn("node", F.xxhash64(F.trim(F.regexp_replace(lower, r"[\x09-\x0D ]+", " "))))


def _sized(ids: DataFrame) -> DataFrame:
    """Broadcast if it has few rows (it reads written tables, so counting is cheap); else joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids

