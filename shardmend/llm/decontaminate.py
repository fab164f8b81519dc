"""Benchmark decontamination with DataFrame operations only.

1. Items become weighted sets of five-word shingles (a shingle's weight is how often it occurs). Of each
   document the shingles of items are found by an equi-join. A hit counts in the windows that hold it,
   but not in those that already hold as many of its shingle as the item: so it counts for an interval of
   starts, and a running sum over the interval ends tells which item-sized window holds most of the
   item. That is linear in the hits, however often a passage repeats. This window of each document and
   item that has enough hits, wherever they are, goes on; how much it holds is not asked here.
2. SimHash of these item-sized windows and of each item picks the pairs to compare. Multi-index: of
   RADIUS + 1 blocks of the bits, two fingerprints within the radius share one whole block at least, so
   an equi-join on blocks finds all such pairs of equal size. A window that is farther from the item it
   was cut for is a pair, too, unless they differ in a sure bit: one that so many more of the item's
   shingles have (or lack) that no window of SIMILARITY can differ in it. So no match is lost: short and
   repetitive texts can be similar with fingerprints far apart.
3. Weighted Jaccard similarity of the pairs, exactly; those of SIMILARITY or more are matches.

Words are runs of letters and digits, lower-cased. Items of fewer than five words are one shingle of
all their words; items without a word match nothing. A document shorter than an item is one window.
Null and empty texts match nothing; items without item_id are items all the same. Rows that repeat a
doc_id are one document in the result, with the best of their windows (the last of equally good ones).
Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, spare_name

SHINGLE_WORDS = 5
#: Least similarity as a fraction, and differing bits allowed: 3.6 standard deviations above the mean distance of windows that are just similar enough.
SIMILARITY, RADIUS = (4, 5), 20
#: Rows of a table up to which it is broadcast (they hold a few numbers each, under 100 bytes); larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000

_WORDS = r"regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+', 0)"


def _let(name: str, value: str, body: str) -> str:
    """SQL of body with `name` standing for value, which is evaluated once a row (an alias would be inlined into lambdas, and evaluated for each element)."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _hashes(text: str, k: int) -> str:
    """SQL of the array of hashes of a text's k-word shingles; empty where it has fewer words."""
    parts = ", ".join(f"get(w, i + {j})" if j else "get(w, i)" for j in range(k))
    return _let("w", _WORDS.format(text), f"CASE WHEN size(w) >= {k} THEN transform(sequence(0, size(w) - {k}), i -> xxhash64({parts})) ELSE array() END")


def fingerprint_sql(hashes: str) -> str:
    """SQL of the SimHash of an array of 64-bit hashes, repeats counted."""
    ones = f"aggregate({hashes}, 0, (n, h) -> n + CAST(shiftright(h, b) & 1 AS INT))"
    return f"aggregate(sequence(0, 63), 0L, (f, b) -> f | CASE WHEN 2 * {ones} > size({hashes}) THEN shiftleft(1L, b) ELSE 0L END)"


def sure_sql(hashes: str) -> str:
    """SQL of the bits that an item's SimHash has in common with that of every window of SIMILARITY.

    Of A + B shingles (A <= B, the item's) with I >= up (A + B) / (up + down) in common, A + B - 2 I are in one only. Each moves a bit's lead of ones over noughts by one.
    """
    up, down = SIMILARITY
    lead = f"2 * aggregate({hashes}, 0, (n, h) -> n + CAST(shiftright(h, b) & 1 AS INT)) - size({hashes})"
    moved = f"2 * size({hashes}) * {down - up} div {up + down}"
    return f"aggregate(sequence(0, 63), 0L, (f, b) -> f | CASE WHEN {lead} NOT BETWEEN 1 - {moved} AND {moved} THEN shiftleft(1L, b) ELSE 0L END)"


def common_sql(a: str, b: str) -> str:
    """SQL of the size of the intersection of two arrays as weighted sets; repeats are counted one by one only where both have some."""
    counted = f"aggregate(array_distinct({a}), 0, (n, h) -> n + least(size(filter({a}, x -> x = h)), size(filter({b}, x -> x = h))))"
    return f"CASE WHEN size(array_distinct({a})) = size({a}) OR size(array_distinct({b})) = size({b}) THEN size(array_intersect({a}, {b})) ELSE {counted} END"


def _sized(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has few rows; df is a written table, so counting is cheap."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_table(items: DataFrame, k: int) -> DataFrame:
    """Items with k-word shingles: item_id, m (words), hashes, fp, sure."""
    words = items.select("item_id", "text", F.size(F.expr(_WORDS.format("text"))).alias("m"))
    of_k = words.where(f"m >= {k}") if k == SHINGLE_WORDS else words.where(f"m = {k}")
    rows = of_k.select("item_id", "m", F.expr(_hashes("text", k)).alias("hashes"))
    return rows.select("*", F.expr(fingerprint_sql("hashes")).alias("fp"), F.expr(sure_sql("hashes")).alias("sure"))


def _blocks(fp: str):
    """Array of the RADIUS + 1 blocks of a fingerprint, each masked in place."""
    cuts = [round(64 * n / (RADIUS + 1)) for n in range(RADIUS + 2)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return F.array(*[F.col(fp).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id, similarity, start_word, n_words): the best window of each document for each item it matches."""
    items = items.select("item_id", "text").where("text is not null")
    found = None
    for k in range(1, SHINGLE_WORDS + 1):
        table = materialize(item_table(items, k), "items")
        if k < SHINGLE_WORDS and table.isEmpty():
            continue
        part = _matches_of(docs, table, k)
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("doc_id", "text_key", "item_id").orderBy(F.desc("similarity"), F.desc("start_word"))
    # a document has at most its own windows in such a group
    return found.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def _windows(runs: DataFrame, holders: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_key, m, start, fits, own): the best window of each document and item; own are the keys of the items it was cut for.

    runs: (doc_id, text_key, item_key, m, hits), hits being structs of at, hash and the item's count c of it.
    """
    pair = ["doc_id", "text_key", "item_key", "m"]
    spots = runs.select(*pair, F.explode("hits").alias("x")).groupBy(*pair, "x.hash", "x.c").agg(F.sort_array(F.collect_list("x.at")).alias("p"))
    # of each hit, the place of the hit that is c before it among those of its shingle
    spots = spots.select(*pair, F.explode(F.expr("transform(p, (x, i) -> struct(x AS at, coalesce(get(p, i - CAST(c AS INT)), -1) AS before))")).alias("x"))
    sized = holders.select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"), F.size("h").alias("n"))
    spots = spots.join(sized, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("key_"))).drop("id_", "key_")
    spots = spots.withColumn("f", F.least("n", F.col("m") - (k - 1)))
    spots = spots.select(*pair, "n", "f", F.greatest(F.col("x.before") + 1, F.col("x.at") - F.col("f") + 1, F.lit(0)).alias("lo"), F.least(F.col("x.at"), F.col("n") - F.col("f")).alias("hi")).where("lo <= hi")
    ends = spots.select(*pair, "n", "f", F.explode(F.array(F.struct(F.col("lo").alias("s"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("s"), F.lit(-1).alias("d")))).alias("x"))
    ends = ends.groupBy(*pair, "n", "f", F.col("x.s").alias("s")).agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy(*pair).orderBy("s")
    held = ends.select(*pair, "f", F.sum("d").over(w).alias("both"), (F.lead("s").over(w) - 1).alias("start"))  # the last start that holds so much
    best = held.where("start is not null").groupBy(*pair, "f").agg(F.max(F.struct("both", "start")).alias("x"))
    return best.groupBy("doc_id", "text_key", "m", "x.start", F.col("f").alias("fits")).agg(F.collect_set("item_key").alias("own"))


def _matches_of(docs: DataFrame, table: DataFrame, k: int) -> DataFrame:
    up, down = SIMILARITY
    text = docs.select("doc_id", "text").where("text is not null").withColumn("text_key", F.xxhash64("text"))
    places = text.select("doc_id", "text_key", F.posexplode(F.expr(_hashes("text", k))).alias("at", "hash"))

    keyed = table.select("item_id", "m", "hashes", "fp", "sure", F.xxhash64("item_id", "hashes").alias("item_key"))
    shingles = keyed.select("item_key", "m", "hashes").dropDuplicates(["item_key"]).select("item_key", "m", F.explode("hashes").alias("hash"))
    shingles = materialize(shingles.groupBy("item_key", "m", "hash").agg(F.count(F.lit(1)).alias("c")), "shingles")
    hits = places.join(_sized(shingles), "hash")
    # of one document and item, so bounded by the document's length
    runs = hits.groupBy("doc_id", "text_key", "item_key", "m").agg(F.collect_set(F.struct("at", "hash", "c")).alias("hits"))
    # no window has fewer shingles A than hits I, so I >= up B / down
    runs = materialize(runs.where(F.size("hits") * down >= (F.col("m") - (k - 1)) * up), "runs")

    # Back to the texts of the documents that have enough hits: few, as a rule; a list too long to broadcast is joined by shuffle.
    some = _sized(materialize(runs.select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_")).distinct(), "holding"))
    cut = text.join(some, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("key_")), "left_semi").dropDuplicates(["doc_id", "text_key"])
    cut = materialize(cut.select("doc_id", "text_key", F.expr(_hashes("text", k)).alias("h")), "holders")
    windows = _windows(runs, cut, k).select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"), "m", "start", "fits", "own")
    windows = cut.join(windows, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("key_")))
    windows = windows.select("doc_id", "text_key", "m", "start", "own", F.expr("slice(h, CAST(start AS INT) + 1, fits)").alias("hashes"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = materialize(windows.repartition(n).select("*", F.expr(fingerprint_sql("hashes")).alias("fp")), "windows")

    near = _near(marked, keyed).join(keyed.select("item_key", "item_id", F.col("hashes").alias("item_hashes")).distinct(), "item_key")
    own = [F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"), F.col("m").alias("m_"), F.col("start").alias("start_"), "hashes"]
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("key_")) & (F.col("m") == F.col("m_")) & (F.col("start") == F.col("start_"))
    shared = near.join(marked.select(*own), same).withColumn("both", F.expr(common_sql("hashes", "item_hashes")))
    union = F.size("hashes") + F.size("item_hashes") - F.col("both")
    return shared.where(F.col("both") * down >= union * up).select("doc_id", "text_key", "item_id", (F.col("both") / union).alias("similarity"), F.col("start").cast("int").alias("start_word"), F.col("m").alias("n_words"))


def _near(marked: DataFrame, keyed: DataFrame) -> DataFrame:
    """(doc_id, text_key, m, start, item_key): windows and the items that they may be similar to, by fingerprints; all similar ones are among them.

    The arrays of hashes are fetched for these pairs only.
    """
    pair = ["doc_id", "text_key", "m", "start", "item_key"]
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    index = materialize(keyed.select("item_key", "m", "sure", F.col("fp").alias("item_fp"), F.posexplode(_blocks("fp")).alias("block", "bits")).distinct(), "index")
    probe = marked.select("doc_id", "text_key", "m", "start", "fp", F.posexplode(_blocks("fp")).alias("block", "bits"))
    near = probe.join(_sized(index), ["m", "block", "bits"]).where(F.bit_count(apart) <= RADIUS)
    # a pair is met in each block that it shares: only the first one's row goes on
    first = " AND ".join(f"(block <= {b} OR a[{b}] <> c[{b}])" for b in range(RADIUS))
    near = near.withColumns({"a": _blocks("fp"), "c": _blocks("item_fp")}).where(first).select(*pair)
    # beyond the radius: no block need be shared, but the sure bits are
    far = marked.select("doc_id", "text_key", "start", "fp", F.explode("own").alias("item_key")).join(_sized(index.where("block = 0")), "item_key")
    return near.unionByName(far.where((F.bit_count(apart) > RADIUS) & (apart.bitwiseAND(F.col("sure")) == 0)).select(*pair))


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): one row for each document and item it leaks."""
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("similarity"), F.desc("start_word"), "n_words")
    return matches(docs, items).withColumn("r", F.row_number().over(best)).where("r = 1").select("doc_id", "item_id", "similarity", "start_word", "n_words")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a benchmark passage."""
    key, bad_id, bad_key = spare_name(docs, "text_key"), spare_name(docs, "id_"), spare_name(docs, "key_")
    bad = materialize(matches(docs, items).select(F.col("doc_id").alias(bad_id), F.col("text_key").alias(bad_key)).distinct(), "leaks")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    # leaks are few, as a rule: then no text is shuffled
    return keyed.join(_sized(bad), keyed["doc_id"].eqNullSafe(F.col(bad_id)) & (keyed[key] == F.col(bad_key)), "left_anti").drop(key)
