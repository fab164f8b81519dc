import random
import re
import time
from collections import Counter

from shardmend.llm import decontaminate, stages


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items):
    """Every item-sized window of every document."""
    out = {}
    for d, text in docs:
        w = words(text)
        for i, passage in items:
            v = words(passage)
            if not v:
                continue
            k = min(5, len(v))
            bag = lambda x, k=k: Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
            want = bag(v)
            for start in range(max(0, len(w) - len(v)) + 1):
                got = bag(w[start : start + len(v)])
                common = sum((got & want).values())
                union = sum((got | want).values())
                if common and common * 5 >= union * 4:
                    key, row = (d, i), (-common / union, -start, len(v))
                    out[key] = min(out.get(key, row), row)
    return {(d, i, -s, -start, n) for (d, i), (s, start, n) in out.items()}


def made(seed=4):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(text(rng.choice((2, 4, 5, 9, 30, 60, 60))))) for k in range(25)]
    items += [(100, items[0][1]), (101, ""), (102, None), (103, "!!"), (104, "a b a b a b a b a b a b a b"), (None, " ".join(text(20)))]
    docs = []
    for d in range(160):
        w = text(rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            p = words(rng.choice([p for _, p in items if p]))
            for _ in range(rng.choice((0, 0, 1, 2, 3))):
                if not p:
                    break
                at = rng.randrange(len(p))
                p = rng.choice((p[:at] + ["new"] + p[at:], p[:at] + p[at + 1 :], p[:at] + ["new"] + p[at + 1 :]))
            at = rng.randint(0, len(w))
            w[at:at] = p
        docs.append((d, rng.choice((" ", ", ", " — ")).join(x.upper() if rng.random() < 0.1 else x for x in w)))
    docs += [(200, items[8][1]), (201, (items[8][1] + " ") * 40), (202, "a b " * 300), (203, None), (204, "")]
    return docs, items


def test_against_brute_force(spark, docs_of):
    docs, items = made()
    frame = docs_of(docs + docs[:5], text_key="x", item_id="y")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, m int")
    want = brute(docs, items)
    assert len(want) > 60 and any(s < 1 for _, _, s, _, _ in want)
    got = decontaminate.leaks(frame, bench)
    assert "Python" not in (plan := got._jdf.queryExecution().toString()) and "Arrow" not in plan
    rows = set(map(tuple, got.collect()))
    assert rows == want
    left = decontaminate.clean(frame, bench)
    assert left.columns == frame.columns
    leaked = {w[0] for w in want}
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in docs + docs[:5] if d not in leaked)


def test_null_ids_and_empty_tables(spark, docs_of):
    passage = " ".join(f"x{k}" for k in range(20))
    frame = docs_of([(None, passage), (None, "clean text"), (1, passage), (1, "other")])
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    assert {tuple(r)[:2] for r in decontaminate.leaks(frame, bench).collect()} == {(None, 7), (1, 7)}
    assert sorted(r.text for r in decontaminate.clean(frame, bench).collect()) == ["clean text", "other"]
    assert decontaminate.leaks(frame.limit(0), bench).count() == 0
    assert decontaminate.clean(frame, bench.limit(0)).count() == 4


def test_long_text_of_repeated_passages(spark, docs_of):
    """20,000 words of one passage over and over: the work is linear in the hits."""
    rng = random.Random(8)
    passage = " ".join(f"w{rng.randrange(5000)}" for _ in range(300))
    docs = docs_of([(1, " ".join([passage] * 67)), (2, " ".join(f"w{rng.randrange(5000)}" for _ in range(20_000)))])
    bench = spark.createDataFrame([(7, passage), (8, "other words that no document holds at all")], "item_id long, text string")
    began = time.time()
    rows = [tuple(r) for r in decontaminate.leaks(docs, bench).collect()]
    assert rows == [(1, 7, 1.0, 66 * 300, 300)] and time.time() - began < 60


def test_clean_keeps_clashing_columns(spark, docs_of):
    docs = docs_of([(1, "one two three four five six"), (2, "nothing of the kind is here")], id_="x", key_="y", text_key="z")
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    out = decontaminate.clean(docs, bench)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [2]


def far_apart():
    """Documents as similar as asked whose fingerprints are farther apart than the radius, at times: repetitive, or shorter than the item."""
    rng = random.Random(3)
    items = [(1, "a b a b a b a b a b a b a"), (2, "c d e c d e c d e c d e c d e c d")]
    docs = [(1, "b a b a b a b a b a b a b"), (2, "x y z b a b a b a b a b a b a b q r s"), (3, "d e c d e c d e c d e c d e c d e"), (4, "x y z a b c d e"), (5, None)]
    for k in range(10, 410):
        w = [f"w{rng.randrange(100_000)}" for _ in range(9)]
        items.append((k, " ".join(w)))
        docs.append((k, " ".join(w[:8])))
    return docs, items


def test_similar_windows_with_distant_fingerprints(spark, docs_of, tmp_path):
    docs, items = far_apart()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {r for d in docs for r in brute([d], [i for i in items if i[0] in (1, 2, d[0])])}
    assert {(1, 1, 0.8, 0, 13), (10, 10, 0.8, 0, 9)} <= want and len(want) == 403
    assert set(map(tuple, decontaminate.leaks(docs_of(docs), bench).collect())) == want
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    left = stages.drop_contaminated(spark, docs_of(docs), str(tmp_path))
    assert sorted(r.doc_id for r in left.collect()) == [4, 5]


def test_fingerprints_pick_the_pairs(spark, docs_of, monkeypatch):
    """Windows go to the fingerprints whatever they hold; only pairs that these let through are compared, all similar ones among them."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(5000)}"
    items = [(k, " ".join(word() for _ in range(60))) for k in range(20)]
    other = lambda: " ".join(word() for _ in range(200))
    docs = []
    for k, p in items:
        w = p.split()
        docs.append((k, f"{other()} {' '.join(w[:30] + [word()] + w[31:])} {other()}"))
        docs.append((100 + k, f" {other()} ".join(" ".join(w[n : n + 20]) for n in (0, 20, 40))))  # enough hits, in no one window
    seen, near = [], decontaminate._near

    def spy(marked, keyed):
        out = near(marked, keyed)
        if marked.count():
            seen.append(({r.doc_id for r in marked.collect()}, [(r.doc_id, r.item_key) for r in out.collect()]))
        return out

    monkeypatch.setattr(decontaminate, "_near", spy)
    got = set(map(tuple, decontaminate.leaks(docs_of(docs), spark.createDataFrame(items, "item_id long, text string")).collect()))
    assert got == brute(docs, items) and {(d, i) for d, i, *_ in got} == {(k, k) for k in range(20)}
    ((cut, pairs),) = seen
    assert cut == {d for d, _ in docs} and set(range(20)) <= {d for d, _ in pairs} and len(pairs) == len(set(pairs)) < 32


def test_sure_bits(spark):
    """No window of an item's size, or shorter, that is similar enough differs from it in a sure bit; and there are such bits."""
    rng = random.Random(9)
    h = lambda: rng.getrandbits(64) - (1 << 63)
    rows = []
    for b in [1, 2, 4, 5, 9, 10, 18, 41, 56]:
        for _ in range(40):
            pool = [h() for _ in range(min(b, rng.choice((1, 2, b, b))))]
            item = [rng.choice(pool) for _ in range(b)] if len(pool) < b else pool
            kept = rng.randint((4 * b + 4) // 5, b)
            size = rng.randint(kept, b)
            window = rng.sample(item, kept) + [rng.choice([h(), rng.choice(item)]) for _ in range(size - kept)]
            common = sum((Counter(item) & Counter(window)).values())
            if common * 5 >= 4 * (b + len(window) - common):
                rows.append((item, window))
    df = spark.createDataFrame(rows, "i array<bigint>, w array<bigint>")
    fp, sure = decontaminate.fingerprint_sql, decontaminate.sure_sql
    got = df.selectExpr("size(i) n", f"{sure('i')} sure", f"({fp('i')} ^ {fp('w')}) apart").collect()
    assert len(got) > 150 and all(r.sure & r.apart == 0 for r in got)
    assert all(r.sure == -1 for r in got if r.n < 5) and sum(r.sure != 0 for r in got) > len(got) / 2
    assert max((r.apart & (1 << 64) - 1).bit_count() for r in got) > decontaminate.RADIUS
