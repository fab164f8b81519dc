import random

import __spark_entry__
import corpus_pipeline
import public_tokenizers
import pytest
from shardmend.llm import simhash, stages
from tokenizers import Tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Tables with one of each case the pipeline must catch, and clean documents."""
    rng = random.Random(2)
    vocab = [f"word{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows, labels, items = [], [], [(k, text(40)) for k in range(5)]
    for d in range(400):
        bad = d % 5 == 0
        t = text(rng.randint(120, 300))
        rows.append((d, t + " vilest" * 3 * bad))
        labels.append((d, 1, int(bad)))
    base = text(400).split()
    near = lambda k: " ".join(base[:k] + ["other"] + base[k + 1 :])
    rows += [(1000, " ".join(base)), (1001, " ".join(base)), (1002, near(150)), (1003, near(300))]
    rows += [(1100, text(60) + " " + items[2][1] + " " + text(60)), (1200, text(50) + " mail a.b@c.example.com " + text(50)), (1300, None), (1301, "")]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), dict(rows)


def test_stages(spark, small):
    d, texts = small
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "encoding":
            assert docs.columns == COLUMNS
    kept = {k: set(v) for k, v in seen.items()}
    assert kept["toxicity"] == {i for i in texts if i >= 400 or i % 5}
    fps = {i: simhash.fingerprint(texts[i], 1, True) & (1 << 64) - 1 for i in kept["toxicity"]}
    sets = {i: {tuple((texts[i] or "").split()[k : k + 5]) for k in range(max(1, len((texts[i] or "").split()) - 4))} for i in fps}
    gone = {i for i in fps for j in fps if j < i and (fps[i] ^ fps[j]).bit_count() <= stages.PIPELINE_RADIUS and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert kept["near_duplicates"] == kept["toxicity"] - gone and {1001, 1002, 1003} <= gone and gone - {1001, 1002, 1003, 1301} == set()
    assert kept["decontamination"] == kept["near_duplicates"] - {1100}
    assert kept["personal_data"] == kept["decontamination"]
    masked = {i: r.text for i, r in seen["personal_data"].items()}
    assert masked[1200] == texts[1200].replace("a.b@c.example.com", "[email]") and all(masked[i] == texts[i] for i in masked if i != 1200)
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in seen["encoding"].items():
        assert list(r.ids) == theirs.encode(masked[i] or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    run = {tuple(map(str, r)) for r in corpus_pipeline.run(spark, d).collect()}
    assert run == {tuple(map(str, r)) for r in seen["encoding"].values()}


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_only_similar_texts_are_near_duplicates(spark, docs_of):
    """Near fingerprints alone don't drop a document; texts of a five-word similarity of 0.8 do, also through others."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(5000)}"
    sets = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    rows = []
    for k in range(25):
        base = [word() for _ in range(300)]
        rows.append((10 * k, " ".join(base)))
        for m in range(1, 8):
            changed = base.copy()
            for at in rng.sample(range(300), 3 * m // 2):
                changed[at] = word()
            rows.append((10 * k + m, " ".join(changed)))
    rows += [(i + 5000, t.upper()) for i, t in rows[:8]]  # copies, but for case
    texts = dict(rows)
    fps = {i: simhash.fingerprint(t, 1, True) & (1 << 64) - 1 for i, t in rows}
    shingles = {i: sets(t.lower()) for i, t in rows}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    false = 0
    for i in texts:
        for j in texts:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= stages.PIPELINE_RADIUS:
                if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                    root[max(top(i), top(j))] = min(top(i), top(j))
                else:
                    false += 1
    got = {r.doc_id for r in stages.drop_near_duplicates(spark, docs_of(rows), "").collect()}
    assert false > 10 and got == {i for i in texts if top(i) == i}
