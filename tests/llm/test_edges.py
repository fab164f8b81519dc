"""Empty tables, very long texts and repeated rows through the operators and the pipeline."""

import random

import corpus_pipeline
from shardmend.llm import quality, simhash, stages, toxicity

LONG = 40_000


def long_text(seed, n=LONG):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256"] and out.count() == 0


def test_long_texts_are_scored_whole(spark, docs_of):
    """What tells stands at the very end of a long text."""
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(300)}"
    rows = [(k, " ".join(word() for _ in range(60)) + " vilest" * (k % 2)) for k in range(600)]
    docs = docs_of(rows)
    labels = spark.createDataFrame([(k, 1 - k % 2, k % 2) for k in range(600)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels.select("doc_id", "toxic"))
    plain = " ".join(f"w{k % 300}" for k in range(LONG))
    both = docs_of([(1, plain), (2, plain + " vilest"), (3, None), (4, "")])
    got = {r.doc_id: r.score for r in toxicity.scored(both, model).collect()}
    assert got[2] > got[1] and got[3] == got[4]
    of_quality = quality.train(docs, labels.select("doc_id", "quality"))
    scores = {r.doc_id: r.score for r in quality.scored(both, of_quality).collect()}
    assert len(scores) == 4 and all(0 <= v <= 1 for v in scores.values()) and quality.scored(both.limit(0), of_quality).count() == 0


def test_long_near_copies(spark, docs_of):
    """Two texts of 40,000 words that differ in a hundred of them are one; a third of the same words in another order is not."""
    base = long_text(2).split()
    rng, near, other = random.Random(3), base.copy(), base.copy()
    for at in rng.sample(range(LONG), 100):
        near[at] = "changed"
    rng.shuffle(other)
    docs = docs_of([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(other)), (4, None), (5, ""), (5, ""), (None, "x"), (None, "x")], gone_id="a", node="b", fp="c", label="d")
    out = stages.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "4", "None", "None"]
    marks = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs.where("doc_id < 5")).collect()}
    assert len(marks) == 4 and marks[4] == 4
