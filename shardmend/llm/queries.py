"""The opN_ queries: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontaminate, htmltext, langid, pii, quality, simhash, toxicity, warc
from .common import crc_of_id, table
from .stages import tokenizer_path


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = htmltext.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    out = toxicity.scored(docs, model)
    return out.select("doc_id", (crc_of_id() % 3 == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_spans(docs, pii.train(docs))
    counts = [pii.count_kind(F.col("pii"), k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, "pii.base_sha256", F.col("pii.joined").alias("spans"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digests(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("url")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    out = langid.identified(docs.drop("lang"), langid.train(docs), with_spans=False)
    return out.select("doc_id", (crc_of_id() % 4 == 2).alias("held_out"), "language.lang_pred", "language.score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_column(docs, tokenizer_path(), fields=("n_tokens", "ids_sha256", "decoded_sha256")).select("doc_id", "bpe.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    out = quality.scored(docs, model)
    return out.select("doc_id", (crc_of_id() % 5 == 3).alias("held_out"), "score", (F.col("score") >= model["threshold"]).cast("int").alias("keep"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_toxicity": op2_toxicity,
    "op3_pii": op3_pii,
    "op4_warc": op4_warc,
    "op5_langid": op5_langid,
    "op6_ann": op6_ann,
    "op7_bpe": op7_bpe,
    "op8_decontaminate": op8_decontaminate,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
}

SQL: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
             h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM h)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    # every item-sized window of every document against every item of which it has enough shingles
    "op8_decontaminate": r"""
        WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
             iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
             i0 AS (SELECT item_id, w, len(w) AS m, least(5, len(w)) AS k FROM iw WHERE len(w) > 0),
             dp AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS pos FROM dw),
             dl AS (SELECT *, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2, lead(x, 3) OVER o AS x3, lead(x, 4) OVER o AS x4
                    FROM dp WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
             ds AS (SELECT doc_id, n, k, pos, CASE k WHEN 1 THEN x WHEN 2 THEN x || ' ' || x1 WHEN 3 THEN x || ' ' || x1 || ' ' || x2
                                             WHEN 4 THEN x || ' ' || x1 || ' ' || x2 || ' ' || x3
                                             ELSE x || ' ' || x1 || ' ' || x2 || ' ' || x3 || ' ' || x4 END AS s
                    FROM dl, (SELECT DISTINCT k FROM i0) ks),
             ip AS (SELECT item_id, m, k, w, unnest(range(0, m - k + 1)) AS pos FROM i0),
             isr AS (SELECT item_id, m, k, array_to_string(w[pos + 1:pos + k], ' ') AS s FROM ip),
             ic AS (SELECT item_id, m, k, s, count(*) AS c FROM isr GROUP BY ALL),
             hits AS (SELECT d.doc_id, d.n, d.pos, d.s, i.item_id, i.m, i.k, i.c FROM ds d JOIN ic i ON d.s = i.s AND d.k = i.k),
             pairs AS (SELECT doc_id, item_id, n, m, k FROM hits GROUP BY ALL HAVING 9 * count(*) >= 4 * (least(n, m) + m - 2 * k + 2)),
             win AS (SELECT doc_id, item_id, n, m, k, unnest(range(0, greatest(0, n - m) + 1)) AS start FROM pairs),
             cnt AS (SELECT w.doc_id, w.item_id, w.n, w.m, w.k, w.start, h.s, least(count(*), any_value(h.c)) AS c
                     FROM win w JOIN hits h ON h.doc_id = w.doc_id AND h.item_id = w.item_id AND h.pos BETWEEN w.start AND w.start + least(w.n, w.m) - w.k
                     GROUP BY ALL),
             hit AS (SELECT doc_id, item_id, n, m, k, start, sum(c)::BIGINT AS common FROM cnt GROUP BY ALL),
             sim AS (SELECT doc_id, item_id, m, start, common / (least(n, m) + m - 2 * k + 2 - common)::DOUBLE AS similarity
                     FROM hit WHERE 9 * common >= 4 * (least(n, m) + m - 2 * k + 2)),
             r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start DESC) AS r FROM sim)
        SELECT doc_id, item_id, similarity, start AS start_word, m AS n_words FROM r WHERE r = 1""",
    "op6_ann": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
                   FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
             r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
