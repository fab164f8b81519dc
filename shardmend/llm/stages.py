"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> the documents that go on, with the columns of docs.

Null and empty texts are no toxic, contaminated or private ones; they are copies of each other, so the
near-duplicate stage keeps one of them, as it keeps one of the rows that repeat a doc_id. Rows without
doc_id stay. Empty tables go through as empty tables: without labels every toxicity is 0.5, which is kept.
Other columns go along, whatever their names; the last stage returns doc_id and what it makes. Texts of any
length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, pii, simhash, toxicity
from .common import spare_name, table

#: Differing bits of near duplicates in the pipeline: wider than the operator's default of 3. All pairs within this radius are
#: found, and verified by their exact five-word similarity before one is dropped.
PIPELINE_RADIUS = 6


def tokenizer_path() -> str:
    """Where the public vocabulary file is on the driver's machine; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold."""
    return toxicity.kept(docs, toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the smallest doc_id."""
    return simhash.one_of_each(docs, radius=PIPELINE_RADIUS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind."""
    return pii.masked(docs, pii.train(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the ids of each document."""
    out = bpe.encode_column(docs, tokenizer_path(), fields=("n_tokens", "ids", "ids_sha256"))
    return out.select("doc_id", f"{spare_name(docs, 'bpe')}.*")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("encoding", encode),
]
