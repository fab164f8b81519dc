"""Shared plumbing of the training-data operators: reading tables, shared-folder tables (materialize), bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import bounded_batches as small_batches
from ..functions.scratch import written as materialize

__all__ = ["bounded_sample", "crc_of_id", "fit_in_one_task", "materialize", "small_batches", "spare_name", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, through Spark's reader only, so any Hadoop file system will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have, whatever extra columns it has."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def crc_of_id(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text (null: of the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("")))


def bounded_sample(df: DataFrame, rows: int, key: str = "doc_id", salt: int = 17) -> DataFrame:
    """About `rows` rows of df (all, if it has fewer), picked by a hash of the key: the same rows at every run.

    The fraction comes from a count; the number of rows kept has the spread of a binomial. A final
    limit holds it to twice the bound even where one key is repeated without end.
    """
    n = df.count()
    if n > rows:
        h = F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(1 << 30))
        df = df.where(h < F.lit(int((1 << 30) * rows / n))).limit(2 * rows)
    return df


def fit_in_one_task(sample: DataFrame, fit: Callable[[Iterator], Iterator], schema: str) -> list:
    """Run fit over a bounded sample in one executor task, and bring its (bounded) model to the driver."""
    return sample.coalesce(1).mapInPandas(fit, schema).collect()
