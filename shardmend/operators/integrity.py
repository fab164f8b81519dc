"""Integrity: whole-file and block hashes, checksums, and comparison with manifests."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import bytesio, dims

MAX_BLOCKS = 500_000


@F.pandas_udf(StringType())  # a type, not its name: names need a session at import
def sha3_512(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else hashlib.sha3_512(b).hexdigest())


def checksum(name: str):
    """A pandas function of BINARY for one of the catalogue's checksums, as lower-case hex."""
    width, *rest = next(c[1:] for c in dims.CRCS if c[0] == name)

    @F.pandas_udf("string")
    def crc(content: pd.Series) -> pd.Series:
        return content.map(lambda b: None if b is None else f"{bytesio.crc(b, width, *rest):0{width // 4}x}")

    return crc


def hashes(files: DataFrame) -> DataFrame:
    """files with sha256 and crc32 of the content."""
    return files.withColumns({"sha256": F.sha2("content", 256), "crc32": F.crc32("content")})


def block_hashes(files: DataFrame, block_size: int = 65536, expected: DataFrame | None = None) -> DataFrame:
    """(file_id, block_index, offset, length, actual) of each block; none of an empty file, at most MAX_BLOCKS. With `expected` (file_id, block_index, expected) also that hash and whether it matches (null: unknown)."""
    last = F.least(F.floor((F.length("content") - 1) / block_size), F.lit(MAX_BLOCKS - 1))
    rows = files.where(F.length("content") > 0).select("file_id", "content", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("block_index"))
    block = F.col("content").substr((F.col("block_index") * block_size + 1).cast("int"), F.lit(block_size))
    out = rows.select("file_id", "block_index", (F.col("block_index") * block_size).alias("offset"), F.length(block).cast("long").alias("length"), F.sha2(block, 256).alias("actual"))
    if expected is None:
        return out
    known = expected.select("file_id", "block_index", F.lower("expected").alias("expected"))
    return out.join(known, ["file_id", "block_index"], "left").withColumn("matches", F.col("actual") == F.col("expected"))


def compare(hashed: DataFrame, manifest: DataFrame, hash_column: str = "sha256") -> DataFrame:
    """hashed joined with a manifest (name, hash): expected, manifest_present, matches and status.

    No expected hash means unknown, not corrupt. Where both have a path, files are told apart by it, not by
    their names alone.
    """
    key = "path" if "path" in hashed.columns and "path" in manifest.columns else "name"
    m = manifest.select(F.col(key).alias("_key"), F.lower("hash").alias("expected"))
    out = hashed.join(m, F.col(key) == F.col("_key"), "left").drop("_key")
    matches = F.coalesce(F.col("expected") == F.lower(hash_column), F.lit(False))
    return out.withColumns({"manifest_present": F.col("expected").isNotNull(), "matches": matches, "status": F.when(F.col("expected").isNull(), "unknown").when(matches, "verified").otherwise("mismatch")})
