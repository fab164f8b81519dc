"""Identification: content by signature, name by suffix, and how they agree. One projection, no join, no Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs


def identify(files: DataFrame) -> DataFrame:
    """files (name, content, length) with by_content, by_name, provenance, agreement, best_effort and engine_format.

    A signature that reaches past the bytes does not fire. Null content counts as no bytes.
    """
    length = F.coalesce("length", F.length("content"), F.lit(0)) if "length" in files.columns else F.coalesce(F.length("content"), F.lit(0))
    out = files.withColumn("_ord", exprs.signature_ord(F.coalesce("content", F.lit(b"")), length))
    # in steps, so that the long chains of conditions are evaluated once each
    out = out.withColumns({"by_content": exprs.by_signature(F.col("_ord"), 0), "by_name": exprs.name_format(F.col("name")), "provenance": exprs.by_signature(F.col("_ord"), 4)})
    content, name = F.col("by_content"), F.col("by_name")
    return out.withColumns({"agreement": exprs.agreement(content, name), "best_effort": F.coalesce(content, name), "engine_format": exprs.engine_format(content, F.col("name"))}).drop("_ord")
