"""Sources and sinks: files, memory, manifests, sidecars, repaired output."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_files(spark: SparkSession, path: str, max_bytes: int = 1 << 30) -> DataFrame:
    """(file_id, path, name, length, mtime, content, error) of files under a path.

    Larger files than max_bytes are rows with an error and no content; the filter on length reaches the reader.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = raw.where(F.col("length") <= max_bytes)
    large = raw.where(F.col("length") > max_bytes).withColumn("content", F.lit(None).cast("binary"))
    rows = small.unionByName(large.select(small.columns))
    error = F.when(F.col("length") > max_bytes, F.concat(F.lit("too large: "), F.col("length").cast("string")))
    return rows.select(F.sha2("path", 256).alias("file_id"), "path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("mtime"), "content", error.alias("error"))


def from_bytes(spark: SparkSession, files: list[tuple[str, bytes]]) -> DataFrame:
    """In-memory files, numbered by name."""
    rows = [(n, n, len(b), bytearray(b)) for n, b in files]
    return spark.createDataFrame(rows, "file_id string, name string, length long, content binary")


def manifest(lines: DataFrame) -> DataFrame:
    """(name, hash) of manifest lines (line_no, value): hash, white space, an optional star, name. A later line of a name wins."""
    pattern = r"^\s*(\S+)\s+\*?(.+?)\s*$"
    rows = lines.where(F.trim("value") != "").select("line_no", F.lower(F.regexp_extract("value", pattern, 1)).alias("hash"), F.regexp_extract("value", pattern, 2).alias("name"))
    return rows.where("name <> ''").groupBy("name").agg(F.max_by("hash", "line_no").alias("hash"))


def sidecars(files: DataFrame) -> DataFrame:
    """(name, hash, kind, and the target's path where files have one) from `<name>.sha256` and `<name>.sha3_512` files next to their targets, which carry the hash as first word."""
    suffix = r"(?i)\.(sha256|sha3_512)$"
    ext = F.regexp_extract(F.lower("name"), r"\.(sha256|sha3_512)$", 1)
    rows = files.where(ext != "")
    first = F.lower(F.element_at(F.split(F.trim(F.decode("content", "UTF-8")), r"\s+"), 1))
    place = [F.regexp_replace("path", suffix, "").alias("path")] if "path" in files.columns else []
    return rows.select(F.regexp_replace("name", suffix, "").alias("name"), first.alias("hash"), ext.alias("kind"), *place)


def output_path(path, output_dir: str):
    """`<output_dir>/<name>.recovered`, which must not be the source."""
    out = F.concat(F.lit(output_dir.rstrip("/") + "/"), F.element_at(F.split(path, "/"), -1), F.lit(".recovered"))
    return F.when(out == path, F.raise_error("output would overwrite its source").cast("string")).otherwise(out)


def write_repaired(repaired: DataFrame, output_dir: str) -> None:
    """Repaired bytes and reports as a Parquet table of (output_path, content, report): a distributed, atomic sink."""
    repaired.write.mode("errorifexists").parquet(output_dir)


def write_files(repaired: DataFrame) -> None:
    """Each row's `content` as a file at its `output_path`, and its `manifest` (where it has one) beside it as `<output_path>.manifest.json`.

    Written by the executors under a name of its own and then moved, so that a lost task leaves no half file; any store that pyarrow knows.
    """
    names = [c for c in ("output_path", "content", "manifest") if c in repaired.columns]

    def put(rows: Iterator) -> None:
        for r in rows:
            if r["content"] is None:
                continue
            store, path = pyarrow.fs.FileSystem.from_uri(r["output_path"]) if "://" in r["output_path"] else (pyarrow.fs.LocalFileSystem(), r["output_path"])
            store.create_dir(path.rpartition("/")[0] or ".", recursive=True)
            for name, body in ((path, bytes(r["content"])), (f"{path}.manifest.json", r["manifest"].encode() if "manifest" in names and r["manifest"] else None)):
                if body is not None:
                    part = f"{name}.part-{uuid.uuid4().hex}"
                    with store.open_output_stream(part) as f:
                        f.write(body)
                    store.move(part, name)

    repaired.select(*names).foreachPartition(put)
