"""Header fields as a dimension, and their values in files: a projection of byte ranges, no Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the public formats: format, field, offset of the first header, bytes, byte order
# (le, be, octal, raw), expected bytes in hex or -, least and greatest value or -.
FIELDS_TEXT = """
zip LocalFileHeader.signature 0 4 raw 504B0304 - -
zip LocalFileHeader.version_needed 4 2 le - 10 63
zip LocalFileHeader.flags 6 2 le - 0 2111
zip LocalFileHeader.compression 8 2 le - 0 20
zip LocalFileHeader.crc32 14 4 le - - -
zip LocalFileHeader.compressed_size 18 4 le - - -
zip LocalFileHeader.uncompressed_size 22 4 le - - -
zip LocalFileHeader.name_len 26 2 le - 1 65535
zip LocalFileHeader.extra_len 28 2 le - - -
tar UStarHeader.name 0 100 raw - - -
tar UStarHeader.mode 100 8 octal - - -
tar UStarHeader.size 124 12 octal - - -
tar UStarHeader.mtime 136 12 octal - - -
tar UStarHeader.checksum 148 8 octal - - -
tar UStarHeader.typeflag 156 1 raw - - -
tar UStarHeader.magic 257 5 raw 7573746172 - -
iso9660 PrimaryVolumeDescriptor.type 32768 1 le - 1 1
iso9660 PrimaryVolumeDescriptor.magic 32769 5 raw 4344303031 - -
iso9660 PrimaryVolumeDescriptor.version 32774 1 le - 1 1
iso9660 PrimaryVolumeDescriptor.volume_space 32848 4 le - - -
iso9660 PrimaryVolumeDescriptor.path_table_size 32900 4 le - - -
iso9660 PrimaryVolumeDescriptor.path_table_location 32908 4 le - - -
gzip gzip.magic 0 2 raw 1F8B - -
gzip gzip.cm 2 1 le - 8 8
gzip gzip.flags 3 1 le - 0 31
gzip gzip.mtime 4 4 le - - -
sqlite sqlite.magic 0 16 raw 53514C69746520666F726D6174203300 - -
sqlite sqlite.page_size 16 2 be - 1 32768
sqlite sqlite.write_version 18 1 be - 1 2
sqlite sqlite.change_counter 24 4 be - - -
sqlite sqlite.page_count 28 4 be - - -
sqlite sqlite.freelist_trunk 32 4 be - - -
sqlite sqlite.freelist_count 36 4 be - - -
sqlite sqlite.version_valid_for 92 4 be - - -
seven_z 7z.signature 0 6 raw 377ABCAF271C - -
seven_z 7z.start_header_crc 8 4 le - - -
"""


def fields() -> list[tuple]:
    rows = (line.split() for line in FIELDS_TEXT.strip().split("\n"))
    return [(f, n, int(a), int(k), o, None if e == "-" else e, None if lo == "-" else int(lo), None if hi == "-" else int(hi)) for f, n, a, k, o, e, lo, hi in rows]


def field_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fields(), "engine_format string, field string, at int, size int, byte_order string, expected string, least long, greatest long")


def field_values(files: DataFrame) -> DataFrame:
    """(file_id, field, raw, value, valid) of files' first headers: raw bytes in hex, the number, and whether it is as expected. Fields past the end are absent."""
    rows = files.select("file_id", "content", "engine_format").join(F.broadcast(field_dim(files.sparkSession)), "engine_format")
    rows = rows.where(F.length("content") >= F.col("at") + F.col("size"))
    part = rows.withColumn("raw", F.hex(F.col("content").substr(F.col("at") + 1, F.col("size")))).drop("content")
    pairs = F.regexp_extract_all("raw", F.lit("(..)"), F.lit(1))
    digits = F.regexp_extract(F.decode(F.unhex("raw"), "ISO-8859-1"), "^[ ]*([0-7]+)", 1)
    number = (
        F.when(F.col("byte_order") == "le", F.conv(F.array_join(F.reverse(pairs), ""), 16, 10))
        .when(F.col("byte_order") == "be", F.conv("raw", 16, 10))
        .when((F.col("byte_order") == "octal") & (digits != ""), F.conv(digits, 8, 10))
    ).try_cast("long")
    part = part.withColumn("value", number)
    ok = F.coalesce(F.col("raw") == F.col("expected"), F.lit(True)) & F.coalesce(F.col("value").between(F.col("least"), F.col("greatest")), F.lit(True))
    return part.select("file_id", "field", "raw", "value", ok.alias("valid"))
