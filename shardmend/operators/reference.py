"""Findings from a known good copy: what happened to the bytes, the first explanation that fits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .members import _per_file

# Rules of each format for a short tail (minor, major, catastrophic), a short head, missing bytes, a lost magic, and flips (few bytes, many, in the first 512).
_BY_FORMAT = {
    "zip": ("ZIP_TRUNC_001", "ZIP_TRUNC_002", "ZIP_TRUNC_003", "ZIP_TRUNC_004", "ZIP_CD_003", "GEN_STRUCT_001", "ZIP_FLIP_001", "ZIP_FLIP_002", "ZIP_FLIP_003"),
    "tar": ("TAR_TRUNC_001", "TAR_TRUNC_002", "TAR_TRUNC_002", "TAR_TRUNC_003", "TAR_SIZE_002", "GEN_STRUCT_001", "TAR_FLIP_001", "TAR_FLIP_001", "TAR_FLIP_002"),
    "iso9660": ("ISO_TRUNC_001", "ISO_TRUNC_001", "ISO_TRUNC_002", "ISO_TRUNC_003", "ISO_SECTOR_002", "GEN_STRUCT_001", "ISO_SECTOR_001", "ISO_SECTOR_001", "ISO_SECTOR_001"),
    "gzip": ("GEN_TRUNC_001", "GEN_TRUNC_001", "GEN_TRUNC_001", "GEN_TRUNC_001", "GEN_MISSING_001", "GZ_MAGIC_001", "GEN_FLIP_001", "GEN_FLIP_001", "GEN_FLIP_001"),
    "pdf": ("GEN_TRUNC_001", "GEN_TRUNC_001", "GEN_TRUNC_001", "GEN_TRUNC_001", "GEN_MISSING_001", "PDF_HDR_001", "GEN_FLIP_001", "GEN_FLIP_001", "GEN_FLIP_001"),
    "sqlite": ("GEN_TRUNC_001", "GEN_TRUNC_001", "GEN_TRUNC_001", "GEN_TRUNC_001", "GEN_MISSING_001", "SQ_MAGIC_001", "GEN_FLIP_001", "GEN_FLIP_001", "GEN_FLIP_001"),
    "rar": ("GEN_TRUNC_001",) * 4 + ("GEN_MISSING_001", "RAR_MAGIC_001", "GEN_FLIP_001", "GEN_FLIP_001", "GEN_FLIP_001"),
    "seven_z": ("GEN_TRUNC_001",) * 4 + ("GEN_MISSING_001", "7Z_MAGIC_001", "GEN_FLIP_001", "GEN_FLIP_001", "GEN_FLIP_001"),
    "bzip2": ("GEN_TRUNC_001",) * 4 + ("GEN_MISSING_001", "BZ2_MAGIC_001", "GEN_FLIP_001", "GEN_FLIP_001", "GEN_FLIP_001"),
    "xz": ("GEN_TRUNC_001",) * 4 + ("GEN_MISSING_001", "XZ_MAGIC_001", "GEN_FLIP_001", "GEN_FLIP_001", "GEN_FLIP_001"),
    "zstd": ("GEN_TRUNC_001",) * 4 + ("GEN_MISSING_001", "ZST_MAGIC_001", "GEN_FLIP_001", "GEN_FLIP_001", "GEN_FLIP_001"),
    "lz4": ("GEN_TRUNC_001",) * 4 + ("GEN_MISSING_001", "LZ4_MAGIC_001", "GEN_FLIP_001", "GEN_FLIP_001", "GEN_FLIP_001"),
}
_ANY = ("GEN_TRUNC_001",) * 4 + ("GEN_MISSING_001", "GEN_STRUCT_001", "GEN_FLIP_001", "GEN_FLIP_001", "GEN_FLIP_001")


def _tail_rule(rules: tuple, share: float) -> str:
    return rules[0] if share <= 0.01 else rules[1] if share <= 0.05 else rules[2]


def difference(fmt: str, bad: bytes, good: bytes) -> Iterator[tuple]:
    """(rule_id, start, end, differing bits) that tell bad from good."""
    rules = _BY_FORMAT.get(fmt, _ANY)
    nb, ng = len(bad), len(good)
    if nb < ng:
        lost = ng - nb
        if good.startswith(bad):
            yield _tail_rule(rules, lost / ng), nb, ng, None
            return
        if good.endswith(bad):
            yield rules[3], 0, lost, None
            return
        yield rules[4], 0, lost, None
    elif nb > ng:
        yield "GEN_STRUCT_001", ng, nb, None
    n = min(nb, ng)
    a, g = np.frombuffer(bad, np.uint8, n), np.frombuffer(good, np.uint8, n)
    at = np.flatnonzero(a != g)
    if not len(at) or nb != ng:
        return
    first, last = int(at[0]), int(at[-1])
    bits = int(np.bitwise_count(a[at] ^ g[at]).sum())
    solid = len(at) == last - first + 1
    if fmt == "iso9660" and ((at >= 32769) & (at < 32774)).any():
        yield "ISO_PVD_001", 32769, 32774, bits
    elif fmt == "tar" and (swap := _swapped(bad, good, at)):
        yield "TAR_BLOCK_001", swap[0] * 512, swap[1] * 512 + 512, bits
    elif fmt == "tar" and (block := _longname(good, at)) is not None:
        yield "TAR_GNU_001", block * 512, block * 512 + 512, bits
    elif first == 0 and solid and len(at) <= 16 and rules[5] != "GEN_STRUCT_001" and bits > 1:
        yield rules[5], 0, last + 1, bits
    elif rule := _field(fmt, good, first):
        yield rule, first, last + 1, bits
    elif solid and len(at) >= 8 or len(at) >= 16 and not a[at].any():
        yield rules[4], first, last + 1, bits
    else:
        yield _flip_rule(rules, first < 512, len(at)), first, last + 1, bits


def _flip_rule(rules: tuple, header: bool, changed: int) -> str:
    return rules[8] if header else rules[7] if changed > 5 else rules[6]


def _swapped(bad: bytes, good: bytes, at: np.ndarray) -> tuple[int, int] | None:
    """The two 512-byte blocks that changed places, if that is all that changed."""
    blocks = np.unique(at // 512).tolist()
    if len(blocks) != 2:
        return None
    i, j = blocks
    part = lambda d, k: d[k * 512 : k * 512 + 512]
    return (i, j) if part(bad, i) == part(good, j) and part(bad, j) == part(good, i) else None


def _longname(good: bytes, at: np.ndarray) -> int | None:
    """The header block of a long name that was hit."""
    for block in np.unique(at // 512).tolist():
        if good[block * 512 : block * 512 + 13] == b"././@LongLink":
            return block
    return None


def _field(fmt: str, good: bytes, first: int) -> str | None:
    """The rule of the header field that holds the first differing byte."""
    if fmt == "zip":
        head = good.rfind(b"PK\x01\x02", max(0, first - 45), first + 1)
        if head >= 0:
            return "ZIP_SIZE_001" if 20 <= first - head < 24 else "ZIP_EXTRA_001" if 30 <= first - head < 32 else None
    if fmt == "tar" and good[first // 512 * 512 + 257 : first // 512 * 512 + 262] == b"ustar":
        return "TAR_UST_001" if 148 <= first % 512 < 156 else "TAR_SIZE_001" if 124 <= first % 512 < 136 else None
    if fmt == "iso9660" and 17 * 2048 <= first < 17 * 2048 + 7:
        return "ISO_SVD_001"
    if fmt == "iso9660" and first >= 18 * 2048 and first % 2048 == 0:
        return "ISO_DIR_001"
    return None


def reference_diff(files: DataFrame, references: DataFrame) -> DataFrame:
    """Findings of files against references (file_id, reference BINARY)."""
    both = files.join(references.select("file_id", "reference"), "file_id")

    def rows(r):
        for n, (rule, start, end, bits) in enumerate(difference(r.engine_format, r.content or b"", r.reference or b"")):
            yield 10_000 + n, rule, None, start, end, None, bits

    schema = "file_id string, seq int, rule_id string, member string, start long, end long, confidence double, bits long"
    return _per_file(both, schema, rows, ("file_id", "name", "content", "engine_format", "reference"))


def swapped_blocks(files: DataFrame, references: DataFrame, size: int = 512) -> DataFrame:
    """(file_id, block, from_block): changed blocks of a file that are another changed block of its reference, by hash."""
    blocks = lambda df, c: df.where(F.length(c) > 0).select("file_id", c, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length(c) - 1) / size))).alias("block")).select("file_id", "block", F.sha2(F.col(c).substr((F.col("block") * size + 1).cast("int"), F.lit(size)), 256).alias("h"))
    a, g = blocks(files, "content"), blocks(references, "reference")
    changed = a.join(g.withColumnRenamed("h", "g"), ["file_id", "block"]).where("h <> g")
    other = changed.select(F.col("file_id").alias("_f"), F.col("block").alias("from_block"), F.col("g").alias("_g"))
    same = (F.col("file_id") == F.col("_f")) & (F.col("h") == F.col("_g")) & (F.col("block") != F.col("from_block"))
    return changed.join(other, same).select("file_id", "block", "from_block")
