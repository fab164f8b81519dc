"""Detection: files to findings. Bytes are read once in Python; what follows is relational.

Deviations from the older behaviour that strict=True restores: payload checksums of deflated members
are checked, too; streamed entries may have no local size; every member of a gzip file is checked.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bytesio as b
from ..functions import zipview
from .members import _per_file

MAX_FINDINGS = 1000
SCHEMA = "file_id string, seq int, rule_id string, member string, start long, end long, confidence double"

# Leading bytes of the formats of which nothing else is read.
MAGICS = {"bzip2": ("BZ2_MAGIC_001", b"BZh"), "xz": ("XZ_MAGIC_001", b"\xfd7zXZ\0"), "zstd": ("ZST_MAGIC_001", b"\x28\xb5\x2f\xfd"), "lz4": ("LZ4_MAGIC_001", b"\x04\x22\x4d\x18"), "rar": ("RAR_MAGIC_001", b"Rar!\x1a\x07")}


def findings_of(fmt: str, data: bytes, strict: bool = False) -> Iterator[tuple]:
    """(rule_id, member, start, end, confidence) in the order of detection."""
    yield from {"zip": _zip, "tar": _tar, "iso9660": _iso, "gzip": _gzip, "sqlite": _sqlite, "seven_z": _sevenz, "pdf": _pdf}.get(fmt, lambda *_: _magic(fmt, data))(data, strict)


def _magic(fmt: str, data: bytes) -> Iterator[tuple]:
    if fmt in MAGICS:
        rule, magic = MAGICS[fmt]
        if not data.startswith(magic):
            yield rule, None, 0, len(magic), None


def encrypted(data: bytes) -> bool:
    return any(e.flags & 0x41 for e, _, _ in zipview.view(data).entries)


def _zip(data: bytes, strict: bool) -> Iterator[tuple]:
    p, n = b.parse_zip(data), len(data)
    if p.eocd is None:
        yield "ZIP_EOCD_001", None, max(0, n - 22), n, None
    elif p.cd_offset + p.cd_size > p.eocd:
        yield "ZIP_EOCD_002", None, p.eocd + 16, p.eocd + 20, 1.0 if p.cd_offset > n else 0.9
    if not p.central and (p.eocd is None or p.declared):
        yield "ZIP_CD_001", None, 0, n, None
    elif p.declared is not None and len(p.central) < p.declared:
        yield "ZIP_CD_003", None, p.cd_offset + p.base, p.eocd, None
    at = {e.offset: e for e in p.local}
    for e in p.central:
        name, where = e.name.decode("utf-8", "replace"), e.offset + p.base
        local = b.local_record(data, where) if strict else at.get(where) or b.local_record(data, where)
        if local is None:
            yield "ZIP_LFH_001", name, where, where + 4, None
            continue
        streamed = local.flags & 8 and not strict
        if not streamed and local.compressed != e.compressed:
            yield "ZIP_SIZE_001", name, e.record_offset + 20, e.record_offset + 24, None
        if e.flags & 0x41 or strict and e.method != 0:
            continue
        status, body, crc = b.extract_zip(data, e, where)
        if status == "CRC_MISMATCH" and crc != e.crc32 or status == "DECODE_FAILED":
            yield "ZIP_CRC_001", name, local.data_offset, local.data_offset + e.compressed, None


def _tar(data: bytes, strict: bool) -> Iterator[tuple]:
    members, ended, cut = b.walk_tar(data)
    for m in members:
        if not m.checksum_ok:
            yield "TAR_UST_001", m.name.decode("utf-8", "replace"), m.offset + 148, m.offset + 156, None
    if cut:
        yield "TAR_TRUNC_002", None, members[-1].offset if members else 0, len(data), None
    elif not ended:
        yield "TAR_TERM_001", None, len(data), len(data), None


def _iso(data: bytes, strict: bool) -> Iterator[tuple]:
    p = b.parse_iso(data)
    if not p.magic_ok:
        yield "ISO_PVD_001", None, 32769, 32774, None
    elif not p.path_table_ok:
        yield "ISO_PT_001", None, 32768 + 140, 32768 + 144, 1.0


def _gzip(data: bytes, strict: bool) -> Iterator[tuple]:
    n = len(data)
    if n < 18:
        yield "GZ_TRUNC_001", None, 0, n, None
        return
    damaged = data[:2] != b"\x1f\x8b"
    if damaged:  # what follows is still read
        yield "GZ_MAGIC_001", None, 0, 2, None
    if data[2] != 8:
        yield "GZ_CM_001", None, 2, 3, None
        return
    at = 0
    while at < n:
        head = b.header_length(data, 0) if at == 0 and damaged else b.gzip_header(data, at)
        if head is None:
            if at == 0 or data[at : at + 2] == b"\x1f\x8b":
                yield "GZ_TRUNC_001", None, at, n, None
            return  # padding after a member is no damage
        whole, end, sum_, length = b.inflate_sums(data, at + head)
        if not whole:
            yield "GZ_TRUNC_001", None, at, n, None
            return
        if end + 8 > n:
            yield "GZ_TRUNC_001", None, end, n, None
            return
        crc, size = struct.unpack_from("<II", data, n - 8 if strict else end)
        if crc != sum_:
            yield "GZ_ICRC_001", None, end, end + 4, None
        if size != length & 0xFFFFFFFF:
            yield "GZ_ISIZE_001", None, end + 4, end + 8, None
        if strict:
            return
        at = end + 8


def _sqlite(data: bytes, strict: bool) -> Iterator[tuple]:
    p, n = b.parse_sqlite(data), len(data)
    if p.readable and not p.magic_ok or not p.readable and data[:16] != b"SQLite format 3\0"[:n]:
        yield "SQ_MAGIC_001", None, 0, 16, None
        return
    if not p.readable:
        yield "SQ_TRUNC_002", None, 0, n, None
        return
    if not p.page_size_ok:
        yield "SQ_PGSIZE_001", None, 16, 18, None
        return
    if p.declared and p.declared != p.actual:
        yield "SQ_PGSIZE_002", None, 28, 32, None
    # a database of one page is whole, but for the older reading
    if n < (2 * p.page_size if strict else p.page_size):
        yield "SQ_TRUNC_002", None, 0, n, None
        return
    if n % p.page_size:
        yield "SQ_TRUNC_001", None, 0, n, None
    if p.trunk > p.actual:
        yield "SQ_FREE_001", None, 32, 36, None
    if p.free > p.actual:
        yield "SQ_FREE_002", None, 36, 40, None
    if p.write_version == 1 and p.counter != p.valid_for:
        yield "SQ_FC_001", None, 24, 28, None
    for rule, page in p.pages:
        yield rule, f"page {page}", (page - 1) * p.page_size, page * p.page_size, None


def wal_findings(files: DataFrame) -> DataFrame:
    """Findings of `<name>-wal` files joined with the databases beside them (by path where files have one): a bad magic, or salts that are not those of the first frame. 56 bytes of each cross the network."""
    place = "path" if "path" in files.columns else "name"
    wal = files.where(F.lower(place).endswith("-wal")).select(F.regexp_replace(place, "(?i)-wal$", "").alias("_db"), F.col("content").substr(1, 56).alias("_wal"))
    rows = files.select("file_id", place).join(wal, F.col(place) == F.col("_db"))
    magic = F.hex(F.col("_wal").substr(1, 4))
    enough = F.length("_wal") >= 32
    bad = ~magic.isin("377F0682", "377F0683")
    other = (F.length("_wal") >= 56) & (F.col("_wal").substr(17, 8) != F.col("_wal").substr(41, 8))
    rule = F.when(enough & bad, "SQ_WAL_001").when(enough & other, "SQ_WAL_002")
    return rows.select("file_id", F.lit(0).alias("seq"), rule.alias("rule_id"), F.lit(None).cast("string").alias("member"), F.lit(0).cast("long").alias("start"), F.lit(4).cast("long").alias("end"), F.lit(None).cast("double").alias("confidence")).where("rule_id is not null")


def _sevenz(data: bytes, strict: bool) -> Iterator[tuple]:
    p = b.parse_sevenz(data)
    if not p.magic_ok:
        yield "7Z_MAGIC_001", None, 0, 6, None
        return
    if not p.header_ok:
        yield "7Z_CRC_001", None, 8, 12, 1.0
    elif not p.next_inside:
        yield "7Z_TRUNC_001", None, 12, len(data), None


def _pdf(data: bytes, strict: bool) -> Iterator[tuple]:
    if not data.startswith(b"%PDF-"):
        yield "PDF_HDR_001", None, 0, 5, None
    if b"%%EOF" not in data[-1024:]:
        yield "PDF_EOF_001", None, max(0, len(data) - 1024), len(data), None


def detect(files: DataFrame, strict: bool = False) -> DataFrame:
    """Raw findings of files (file_id, name, content, engine_format), at most MAX_FINDINGS of each, in order."""

    def rows(r):
        for n, f in enumerate(findings_of(r.engine_format, r.content or b"", strict)):
            if n >= MAX_FINDINGS:
                return
            yield (n, *f)

    return _per_file(files, SCHEMA, rows)


def scan(files: DataFrame, strict: bool = False) -> DataFrame:
    """Like detect, with `encrypted`, in one reading of the bytes: a file whose state ends its analysis is one row with that flag and no rule."""

    def rows(r):
        data = r.content or b""
        if r.engine_format == "zip" and encrypted(data):
            yield -2, None, None, None, None, None, True
            return
        for n, f in enumerate(findings_of(r.engine_format, data, strict)):
            if n >= MAX_FINDINGS:
                return
            yield (n, *f, False)

    return _per_file(files, f"{SCHEMA}, encrypted boolean", rows)


def mismatches(compared: DataFrame) -> DataFrame:
    """Findings of files whose hash is known and differs; of their length, where they have that column, so that no bytes are needed."""
    rows = compared.where("status = 'mismatch'")
    end = F.col("length") if "length" in rows.columns else F.length("content")
    return rows.select("file_id", F.lit(-1).alias("seq"), F.lit("INTEGRITY_HASH_001").alias("rule_id"), F.lit(None).cast("string").alias("member"), F.lit(0).cast("long").alias("start"), end.cast("long").alias("end"), F.lit(1.0).alias("confidence"))


def capped(found: DataFrame, most: int = MAX_FINDINGS) -> DataFrame:
    """found, its first `most` rows of each file, with whether the file reached that number."""
    w = Window.partitionBy("file_id")
    return found.withColumn("_n", F.row_number().over(w.orderBy("seq"))).withColumn("capped", F.count(F.lit(1)).over(w) >= most).where(F.col("_n") <= most).drop("_n")


def encrypted_files(files: DataFrame) -> DataFrame:
    """(file_id, encrypted) of ZIP files: a state that ends their analysis."""
    return _per_file(files.where("engine_format = 'zip'"), "file_id string, encrypted boolean", lambda r: [(encrypted(r.content or b""),)])
