"""Dimension tables: small, fixed, and broadcast where they are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values. Rules: id, category, severity, field, evidence, deterministic, subscores hit by the penalty
# (s structural, d data, sd both, all with metadata), points, and who emits it (detect, ref for the
# comparison with a reference copy, never).
RULES_TEXT = """
ZIP_EOCD_001 StructuralCorruption Catastrophic EOCD.signature SignatureMismatch y all 85 detect
ZIP_EOCD_002 StructuralCorruption Major EOCD.cd_offset OffsetOutOfBounds n all 63 detect
ZIP_EOCD_003 StructuralCorruption Major EOCD.cd_size LengthOverflow y all 63 never
ZIP_CD_001 StructuralCorruption Catastrophic CentralDirectory StructureMissing n all 85 detect
ZIP_CD_002 StructuralCorruption Major CentralDirHeader.signature SignatureMismatch y sd 44 never
ZIP_CD_003 MissingData Major CentralDirectory TruncationMarker n sd 56 detect+ref
ZIP_LFH_001 StructuralCorruption Major LocalFileHeader.signature SignatureMismatch y sd 56 detect
ZIP_LFH_002 MissingData Major LocalFileHeader StructureMissing n d 25 never
ZIP_CRC_001 ChecksumMismatch Minor LocalFileHeader.crc32 ChecksumMismatch y d 10 detect
ZIP_CRC_002 ChecksumMismatch Major LocalFileHeader.crc32 ChecksumMismatch y sd 44 never
ZIP_SIZE_001 StructuralCorruption Major CentralDirHeader.compressed_size LengthOverflow n sd 56 detect+ref
ZIP_SIZE_002 Truncation Major stream TruncationMarker n sd 25 never
ZIP_TRUNC_001 Truncation Minor stream.tail TruncationMarker n sd 13 ref
ZIP_TRUNC_002 Truncation Major stream.tail TruncationMarker n sd 44 ref
ZIP_TRUNC_003 Truncation Catastrophic stream.tail TruncationMarker n all 68 ref
ZIP_TRUNC_004 Truncation Catastrophic stream.header TruncationMarker n all 85 ref
ZIP_FLIP_001 BitFlip Minor payload.bits ChecksumMismatch n d 10 ref
ZIP_FLIP_002 BitFlip Major payload.bits ChecksumMismatch n sd 40 ref
ZIP_FLIP_003 BitFlip Major header.bits ChecksumMismatch n sd 44 ref
ZIP_EXTRA_001 StructuralCorruption Minor CentralDirHeader.extra_len LengthOverflow n sd 22 ref
ZIP_Z64_001 StructuralCorruption Major ZIP64_EOCD_Locator.signature SignatureMismatch y sd 56 never
ZIP_COMP_001 StructuralCorruption Catastrophic EOCD.signature SignatureMismatch y all 50 never
ZIP_COMP_002 Truncation Catastrophic stream.tail TruncationMarker n all 50 never
TAR_UST_001 StructuralCorruption Major UStarHeader.checksum ChecksumMismatch y sd 25 detect+ref
TAR_UST_002 StructuralCorruption Minor UStarHeader.magic SignatureMismatch y s 10 never
TAR_TERM_001 StructuralCorruption Minor Archive.terminator StructureMissing n d 10 detect
TAR_TERM_002 PaddingMismatch Benign Archive.terminator PaddingViolation n s 0 never
TAR_SIZE_001 StructuralCorruption Major UStarHeader.size LengthOverflow n sd 44 ref
TAR_SIZE_002 MissingData Major UStarHeader.size TruncationMarker n all 40 ref
TAR_BLOCK_001 BlockReorder Major block.order BlockReorder n sd 44 ref
TAR_TRUNC_001 Truncation Minor stream.tail TruncationMarker n sd 13 ref
TAR_TRUNC_002 Truncation Major stream.tail TruncationMarker n sd 44 detect+ref
TAR_TRUNC_003 Truncation Catastrophic stream.header TruncationMarker n all 85 ref
TAR_FLIP_001 BitFlip Minor payload.bits ChecksumMismatch n d 10 ref
TAR_FLIP_002 BitFlip Major header.bits ChecksumMismatch n sd 44 ref
TAR_GNU_001 StructuralCorruption Major GnuLongName.block StructureMissing n sd 56 ref
TAR_SPARSE_001 StructuralCorruption Major SparseMap ValueOutOfRange n s 25 never
TAR_COMP_001 StructuralCorruption Catastrophic UStarHeader.checksum ChecksumMismatch y all 50 never
ISO_PVD_001 StructuralCorruption Catastrophic PrimaryVolumeDescriptor.magic SignatureMismatch y all 85 detect+ref
ISO_PVD_002 StructuralCorruption Major PrimaryVolumeDescriptor.volume_space ValueOutOfRange n s 25 never
ISO_SVD_001 StructuralCorruption Major SupplementaryVolumeDescriptor.magic SignatureMismatch y sd 44 ref
ISO_PT_001 MissingData Major PrimaryVolumeDescriptor.path_table_location OffsetOutOfBounds n all 63 detect
ISO_PT_002 StructuralCorruption Major PathTable.entry_length LengthUnderflow n s 25 never
ISO_DIR_001 StructuralCorruption Major DirectoryRecord.length LengthUnderflow n sd 44 ref
ISO_DIR_002 MissingData Major DirectoryRecord.extent OffsetOutOfBounds n d 25 never
ISO_SECTOR_001 BitFlip Minor sector.bits ChecksumMismatch n d 10 ref
ISO_SECTOR_002 MissingData Major sector.data StructureMissing n sd 56 ref
ISO_TRUNC_001 Truncation Major stream.tail TruncationMarker n sd 44 ref
ISO_TRUNC_002 Truncation Catastrophic stream.tail TruncationMarker n all 68 ref
ISO_TRUNC_003 Truncation Catastrophic stream.header TruncationMarker n all 50 ref
GZ_MAGIC_001 StructuralCorruption Catastrophic gzip.magic SignatureMismatch y all 85 detect+ref
GZ_CM_001 StructuralCorruption Major gzip.cm ValueOutOfRange n s 25 detect
GZ_HCRC_001 ChecksumMismatch Minor gzip.hcrc ChecksumMismatch n d 10 never
GZ_ICRC_001 ChecksumMismatch Major gzip.crc32 ChecksumMismatch y sd 56 detect
GZ_ISIZE_001 StructuralCorruption Minor gzip.isize ValueOutOfRange n d 15 detect
GZ_TRUNC_001 Truncation Major stream.tail TruncationMarker n sd 25 detect
GZ_TRUNC_002 Truncation Catastrophic stream.header TruncationMarker n all 50 never
GZ_FLIP_001 BitFlip Major payload.bits ChecksumMismatch n sd 56 never
GZ_EXTRA_001 StructuralCorruption Minor gzip.extra_len LengthOverflow n s 10 never
PDF_HDR_001 StructuralCorruption Catastrophic pdf.header SignatureMismatch y all 85 detect+ref
PDF_HDR_002 StructuralCorruption Minor pdf.version ValueOutOfRange n s 10 never
PDF_EOF_001 StructuralCorruption Major pdf.eof StructureMissing n sd 30 detect
PDF_XREF_001 StructuralCorruption Major pdf.startxref OffsetOutOfBounds n sd 44 never
PDF_XREF_002 MissingData Major pdf.xref StructureMissing n d 25 never
PDF_XREF_003 StructuralCorruption Major pdf.xref.entry ValueOutOfRange n s 25 never
PDF_OBJ_001 StructuralCorruption Major pdf.objstm StructureMissing n s 25 never
PDF_OBJ_002 MissingData Major pdf.object StructureMissing n d 25 never
PDF_TRUNC_001 Truncation Minor stream.tail TruncationMarker n sd 10 never
PDF_TRUNC_002 Truncation Major stream.tail TruncationMarker n sd 25 never
PDF_TRUNC_003 Truncation Catastrophic stream.tail TruncationMarker n all 50 never
PDF_FLIP_001 BitFlip Minor payload.bits ChecksumMismatch n d 10 never
PDF_FLIP_002 BitFlip Major pdf.xref.bits ChecksumMismatch n d 25 never
PDF_COMP_001 StructuralCorruption Catastrophic pdf.xref StructureMissing n all 50 never
SQ_MAGIC_001 StructuralCorruption Catastrophic sqlite.magic SignatureMismatch y all 85 detect+ref
SQ_PGSIZE_001 StructuralCorruption Catastrophic sqlite.page_size ValueOutOfRange n all 85 detect
SQ_PGSIZE_002 StructuralCorruption Major sqlite.page_size ValueOutOfRange n sd 30 detect
SQ_FC_001 StructuralCorruption Major sqlite.change_counter ValueOutOfRange n s 10 detect
SQ_BTREE_001 StructuralCorruption Major sqlite.btree.page_type ValueOutOfRange n sd 44 detect
SQ_BTREE_002 StructuralCorruption Major sqlite.btree.cell_count ValueOutOfRange n sd 30 detect
SQ_BTREE_003 MissingData Major sqlite.btree.cell_ptr OffsetOutOfBounds n sd 20 detect
SQ_FREE_001 StructuralCorruption Minor sqlite.freelist_trunk ValueOutOfRange n d 15 detect
SQ_FREE_002 StructuralCorruption Major sqlite.freelist_count ValueOutOfRange n sd 20 detect
SQ_WAL_001 StructuralCorruption Minor wal.magic SignatureMismatch y s 10 detect
SQ_WAL_002 StructuralCorruption Major wal.salt ValueOutOfRange n s 15 detect
SQ_TRUNC_001 Truncation Major stream.tail TruncationMarker n sd 44 detect
SQ_TRUNC_002 Truncation Catastrophic stream.tail TruncationMarker n all 75 detect
SQ_FLIP_001 BitFlip Minor payload.bits ChecksumMismatch n d 10 never
SQ_FLIP_002 BitFlip Major sqlite.btree.key ChecksumMismatch n sd 25 never
SQ_COMP_001 StructuralCorruption Catastrophic sqlite.btree StructureMissing n all 70 never
RAR_MAGIC_001 StructuralCorruption Catastrophic signature SignatureMismatch y all 85 detect+ref
RAR_CRC_001 ChecksumMismatch Major trailer.checksum ChecksumMismatch n d 25 never
7Z_MAGIC_001 StructuralCorruption Catastrophic signature SignatureMismatch y all 85 detect+ref
7Z_CRC_001 ChecksumMismatch Major trailer.checksum ChecksumMismatch n d 25 detect
7Z_TRUNC_001 Truncation Catastrophic stream.tail TruncationMarker n sd 50 detect
BZ2_MAGIC_001 StructuralCorruption Catastrophic signature SignatureMismatch y all 85 detect+ref
BZ2_CRC_001 ChecksumMismatch Major trailer.checksum ChecksumMismatch n d 25 never
XZ_MAGIC_001 StructuralCorruption Catastrophic signature SignatureMismatch y all 85 detect+ref
XZ_CRC_001 ChecksumMismatch Major trailer.checksum ChecksumMismatch n d 25 never
ZST_MAGIC_001 StructuralCorruption Catastrophic signature SignatureMismatch y all 85 detect+ref
ZST_CRC_001 ChecksumMismatch Major trailer.checksum ChecksumMismatch n d 25 never
LZ4_MAGIC_001 StructuralCorruption Catastrophic signature SignatureMismatch y all 85 detect+ref
LZ4_CRC_001 ChecksumMismatch Major trailer.checksum ChecksumMismatch n d 25 never
INTEGRITY_HASH_001 ChecksumMismatch Major manifest.hash ChecksumMismatch y d 20 detect
GEN_TRUNC_001 Truncation Major stream.tail TruncationMarker n sd 44 ref
GEN_FLIP_001 BitFlip Minor payload.bits ChecksumMismatch n d 10 ref
GEN_MISSING_001 MissingData Major data.range StructureMissing n sd 44 ref
GEN_STRUCT_001 StructuralCorruption Major stream.layout ValueOutOfRange n sd 44 ref
GEN_REORDER_001 BlockReorder Major block.order BlockReorder n s 25 never
SEC_BOMB_RATIO_001 SecurityThreat Catastrophic decompress.ratio RatioExceeded n all 50 never
SEC_BOMB_OUTPUT_001 SecurityThreat Catastrophic decompress.output_bytes RatioExceeded n all 50 never
SEC_BOMB_OVERLAP_001 SecurityThreat Catastrophic LocalFileHeader.compressed_data OverlappingEntries n all 50 never
SEC_CYCLE_001 SecurityThreat Catastrophic container.sha256 CycleDetected y all 50 never
SEC_DEPTH_001 SecurityThreat Major container.depth DepthExceeded y all 25 never
SEC_ENTRIES_001 SecurityThreat Major container.entry_count ValueOutOfRange n all 25 never
SEC_TRAVERSAL_001 SecurityThreat Major entry.path PathEscape y all 25 never
SEC_SYMLINK_001 SecurityThreat Major entry.link_target PathEscape y all 25 never
SEC_PARSER_TIMEOUT_001 SecurityThreat Major container.cpu_time ValueOutOfRange n all 25 never
"""

# Confidence of a finding by its evidence.
EVIDENCE_CONFIDENCE = {
    "SignatureMismatch": 1.0,
    "ChecksumMismatch": 1.0,
    "OffsetOutOfBounds": 1.0,
    "LengthOverflow": 1.0,
    "LengthUnderflow": 0.95,
    "StructureMissing": 0.98,
    "ValueOutOfRange": 0.95,
    "BlockReorder": 0.8,
    "PaddingViolation": 0.7,
    "TruncationMarker": 0.99,
    "OverlappingEntries": 0.99,
    "RatioExceeded": 0.99,
    "DepthExceeded": 1.0,
    "PathEscape": 1.0,
    "CycleDetected": 1.0,
}
EMIT_THRESHOLD = 0.5
SEVERITY_RANK = {"Benign": 0, "Minor": 1, "Major": 2, "Catastrophic": 3}

# Formats with their labels, whether they hold members, and the suffixes of their names.
FORMATS = [
    ("zip", "ZIP archive", True, ".zip .jar .apk .docx .xlsx .pptx .epub .odt .ods"),
    ("tar", "TAR archive", True, ".tar"),
    ("iso9660", "ISO 9660 disc image", True, ".iso"),
    ("gzip", "gzip stream", False, ".gz .tgz"),
    ("sqlite", "SQLite database", False, ".db .sqlite .sqlite3"),
    ("seven_z", "7-Zip archive", True, ".7z"),
    ("rar", "RAR archive", True, ".rar"),
    ("pdf", "PDF document", False, ".pdf"),
    ("bzip2", "bzip2 stream", False, ".bz2"),
    ("xz", "xz stream", False, ".xz"),
    ("zstd", "Zstandard stream", False, ".zst .zstd"),
    ("lz4", "LZ4 stream", False, ".lz4"),
    ("cab", "Microsoft Cabinet archive", True, ".cab"),
    ("wim", "Windows image (WIM)", True, ".wim"),
    ("qcow2", "QCOW2 disk image", False, ".qcow2 .qcow"),
    ("vhd", "VHD virtual disk", False, ".vhd"),
    ("vhdx", "VHDX virtual disk", False, ".vhdx .avhdx"),
    ("vmdk", "VMDK virtual disk", False, ".vmdk"),
    ("dmg", "Apple disk image (DMG)", False, ".dmg"),
    ("acronis_tib", "Acronis True Image backup", False, ".tib"),
    ("macrium_x", "Macrium Reflect X image", False, ".mrimgx .mrbakx"),
]
#: Formats whose bytes the engine reads; the others are only named.
ENGINE_FORMATS = ("zip", "tar", "iso9660", "gzip", "sqlite", "seven_z", "rar", "pdf", "bzip2", "xz", "zstd", "lz4")

# Suffixes by which the engine falls back on the name, in order (the first that fits counts).
ENGINE_SUFFIXES = [
    ("gzip", ".gz .tgz"),
    ("sqlite", ".db .sqlite .sqlite3"),
    ("seven_z", ".7z"),
    ("rar", ".rar"),
    ("pdf", ".pdf"),
    ("bzip2", ".bz2"),
    ("xz", ".xz"),
    ("zstd", ".zst .zstd"),
    ("lz4", ".lz4"),
    ("zip", ".zip .jar .apk .docx .xlsx .pptx .epub"),
    ("tar", ".tar"),
    ("iso9660", ".iso"),
]

# Signatures in the order in which they are tried: format, offset (negative: from the end), bytes in hex, least length, provenance.
SIGNATURES = [
    ("zip", 0, "504B03", 4, "measured"),
    ("zip", 0, "504B05", 4, "measured"),
    ("zip", 0, "504B07", 4, "measured"),
    ("gzip", 0, "1F8B", 2, "measured"),
    ("sqlite", 0, "53514C69746520666F726D6174203300", 16, "measured"),
    ("pdf", 0, "255044462D", 5, "measured"),
    ("bzip2", 0, "425A68", 3, "measured"),
    ("xz", 0, "FD377A585A00", 6, "measured"),
    ("zstd", 0, "28B52FFD", 4, "measured"),
    ("lz4", 0, "04224D18", 4, "measured"),
    ("seven_z", 0, "377ABCAF271C", 6, "measured"),
    ("rar", 0, "526172211A07", 7, "measured"),
    ("cab", 0, "4D534346", 4, "measured"),
    ("wim", 0, "4D5357494D000000", 8, "measured"),
    ("qcow2", 0, "514649FB", 4, "measured"),
    ("vhdx", 0, "7668647866696C65", 8, "documented"),
    ("vhd", 0, "636F6E6563746978", 512, "documented"),
    ("vmdk", 0, "4B444D56", 512, "documented"),
    ("acronis_tib", 0, "CE24B9A220000000", 8, "documented"),
    ("vhd", -512, "636F6E6563746978", 512, "documented"),
    ("dmg", -512, "6B6F6C79", 512, "documented"),
    ("macrium_x", -12, "4D41435249554D5F46494C45", 20, "documented"),
    ("tar", 257, "7573746172", 263, "measured"),
    ("iso9660", 32769, "4344303031", 32775, "measured"),
]

# Repair strategies in the order of their registration: name, priority, technique, risk,
# whether an output that only holds the file's health may be kept (terminal).
STRATEGIES = [
    ("bitflip", 90, "ReferenceVerify", "Inferred", False),
    ("tar-terminator-append", 88, "HeaderRepair", "Safe", False),
    ("tar-checksum-fix", 85, "HeaderRepair", "Safe", False),
    ("gz-magic-restore", 85, "HeaderRepair", "Safe", False),
    ("sevenz-signature-restore", 85, "HeaderRepair", "Safe", False),
    ("gz-member-salvage", 84, "MemberSalvage", "Lossy", True),
    ("gz-trailer-recompute", 82, "HeaderRepair", "Inferred", False),
    ("zip-rebuild", 80, "CentralDirRebuild", "Safe", True),
    ("tar-reorder", 80, "BlockReorder", "Safe", False),
    ("tar-size-resync", 78, "HeaderRepair", "Inferred", False),
    ("zip-crc-fix", 75, "CrcAnnotate", "Safe", False),
    ("iso-sector", 70, "SectorRead", "Lossy", False),
    ("tar-continuation-salvage", 45, "MemberSalvage", "Lossy", True),
    ("gz-partial-inflate", 40, "PartialExtract", "Lossy", False),
    ("partial-extract", 30, "PartialExtract", "Lossy", True),
    ("forensic-carve", 10, "ForensicCarve", "Lossy", True),
]

# Checksums by width, polynomial, start, reflection in and out, final xor.
CRCS = [
    ("CRC-32/ISO-HDLC", 32, 0x04C11DB7, 0xFFFFFFFF, True, True, 0xFFFFFFFF),
    ("CRC-32/BZIP2", 32, 0x04C11DB7, 0xFFFFFFFF, False, False, 0xFFFFFFFF),
    ("CRC-64/XZ", 64, 0x42F0E1EBA9EA3693, 0xFFFFFFFFFFFFFFFF, True, True, 0xFFFFFFFFFFFFFFFF),
]


def rules() -> list[tuple]:
    """(rule_id, category, severity, severity_rank, field, evidence, deterministic, hits structural, data, metadata, points, emitted_by, base confidence)."""
    out = []
    for line in RULES_TEXT.strip().split("\n"):
        rule, category, severity, field, evidence, det, hits, points, emitter = line.split()
        hit = {"s": (1, 0, 0), "d": (0, 1, 0), "sd": (1, 1, 0), "all": (1, 1, 1)}[hits]
        confidence = 1.0 if det == "y" else EVIDENCE_CONFIDENCE[evidence]
        out.append((rule, category, severity, SEVERITY_RANK[severity], field, evidence, det == "y", *hit, int(points), emitter, confidence))
    return out


RULE_SCHEMA = "rule_id string, category string, severity string, severity_rank int, field string, evidence_type string, deterministic boolean, hits_structural int, hits_data int, hits_metadata int, points int, emitted_by string, base_confidence double"


def rule_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rules(), RULE_SCHEMA)


def strategy_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*s, n) for n, s in enumerate(STRATEGIES)], "strategy string, priority int, technique string, risk string, terminal boolean, reg_ord int")


def signature_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, *s) for n, s in enumerate(SIGNATURES, 1)], "ord int, format string, at int, magic string, min_len int, provenance string")


def format_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, label, multi, ext.split(), f in ENGINE_FORMATS) for f, label, multi, ext in FORMATS], "format string, label string, multi_member boolean, extensions array<string>, readable boolean")
