"""Seeded damage for tests and drills: each mutator changes bytes by a generator keyed by (seed, id), so entries do not depend on their order."""

from __future__ import annotations

import hashlib
import random
import struct
from collections.abc import Callable

from . import bytesio as b

Mutator = Callable[[bytes, random.Random], bytes]


def generator(seed: int, entry: str) -> random.Random:
    return random.Random(hashlib.sha256(f"{seed}\0{entry}".encode()).digest())


def _range(data: bytes, r: random.Random, n: int) -> tuple[int, int]:
    n = min(n, len(data))
    at = r.randrange(len(data) - n + 1) if data else 0
    return at, at + n


def put(data: bytes, at: int, new: bytes) -> bytes:
    return data[:at] + new + data[at + len(new) :] if 0 <= at and at + len(new) <= len(data) else data


def flip(data: bytes, at: int, bit: int = 0) -> bytes:
    return put(data, at, bytes([data[at] ^ 1 << bit])) if at < len(data) else data


def flips(n: int, lo: int = 0) -> Mutator:
    def mutate(data: bytes, r: random.Random) -> bytes:
        out = bytearray(data)
        for _ in range(n if len(data) > lo else 0):
            out[r.randrange(lo, len(out))] ^= 1 << r.randrange(8)
        return bytes(out)

    return mutate


def tail(share: float) -> Mutator:
    return lambda data, r: data[: len(data) - max(1, int(len(data) * share))]


def head(share: float) -> Mutator:
    return lambda data, r: data[max(1, int(len(data) * share)) :]


def over(fill: Callable[[random.Random, int], bytes], n: int) -> Mutator:
    """A range overwritten by what fill makes."""

    def mutate(data: bytes, r: random.Random) -> bytes:
        lo, hi = _range(data, r, n)
        return put(data, lo, fill(r, hi - lo))

    return mutate


def _insert(data: bytes, r: random.Random) -> bytes:
    at = r.randrange(len(data) + 1)
    return data[:at] + r.randbytes(16) + data[at:]


def _delete(data: bytes, r: random.Random) -> bytes:
    lo, hi = _range(data, r, 64)
    return data[:lo] + data[hi:]


def _swap(data: bytes, r: random.Random) -> bytes:
    n = len(data) // 512
    if n < 2:
        return data
    i, j = sorted(r.sample(range(n), 2))
    k = lambda x: data[x * 512 : x * 512 + 512]
    return data[: i * 512] + k(j) + data[i * 512 + 512 : j * 512] + k(i) + data[j * 512 + 512 :]


def _duplicate(data: bytes, r: random.Random) -> bytes:
    lo, hi = _range(data, r, 512)
    return data[:hi] + data[lo:hi] + data[hi:]


def _sector(data: bytes, r: random.Random) -> bytes:
    at = r.randrange(max(1, len(data) // 2048)) * 2048
    return put(data, at, bytes(min(2048, len(data) - at)))


def _interrupted(data: bytes, r: random.Random) -> bytes:
    at = len(data) // 2 + r.randrange(max(1, len(data) // 4))
    return data[:at] + bytes(len(data) - at)


def at_zip(place: str, offset: int, new: bytes | None, zero: int = 4) -> Mutator:
    """Bytes at an offset of the end record, the first directory record or the first local header."""

    def mutate(data: bytes, r: random.Random) -> bytes:
        p = b.parse_zip(data)
        at = {"eocd": p.eocd, "central": p.central[0].record_offset if p.central else None, "local": p.local[0].offset if p.local else None}[place]
        return data if at is None else put(data, at + offset, new if new is not None else r.randbytes(zero))

    return mutate


def _without_directory(data: bytes, r: random.Random) -> bytes:
    p = b.parse_zip(data)
    return data if p.cd_offset is None else data[: p.cd_offset]


def _payload(data: bytes, r: random.Random) -> bytes:
    e = next((e for e in b.parse_zip(data).local if e.compressed), None)
    return flip(data, e.data_offset + r.randrange(e.compressed), r.randrange(8)) if e else data


def _tar_size(data: bytes, r: random.Random) -> bytes:
    size = b.octal(data[124:136]) or 0
    out = put(data, 124, b"%011o\0" % (size + 512 * r.randint(1, 4)))
    return put(out, 148, b"%06o\0 " % b.tar_checksum(out[:512]))


def both(first: Mutator, second: Mutator) -> Mutator:
    return lambda data, r: second(first(data, r), r)


#: (format, or * for any) and mutator by name.
MUTATORS: dict[str, tuple[str, Mutator]] = {
    "truncate_tail_1": ("*", tail(0.01)),
    "truncate_tail_5": ("*", tail(0.05)),
    "truncate_tail_20": ("*", tail(0.20)),
    "truncate_tail_50": ("*", tail(0.50)),
    "truncate_head_5": ("*", head(0.05)),
    "bitflip": ("*", flips(1)),
    "bitflips_payload": ("*", flips(8, 512)),
    "bitflips_anywhere": ("*", flips(24)),
    "zero_range": ("*", over(lambda r, n: bytes(n), 64)),
    "random_range": ("*", over(lambda r, n: r.randbytes(n), 64)),
    "insert_bytes": ("*", _insert),
    "delete_range": ("*", _delete),
    "swap_ranges": ("*", _swap),
    "duplicate_range": ("*", _duplicate),
    "sector_failure": ("*", _sector),
    "interrupted_write": ("*", _interrupted),
    "corrupt_magic": ("*", lambda data, r: put(data, 0, bytes(x ^ 0xFF for x in data[:4]))),
    "corrupt_trailing_checksum": ("*", lambda data, r: data[:-8] + bytes(x ^ 0xFF for x in data[-8:-4]) + data[-4:]),
    "zip_zero_eocd_signature": ("zip", at_zip("eocd", 0, bytes(4))),
    "zip_eocd_cd_offset_oob": ("zip", at_zip("eocd", 16, b"\xf0\xff\xff\xff")),
    "zip_corrupt_crc": ("zip", at_zip("central", 16, None)),
    "zip_corrupt_compressed_size": ("zip", at_zip("central", 20, struct.pack("<I", 0x00FFFFFF))),
    "zip_remove_central_directory": ("zip", _without_directory),
    "zip_corrupt_local_header_sig": ("zip", at_zip("local", 0, bytes(4))),
    "zip_extra_field_overflow": ("zip", at_zip("central", 30, b"\xff\xff")),
    "zip_corrupt_payload": ("zip", _payload),
    "zip_compound_eocd_crc": ("zip", both(at_zip("central", 16, None), at_zip("eocd", 0, bytes(4)))),
    "zip_compound_trunc_bitflip": ("zip", both(flips(4), tail(0.05))),
    "tar_corrupt_checksum": ("tar", lambda data, r: put(data, 148, b"000000")),
    "tar_remove_terminator": ("tar", lambda data, r: data[:-1024]),
    "tar_swap_blocks": ("tar", _swap),
    "tar_overstate_size": ("tar", _tar_size),
    "tar_compound_checksum_trunc": ("tar", both(lambda data, r: put(data, 148, b"000000"), tail(0.05))),
    "iso_zero_pvd_magic": ("iso9660", lambda data, r: put(data, 32769, bytes(5))),
    "iso_path_table_oob": ("iso9660", lambda data, r: put(data, 32768 + 140, b"\xff\xff\xff\x0f")),
    "iso_corrupt_svd": ("iso9660", lambda data, r: put(data, 17 * 2048 + 1, bytes(5))),
    "gz_corrupt_magic": ("gzip", lambda data, r: put(data, 0, b"\0\0")),
    "gz_corrupt_isize": ("gzip", lambda data, r: data[:-4] + bytes(x ^ 0x5A for x in data[-4:])),
    "gz_corrupt_trailer_crc": ("gzip", lambda data, r: data[:-8] + bytes(x ^ 0x5A for x in data[-8:-4]) + data[-4:]),
    "pdf_corrupt_header": ("pdf", lambda data, r: put(data, 0, b"XXXXX")),
    "pdf_remove_eof_marker": ("pdf", lambda data, r: data.replace(b"%%EOF", b"")),
    "pdf_corrupt_startxref": ("pdf", lambda data, r: data.replace(b"startxref", b"startxxxx")),
    "sqlite_corrupt_magic": ("sqlite", lambda data, r: put(data, 0, bytes(16))),
    "sqlite_corrupt_page_size": ("sqlite", lambda data, r: put(data, 16, b"\x12\x35")),
    "sqlite_corrupt_btree_page": ("sqlite", lambda data, r: put(data, 100, b"\x07")),
    "sqlite_corrupt_freelist": ("sqlite", lambda data, r: put(data, 32, b"\x7f\xff\xff\xff")),
}

#: Rules of which detection must find one after the mutator, where it can tell without a reference copy.
EXPECTED: dict[str, tuple[str, ...]] = {
    "zip_zero_eocd_signature": ("ZIP_EOCD_001",),
    "zip_eocd_cd_offset_oob": ("ZIP_EOCD_002",),
    "zip_corrupt_crc": ("ZIP_CRC_001",),
    "zip_corrupt_compressed_size": ("ZIP_SIZE_001",),
    "zip_remove_central_directory": ("ZIP_CD_001",),
    "zip_corrupt_local_header_sig": ("ZIP_LFH_001",),
    "zip_corrupt_payload": ("ZIP_CRC_001",),
    "zip_compound_eocd_crc": ("ZIP_EOCD_001",),
    "tar_corrupt_checksum": ("TAR_UST_001",),
    "tar_remove_terminator": ("TAR_TERM_001",),
    "tar_compound_checksum_trunc": ("TAR_UST_001",),
    "iso_zero_pvd_magic": ("ISO_PVD_001",),
    "iso_path_table_oob": ("ISO_PT_001",),
    "gz_corrupt_magic": ("GZ_MAGIC_001",),
    "gz_corrupt_isize": ("GZ_ISIZE_001",),
    "gz_corrupt_trailer_crc": ("GZ_ICRC_001",),
    "pdf_corrupt_header": ("PDF_HDR_001",),
    "pdf_remove_eof_marker": ("PDF_EOF_001",),
    "sqlite_corrupt_magic": ("SQ_MAGIC_001",),
    "sqlite_corrupt_page_size": ("SQ_PGSIZE_001",),
    "sqlite_corrupt_btree_page": ("SQ_BTREE_001",),
    "sqlite_corrupt_freelist": ("SQ_FREE_001",),
}


def mutate(name: str, data: bytes, seed: int, entry: str) -> bytes:
    return MUTATORS[name][1](data, generator(seed, entry))


# --- clean builders of other containers ------------------------------------------------------------

_RELS = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="{}"/></Relationships>'


def build_opc(kind: str, text: str) -> bytes:
    """A minimal docx, xlsx or pptx package."""
    main = {"docx": "word/document.xml", "xlsx": "xl/workbook.xml", "pptx": "ppt/presentation.xml"}[kind]
    types = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/></Types>'
    return b.build_zip([("[Content_Types].xml", types.encode()), ("_rels/.rels", _RELS.format(main).encode()), (main, f"<main>{text}</main>".encode())])


def build_iso() -> bytes:
    out = bytearray(21 * 2048)
    out[32768:32775] = b"\x01CD001\x01"
    out[32768 + 140 : 32768 + 144] = struct.pack("<I", 18)
    out[17 * 2048 : 17 * 2048 + 7] = b"\xffCD001\x01"
    return bytes(out)


def build_pdf(text: str = "") -> bytes:
    body = b"%PDF-1.4\n1 0 obj<</Type/Catalog>>endobj\n% " + text.encode() + b"\n"
    return body + b"xref\n0 1\n0000000000 65535 f \ntrailer<</Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % len(body)


def build_sqlite(pages: int = 3, size: int = 4096) -> bytes:
    """Empty leaf pages behind a right header."""
    leaf = b"\x0d" + struct.pack(">HHHB", 0, 0, size & 0xFFFF, 0)
    head = bytearray(100)
    head[:16] = b"SQLite format 3\0"
    head[16:20] = struct.pack(">HBB", size, 1, 1)
    head[24:32] = struct.pack(">II", 7, pages)
    head[92:96] = struct.pack(">I", 7)
    return bytes(head) + leaf + bytes(size - 100 - len(leaf)) + (leaf + bytes(size - len(leaf))) * (pages - 1)
