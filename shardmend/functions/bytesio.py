"""Readers and builders of container bytes, one file at a time, in plain Python.

They run inside Arrow-batched functions; everything after them is DataFrame work. Readers never raise
on damaged bytes: what cannot be read is absent or null. Decompression is bounded.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

MAX_INFLATE = 512 << 20
MAX_PAGES, MAX_CELLS = 512, 8
_LFH, _CDFH, _EOCD, _DD = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x07\x08"


def inflate(data: bytes, wbits: int = -15, limit: int = MAX_INFLATE) -> tuple[bytes, bool, int]:
    """(bytes, whether the stream ended, compressed bytes used); stops at the limit. Raises zlib.error on broken streams."""
    d = zlib.decompressobj(wbits)
    out = d.decompress(data, limit)
    return out, d.eof, len(data) - len(d.unused_data) - len(d.unconsumed_tail)


def inflate_prefix(data: bytes, wbits: int = -15, limit: int = MAX_INFLATE, step: int = 512) -> tuple[bytes, bool, int]:
    """Like inflate, but a broken stream gives the bytes before the break."""
    d, out, size, at = zlib.decompressobj(wbits), [], 0, 0
    try:
        while at < len(data) and not d.eof and size < limit:
            out.append(d.decompress(data[at : at + step], limit - size))
            size += len(out[-1])
            at += step
    except zlib.error:
        return b"".join(out), False, at
    return b"".join(out), d.eof, min(at, len(data)) - len(d.unused_data)


def inflate_sums(data: bytes, at: int, step: int = 1 << 16) -> tuple[bool, int, int, int]:
    """(whether the raw stream at an offset ended, the offset after it, checksum and size of its bytes), in bounded memory whatever the size. A broken stream has not ended."""
    d, crc, size = zlib.decompressobj(-15), 0, 0
    view, left = memoryview(data), b""
    try:
        while not d.eof and (left or at < len(data)):
            if not left:
                left = view[at : at + step]
                at += len(left)
            out = d.decompress(left, 1 << 20)
            left = d.unconsumed_tail
            crc, size = zlib.crc32(out, crc), size + len(out)
    except zlib.error:
        return False, at, crc, size
    return d.eof, at - len(d.unused_data), crc, size


# --- ZIP ------------------------------------------------------------------------------------------


class ZipEntry(NamedTuple):
    """One directory record or local header."""

    offset: int  # of the local header, as the record says
    name: bytes
    method: int
    flags: int
    crc32: int
    compressed: int
    size: int
    data_offset: int | None  # of the payload, for local headers
    zip64: bool
    link: bool
    record_offset: int


class ZipParse(NamedTuple):
    eocd: int | None
    cd_offset: int | None
    cd_size: int | None
    declared: int | None
    located_by_size: bool
    base: int
    central: list[ZipEntry]
    local: list[ZipEntry]


def has_zip64(extra: bytes, *values: int) -> bool:
    at = 0
    while at + 4 <= len(extra):
        tag, n = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            return True
        at += 4 + n
    return 0xFFFFFFFF in values


def find_eocd(data: bytes) -> int | None:
    at = data.rfind(_EOCD, max(0, len(data) - 22 - 65535))
    return at if at >= 0 and at + 22 <= len(data) else None


def central_record(data: bytes, at: int) -> tuple[ZipEntry, int] | None:
    """A directory record and the offset after it."""
    if data[at : at + 4] != _CDFH or at + 46 > len(data):
        return None
    made, _, flags, method, _, _, crc, comp, size, n, e, c, _, _, attrs, lho = struct.unpack_from("<HHHHHHIIIHHHHHII", data, at + 4)
    end = at + 46 + n + e + c
    if end > len(data):
        return None
    extra = data[at + 46 + n : at + 46 + n + e]
    link = made >> 8 == 3 and (attrs >> 16) & 0o170000 == 0o120000
    return ZipEntry(lho, data[at + 46 : at + 46 + n], method, flags, crc, comp, size, None, has_zip64(extra, comp, size, lho), link, at), end


def central_chain(data: bytes, at: int) -> list[ZipEntry]:
    """Records one after another; the declared count is not a bound."""
    out = []
    while got := central_record(data, at):
        out.append(got[0])
        at = got[1]
    return out


def local_record(data: bytes, at: int) -> ZipEntry | None:
    if data[at : at + 4] != _LFH or at + 30 > len(data):
        return None
    _, flags, method, _, _, crc, comp, size, n, e = struct.unpack_from("<HHHHHIIIHH", data, at + 4)
    start = at + 30 + n + e
    if start > len(data) or n == 0 and not size:
        return None
    extra = data[at + 30 + n : start]
    return ZipEntry(at, data[at + 30 : at + 30 + n], method, flags, crc, comp, size, start, has_zip64(extra, comp, size), False, at)


def next_signature(data: bytes, at: int) -> int:
    found = [p for s in (_LFH, _CDFH, _DD) if (p := data.find(s, at)) >= 0]
    return min(found, default=len(data))


def local_headers(data: bytes, most: int | None = None) -> Iterator[ZipEntry | None]:
    """Local headers from front to back, None for each signature that starts none. A known payload is skipped; an unsized entry runs to the next signature."""
    stop = len(data) if most is None else min(most, len(data))
    at = data.find(_LFH, 0, stop)
    while at >= 0:
        e = local_record(data, at)
        if e is None:
            yield None
            at = data.find(_LFH, at + 1, stop)
            continue
        if e.compressed and e.data_offset + e.compressed <= len(data):
            nxt = e.data_offset + e.compressed
        else:
            nxt = next_signature(data, e.data_offset)
            if e.flags & 8 and data[nxt : nxt + 4] == _DD and nxt + 16 <= len(data):
                crc, comp, size = struct.unpack_from("<III", data, nxt + 4)
                if comp == nxt - e.data_offset:
                    e = e._replace(crc32=crc, compressed=comp, size=size)
        yield e
        at = data.find(_LFH, max(nxt, at + 4), stop)


def scan_local(data: bytes) -> list[ZipEntry]:
    return [e for e in local_headers(data) if e is not None]


def parse_zip(data: bytes) -> ZipParse:
    eocd = find_eocd(data)
    cd = size = count = None
    by_size, central, base = False, [], 0
    if eocd is not None:
        count, size, cd = struct.unpack_from("<HII", data, eocd + 10)
        central = central_chain(data, cd)
        if not central and count and eocd - size >= 0 and (central := central_chain(data, eocd - size)):
            by_size, base = True, eocd - size - cd
    return ZipParse(eocd, cd, size, count, by_size, base, central, scan_local(data))


def surviving_chains(data: bytes, limit: int = 262_144) -> list[list[ZipEntry]]:
    """Every maximal chain of directory records in the bytes."""
    out, at = [], data.find(_CDFH)
    while at >= 0 and len(out) < limit:
        chain = central_chain(data, at)
        if chain:
            out.append(chain)
            last = central_record(data, chain[-1].record_offset)
            at = data.find(_CDFH, last[1])
        else:
            at = data.find(_CDFH, at + 1)
    return out


def extract_zip(data: bytes, e: ZipEntry, at: int | None = None) -> tuple[str, bytes | None, int | None]:
    """(status, bytes, crc of the bytes) of an entry, its header looked up at `at` or where it says."""
    head = local_record(data, e.offset if at is None else at)
    if e.flags & 0x41:
        return "ENCRYPTED", None, None
    if e.zip64:
        return "ZIP64_UNSUPPORTED", None, None
    if head is None:
        return "BAD_LOCAL_HEADER", None, None
    if e.flags & 8 and not e.compressed and e.method == 0 and not e.size and e.crc32:
        return "STREAMED_UNSIZED", None, None
    if e.flags & 8 and not e.compressed and not e.size and not e.crc32 and next_signature(data, head.data_offset) != head.data_offset:
        return "STREAMED_UNSIZED", None, None
    raw = data[head.data_offset : head.data_offset + e.compressed]
    if len(raw) < e.compressed:
        return "TRUNCATED", None, None
    if e.method == 0:
        body = raw
    elif e.method == 8:
        try:
            body, whole, _ = inflate(raw)
        except zlib.error:
            return "DECODE_FAILED", None, None
        if not whole:
            return "DECODE_FAILED", None, None
    else:
        return "UNSUPPORTED", None, None
    crc = zlib.crc32(body)
    return ("VERIFIED_CRC" if crc == e.crc32 and len(body) == e.size else "CRC_MISMATCH"), body, crc


def build_zip(members: list[tuple[str, bytes]], streamed: bool = False) -> bytes:
    """A ZIP of the members, deflated where that is smaller; `streamed` writes data descriptors and no local sizes."""
    out, directory = bytearray(), bytearray()
    for name, body in members:
        n = name.encode()
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = c.compress(body) + c.flush()
        method, packed = (8, packed) if len(packed) < len(body) else (0, body)
        crc, at = zlib.crc32(body), len(out)
        flags = 0x800 | (8 if streamed else 0)
        known = (0, 0, 0) if streamed else (crc, len(packed), len(body))
        out += struct.pack("<4sHHHHHIIIHH", _LFH, 20, flags, method, 0, 0x21, *known, len(n), 0) + n + packed
        if streamed:
            out += struct.pack("<4sIII", _DD, crc, len(packed), len(body))
        directory += struct.pack("<4sHHHHHHIIIHHHHHII", _CDFH, 20, 20, flags, method, 0, 0x21, crc, len(packed), len(body), len(n), 0, 0, 0, 0, 0, at) + n
    return bytes(out + directory + struct.pack("<4sHHHHIIH", _EOCD, 0, 0, len(members), len(members), len(directory), len(out), 0))


def directory_of(entries: list[ZipEntry], at: int) -> bytes:
    """A directory and end record for entries whose offsets are right, to be placed at `at`."""
    d = b"".join(struct.pack("<4sHHHHHHIIIHHHHHII", _CDFH, 20, 20, e.flags, e.method, 0, 0x21, e.crc32, e.compressed, e.size, len(e.name), 0, 0, 0, 0, 0, e.offset) + e.name for e in entries)
    return d + struct.pack("<4sHHHHIIH", _EOCD, 0, 0, len(entries), len(entries), len(d), at, 0)


# --- TAR ------------------------------------------------------------------------------------------


class TarMember(NamedTuple):
    offset: int
    name: bytes
    size: int | None
    data_offset: int
    kind: bytes
    link: bytes
    checksum_ok: bool
    truncated: bool


def octal(field: bytes) -> int | None:
    """Number of an octal field; an empty one is None."""
    text = field.split(b"\0")[0].strip(b" ")
    if not text or any(c not in b"01234567" for c in text):
        return None
    return int(text, 8)


def tar_checksum(block: bytes) -> int:
    return sum(block[:148]) + 8 * 32 + sum(block[156:512])


def tar_header_ok(block: bytes) -> bool:
    return len(block) == 512 and octal(block[148:156]) == tar_checksum(block)


def walk_tar(data: bytes) -> tuple[list[TarMember], bool, bool]:
    """(members, whether two zero blocks end it, whether it is cut short)."""
    out, at = [], 0
    while at + 512 <= len(data):
        block = data[at : at + 512]
        if not any(block):
            return out, not any(data[at + 512 : at + 1024]) and at + 1024 <= len(data), False
        size = octal(block[124:136])
        prefix = block[345:500].split(b"\0")[0] if block[257:262] == b"ustar" else b""
        name = block[:100].split(b"\0")[0]
        full = prefix + b"/" + name if prefix else name
        end = at + 512 + -(-(size or 0) // 512) * 512
        cut = at + 512 + (size or 0) > len(data)
        out.append(TarMember(at, full, size, at + 512, block[156:157], block[157:257].split(b"\0")[0], tar_header_ok(block), cut))
        if cut:
            return out, False, True
        at = end
    return out, False, at > len(data) or len(data) % 512 != 0


def build_tar(members: list[tuple[str, bytes]]) -> bytes:
    return b"".join(tar_member(n, b) for n, b in members) + bytes(1024)


def tar_member(name: str, body: bytes) -> bytes:
    n = name.encode()[:100]
    head = bytearray(512)
    head[: len(n)] = n
    for at, text in ((100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % len(body)), (136, b"00000000000\0"), (148, b"        "), (156, b"0"), (257, b"ustar\x0000")):
        head[at : at + len(text)] = text
    head[148:156] = b"%06o\0 " % tar_checksum(bytes(head))
    return bytes(head) + body + bytes(-len(body) % 512)


class Segment(NamedTuple):
    """A stretch of a damaged stream that was made out again."""

    kind: str  # Verified, Unverified or StoredBlock
    name: bytes
    start: int
    end: int
    body: bytes


def salvage_tar(data: bytes) -> list[Segment]:
    """Members whose header checksum holds, found again after damage at any 512-byte step."""
    out, at = [], 0
    while at + 512 <= len(data):
        block = data[at : at + 512]
        size = octal(block[124:136])
        if not any(block) or not tar_header_ok(block) or size is None or at + 512 + size > len(data):
            at += 512
            continue
        prefix = block[345:500].split(b"\0")[0] if block[257:262] == b"ustar" else b""
        name = block[:100].split(b"\0")[0]
        out.append(Segment("Verified", prefix + b"/" + name if prefix else name, at, at + 512 + size, data[at + 512 : at + 512 + size]))
        at += 512 + -(-size // 512) * 512
    return out


# --- gzip -----------------------------------------------------------------------------------------


def gzip_header(data: bytes, at: int = 0) -> int | None:
    """Length of a member's header."""
    if data[at : at + 3] != b"\x1f\x8b\x08" or at + 10 > len(data):
        return None
    return header_length(data, at)


def header_length(data: bytes, at: int) -> int | None:
    """Length by the flags alone, whatever the magic."""
    flags, p = data[at + 3], at + 10
    if flags & 0xE0:
        return None
    if flags & 4:
        if p + 2 > len(data):
            return None
        p += 2 + int.from_bytes(data[p : p + 2], "little")
    for bit in (8, 16):
        if flags & bit:
            p = data.find(b"\0", p) + 1
            if p == 0:
                return None
    if flags & 2:
        p += 2
    return p - at if p <= len(data) else None


def gzip_name(data: bytes) -> bytes | None:
    if gzip_header(data) is None or not data[3] & 8:
        return None
    p = 10 + (2 + int.from_bytes(data[10:12], "little") if data[3] & 4 else 0)
    return data[p : data.find(b"\0", p)]


def salvage_gzip(data: bytes, limit: int = MAX_INFLATE) -> list[Segment]:
    """Members in any bytes: verified by their trailer, else what can be inflated, and stored blocks after that."""
    out, at, left = [], data.find(b"\x1f\x8b\x08"), limit
    while at >= 0:
        n = gzip_header(data, at)
        if n is None:
            at = data.find(b"\x1f\x8b\x08", at + 1)
            continue
        start = at + n
        body, whole, used = inflate_prefix(data[start:], limit=left)
        end = start + used
        if whole and end + 8 <= len(data) and struct.unpack_from("<II", data, end) == (zlib.crc32(body), len(body) & 0xFFFFFFFF):
            out.append(Segment("Verified", b"", at, end + 8, body))
            left -= len(body)
            at = data.find(b"\x1f\x8b\x08", end + 8)
            continue
        nxt = data.find(b"\x1f\x8b\x08", at + 1)
        if body:
            out.append(Segment("Unverified", b"", at, min(end, len(data)), body))
            left -= len(body)
        out += [Segment("StoredBlock", b"", a, b, data[a + 4 : b]) for a, b in stored_blocks(data, end, nxt if nxt >= 0 else len(data))] if not whole else []
        at = nxt
    return out


def stored_blocks(data: bytes, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """(offset of LEN, end) of stretches that look like stored deflate blocks: LEN, its complement, and 8 bytes or more. The block's type shares its byte with bits before it, so it tells nothing."""
    p = lo
    while p + 4 <= hi:
        n, c = struct.unpack_from("<HH", data, p)
        if n ^ c == 0xFFFF and n >= 8 and p + 4 + n <= hi:
            yield p, p + 4 + n
            p += 4 + n
        else:
            p += 1


def build_gzip(body: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + c.compress(body) + c.flush() + struct.pack("<II", zlib.crc32(body), len(body) & 0xFFFFFFFF)


# --- other formats --------------------------------------------------------------------------------


class IsoParse(NamedTuple):
    magic_ok: bool
    path_table: int | None
    path_table_ok: bool


def parse_iso(data: bytes) -> IsoParse:
    pvd = data[32768:34816]
    ok = pvd[:6] == b"\x01CD001"
    if not ok or len(pvd) < 144:
        return IsoParse(ok, None, True)
    lba = struct.unpack_from("<I", pvd, 140)[0]
    return IsoParse(True, lba, lba * 2048 < len(data))


class SqliteParse(NamedTuple):
    readable: bool
    magic_ok: bool
    page_size: int
    page_size_ok: bool
    declared: int
    actual: int | None
    write_version: int
    counter: int
    valid_for: int
    trunk: int
    free: int
    salts: tuple[int, int]
    pages: list[tuple[str, int]]  # (rule, page number)


def parse_sqlite(data: bytes) -> SqliteParse:
    if len(data) < 100:
        return SqliteParse(False, False, 0, False, 0, None, 0, 0, 0, 0, 0, (0, 0), [])
    raw = int.from_bytes(data[16:18], "big")
    size = 65536 if raw == 1 else raw
    ok = 512 <= size <= 65536 and size & (size - 1) == 0
    counter, declared, trunk, free = struct.unpack_from(">IIII", data, 24)
    valid_for = int.from_bytes(data[92:96], "big")
    actual = len(data) // size if ok else None
    bad = [*_sqlite_pages(data, size, min(actual, MAX_PAGES))] if ok else []
    return SqliteParse(True, data[:16] == b"SQLite format 3\0", size, ok, declared, actual, data[18], counter, valid_for, trunk, free, (0, 0), bad)


def _sqlite_pages(data: bytes, size: int, n: int) -> Iterator[tuple[str, int]]:
    for k in range(n):
        at = k * size + (100 if k == 0 else 0)
        kind = data[at] if at < len(data) else None
        if kind not in (2, 5, 10, 13):
            yield "SQ_BTREE_001", k + 1
            continue
        cells = int.from_bytes(data[at + 3 : at + 5], "big")
        head = 12 if kind in (2, 5) else 8
        if cells * 2 > size - head:
            yield "SQ_BTREE_002", k + 1
            continue
        for c in range(min(cells, MAX_CELLS)):
            p = at + head + 2 * c
            if int.from_bytes(data[p : p + 2], "big") >= size and size < 65536:
                yield "SQ_BTREE_003", k + 1
                break


class SevenZ(NamedTuple):
    magic_ok: bool
    header_ok: bool  # the start header's checksum
    next_offset: int | None
    next_size: int | None
    next_inside: bool
    next_ok: bool | None


def parse_sevenz(data: bytes) -> SevenZ:
    magic = data[:6] == b"7z\xbc\xaf\x27\x1c"
    if len(data) < 32:
        return SevenZ(magic, False, None, None, False, None)
    crc = struct.unpack_from("<I", data, 8)[0]
    offset, size, next_crc = struct.unpack_from("<QQI", data, 12)
    ok = zlib.crc32(data[12:32]) == crc
    inside = 32 + offset + size <= len(data)
    return SevenZ(magic, ok, offset if offset < 1 << 63 else None, size if size < 1 << 63 else None, inside, zlib.crc32(data[32 + offset : 32 + offset + size]) == next_crc if inside else None)


class RarBlock(NamedTuple):
    offset: int
    kind: int | None
    header_ok: bool
    name: bytes | None
    packed: int | None
    size: int | None
    crc32: int | None
    method: int | None
    data_offset: int | None


def vint(data: bytes, at: int) -> tuple[int | None, int]:
    """Base-128 number and the offset after it; None where it is cut or too long."""
    value = shift = 0
    while at < len(data) and shift < 63:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if not b & 128:
            return value, at
        shift += 7
    return None, at


def rar5_blocks(data: bytes, limit: int = 1_000_000) -> list[RarBlock]:
    """Blocks of a RAR5 archive; a block with a broken header is listed and ends the walk."""
    out, at = [], 8
    if data[:8] != b"Rar!\x1a\x07\x01\x00":
        return out
    while at + 7 <= len(data) and len(out) < limit:
        size, p = vint(data, at + 4)
        if size is None or size == 0 or p + size > len(data):
            out.append(RarBlock(at, None, False, *[None] * 6))
            break
        end = p + size
        ok = zlib.crc32(data[at + 4 : end]) == int.from_bytes(data[at : at + 4], "little")
        if not ok:
            out.append(RarBlock(at, None, False, *[None] * 6))
            break
        kind, q = vint(data, p)
        flags, q = vint(data, q)
        if (flags or 0) & 1:
            _, q = vint(data, q)
        packed = 0
        if (flags or 0) & 2:
            packed, q = vint(data, q)
        name = unpacked = crc = method = None
        if kind in (2, 3):
            fflags, q = vint(data, q)
            unpacked, q = vint(data, q)
            _, q = vint(data, q)
            if (fflags or 0) & 2:
                q += 4
            if (fflags or 0) & 4:
                crc = int.from_bytes(data[q : q + 4], "little")
                q += 4
            info, q = vint(data, q)
            method = (info or 0) >> 7 & 7
            _, q = vint(data, q)
            n, q = vint(data, q)
            name = data[q : q + (n or 0)]
        out.append(RarBlock(at, kind, True, name, packed, unpacked, crc, method, end))
        at = end + (packed or 0)
        if kind == 5:
            break
    return out


def rar5_stored(data: bytes, b: RarBlock) -> bytes | None:
    """Bytes of a stored file whose checksum holds."""
    if b.kind != 2 or b.method != 0 or b.packed != b.size or b.crc32 is None:
        return None
    body = data[b.data_offset : b.data_offset + b.packed]
    return body if len(body) == b.packed and zlib.crc32(body) == b.crc32 else None


def android_backup(data: bytes) -> tuple[str, bytes | None]:
    """(status, tar bytes) of an Android backup: unencrypted ones of versions 1 to 5."""
    lines = data.split(b"\n", 4)
    if len(lines) < 5 or lines[0] != b"ANDROID BACKUP":
        return "NOT_A_BACKUP", None
    if not lines[1].isdigit() or not 1 <= int(lines[1]) <= 5:
        return "UNSUPPORTED_VERSION", None
    if lines[2] not in (b"0", b"1"):
        return "BAD_HEADER", None
    if lines[3] != b"none":
        return ("ENCRYPTED" if lines[3] == b"AES-256" else "UNSUPPORTED_ENCRYPTION"), None
    if lines[2] == b"0":
        return "OK", lines[4]
    body, whole, _ = inflate_prefix(lines[4], wbits=15)
    return ("OK" if whole else "TRUNCATED"), body


def crc(data: bytes, width: int, poly: int, init: int, refin: bool, refout: bool, xorout: int) -> int:
    """Any checksum of this family, by a table of 256 remainders."""
    top, mask = 1 << (width - 1), (1 << width) - 1
    flip = lambda v, n: int(f"{v:0{n}b}"[::-1], 2)
    if refin:
        low = flip(poly, width)
        table = []
        for b in range(256):
            for _ in range(8):
                b = b >> 1 ^ (low if b & 1 else 0)
            table.append(b)
        r = flip(init, width)
        for b in data:
            r = r >> 8 ^ table[(r ^ b) & 255]
        return (r if refout else flip(r, width)) ^ xorout
    table = []
    for b in range(256):
        v = b << (width - 8)
        for _ in range(8):
            v = (v << 1 ^ (poly if v & top else 0)) & mask
        table.append(v)
    r = init
    for b in data:
        r = (r << 8 & mask) ^ table[(r >> (width - 8) ^ b) & 255]
    return (flip(r, width) if refout else r) ^ xorout


SIGNATURES_TO_CARVE = (b"PK\x03\x04", b"\x1f\x8b\x08", b"%PDF-", b"7z\xbc\xaf\x27\x1c", b"Rar!\x1a\x07", b"SQLite format 3\0")


def carve_hits(data: bytes) -> list[int]:
    """Offsets of all carving signatures, in order."""
    out = set()
    for s in SIGNATURES_TO_CARVE:
        at = data.find(s)
        while at >= 0:
            out.add(at)
            at = data.find(s, at + 1)
    return sorted(out)
