import gzip
import io
import random
import sqlite3
import struct
import tarfile
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from shardmend.functions import bytesio as b
from shardmend.functions import dims
from shardmend.operators import detect, recover, reference

MEMBERS = [("a.txt", b"hello world " * 40), ("dir/b.bin", bytes(range(256)) * 3), ("empty", b""), ("é.txt", b"x")]


def rules(fmt, data, **kw):
    return [f[0] for f in detect.findings_of(fmt, data, **kw)]


def test_dimensions():
    assert len(dims.rules()) == 117 and len(dims.SIGNATURES) == 24 and len(dims.FORMATS) == 21 and len(dims.STRATEGIES) == 16
    assert set(recover.APPLY) == {s[0] for s in dims.STRATEGIES}


@pytest.mark.parametrize("streamed", [False, True])
def test_zip(streamed):
    z = b.build_zip(MEMBERS, streamed)
    assert {i.filename: zipfile.ZipFile(io.BytesIO(z)).read(i) for i in zipfile.ZipFile(io.BytesIO(z)).infolist()} == dict(MEMBERS)
    p = b.parse_zip(z)
    for entries in (p.central, p.local):
        assert [b.extract_zip(z, e)[:2] for e in entries] == [("VERIFIED_CRC", body) for _, body in MEMBERS]
    assert rules("zip", z) == []
    lost = z[: p.cd_offset]
    assert set(rules("zip", lost)) == {"ZIP_EOCD_001", "ZIP_CD_001"}
    rebuilt = recover.zip_rebuild(lost)[0]
    assert {i.filename: zipfile.ZipFile(io.BytesIO(rebuilt)).read(i) for i in zipfile.ZipFile(io.BytesIO(rebuilt)).infolist()} == dict(MEMBERS)
    assert ("ZIP_SIZE_001" in rules("zip", z, strict=True)) == streamed


def test_zip_statuses():
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_BZIP2) as f:
        f.writestr("a", b"text" * 100)
    z = buf.getvalue()
    assert b.extract_zip(z, b.parse_zip(z).central[0])[0] == "UNSUPPORTED"
    z = bytearray(b.build_zip([("a", b"secret")]))
    e = b.parse_zip(bytes(z)).central[0]
    assert b.extract_zip(bytes(z), e._replace(flags=1))[0] == "ENCRYPTED"
    assert b.extract_zip(bytes(z), e._replace(zip64=True))[0] == "ZIP64_UNSUPPORTED"
    assert b.extract_zip(bytes(z), e._replace(offset=3))[0] == "BAD_LOCAL_HEADER"
    assert b.extract_zip(bytes(z), e._replace(compressed=10_000))[0] == "TRUNCATED"
    z[b.parse_zip(bytes(z)).local[0].data_offset] ^= 1
    assert b.extract_zip(bytes(z), e)[0] == "CRC_MISMATCH" and rules("zip", bytes(z)) == ["ZIP_CRC_001"]
    # a payload that both checksums contradict is never blessed; one wrong header checksum is put right
    assert recover.zip_checksums(bytes(z)) is None
    good = bytearray(b.build_zip([("a", b"secret")]))
    bad = bytes(good[:14]) + b"\0\0\0\0" + bytes(good[18:])
    assert recover.zip_checksums(bad)[0] == bytes(good)


@given(st.integers(0, 5000), st.integers(1, 255), st.booleans())
@settings(max_examples=300, deadline=None)
def test_no_mutation_verifies_other_bytes(at, flip, streamed):
    z = bytearray(b.build_zip(MEMBERS, streamed))
    z[at % len(z)] ^= flip
    bodies = {body for _, body in MEMBERS}
    p = b.parse_zip(bytes(z))
    for e in p.central + p.local:
        status, body, _ = b.extract_zip(bytes(z), e)
        assert status != "VERIFIED_CRC" or body in bodies
    for made in filter(None, (recover.zip_rebuild(bytes(z)), recover.zip_checksums(bytes(z)))):
        q = b.parse_zip(made[0])
        for e in q.central:
            status, body, _ = b.extract_zip(made[0], e)
            assert status != "VERIFIED_CRC" or body in bodies


@given(st.binary(max_size=600))
@settings(max_examples=300, deadline=None)
def test_readers_never_raise(data):
    for prefix in (b"", b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"\x1f\x8b\x08", b"Rar!\x1a\x07\x01\x00", b"7z\xbc\xaf\x27\x1c", b"SQLite format 3\0", b"%PDF-", b"ANDROID BACKUP\n1\n1\nnone\n"):
        d = prefix + data
        for fmt in ("zip", "tar", "gzip", "sqlite", "seven_z", "pdf", "iso9660", "rar", "raw", "xz"):
            list(detect.findings_of(fmt, d))
        b.salvage_gzip(d), b.salvage_tar(d), b.rar5_blocks(d), b.android_backup(d), b.carve_hits(d), b.surviving_chains(d)
        for f in recover.APPLY.values():
            f(d)


def test_tar():
    t = b.build_tar(MEMBERS[:3])
    f = tarfile.open(fileobj=io.BytesIO(t))
    assert [(m.name, f.extractfile(m).read()) for m in f] == MEMBERS[:3]
    assert rules("tar", t) == []
    assert rules("tar", t[:-1024]) == ["TAR_TERM_001"] and recover.tar_terminator(t[:-1024])[0] == t
    bad = bytearray(t)
    bad[148:154] = b"000000"
    assert rules("tar", bytes(bad)) == ["TAR_UST_001"]
    fixed = recover.tar_checksums(bytes(bad))[0]
    assert rules("tar", fixed) == []
    assert [s.body for s in b.salvage_tar(bytes(bad))] == [x for _, x in MEMBERS[1:3]]
    salvaged = recover.tar_members(bytes(bad))[0]
    assert [m.name for m in tarfile.open(fileobj=io.BytesIO(salvaged))] == ["dir/b.bin", "empty"]
    wrong = bytearray(t)
    wrong[124:136] = b"%011o\0" % 5000
    assert [m.name for m in tarfile.open(fileobj=io.BytesIO(recover.tar_sizes(bytes(wrong))[0]))] == [n for n, _ in MEMBERS[:3]]
    assert rules("tar", t[:700]) == ["TAR_TRUNC_002"]


def test_gzip():
    g = gzip.compress(b"one" * 100) + b.build_gzip(b"two" * 100)
    assert [s.body for s in b.salvage_gzip(g)] == [b"one" * 100, b"two" * 100] and rules("gzip", g) == []
    assert rules("gzip", g, strict=True) == ["GZ_ICRC_001"]
    one = b.build_gzip(b"text " * 500)
    assert rules("gzip", one[:-4]) == ["GZ_TRUNC_001"] and rules("gzip", b"xx" + one[2:]) == ["GZ_MAGIC_001"]
    assert recover.gz_magic(b"xx" + one[2:])[0] == one
    bad = one[:-8] + bytes(4) + one[-4:]
    assert rules("gzip", bad) == ["GZ_ICRC_001"] and recover.gz_trailer(bad)[0] == one and recover.gz_trailer(one[:-20]) is None
    assert recover.gz_members(bad) is None
    big = b.build_gzip(random.Random(1).randbytes(5000))
    assert gzip.decompress(recover.gz_prefix(big[:3000])[0])[:1000] == random.Random(1).randbytes(5000)[:1000]
    rng = random.Random(2)
    assert not any(s.kind == "Verified" for _ in range(50) for s in b.salvage_gzip(rng.randbytes(3000)))
    named = b"\x1f\x8b\x08\x08\0\0\0\0\0\xffname.txt\0" + one[10:]
    assert b.gzip_name(named) == b"name.txt" and gzip.decompress(named) == b"text " * 500


def test_sqlite(tmp_path):
    path = tmp_path / "a.db"
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE t(x)")
    con.executemany("INSERT INTO t VALUES (?)", [(k,) for k in range(2000)])
    con.commit()
    con.close()
    data = path.read_bytes()
    assert rules("sqlite", data) == []
    assert rules("sqlite", b"X" + data[1:]) == ["SQ_MAGIC_001"]
    assert rules("sqlite", data[:16] + b"\x12\x34" + data[18:]) == ["SQ_PGSIZE_001"]
    assert rules("sqlite", data[:-100])[:2] == ["SQ_PGSIZE_002", "SQ_TRUNC_001"]
    assert rules("sqlite", data[:2000]) == ["SQ_PGSIZE_002", "SQ_TRUNC_002"]
    assert "SQ_FREE_001" in rules("sqlite", data[:32] + b"\0\0\xff\xff" + data[36:])
    assert "SQ_BTREE_001" in rules("sqlite", data[:4096] + b"\x07" + data[4097:])


def test_sevenz_rar_android_iso_pdf():
    nxt = b"header bytes"
    start = struct.pack("<QQI", 0, len(nxt), zlib.crc32(nxt))
    z = b"7z\xbc\xaf\x27\x1c\0\4" + struct.pack("<I", zlib.crc32(start)) + start + nxt
    assert rules("seven_z", z) == [] and b.parse_sevenz(z).next_ok
    assert rules("seven_z", z[:-3]) == ["7Z_TRUNC_001"] and recover.sevenz_signature(b"\0\0\0\0\0\0" + z[6:])[0] == z
    assert recover.sevenz_signature(b"\0" * 12 + z[12:]) is None

    def block(kind, body, data=b""):
        flags = 2 if data else 0
        head = bytes([kind, flags]) + (bytes([len(data)]) if data else b"") + body
        sized = bytes([len(head)]) + head
        return struct.pack("<I", zlib.crc32(sized)) + sized + data

    data = b"stored text"
    file = bytes([4, len(data), 0]) + struct.pack("<I", zlib.crc32(data)) + bytes([0, 0, 5]) + b"a.txt"
    rar = b"Rar!\x1a\x07\x01\x00" + block(1, b"\0") + block(2, file, data) + block(5, b"\0")
    found = b.rar5_blocks(rar)
    assert [x.kind for x in found] == [1, 2, 5] and found[1].name == b"a.txt" and b.rar5_stored(rar, found[1]) == data
    broken = rar.replace(b"stored text", b"stored texT")
    assert b.rar5_stored(broken, b.rar5_blocks(broken)[1]) is None
    assert not b.rar5_blocks(rar[:8] + b"\xff" + rar[9:])[0].header_ok
    t = b.build_tar(MEMBERS[:1])
    assert b.android_backup(b"ANDROID BACKUP\n1\n0\nnone\n" + t) == ("OK", t)
    assert b.android_backup(b"ANDROID BACKUP\n1\n1\nnone\n" + zlib.compress(t)) == ("OK", t)
    assert b.android_backup(b"ANDROID BACKUP\n9\n1\nnone\n")[0] == "UNSUPPORTED_VERSION" and b.android_backup(b"ANDROID BACKUP\n1\n1\nAES-256\n")[0] == "ENCRYPTED"
    iso = bytearray(21 * 2048)
    iso[32768:32774] = b"\x01CD001"
    iso[32768 + 140 : 32768 + 144] = struct.pack("<I", 18)
    assert rules("iso9660", bytes(iso)) == [] and rules("iso9660", bytes(40_000)) == ["ISO_PVD_001"]
    iso[32768 + 140 : 32768 + 144] = struct.pack("<I", 9999)
    assert rules("iso9660", bytes(iso)) == ["ISO_PT_001"]
    assert rules("pdf", b"%PDF-1.4\n%%EOF") == [] and rules("pdf", b"%PDF-1.4\n") == ["PDF_EOF_001"]
    for fmt, (rule, magic) in detect.MAGICS.items():
        assert rules(fmt, magic + b"rest") == [] and rules(fmt, b"?" + magic) == [rule]


def test_checksums():
    want = {"CRC-32/ISO-HDLC": 0xCBF43926, "CRC-32/BZIP2": 0xFC891918, "CRC-64/XZ": 0x995DC9BBDF1939FA}
    assert {c[0]: b.crc(b"123456789", *c[1:]) for c in dims.CRCS} == want
    data = random.Random(3).randbytes(999)
    assert b.crc(data, *dims.CRCS[0][1:]) == zlib.crc32(data)


def test_reference_differences():
    good = random.Random(5).randbytes(4000)
    first = lambda fmt, bad: next(reference.difference(fmt, bad, good))[0]
    assert first("zip", good[:-10]) == "ZIP_TRUNC_001" and first("zip", good[:-150]) == "ZIP_TRUNC_002" and first("zip", good[:-2000]) == "ZIP_TRUNC_003"
    assert first("tar", good[100:]) == "TAR_TRUNC_003" and first("raw", good[:100] + good[200:]) == "GEN_MISSING_001" and first("raw", good + b"x") == "GEN_STRUCT_001"
    flip = lambda k: good[:k] + bytes([good[k] ^ 1]) + good[k + 1 :]
    assert first("zip", flip(2000)) == "ZIP_FLIP_001" and first("zip", flip(100)) == "ZIP_FLIP_003" and first("raw", flip(9)) == "GEN_FLIP_001"
    swapped = good[:512] + good[1024:1536] + good[512:1024] + good[1536:]
    assert next(reference.difference("tar", swapped, good))[:3] == ("TAR_BLOCK_001", 512, 1536)
    assert first("gzip", b"\0\0\0" + good[3:]) == "GZ_MAGIC_001" and first("zip", good[:1000] + bytes(64) + good[1064:]) == "ZIP_CD_003"
    assert list(reference.difference("zip", good, good)) == []
