import random

import pytest
from shardmend.functions import bytesio as b
from shardmend.functions import zipview
from shardmend.operators import zipcore

NAMES = [f"files/item-{k}.bin" for k in range(6)]


def bodies(seed=1):
    rng = random.Random(seed)
    return [rng.randbytes(rng.randint(200, 900)) for _ in NAMES]


def archive(seed=1, names=NAMES):
    return b.build_zip([*zip(names, bodies(seed), strict=True)])


def got(data, **limits):
    v = zipview.view(data, zipview.Limits(**limits))
    return {p.entry.name.decode("utf-8", "replace"): (b.extract_zip(data, p.entry, p.where)[0] if p.where is not None else "LOST", p.source) for p in v.entries}, v


def record_at(data, n):
    return [e.record_offset for e in b.parse_zip(data).central][n]


def test_intact():
    found, v = got(archive())
    assert found == dict.fromkeys(NAMES, ("VERIFIED_CRC", "directory")) and v.complete and v.limits == () and (v.declared, v.directory, v.nested) == (6, "declared", 0)


def test_half_destroyed_directory():
    """Three records are left; the scan tells of the rest: six of six."""
    z = bytearray(archive())
    at = record_at(z, 3)
    z[at : at + 46] = bytes(46)
    found, v = got(bytes(z))
    assert found == {n: ("VERIFIED_CRC", "directory" if k < 3 else "scan") for k, n in enumerate(NAMES)} and v.from_directory == 3 and not v.complete


def test_interior_deletion():
    """Stale offsets on one side of an edit: a map of two segments, the directory found by its size, the entry that was hit not verified."""
    z = archive()
    cut = b.parse_zip(z).local[2].data_offset + 50
    found, v = got(z[:cut] + z[cut + 64 :])
    assert [*found] == NAMES and v.directory == "size" and v.segments == 2 and v.moved == 3
    assert [s for s, _ in found.values()] == ["VERIFIED_CRC"] * 2 + ["CRC_MISMATCH"] + ["VERIFIED_CRC"] * 3


def test_lost_tail_and_lost_head():
    z = archive()
    found, v = got(z[: b.parse_zip(z).cd_offset])
    assert found == dict.fromkeys(NAMES, ("VERIFIED_CRC", "scan")) and v.directory is None
    head = b.parse_zip(z).local[2].offset
    found, v = got(z[head:-22])
    assert v.directory == "chain" and v.shift == -head
    assert found == {n: ("LOST" if k < 2 else "VERIFIED_CRC", "directory") for k, n in enumerate(NAMES)}


def test_embedded_archives_are_no_entries():
    inner = archive(2, [f"inner/{k}" for k in range(6)])
    z = b.build_zip([("a.txt", b"a" * 300), ("b.zip", inner), ("c.txt", b"c" * 300)])
    found, v = got(z)
    assert [*found] == ["a.txt", "b.zip", "c.txt"] and v.nested == 0 or v.nested == 1
    stored = archive(2, [f"inner/{k}" for k in range(6)])
    out = z[: b.parse_zip(z).cd_offset]
    rng = random.Random(3)
    plain = b.build_zip([("x.bin", rng.randbytes(400))])
    # the outer tail is gone, the inner directory is the last one: it is not this archive's
    cut = plain[: b.parse_zip(plain).cd_offset] + rng.randbytes(40) + stored
    found, v = got(cut)
    assert v.nested == 1 and [*found] == ["x.bin"] and len(out) > 0


def test_a_planted_header_in_a_gap_is_told_apart():
    z = archive()
    at = b.parse_zip(z).local[3].offset
    ghost = b.build_zip([("ghost", b"boo" * 20)])
    ghost = ghost[: b.parse_zip(ghost).cd_offset]
    found, v = got(z[:at] + ghost + z[at:])
    assert found["ghost"][1] == "scan" and all(found[n] == ("VERIFIED_CRC", "directory") for n in NAMES) and v.moved == 3


def test_limits():
    z = archive()
    for name, code in zipview.LIMIT_CODES.items():
        if name != "malformed":
            assert code in got(z[:-22] if name in ("candidates", "scan_bytes") else z, **{name: 5})[1].limits, name
    assert zipview.LIMIT_CODES["malformed"] in got((b"PK\x03\x04" + bytes(26)) * 50, malformed=20)[1].limits
    with pytest.raises(ValueError):
        zipview.view(z, zipview.Limits(records=0))


def test_odd_bytes():
    rng = random.Random(5)
    z = archive()
    for _ in range(300):
        d = bytearray(z)
        for _ in range(rng.randint(1, 30)):
            d[rng.randrange(len(d))] = rng.randrange(256)
        at, n = rng.randrange(len(d)), rng.randrange(200)
        d = bytes(d[:at] + d[at + n :])
        whole = [b.extract_zip(d, p.entry, p.where) for p in zipview.view(d).entries if p.where is not None]
        assert {body for status, body, _ in whole if status == "VERIFIED_CRC" and body} <= {*bodies()}
    for d in (b"", b"PK", b"PK\x05\x06" + bytes(18), b"PK\x05\x06" * 20):
        assert zipview.view(d).entries == []


def test_views_and_extraction(spark):
    z = bytearray(archive())
    at = record_at(z, 3)
    z[at : at + 46] = bytes(46)
    files = spark.createDataFrame([("a", "a.zip", bytearray(z), "zip"), ("b", "b.zip", None, "zip")], "file_id string, name string, content binary, engine_format string")
    rows = zipcore.extracted(files).collect()
    assert sorted((r.name, r.status, r.source) for r in rows) == sorted((n, "VERIFIED_CRC", "directory" if k < 3 else "scan") for k, n in enumerate(NAMES))
    v = {r.file_id: r for r in zipcore.views(files).collect()}
    assert (v["a"].from_directory, v["a"].from_scan, v["b"].from_directory) == (3, 3, 0)


def test_large_gzip_members_are_checked():
    """100 MB of zeros in 100 kB: checksum and size count beyond any buffer, and trailing bytes of a second member are found."""
    from shardmend.operators.detect import findings_of

    big = b.build_gzip(bytes(100 << 20))
    two = big + b.build_gzip(b"end")
    rules = lambda d: [f[0] for f in findings_of("gzip", d)]
    assert rules(two) == []
    assert rules(big[:-8] + bytes([big[-8] ^ 1]) + big[-7:]) == ["GZ_ICRC_001"] and rules(two[:-4] + bytes([two[-4] ^ 1]) + two[-3:]) == ["GZ_ISIZE_001"]
    assert rules(big[: len(big) // 2]) == ["GZ_TRUNC_001"]
    assert b.inflate_sums(big, 10) == (True, len(big) - 8, __import__("zlib").crc32(bytes(100 << 20)), 100 << 20)
