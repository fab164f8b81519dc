import io
import random
import zipfile

from pyspark.sql import functions as F
from shardmend.functions import bytesio as b
from shardmend.functions import dims, exprs
from shardmend.operators import identify, integrity, members, recover, reference, relational, scoring, zipcore
from shardmend.plans import triage
from shardmend.sources import files as sources

MEMBERS = [(f"m{k}.txt", f"member {k} ".encode() * 30) for k in range(5)]


def frame(spark, *pairs):
    return sources.from_bytes(spark, [*pairs])


def known(spark, *pairs):
    return identify.identify(frame(spark, *pairs))


def test_every_signature_and_its_neighbours(spark):
    rows = []
    for n, (fmt, at, magic, least, _) in enumerate(dims.SIGNATURES):
        m = bytes.fromhex(magic)
        size = max(least, at + len(m) if at >= 0 else -at)
        body = bytearray(b"\xee" * size)
        where = at if at >= 0 else size + at
        body[where : where + len(m)] = m
        rows.append((f"{n}-{fmt}", bytes(body)))
        off = bytearray(body)
        off[where] ^= 0x55
        rows.append((f"{n}-off", bytes(off)))
    rows += [("x-none", b""), ("x-short", b"P")]
    got = {r["name"]: r.by_content for r in known(spark, *rows).collect()}
    for name, fmt in got.items():
        kind = name.split("-")[1]
        assert fmt == (None if kind in ("off", "none", "short") else kind), name


def test_names_and_agreement(spark):
    got = {r["name"]: (r.by_name, r.agreement, r.engine_format) for r in known(spark, ("a.ZIP", b"PK\x03\x04"), ("b.odt", b"??"), ("c.tar.gz", b"PK\x03\x04"), ("d", b""), ("e.vhd", b"x"), ("f.docx", b"")).collect()}
    assert got == {"a.ZIP": ("zip", "Match", "zip"), "b.odt": ("zip", "NameOnly", "raw"), "c.tar.gz": ("gzip", "Mismatch", "zip"), "d": (None, "Unknown", "raw"), "e.vhd": ("vhd", "NameOnly", "raw"), "f.docx": ("zip", "NameOnly", "zip")}


def test_hashes_and_manifests(spark):
    f = frame(spark, ("a", b"abc"), ("b", b"x"), ("c", b""))
    assert {r["name"]: r.c for r in f.select("name", integrity.checksum("CRC-32/ISO-HDLC")("content").alias("c")).collect()}["a"] == "352441c2"
    assert f.where("name = 'a'").select(integrity.sha3_512("content")).first()[0].startswith("b751850b1a57168a")
    assert integrity.block_hashes(f, 2).groupBy("file_id").count().where("file_id = 'a'").first()["count"] == 2
    side = frame(spark, ("a", b"abc"), ("a.sha256", b"BA78 a\n"), ("b.sha3_512", b"ff"))
    assert {(r["name"], r.hash, r.kind) for r in sources.sidecars(side).collect()} == {("a", "ba78", "sha256"), ("b", "ff", "sha3_512")}


def test_islands_are_a_fold(spark):
    rng = random.Random(1)
    rows = [(g, s := rng.randrange(60), s + rng.randrange(1, 9)) for g in range(40) for _ in range(12)]
    got = sorted(map(tuple, relational.islands(spark.createDataFrame(rows, "g int, s int, e int"), ["g"], "s", "e").groupBy("g", "island").agg(F.min("s"), F.max("e")).drop("island").collect()))
    want = []
    for g in range(40):
        cur = None
        for s, e in sorted((s, e) for h, s, e in rows if h == g):
            if cur and s <= cur[1]:
                cur[1] = max(cur[1], e)
            else:
                cur = [s, e]
                want.append((g, cur))
    assert got == sorted((g, *c) for g, c in want)


def test_range_join(spark):
    rng = random.Random(2)
    ranges = [(k % 3, s := rng.randrange(1000), s + rng.randrange(0, 90)) for k in range(200)]
    points = [(k % 3, rng.randrange(1100)) for k in range(300)]
    r, p = spark.createDataFrame(ranges, "k int, s int, e int"), spark.createDataFrame(points, "k int, p int")
    for inclusive in (False, True):
        got = sorted(map(tuple, relational.range_join(p, r, ["k"], "p", "s", "e", 37, inclusive).select("k", "p", "s", "e").collect()))
        assert got == sorted((k, x, s, e) for k, x in points for h, s, e in ranges if h == k and s <= x and (x <= e if inclusive else x < e))


def test_paths(spark):
    cases = {"a/b": "a/b", "a\\b": "a/b", "/a": None, "..": None, "a/../b": None, "a:b": None, "": None, "a//b": "a/b", "x\0y": None, "/": None, "a" * 5000: None}
    rows = spark.createDataFrame([(k,) for k in [*cases, None]], "p string").select("p", exprs.safe_path(F.col("p")).alias("s")).collect()
    assert {r.p: r.s for r in rows} == cases | {None: None}


def test_offset_map_is_a_fold(spark):
    rng = random.Random(4)
    rows = [(g, s := rng.randrange(500), s + rng.choice((0, 0, 100, 100, -50))) for g in range(60) for _ in range(8)]
    got = {}
    for r in zipcore.offset_map(spark.createDataFrame(rows, "file_id int, stored long, physical long")).collect():
        got.setdefault(r.file_id, []).append((r.seg, r.delta, r.support))
    for g in range(60):
        seen, last, runs = {}, None, []
        for _, s, p in sorted((f, s, p) for f, s, p in rows if f == g):
            seen.setdefault(s, p)
        for s in sorted(seen):
            if last is None or seen[s] > last:
                last = seen[s]
                if runs and runs[-1][0] == last - s:
                    runs[-1][1] += 1
                else:
                    runs.append([last - s, 1])
        want = [(n, d, k) for n, (d, k) in enumerate(runs, 1)] if len(runs) <= zipcore.MAX_SEGMENTS else None
        assert (sorted(got[g]) if g in got else None) == want


def test_containers_and_directories(spark):
    inner = b.build_zip(MEMBERS[:2])
    outer = b.build_zip([("in.zip", b"")])
    data = b"junk" * 10 + inner + b"more junk"
    f = known(spark, ("a.zip", outer + data), ("b.zip", b.build_zip(MEMBERS)))
    held = zipcore.containers(f)
    base = len(outer) + 40
    assert {(r.file_id, r.base, r.end, r.records) for r in held.where(F.col("base") > 0).collect()} == {("a.zip", base, base + len(inner), 2)}
    points = spark.createDataFrame([("a.zip", base + 5), ("a.zip", base + len(inner)), ("b.zip", 0)], "file_id string, offset long")
    assert {(r.offset, r.owner) for r in zipcore.owners(points, held).where("file_id = 'a.zip'").collect()} == {(base + 5, base), (base + len(inner), None)}
    z = b.build_zip(MEMBERS)
    cut = z[: z.rfind(b"PK\x05\x06")]
    [r] = zipcore.the_surviving(zipcore.surviving_directories(known(spark, ("c.zip", cut)))).collect()
    assert (r.records, r.delta, r.proven) == (5, 0, True)


def test_reconcile_rejects_headers_inside_payloads(spark):
    inner = b.build_zip([("hidden", b"h" * 50)])
    body = bytes(range(256)) + inner  # stored, as it does not shrink
    f = known(spark, ("a.zip", b.build_zip([("outer", body), ("z", b"q" * 9)])))
    e = zipcore.entries(f)
    local = e.where("source = 'local'").unionByName(e.where("source = 'local'").limit(1).withColumns({"local_header_offset": F.lit(31 + 5 + 256).cast("long"), "data_offset": F.lit(31 + 5 + 256 + 36).cast("long"), "name": F.lit("hidden"), "compressed_size": F.lit(5).cast("long")}))
    assert sorted(r["name"] for r in zipcore.reconcile(e.where("source = 'central'"), local).collect()) == ["outer", "z"]


def test_export_budget(spark, monkeypatch):
    monkeypatch.setattr(zipcore, "EXPORT_BYTES", 1000)
    parts = zipcore.extracted(known(spark, ("a.zip", b.build_zip([("big", b"x" * 900), ("bigger", b"y" * 400), ("BIG", b"z"), ("small", b"s" * 50)]))))
    got = {r["name"]: r.skipped for r in zipcore.export(parts).collect()}
    assert got["big"] is None and got["bigger"] == "over budget" and got["BIG"] == "duplicate path" and got["small"] is None
    silent = zipcore.export(parts.withColumn("provenance", F.lit("Guessed")))
    assert {r.skipped for r in silent.where("name <> 'BIG'").collect()} == {"unattested"}


def test_triage_and_recovery(spark):
    z, t = b.build_zip(MEMBERS), b.build_tar(MEMBERS)
    g = b.build_gzip(b"payload " * 300)
    lost = z[: b.parse_zip(z).cd_offset]
    secret = bytearray(z)
    for k in range(len(z) - 4):
        if z[k : k + 4] == b"PK\x03\x04":
            secret[k + 6] |= 1
        if z[k : k + 4] == b"PK\x01\x02":
            secret[k + 8] |= 1
    f = frame(spark, ("ok.zip", z), ("lost.zip", lost), ("cut.tar", t[:-1024]), ("bad.gz", g[:-8] + bytes(4) + g[-4:]), ("secret.zip", bytes(secret)), ("plain.txt", b"text"), ("empty.zip", b""))
    got = {r["name"]: r for r in triage.analyze(f).collect()}
    assert len(got) == 7
    assert got["ok.zip"].findings == 0 and got["ok.zip"].overall == 100 and got["ok.zip"]["class"] == "High"
    assert got["lost.zip"].worst_severity == "Catastrophic" and got["lost.zip"].overall < 50
    assert got["secret.zip"].error == "Encrypted" and got["secret.zip"].findings == 0
    assert got["plain.txt"].engine_format == "raw" and got["plain.txt"].findings == 0
    want = spark.createDataFrame([("cut.tar", __import__("hashlib").sha256(t).hexdigest())], "name string, hash string")
    done = {r.file_id: r for r in triage.recover_files(f, want).collect()}
    assert "ok.zip" not in done and "plain.txt" not in done and "secret.zip" not in done
    assert done["lost.zip"].success and done["lost.zip"].strategy == "zip-rebuild" and done["lost.zip"].guarantee == "Unverified"
    assert zipfile.ZipFile(io.BytesIO(done["lost.zip"].output)).testzip() is None
    assert bytes(done["cut.tar"].output) == t and done["cut.tar"].verified and done["cut.tar"].guarantee == "Verified"
    # a trailer that the repair itself wrote proves nothing: without a manifest the gzip is not blessed
    assert not done["bad.gz"].success or done["bad.gz"].strategy != "gz-trailer-recompute"


def test_keep_gate(spark):
    rows = [
        ("worse", b"x", "Safe", False, False, 50, 40),
        ("better", b"x", "Safe", False, False, 50, 60),
        ("guess", b"x", "Inferred", False, False, 50, 100),
        ("proved", b"x", "Inferred", False, True, 50, 50),
        ("held", b"x", "Lossy", False, False, 50, 50),
        ("last", b"x", "Lossy", True, False, 50, 50),
        ("empty", b"", "Safe", True, True, 50, 100),
    ]
    f = spark.createDataFrame([(n, bytearray(s), *r, False) for n, s, *r in rows], "n string, staged binary, risk string, terminal boolean, verified boolean, health_before int, health_after int, raw_after boolean")
    assert {r.n: r.kept for r in recover.keep_gate(f).collect()} == {"worse": False, "better": True, "guess": False, "proved": True, "held": False, "last": True, "empty": False}


def test_manifest_and_entry_evidence(spark):
    f = frame(spark, ("a", b"abc"))
    report = spark.createDataFrame([("a", "zip-rebuild", bytearray(b"abcd"), "Unverified")], "file_id string, strategy string, output binary, guarantee string")
    [r] = recover.manifest_json(report, f).collect()
    m = __import__("json").loads(r.manifest)
    assert m["guarantees"] == {"verified_bytes": 0, "unverified_bytes": 4, "lost_bytes": 0} and r.signature is None and len(r.digest) == 64
    out = spark.createDataFrame([("a", "x", "VERIFIED_CRC"), ("a", "y", "VERIFIED_CRC"), ("a", "z", "TRUNCATED")], "file_id string, name string, status string")
    att = spark.createDataFrame([("a", "x"), ("a", "z")], "file_id string, name string")
    assert {r["name"]: r.verdict for r in recover.entry_evidence(out, att).collect()} == {"x": "exact", "y": "content proven, name unattested", "z": "exists, content unproven"}


def test_reference_suppresses_symptoms(spark):
    z = b.build_zip(MEMBERS)
    f = known(spark, ("a.zip", z[: len(z) // 2]))
    refs = spark.createDataFrame([("a.zip", bytearray(z))], "file_id string, reference binary")
    ready = triage.prepared(f.select("file_id", "name", "content"))
    assert {r.rule_id for r in triage.findings(ready, references=refs).collect()} == {"ZIP_TRUNC_003"}
    t = b.build_tar(MEMBERS)
    swapped = t[:512] + t[1024:1536] + t[512:1024] + t[1536:]
    got = reference.swapped_blocks(known(spark, ("t", swapped)), spark.createDataFrame([("t", bytearray(t))], "file_id string, reference binary")).collect()
    assert {(r.block, r.from_block) for r in got} == {(1, 2), (2, 1)}


def test_members_and_sources(spark, tmp_path):
    (tmp_path / "a.tar").write_bytes(b.build_tar(MEMBERS))
    (tmp_path / "b.gz").write_bytes(b.build_gzip(b"x"))
    f = identify.identify(sources.whole_files(spark, str(tmp_path)))
    assert {(r.path, r.size) for r in members.members(f.where("name = 'a.tar'")).collect()} == {(n, len(x)) for n, x in MEMBERS}
    assert sources.whole_files(spark, str(tmp_path), max_bytes=100).where("error is not null").count() == 1
    out = sources.output_path(F.lit("/in/a.tar"), "/out")
    assert spark.range(1).select(out).first()[0] == "/out/a.tar.recovered"
    for g in (members.rar5_blocks, members.sevenz_headers, members.android_backups, members.segments, zipcore.parses):
        g(f).collect()


def test_empty_inputs(spark):
    f = known(spark, ("a", b"")).limit(0)
    assert triage.analyze(f.select("file_id", "name", "content")).count() == 0
    assert triage.recover_files(f.select("file_id", "name", "content")).count() == 0


def test_stream(spark, tmp_path):
    from shardmend.streaming.triage import triage_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.zip").write_bytes(b.build_zip(MEMBERS))
    q = triage_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert [r.engine_format for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["zip"]


def test_scoring_of_nothing(spark):
    none = spark.createDataFrame([], "file_id string, seq int, rule_id string, member string, start long, end long, confidence double")
    assert scoring.health(scoring.merge_adjacent(scoring.classify(none))).count() == 0


def test_command_line(spark, tmp_path):
    from shardmend.__main__ import main

    (tmp_path / "ok").mkdir()
    (tmp_path / "bad").mkdir()
    (tmp_path / "ok" / "a.zip").write_bytes(b.build_zip(MEMBERS))
    t = b.build_tar(MEMBERS)
    (tmp_path / "bad" / "a.tar").write_bytes(t[:-1024])
    assert main([str(tmp_path / "ok")]) == 0
    assert main([str(tmp_path / "bad"), "--output", str(tmp_path / "out")]) == 1
    [r] = spark.read.parquet(str(tmp_path / "out")).collect()
    assert bytes(r.content) == t and r.output_path == f"{tmp_path}/out/a.tar.recovered"


def test_field_values(spark):
    from shardmend.functions import corpus
    from shardmend.operators.fields import field_values

    rows = [("a.zip", b.build_zip(MEMBERS)), ("b.tar", b.build_tar(MEMBERS)), ("c.gz", b.build_gzip(b"x" * 99)), ("d.db", corpus.build_sqlite()), ("e.iso", corpus.build_iso()), ("f.gz", b"\x1f\x8b\x09")]
    got = {(r.file_id, r.field): (r.value, r.valid) for r in field_values(known(spark, *rows)).collect()}
    assert got["a.zip", "LocalFileHeader.name_len"] == (6, True) and got["a.zip", "LocalFileHeader.uncompressed_size"] == (len(MEMBERS[0][1]), True)
    assert got["b.tar", "UStarHeader.size"] == (len(MEMBERS[0][1]), True) and got["d.db", "sqlite.page_size"] == (4096, True)
    assert got["e.iso", "PrimaryVolumeDescriptor.path_table_location"] == (18, True) and got["f.gz", "gzip.cm"] == (9, False)
    assert ("f.gz", "gzip.mtime") not in got and all(valid for (f, _), (_, valid) in got.items() if f != "f.gz")
