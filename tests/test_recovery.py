import hashlib
import json

import pytest
from shardmend.__main__ import main
from shardmend.functions import bytesio as b
from shardmend.functions import ed25519
from shardmend.operators import detect, integrity, recover
from shardmend.plans import triage
from shardmend.sources import files as sources
from shardmend.streaming.triage import recovery_stream

MEMBERS = [("a.txt", b"alpha " * 90), ("b.txt", b"beta " * 120)]


def frame(spark, *files):
    return spark.createDataFrame([(n, f"/d/{n}", n.rpartition("/")[2], bytearray(d)) for n, d in files], "file_id string, path string, name string, content binary")


def test_ed25519():
    """The first vectors of RFC 8032, and a changed bit anywhere."""
    for seed, key, message, signature in (
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ):
        seed, key, message, signature = map(bytes.fromhex, (seed, key, message, signature))
        assert ed25519.public_key(seed) == key and ed25519.sign(seed, message) == signature and ed25519.verify(key, message, signature)
        assert not ed25519.verify(key, message + b"x", signature) and not ed25519.verify(key, message, signature[:-1] + b"\x01")
    assert not ed25519.verify(b"", b"", b"") and not ed25519.verify(b"\xff" * 32, b"", bytes(64))


def test_manifests_are_signed_and_checked(spark):
    z = b.build_zip(MEMBERS)
    f = frame(spark, ("x.zip", z[: b.parse_zip(z).cd_offset]))
    done = triage.recover_files(f).where("success")
    made = recover.manifest_json(done, f, bytes(range(32)))
    [r] = recover.manifest_verified(made).collect()
    body = json.loads(r.manifest)
    assert r.signature_ok and r.public_key == ed25519.public_key(bytes(range(32))).hex() and len(r.key_id) == 16
    assert body["output_sha256"] == hashlib.sha256(done.first().output).hexdigest() and body["guarantees"]["unverified_bytes"] == len(done.first().output)
    changed = made.selectExpr("replace(manifest, 'Unverified', 'Verified') AS manifest", "signature", "public_key")
    assert [x.signature_ok for x in recover.manifest_verified(changed).collect()] == [False]
    bare = recover.manifest_json(done, f)
    assert bare.first().signature is None and not recover.manifest_verified(bare).first().signature_ok


def test_names_in_two_folders(spark):
    """Sidecars, manifests and WAL files belong to the file beside them, not to every file of the name."""
    wal = b"\x37\x7f\x06\x82" + bytes(12) + b"saltsalt" + bytes(16) + b"othersal" + bytes(20)
    rows = [("1", "/a/x.db", "x.db", b"one"), ("2", "/b/x.db", "x.db", b"two"), ("3", "/b/x.db-wal", "x.db-wal", wal)]
    rows += [(f"s{k}", f"/{d}/x.db.sha256", "x.db.sha256", hashlib.sha256(body).hexdigest().encode()) for k, (d, body) in enumerate((("a", b"one"), ("b", b"two")))]
    f = spark.createDataFrame([(i, p, n, bytearray(c)) for i, p, n, c in rows], "file_id string, path string, name string, content binary")
    side = sources.sidecars(f)
    got = {r.file_id: r.status for r in integrity.compare(integrity.hashes(f), side).collect()}
    assert got == {"1": "verified", "2": "verified", "3": "unknown", "s0": "unknown", "s1": "unknown"}
    assert {(r.file_id, r.rule_id) for r in detect.wal_findings(f).collect()} == {("2", "SQ_WAL_002")}


def test_bytes_are_in_no_join_of_the_analysis(spark):
    z = b.build_zip(MEMBERS)
    f = frame(spark, ("x.zip", z), ("y.zip", z[:-30]))
    known, meta = triage._known(f, spark.createDataFrame([("x.zip", "00")], "name string, hash string"))
    assert "content" in known.columns and "content" not in meta.columns
    assert "Join" not in known._jdf.queryExecution().executedPlan().toString()
    assert {r.file_id: r.status for r in meta.collect()} == {"x.zip": "mismatch", "y.zip": "unknown"}


def test_capped_and_unread_reach_the_score(spark, monkeypatch):
    t = b.build_tar(MEMBERS)
    hurt = bytearray(t)
    for at in (0, 512 + 1024):
        hurt[at + 148 : at + 156] = b"000000\0 "
    f = frame(spark, ("x.tar", bytes(hurt))).selectExpr("*", "CAST(NULL AS string) AS error")
    assert triage.analyze(f).first().confidence == 1.0
    assert triage.analyze(f.drop("error").selectExpr("*", "'lost' AS error")).first().confidence == 0.4
    monkeypatch.setattr(detect, "MAX_FINDINGS", 2)
    row = triage.analyze(f).first()
    assert row.findings == 2 and row.confidence == 0.6


def test_forced_all_and_unchanged(spark):
    z, g = b.build_zip(MEMBERS), b.build_gzip(b"payload " * 50)
    f = frame(spark, ("ok.zip", z), ("lost.zip", z[: b.parse_zip(z).cd_offset]), ("bad.gz", b"xx" + g[2:-8] + bytes(8)))
    out = {r.file_id: r for r in triage.recover_bytes(f).collect()}
    assert out["ok.zip"].content == z and out["ok.zip"].warning and out["lost.zip"].warning is None and out["lost.zip"].strategy == "zip-rebuild"
    # a bad magic does not end the checks: both strategies are planned
    found = triage.findings(triage.prepared(f.where("file_id = 'bad.gz'")))
    assert {r.rule_id for r in found.collect()} >= {"GZ_MAGIC_001", "GZ_ICRC_001", "GZ_ISIZE_001"}
    once = triage.recover_files(f, passes=1).where("file_id = 'bad.gz'").first()
    every = triage.recover_files(f, passes=None).where("file_id = 'bad.gz'").first()
    assert len(once.tried) == 1 and len(every.tried) >= len(once.tried)
    forced = {r.file_id: r for r in triage.recover_files(f, strategy="partial-extract").collect()}
    assert {*forced} == {"ok.zip", "lost.zip", "bad.gz"} and all(r.tried == ["partial-extract"] for r in forced.values())
    with pytest.raises(ValueError):
        triage.recover_files(f, strategy="none-such")


def test_blocks_against_expected_hashes(spark):
    f = frame(spark, ("x", b"0123456789"))
    want = spark.createDataFrame([("x", 0, hashlib.sha256(b"0123").hexdigest().upper()), ("x", 1, "00")], "file_id string, block_index long, expected string")
    rows = integrity.block_hashes(f, 4, want).orderBy("block_index").collect()
    assert [r.matches for r in rows] == [True, False, None] and rows[2].expected is None


def test_stored_blocks_share_their_type_byte():
    payload = b"stored payload here"
    data = b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + b"\x07" + b"\x55" + len(payload).to_bytes(2, "little") + (len(payload) ^ 0xFFFF).to_bytes(2, "little") + payload
    assert payload in [s.body for s in b.salvage_gzip(data) if s.kind == "StoredBlock"]


def test_command_line_and_stream(spark, tmp_path, capsys):
    z = b.build_zip(MEMBERS)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "ok.zip").write_bytes(z)
    (tmp_path / "in" / "lost.zip").write_bytes(z[: b.parse_zip(z).cd_offset])
    assert main([str(tmp_path / "in"), "--files", str(tmp_path / "out"), "--sign-key", "11" * 32]) == 1
    assert len(capsys.readouterr().out.strip().split("\n")) == 3
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["lost.zip.recovered", "lost.zip.recovered.manifest.json"]
    side = json.loads((tmp_path / "out" / "lost.zip.recovered.manifest.json").read_text())
    assert ed25519.verify(bytes.fromhex(side["public_key"]), side["manifest"].encode(), bytes.fromhex(side["signature"]))
    assert {n: x for n, x in MEMBERS} == {e.entry.name.decode(): b.extract_zip(d, e.entry, e.where)[1] for d in [(tmp_path / "out" / "lost.zip.recovered").read_bytes()] for e in __import__("shardmend.functions.zipview", fromlist=["x"]).view(d).entries}
    recovery_stream(spark, str(tmp_path / "in"), str(tmp_path / "s"), str(tmp_path / "ck")).awaitTermination(120)
    got = {r["name"]: r for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert bytes(got["ok.zip"].content) == z and got["lost.zip"].strategy == "zip-rebuild"
