"""Recovery: which strategies apply, what they make of the bytes, and whether the result is kept.

A checksum that a repair wrote proves nothing: output counts as verified only against something the
repair did not make (a manifest's hash, or a member's own checksum that was there before).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bytesio as b
from ..functions import ed25519
from ..functions.dims import strategy_dim
from .members import _per_file

PASSES = 3
HEALTH_BITS = 32


# --- strategies: bytes to (bytes, whether it did what it is for); None where it abstains ----------


def _same(data: bytes) -> tuple[bytes, bool]:
    return data, True


def _moved_only(data: bytes) -> tuple[bytes, bool]:
    return data, False


def tar_terminator(data: bytes) -> tuple[bytes, bool] | None:
    return None if b.walk_tar(data)[1] else (data + bytes(-len(data) % 512) + bytes(1024), True)


def tar_checksums(data: bytes) -> tuple[bytes, bool] | None:
    out, at, fixed = bytearray(data), 0, 0
    while at + 512 <= len(out) and any(block := bytes(out[at : at + 512])):
        if not b.tar_header_ok(block):
            out[at + 148 : at + 156] = b"%06o \0" % b.tar_checksum(block)
            fixed += 1
        at += 512 + -(-(b.octal(block[124:136]) or 0) // 512) * 512
    return (bytes(out), True) if fixed else None


def gz_magic(data: bytes) -> tuple[bytes, bool] | None:
    return (b"\x1f\x8b" + data[2:], True) if len(data) >= 18 and b.header_length(data, 0) else None


def sevenz_signature(data: bytes) -> tuple[bytes, bool] | None:
    return (b"7z\xbc\xaf\x27\x1c" + data[6:], True) if b.parse_sevenz(data).header_ok else None


def gz_members(data: bytes) -> tuple[bytes, bool] | None:
    good = [s.body for s in b.salvage_gzip(data) if s.kind == "Verified"]
    return (b.build_gzip(b"".join(good)), True) if good else None


def gz_trailer(data: bytes) -> tuple[bytes, bool] | None:
    head = b.gzip_header(data)
    if head is None:
        return None
    body, whole, used = b.inflate_prefix(data[head:])
    if not whole:
        return None
    return data[: head + used] + struct.pack("<II", zlib.crc32(body), len(body) & 0xFFFFFFFF), True


def gz_prefix(data: bytes) -> tuple[bytes, bool] | None:
    head = b.gzip_header(data)
    body = b.inflate_prefix(data[head:])[0] if head else b""
    return (b.build_gzip(body), True) if body else None


def zip_rebuild(data: bytes) -> tuple[bytes, bool] | None:
    """Entries from the first byte on until the first break, with a new directory."""
    kept, at = [], 0
    while e := b.local_record(data, at):
        if not e.compressed and e.flags & 8:
            end = b.next_signature(data, e.data_offset)
            if data[end : end + 4] == b"PK\x07\x08" and end + 16 <= len(data):
                crc, comp, size = struct.unpack_from("<III", data, end + 4)
                if comp != end - e.data_offset:
                    break
                e, end = e._replace(crc32=crc, compressed=comp, size=size), end + 16
            else:
                break
        else:
            end = e.data_offset + e.compressed
        if end > len(data):
            break
        kept.append(e)
        at = end
    return (data[:at] + b.directory_of(kept, at), True) if kept else None


def zip_checksums(data: bytes) -> tuple[bytes, bool] | None:
    """Two of three (payload, header, record) decide a checksum; a payload that both contradict is never blessed."""
    p, out, fixed = b.parse_zip(data), bytearray(data), 0
    at = {e.offset: e for e in p.local}
    for e in p.central:
        local = at.get(e.offset + p.base)
        if local is None or e.flags & 0x41 or local.flags & 8 or local.crc32 == e.crc32:
            continue
        crc = b.extract_zip(data, e, local.offset)[2]
        if crc == e.crc32:
            out[local.offset + 14 : local.offset + 18] = struct.pack("<I", crc)
        elif crc == local.crc32:
            out[e.record_offset + 16 : e.record_offset + 20] = struct.pack("<I", crc)
        else:
            continue
        fixed += 1
    return (bytes(out), True) if fixed else None


def tar_sizes(data: bytes) -> tuple[bytes, bool] | None:
    """A header whose size doesn't lead to the next header gets the size that does."""
    heads = [at for at in range(0, len(data) - 511, 512) if data[at + 257 : at + 262] == b"ustar" and b.octal(data[at + 148 : at + 156]) is not None]
    out, fixed = bytearray(data), 0
    for at, nxt in zip(heads, heads[1:], strict=False):
        size = b.octal(data[at + 124 : at + 136])
        room = nxt - at - 512
        if (size is None or -(-size // 512) * 512 != room) and data[at + 156 : at + 157] in (b"0", b"\0"):
            out[at + 124 : at + 136] = b"%011o\0" % room
            out[at + 148 : at + 156] = b"%06o\0 " % b.tar_checksum(bytes(out[at : at + 512]))
            fixed += 1
    return (bytes(out), True) if fixed else None


def tar_members(data: bytes) -> tuple[bytes, bool] | None:
    found = b.salvage_tar(data)
    blocks = [data[s.start : s.start + 512 + -(-len(s.body) // 512) * 512] for s in found]
    return (b"".join(x + bytes(-len(x) % 512) for x in blocks) + bytes(1024), True) if blocks else None


def carve(data: bytes) -> tuple[bytes, bool] | None:
    hits = b.carve_hits(data)
    return (data[hits[0] :], True) if hits else None


APPLY: dict[str, Callable[[bytes], tuple[bytes, bool] | None]] = {
    "bitflip": _same,
    "tar-terminator-append": tar_terminator,
    "tar-checksum-fix": tar_checksums,
    "gz-magic-restore": gz_magic,
    "sevenz-signature-restore": sevenz_signature,
    "gz-member-salvage": gz_members,
    "gz-trailer-recompute": gz_trailer,
    "zip-rebuild": zip_rebuild,
    "tar-reorder": _moved_only,
    "tar-size-resync": tar_sizes,
    "zip-crc-fix": zip_checksums,
    "iso-sector": _moved_only,
    "tar-continuation-salvage": tar_members,
    "gz-partial-inflate": gz_prefix,
    "partial-extract": _same,
    "forensic-carve": carve,
}


def applies() -> dict[str, Column]:
    """Predicate over one finding (with engine_format and manifest_present) of each strategy."""
    fmt, rule, cat = F.col("engine_format"), F.col("rule_id"), F.col("category")
    structural = cat == "StructuralCorruption"
    return {
        "bitflip": F.coalesce("manifest_present", F.lit(False)) & (cat == "BitFlip"),
        "tar-terminator-append": (fmt == "tar") & ((rule == "TAR_TERM_001") | (cat == "Truncation")),
        "tar-checksum-fix": (fmt == "tar") & (rule == "TAR_UST_001"),
        "gz-magic-restore": (fmt == "gzip") & (rule == "GZ_MAGIC_001"),
        "sevenz-signature-restore": (fmt == "seven_z") & (rule == "7Z_MAGIC_001"),
        "gz-member-salvage": fmt == "gzip",
        "gz-trailer-recompute": (fmt == "gzip") & rule.isin("GZ_ICRC_001", "GZ_ISIZE_001"),
        "zip-rebuild": (fmt == "zip") & (structural | rule.startswith("ZIP_CD_") | rule.startswith("ZIP_EOCD_") | rule.startswith("ZIP_LFH_")),
        "tar-reorder": (fmt == "tar") & (cat == "BlockReorder"),
        "tar-size-resync": (fmt == "tar") & (rule.isin("TAR_SIZE_001", "TAR_UST_001") | structural),
        "zip-crc-fix": (fmt == "zip") & (rule == "ZIP_CRC_001"),
        "iso-sector": (fmt == "iso9660") & (cat == "MissingData"),
        "tar-continuation-salvage": fmt == "tar",
        "gz-partial-inflate": (fmt == "gzip") & (cat == "Truncation"),
        "partial-extract": cat == "Truncation",
        "forensic-carve": (fmt == "raw") & (F.col("severity") == "Catastrophic"),
    }


def plan(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, strategy, rule_id, start, end, technique, risk, priority, reg_ord): a row for each finding that a strategy handles. Reads no bytes."""
    f = findings.join(files.select("file_id", "engine_format", "manifest_present"), "file_id")
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in applies().items()]), lambda x: x.isNotNull())
    rows = f.select("file_id", "rule_id", "start", "end", F.explode(names).alias("strategy"))
    return rows.join(F.broadcast(strategy_dim(findings.sparkSession)), "strategy")


def select(planned: DataFrame, passes: int | None = PASSES) -> DataFrame:
    """(file_id, strategy, pass, ...): the first strategies of each file by priority, then registration; all of them without a number of passes. Files without findings have none."""
    once = planned.dropDuplicates(["file_id", "strategy"]).drop("rule_id", "start", "end")
    w = Window.partitionBy("file_id").orderBy(F.desc("priority"), "reg_ord")
    ranked = once.withColumn("pass", F.row_number().over(w))
    return ranked if passes is None else ranked.where(F.col("pass") <= passes)


def forced(files: DataFrame, strategy: str) -> DataFrame:
    """One named strategy for every file, whatever its findings. Raises ValueError for a name that is none."""
    if strategy not in APPLY:
        raise ValueError(f"unknown strategy {strategy!r}")
    one = strategy_dim(files.sparkSession).where(F.col("strategy") == strategy)
    return files.select("file_id").crossJoin(F.broadcast(one)).withColumn("pass", F.lit(1))  # one row on the right


#: Files with chosen strategies (their ids and names, some 100 bytes each) up to which the list is broadcast.
BROADCAST_ROWS = 300_000


def outputs(rows: DataFrame) -> DataFrame:
    """Output bytes of each strategy of files (file_id, name, content, engine_format, strategies: an array of structs with `strategy`), null where it abstains: no join, one reading of the bytes.

    The structs' other fields come along as columns.
    """
    fields = rows.schema["strategies"].dataType.elementType.fields
    others = [f.name for f in fields if f.name != "strategy"]

    def run(r) -> Iterator[tuple]:
        for s in r.strategies:
            got = APPLY[s["strategy"]](r.content or b"")
            yield s["strategy"], None if got is None else got[0], got is not None and got[1], *[s[c] for c in others]

    types = ["file_id string", "strategy string", "staged binary", "did boolean", *[f"{f.name} {f.dataType.simpleString()}" for f in fields if f.name != "strategy"]]
    return _per_file(rows, ", ".join(types), run, ("file_id", "name", "content", "engine_format", "strategies"))


def staged(files: DataFrame, selected: DataFrame) -> DataFrame:
    """selected with the output bytes of each strategy, always of the original bytes; null where it abstains.

    A file's strategies are joined as one list with all that is known of them, so that its bytes are read once, outputs join nothing, and
    bytes cross no network where the list is short. Where it is long, they cross it once, and are hashed against the list, not sorted.
    """
    lists = selected.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("strategy", *[c for c in selected.columns if c not in ("file_id", "strategy")]))).alias("strategies"))
    short = selected.count() <= BROADCAST_ROWS
    lists = F.broadcast(lists) if short else lists.hint("shuffle_hash")
    return outputs(files.select("file_id", "name", "content", "engine_format").join(lists, "file_id"))


def keep_gate(rows: DataFrame) -> DataFrame:
    """rows (staged, risk, terminal, verified, health_before, health_after, raw_after) with kept and stop.

    Kept: some bytes, no worse than before, still of the format; an inferred repair only if verified;
    else if verified, better, or as good and terminal.
    """
    fine = (F.length("staged") > 0) & (F.col("health_after") >= F.col("health_before")) & ~F.coalesce("raw_after", F.lit(False))
    better = F.col("health_after") > F.col("health_before")
    kept = fine & F.when(F.col("risk") == "Inferred", F.col("verified")).otherwise(F.col("verified") | better | F.col("terminal"))
    return rows.withColumns({"kept": F.coalesce(kept, F.lit(False)), "stop": F.coalesce(kept & (F.col("verified") | better), F.lit(False))})


def outcome(gated: DataFrame) -> DataFrame:
    """One row of each file: the first kept pass that verified or improved, else the last kept one; recovered, lost and warnings of the passes up to it."""
    w = Window.partitionBy("file_id")
    stop = F.min(F.when(F.col("stop"), F.col("pass"))).over(w)
    seen = gated.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("pass") <= F.col("_stop")))
    n = F.when(F.col("kept"), F.length("staged")).otherwise(0).cast("long")
    best = F.max_by(F.when(F.col("kept"), F.struct("strategy", "risk", "staged", "verified", "health_after")), F.when(F.col("kept"), F.col("pass")))
    out = seen.groupBy("file_id").agg(
        best.alias("b"),
        F.max(n).alias("bytes_recovered"),
        F.max("health_before").alias("health_before"),
        F.bool_or(~F.col("kept")).alias("rolled_back"),
        F.array_sort(F.collect_set("strategy")).alias("tried"),
    )
    guarantee = F.when((F.col("b.risk") == "Safe") & F.col("b.verified"), "Verified").when(F.col("b.risk").isin("Safe", "Inferred"), "Unverified").when(F.col("b").isNotNull(), "Lost")
    return out.select("file_id", "b.strategy", F.col("b.staged").alias("output"), F.col("b").isNotNull().alias("success"), "bytes_recovered", "health_before", F.coalesce("b.health_after", "health_before").alias("health_after"), F.coalesce("b.verified", F.lit(False)).alias("verified"), "rolled_back", "tried", guarantee.alias("guarantee"))


# --- evidence -------------------------------------------------------------------------------------


def evidence(records: DataFrame) -> DataFrame:
    """records (axis, class, verifiers and solved_against as arrays of structs kind, [width,] start, end; target_trust, unique_gate, clean_diff) with evidence_bits, error, can_emit, raises_health and false_accept_bound."""
    bits = F.when(F.col("axis") == "Probabilistic", F.aggregate("verifiers", F.lit(0), lambda acc, v: acc + v["width"])).otherwise(0)
    same = F.exists("verifiers", lambda v: F.exists("solved_against", lambda s: (s["kind"] == v["kind"]) & (s["start"] < v["end"]) & (v["start"] < s["end"])))
    erasure = (F.col("axis") == "Probabilistic") & (F.col("class") == "ExactErasure")
    trusted = F.col("target_trust").isNotNull()
    prob = F.col("axis") == "Probabilistic"
    out = records.withColumn("evidence_bits", bits)
    b_ = F.col("evidence_bits")
    error = F.when(same, "tautological verifier").when(erasure & ~trusted, "untrusted erasure target").when(prob & ~erasure & (b_ == 0), "no independent verifier")
    can = F.when(erasure, trusted).when(prob, b_ > 0).otherwise(True)
    unique = (F.col("axis") == "Logical") & (F.col("class") == "StructuralUnique") & F.coalesce("unique_gate", F.lit(False)) & F.coalesce("clean_diff", F.lit(False))
    raises = F.when(erasure, trusted).when(prob, (b_ >= HEALTH_BITS) & (F.size("verifiers") > 0)).otherwise(unique)
    bound = F.when(erasure, "deterministic (exact erasure under trusted target)").when(prob, F.concat(F.lit("2^-"), b_.cast("string"))).when(F.col("axis") == "Logical", "model-incompleteness (empirical)").otherwise("suggestion")
    return out.withColumns({"error": error, "can_emit": can & error.isNull(), "raises_health": raises & error.isNull(), "false_accept_bound": bound})


def entry_evidence(output_entries: DataFrame, attested: DataFrame) -> DataFrame:
    """output_entries (file_id, name, status) with existence and content evidence and the verdict of both."""
    names = attested.select("file_id", "name").distinct().withColumn("_a", F.lit(True))
    rows = output_entries.join(names, ["file_id", "name"], "left")
    exists_, content = F.coalesce("_a", F.lit(False)), F.col("status") == "VERIFIED_CRC"
    verdict = F.when(exists_ & content, "exact").when(exists_, "exists, content unproven").when(content, "content proven, name unattested").otherwise("unproven")
    return rows.withColumns({"existence_evidence": F.when(exists_, "source directory").otherwise("none"), "content_evidence": F.when(content, "checksum").otherwise("none"), "verdict": verdict, "trusted": exists_ & content}).drop("_a")


def manifest_json(reports: DataFrame, files: DataFrame, key: bytes | None = None, tool: str = "shardmend") -> DataFrame:
    """reports (file_id, output, strategy, guarantee) with a canonical JSON manifest, its digest, and (with a key of 32 bytes) its Ed25519 signature, public key and key id.

    The signature is over the manifest's bytes; without a key it is null.
    """
    rows = reports.join(files.select("file_id", "name", F.sha2("content", 256).alias("source_sha256"), F.length("content").alias("source_bytes")), "file_id")
    n = F.coalesce(F.length("output"), F.lit(0))
    count = lambda g: F.when(F.col("guarantee") == g, n).otherwise(0)
    lost = F.greatest(F.col("source_bytes") - n, F.lit(0))
    body = F.struct(
        "file_id", "name", F.lit("1").alias("manifest_version"), F.lit(tool).alias("tool"), "source_sha256", "source_bytes", F.sha2("output", 256).alias("output_sha256"), "strategy", "guarantee",
        F.struct(count("Verified").alias("verified_bytes"), count("Unverified").alias("unverified_bytes"), lost.alias("lost_bytes")).alias("guarantees"),
    )
    js = F.to_json(body)
    out = rows.select("file_id", js.alias("manifest"), F.sha2(js, 256).alias("digest"))
    if key is None:
        return out.withColumns({c: F.lit(None).cast("string") for c in ("signature", "public_key", "key_id")})
    public = ed25519.public_key(key)

    @F.pandas_udf("string")
    def signed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: ed25519.sign(key, t.encode()).hex())

    return out.withColumns({"signature": signed("manifest"), "public_key": F.lit(public.hex()), "key_id": F.lit(hashlib.sha256(public).hexdigest()[:16])})


def manifest_verified(manifests: DataFrame) -> DataFrame:
    """manifests (manifest, signature, public_key) with whether the signature holds; false where one is missing or odd."""

    @F.pandas_udf("boolean")
    def holds(text: pd.Series, signature: pd.Series, public: pd.Series) -> pd.Series:
        def one(t, s, k) -> bool:
            try:
                return ed25519.verify(bytes.fromhex(k), t.encode(), bytes.fromhex(s))
            except (TypeError, ValueError, AttributeError):
                return False

        return pd.Series([one(*x) for x in zip(text, signature, public, strict=True)], dtype=bool)

    return manifests.withColumn("signature_ok", holds("manifest", "signature", "public_key"))


def carved(files: DataFrame) -> DataFrame:
    """(file_id, offset, end): pieces from each signature to the next."""
    hits = _per_file(files, "file_id string, offset long, length long", lambda r: [(h, len(r.content)) for h in b.carve_hits(r.content or b"")])
    w = Window.partitionBy("file_id").orderBy("offset")
    return hits.select("file_id", "offset", F.coalesce(F.lead("offset").over(w), F.col("length")).alias("end"))


def counters(segments: DataFrame) -> DataFrame:
    """Verified and unverified bytes and members of salvaged segments."""
    ok, n = F.col("kind") == "Verified", F.length("bytes")
    return segments.groupBy("file_id").agg(F.sum(F.when(ok, n).otherwise(0)).alias("verified_bytes"), F.sum(F.when(ok, 0).otherwise(n)).alias("unverified_bytes"), F.count_if(ok).alias("verified_members"), F.count_if(~ok).alias("unverified_members"))


