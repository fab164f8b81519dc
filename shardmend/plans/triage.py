"""The two spines: analysis (bytes to findings and scores) and recovery (findings to kept repairs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import written
from ..operators import detect, identify, integrity, members, recover, scoring


def prepared(files: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """files with formats, hashes and their comparison with a manifest (name, hash)."""
    known = identify.identify(files.withColumn("length", F.length("content").cast("long")))
    hashed = integrity.hashes(known)
    if manifest is None:
        manifest = files.select("name", F.lit(None).cast("string").alias("hash")).limit(0)
    return integrity.compare(hashed, manifest)


META = ("file_id", "name", "length", "by_content", "by_name", "provenance", "agreement", "best_effort", "engine_format", "sha256", "crc32", "expected", "manifest_present", "matches", "status")


def _parsed(files: DataFrame, meta: DataFrame, strict: bool, references: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(classified and merged findings, (file_id, encrypted, capped)) of identified files, whose bytes are read once; meta has file_id, length and status."""
    raw = written(detect.scan(files, strict), "raw")
    state = raw.groupBy("file_id").agg(F.bool_or("encrypted").alias("encrypted"), (F.count("rule_id") >= detect.MAX_FINDINGS).alias("capped"))
    closed = raw.where("encrypted").select("file_id")
    wal = detect.wal_findings(files)
    found = raw.where("rule_id IS NOT NULL").drop("encrypted").unionByName(detect.mismatches(meta.join(closed, "file_id", "left_anti"))).unionByName(wal)
    out = scoring.classify(detect.capped(found).drop("capped"))
    if references is not None:
        from ..operators.reference import reference_diff

        out = scoring.suppress_symptoms(out.unionByName(scoring.classify(reference_diff(files.join(closed, "file_id", "left_anti"), references).drop("bits"))))
    return written(scoring.merge_adjacent(out), "findings"), state


def findings(files: DataFrame, strict: bool = False, references: DataFrame | None = None) -> DataFrame:
    """Classified, merged findings of prepared files, written once: they are small, and several steps read them."""
    return _parsed(files, files, strict, references)[0]


def _known(files: DataFrame, manifest: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(identified files, a projection of the input; their metadata, written). No bytes are in a join."""
    known = identify.identify(files.withColumn("length", F.length("content").cast("long")))
    place = [c for c in ("path", "error") if c in files.columns]
    slim = integrity.hashes(known).drop("content")
    if manifest is None:
        manifest = files.select("name", F.lit(None).cast("string").alias("hash")).limit(0)
    return known, written(integrity.compare(slim, manifest).select(*META, *place), "meta")


def analyze(files: DataFrame, manifest: DataFrame | None = None, strict: bool = False, references: DataFrame | None = None) -> DataFrame:
    """One row of each file: formats, hash, findings, worst severity, health, recoverability, error. Bytes are read for the metadata and for the findings; the rest joins small tables."""
    known, meta = _known(files, manifest)
    found, state = _parsed(known, meta, strict, references)
    unread = F.col("error").isNotNull() if "error" in meta.columns else F.lit(False)
    sized = meta.select("file_id", "engine_format", F.col("length").alias("total_size"), "manifest_present", (F.col("engine_format") == "zip").alias("embedded_checksums"), unread.alias("unread"))
    sized = sized.join(state.select("file_id", "capped"), "file_id", "left")
    chance = scoring.recoverability(found, sized)
    closed = state.where("encrypted").select("file_id", F.lit("Encrypted").alias("_closed"))
    out = meta.join(scoring.worst(found), "file_id", "left").join(scoring.health(found), "file_id", "left").join(chance.drop("factors"), "file_id", "left").join(closed, "file_id", "left")
    error = F.coalesce("error", "_closed") if "error" in meta.columns else F.col("_closed")
    full = {c: F.coalesce(c, F.lit(100)) for c in ("structural", "data", "metadata", "overall")}
    return out.withColumns(full | {"findings": F.coalesce("findings", F.lit(0)), "error": error}).drop("_closed")


def recover_files(files: DataFrame, manifest: DataFrame | None = None, passes: int | None = recover.PASSES, strategy: str | None = None) -> DataFrame:
    """One row of each file with findings: what was kept, with its bytes and guarantee.

    passes: strategies tried of each file, all of them with None; strategy: this one alone, for every file. Outputs are
    analysed again under their first format, so a lost format shows as damage.
    """
    known, meta = _known(files, manifest)
    found, _ = _parsed(known, meta, False, None)
    chosen = recover.select(recover.plan(found, meta), passes) if strategy is None else recover.forced(meta, strategy)
    chosen = written(chosen, "chosen")
    made = written(recover.staged(known, chosen), "staged")
    again = made.where("staged is not null").join(meta.select("file_id", "engine_format", "expected", "name"), "file_id")
    again = again.select(F.concat_ws("\x01", "file_id", "strategy").alias("file_id"), "name", F.col("staged").alias("content"), "engine_format", "expected")
    after = scoring.health(scoring.classify(detect.detect(again))).select("file_id", F.col("overall").alias("health_after"))
    # a known format that the output no longer has
    now = identify.identify(again.drop("engine_format").withColumn("length", F.length("content").cast("long"))).select("file_id", "by_content")
    first = again.select("file_id", "engine_format", F.coalesce(F.sha2("content", 256) == F.col("expected"), F.lit(False)).alias("verified"))
    hashed = first.join(now, "file_id").withColumn("raw_after", (F.col("engine_format") != "raw") & F.col("by_content").isNull())
    after = hashed.join(after, "file_id", "left").select("verified", "raw_after", F.coalesce("health_after", F.lit(100)).alias("health_after"), F.split("file_id", "\x01").alias("_k"))
    after = after.select(F.col("_k")[0].alias("file_id"), F.col("_k")[1].alias("strategy"), "verified", "raw_after", "health_after")
    before = meta.select("file_id").join(scoring.health(found).select("file_id", "overall"), "file_id", "left").select("file_id", F.coalesce("overall", F.lit(100)).alias("health_before"))
    rows = made.join(after, ["file_id", "strategy"], "left").join(before, "file_id")
    return recover.outcome(recover.keep_gate(rows))


def recover_bytes(files: DataFrame, manifest: DataFrame | None = None, passes: int | None = recover.PASSES, strategy: str | None = None) -> DataFrame:
    """files, each with its repaired content, or its own where nothing was repaired; `warning` says so, and `strategy` and `guarantee` what was done."""
    done = recover_files(files, manifest, passes, strategy).where("success").select("file_id", F.col("output").alias("_output"), "strategy", "guarantee")
    out = files.join(done, "file_id", "left")
    warning = F.when(F.col("_output").isNull(), "no repair applied; passed through unchanged")
    return out.withColumns({"content": F.coalesce("_output", "content"), "warning": warning}).drop("_output")


def member_report(files: DataFrame) -> DataFrame:
    ready = prepared(files)
    return scoring.per_member(members.members(ready), findings(ready))
