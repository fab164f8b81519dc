"""Classification, merging, health, recoverability and breakdown of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from ..functions.dims import EMIT_THRESHOLD, rule_dim
from .relational import islands


def classify(found: DataFrame) -> DataFrame:
    """Raw findings joined with their rules (117 rows, broadcast): confidence, description and a stable id; weak ones are dropped."""
    rules = F.broadcast(rule_dim(found.sparkSession))
    out = found.join(rules, "rule_id").withColumn("confidence", F.coalesce("confidence", "base_confidence")).drop("base_confidence")
    out = out.where(F.col("confidence") >= EMIT_THRESHOLD)
    said = exprs.description(F.col("rule_id"), F.col("field"), F.col("start"), F.col("confidence"))
    key = F.sha2(F.concat_ws("\0", "file_id", "rule_id", F.col("start").cast("string"), F.col("end").cast("string"), F.col("seq").cast("string")), 256)
    return out.withColumns({"description": said, "finding_id": key})


def merge_adjacent(findings: DataFrame) -> DataFrame:
    """Bit flips of a file that touch become one finding, with the first one's rule and the worst severity; others pass."""
    flips = findings.where("category = 'BitFlip' and start is not null")
    rest = findings.where("category <> 'BitFlip' or start is null").withColumn("merged", F.lit(1).cast("long"))
    first = [c for c in findings.columns if c not in ("file_id", "start", "end", "severity", "severity_rank")]
    order = F.struct("start", "end", "seq")
    grouped = islands(flips, ["file_id"], "start", "end", ["end", "seq"]).groupBy("file_id", "island")
    out = grouped.agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.max_by("severity", "severity_rank").alias("severity"),
        F.max("severity_rank").alias("severity_rank"),
        F.count(F.lit(1)).alias("merged"),
        *[F.min_by(c, order).alias(c) for c in first],
    ).drop("island")
    return out.unionByName(rest.select(out.columns))


def health(findings: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Scores 0 to 100 of each key with findings: structural, data, metadata, overall. Keys without findings are at 100."""
    left = lambda hit: F.greatest(F.lit(0), 100 - F.sum(F.col("points") * F.col(hit))).cast("int")
    scores = findings.groupBy(*keys).agg(left("hits_structural").alias("structural"), left("hits_data").alias("data"), left("hits_metadata").alias("metadata"))
    return scores.withColumn("overall", exprs.overall_health(F.col("structural"), F.col("data"), F.col("metadata")))


def _flag(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


# What each circumstance adds to the probability of recovery, in the order in which they are added.
FACTORS = [
    ("bitflip_only", 0.08),
    ("tar_checksum_only", 0.25),
    ("zip_redundancy", 0.20),
    ("pdf_linearization", 0.10),
    ("sqlite_wal", 0.15),
    ("external_manifest", 0.18),
    ("embedded_checksums", 0.08),
    ("small_damage", 0.12),
    ("signature_missing", -0.60),
    ("page_size_invalid", -0.55),
    ("truncated_at_header", -0.45),
    ("missing_data", -0.28),
    ("catastrophic_structural", -0.45),
    ("nothing_to_verify", -0.12),
]
BASE, NONE_CEILING, LOW_FLOOR = 0.5, 0.10, 0.15


def recoverability(findings: DataFrame, files: DataFrame) -> DataFrame:
    """One row of each of files (file_id, engine_format, total_size, manifest_present, embedded_checksums, capped): probability, class, confidence, factors.

    One aggregation to flags, then a single expression that adds the factors in order, so the bands' edges do not depend on a shuffle.
    """
    rule = F.col("rule_id")
    head = F.floor(F.col("total_size") * 0.10)
    sized = findings.join(files.select("file_id", F.col("total_size").alias("total_size")), "file_id")
    flags = sized.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.col("category") == "BitFlip").alias("bitflip_only"),
        F.bool_and(rule == "TAR_UST_001").alias("tar_checksum_only"),
        _flag(rule.isin("ZIP_CD_001", "ZIP_TRUNC_004")).alias("zip_gone"),
        (_flag(rule.startswith("PDF_")) & ~_flag(rule == "PDF_HDR_001")).alias("pdf_linearization"),
        _flag(rule == "SQ_WAL_001").alias("sqlite_wal"),
        (_flag(rule.endswith("_MAGIC_001")) & ~_flag(rule == "GZ_MAGIC_001") | _flag(rule == "PDF_HDR_001")).alias("signature_missing"),
        _flag(rule == "SQ_PGSIZE_001").alias("page_size_invalid"),
        _flag((F.col("category") == "Truncation") & (F.col("end") > 0) & (F.col("end") < head) & (F.col("total_size") > 0)).alias("head_cut"),
        _flag(rule.isin("ZIP_TRUNC_004", "TAR_TRUNC_003")).alias("head_rule"),
        F.count_if(F.col("category") == "MissingData").alias("missing"),
        _flag((F.col("category") == "StructuralCorruption") & (F.col("severity") == "Catastrophic")).alias("catastrophe"),
        _flag(rule.isin("ZIP_EOCD_001", "ZIP_EOCD_002", "ZIP_EOCD_003")).alias("zip_eocd"),
        _flag(rule == "ZIP_CD_001").alias("zip_cd"),
        _flag(F.col("category") == "SecurityThreat").alias("threat"),
        F.sum(F.col("end") - F.col("start")).alias("damaged"),
    )
    r = files.join(flags, "file_id", "left")
    zip_ = F.col("engine_format") == "zip"
    manifest, embedded = (F.coalesce(c, F.lit(False)) for c in ("manifest_present", "embedded_checksums"))
    cond = {
        "zip_redundancy": zip_ & ~F.col("zip_gone"),
        "external_manifest": manifest,
        "embedded_checksums": embedded,
        "small_damage": (F.col("total_size") > 0) & (F.col("damaged") > 0) & (F.col("damaged") / F.nullif("total_size", F.lit(0)) < 0.01),
        "truncated_at_header": F.col("head_cut") | F.col("head_rule"),
        "catastrophic_structural": F.col("catastrophe") & ~(zip_ & F.col("zip_eocd") & ~F.col("zip_cd")),
        "nothing_to_verify": ~manifest & ~embedded,
    }
    p, told = F.lit(BASE), []
    for name, weight in FACTORS:
        c = F.coalesce(cond.get(name, F.col("missing") > 0 if name == "missing_data" else F.col(name) if name in flags.columns else None), F.lit(False))
        w = F.lit(weight) * F.col("missing") if name == "missing_data" else F.lit(weight)
        p = p + F.when(c, w).otherwise(0.0)
        told.append(F.when(c, F.struct(F.lit(name).alias("name"), w.alias("weight"))))
    hopeless = F.col("signature_missing") | F.col("page_size_invalid") | F.col("head_rule")
    p = F.when(hopeless, F.least(p, F.lit(NONE_CEILING))).otherwise(F.greatest(F.lit(LOW_FLOOR), F.least(p, F.lit(1.0))))
    clean = F.col("n").isNull()
    probability = F.when(clean, 1.0).when(F.col("threat"), 0.0).otherwise(F.greatest(F.lit(0.0), p))
    confidence = F.when(clean | F.col("threat"), 1.0)
    # what the scan could not see: a format that was not made out, bytes that were not read, findings beyond the cap
    for name, value in (("unidentified", 0.3), ("unread", 0.4), ("capped", 0.6)):
        if name in files.columns:
            confidence = confidence.when(F.coalesce(name, F.lit(False)), value)
    confidence = confidence.otherwise(1.0)
    factors = F.when(clean | F.col("threat"), F.array().cast("array<struct<name:string,weight:double>>")).otherwise(F.filter(F.array(*told), lambda x: x.isNotNull()))
    return r.select("file_id", probability.alias("probability"), exprs.recoverability_class(probability).alias("class"), confidence.alias("confidence"), factors.alias("factors"))


def breakdown(findings: DataFrame, classes: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Counts of strong, medium, weak and no evidence of each key; give no keys for a whole fleet. classes has file_id and class."""
    rows = findings.join(classes.select("file_id", "class"), "file_id")
    none = (F.col("class") == "None") & (F.col("severity") == "Catastrophic")
    backed = F.col("evidence_type").isin("ChecksumMismatch", "SignatureMismatch") & (F.col("confidence") >= 0.90)
    band = F.when(none, "none").when(backed, "strong").when(F.col("confidence") >= 0.70, "medium").otherwise("weak")
    return rows.withColumn("_band", band).groupBy(*keys).agg(*[F.count_if(F.col("_band") == b).alias(b) for b in ("strong", "medium", "weak", "none")])


def worst(findings: DataFrame) -> DataFrame:
    return findings.groupBy("file_id").agg(F.max_by("severity", "severity_rank").alias("worst_severity"), F.count(F.lit(1)).alias("findings"))


def per_member(members: DataFrame, findings: DataFrame) -> DataFrame:
    """Members with their own health: findings join by exact path; members without any are whole."""
    own = health(findings.where("member is not null").withColumnRenamed("member", "path"), ("file_id", "path"))
    out = members.join(own, ["file_id", "path"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(100)) for c in ("structural", "data", "metadata", "overall")})


# Rules that a truncation brings about by itself.
SYMPTOMS = ("ZIP_EOCD_001", "ZIP_EOCD_002", "ZIP_EOCD_003", "ZIP_CD_001", "ZIP_CD_002", "ZIP_CD_003", "ZIP_LFH_001", "TAR_TERM_001", "TAR_UST_001", "ISO_PVD_001")


def suppress_symptoms(findings: DataFrame) -> DataFrame:
    """With a reference copy's truncation known, structural symptoms of it are dropped."""
    cut = findings.where(F.col("rule_id").contains("TRUNC")).select("file_id").distinct()
    symptom = F.col("rule_id").isin(*SYMPTOMS)
    return findings.where(~symptom).unionByName(findings.where(symptom).join(cut, "file_id", "left_anti"))
