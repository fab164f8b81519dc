"""Column expressions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import ENGINE_FORMATS, ENGINE_SUFFIXES, FORMATS, SIGNATURES


def signature_ord(content: Column, length: Column) -> Column:
    """Number of the first signature that the bytes carry; one that reaches past the bytes does not fire.

    The signatures are a constant array that is looked through, so the expression stays small when a filter on its result is pushed down.
    """
    rows = [F.struct(F.lit(n).alias("n"), F.lit(at).alias("at"), F.lit(len(magic) // 2).alias("size"), F.lit(bytes.fromhex(magic)).alias("magic"), F.lit(least).alias("least")) for n, (_, at, magic, least, _) in enumerate(SIGNATURES, 1)]

    def fires(s: Column) -> Column:
        at = F.when(s["at"] >= 0, s["at"]).otherwise((length + s["at"]).cast("int"))
        return (length >= s["least"]) & (at >= 0) & (at + s["size"] <= length) & (content.substr(at + 1, s["size"]) == s["magic"])

    return F.array_min(F.transform(F.array(*rows), lambda s: F.when(fires(s), s["n"])))


def by_signature(ord_: Column, column: int) -> Column:
    """A column of the signature table (0 format, 4 provenance) for its number; null for none."""
    # guarded: element_at of a null place gave the last element in compiled code
    return F.when(ord_.isNotNull(), F.element_at(F.array(*[F.lit(s[column]) for s in SIGNATURES]), F.coalesce(ord_, F.lit(1))))


def _by_suffix(name: Column, formats: list[tuple[str, str]]) -> Column:
    """Format of a name's last suffix. No listed suffix holds another dot, so it is also the longest that fits."""
    table = F.create_map(*[F.lit(x) for f, ext in formats for e in ext.split() for x in (e, f)])
    return F.try_element_at(table, F.regexp_extract(F.lower(name), r"(\.[a-z0-9]+)$", 1))


def name_format(name: Column) -> Column:
    return _by_suffix(name, [(f, ext) for f, _, _, ext in FORMATS])


def agreement(by_content: Column, by_name: Column) -> Column:
    return (
        F.when(by_content == by_name, "Match")
        .when(by_content.isNotNull() & by_name.isNotNull(), "Mismatch")
        .when(by_content.isNotNull(), "ContentOnly")
        .when(by_name.isNotNull(), "NameOnly")
        .otherwise("Unknown")
    )


def engine_format(by_content: Column, name: Column) -> Column:
    """Format the engine acts on: its content's if readable, else by suffix in order, else raw."""
    return F.coalesce(F.when(by_content.isin(*ENGINE_FORMATS), by_content), _by_suffix(name, ENGINE_SUFFIXES), F.lit("raw"))


def overall_health(structural: Column, data: Column, metadata: Column) -> Column:
    """round(0.4 s + 0.4 d + 0.2 m) in whole numbers; ties cannot occur."""
    return F.floor((structural * 4 + data * 4 + metadata * 2 + 5) / 10).cast("int")


def health_band(score: Column) -> Column:
    return F.when(score >= 100, "Intact").when(score >= 80, "Minor").when(score >= 50, "Degraded").when(score >= 20, "Severe").otherwise("Destroyed")


def recoverability_class(p: Column) -> Column:
    return F.when(p >= 0.75, "High").when(p >= 0.40, "Medium").when(p >= 0.15, "Low").otherwise("None")


def noisy_or(primary: Column, supporting: Column) -> Column:
    """1 - (1 - p) * product(1 - s), between 0 and 1."""
    rest = F.aggregate(F.coalesce(supporting, F.array().cast("array<double>")), 1 - primary, lambda acc, s: acc * (1 - s))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - rest))


def bitflip_confidence(blocks: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(0.85) + F.lit(0.05) * F.greatest(blocks - 1, F.lit(0)))


def offset_confidence(offset: Column, size: Column) -> Column:
    return F.when(offset > size, 1.0).otherwise(0.9)


def description(rule_id: Column, field: Column, offset: Column, confidence: Column) -> Column:
    return F.format_string("%s: %s at offset 0x%s (confidence %s%%)", rule_id, field, F.hex(offset), F.round(confidence * 100).cast("int").cast("string"))


def safe_path(raw: Column, max_bytes: int = 4096, max_depth: int = 64) -> Column:
    """A relative path without drive, absolute start, dot parts, colons, NUL or too much depth or length; null for others."""
    parts = F.filter(F.split(F.translate(raw, "\\", "/"), "/"), lambda p: p != "")
    bad = (
        (raw == "")
        | (F.octet_length(raw) > max_bytes)
        | raw.contains("\0")
        | raw.startswith("/")
        | raw.startswith("\\")
        | (F.size(parts) == 0)
        | (F.size(parts) > max_depth)
        | F.exists(parts, lambda p: (p == ".") | (p == "..") | p.contains(":"))
    )
    return F.when(raw.isNotNull() & ~bad, F.array_join(parts, "/"))


def false_accept_bound(bits: Column) -> Column:
    return F.concat(F.lit("2^-"), bits.cast("string"))
