"""ZIP evidence: directory records, local headers, offset maps, reconciliation, containers, extraction, export.

Bytes become two tables (directory and local headers) once; everything between them is joins and
windows keyed by file. Only the claims of scanned headers among themselves, and the export budget,
depend on order row by row: those two are folds over one file's entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bytesio as b
from ..functions import exprs, zipview
from .members import _per_file

ENTRY = "file_id string, source string, ordinal int, record_offset long, local_header_offset long, raw_name binary, name string, name_valid_utf8 boolean, method int, flags int, crc32 long, compressed_size long, size long, data_offset long, zip64 boolean, is_link boolean"
PARSE = "file_id string, eocd_found boolean, cd_found boolean, cd_count_consistent boolean, cd_located_by_size boolean, base long, length long, cd_offset long"
#: Segments of an offset map at most, least bytes of an unexplained gap, and the export's budget.
MAX_SEGMENTS, GAP_BYTES, EXPORT_BYTES, EXPORT_ENTRY_BYTES = 4, 30, 1 << 30, 512 << 20
TRUSTED_PROVENANCE = ("OriginalSurviving", "ExternalAttested")


def _utf8(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def entries(files: DataFrame) -> DataFrame:
    """Directory records (source central) and scanned local headers (source local) of ZIP files."""

    def rows(r):
        p = b.parse_zip(r.content or b"")
        for source, found in (("central", p.central), ("local", p.local)):
            for n, e in enumerate(found):
                yield source, n, e.record_offset, e.offset, e.name, e.name.decode("utf-8", "replace"), _utf8(e.name), e.method, e.flags, e.crc32, e.compressed, e.size, e.data_offset, e.zip64, e.link

    return _per_file(files, ENTRY, rows)


def parses(files: DataFrame) -> DataFrame:
    def rows(r):
        p = b.parse_zip(r.content or b"")
        yield p.eocd is not None, bool(p.central), p.declared == len(p.central), p.located_by_size, p.base, len(r.content or b""), p.cd_offset

    return _per_file(files, PARSE, rows)


def observations(central: DataFrame, local: DataFrame) -> DataFrame:
    """(file_id, ordinal, stored, physical): where each record's header really is: at its offset, else at the one header of its name with its method and checksum."""
    c = central.select("file_id", "ordinal", "raw_name", "method", "crc32", F.col("local_header_offset").alias("stored"))
    heads = local.select(F.col("file_id").alias("_f"), F.col("raw_name").alias("_n"), F.col("method").alias("_m"), F.col("crc32").alias("_c"), F.col("local_header_offset").alias("physical"))
    named = c.join(heads, (F.col("file_id") == F.col("_f")) & (F.col("raw_name") == F.col("_n"))).drop("_f")
    direct = F.col("physical") == F.col("stored")
    fits = (F.col("_m") == F.col("method")) & ((F.col("_c") == F.col("crc32")) | (F.col("_c") == 0))
    w = Window.partitionBy("file_id", "ordinal")
    seen = named.where(direct | fits).withColumns({"_direct": F.max(direct.cast("int")).over(w), "_n_fit": F.count(F.lit(1)).over(w)})
    return seen.where(direct | (F.col("_direct") == 0) & (F.col("_n_fit") == 1)).select("file_id", "ordinal", "stored", "physical")


def offset_map(observed: DataFrame, cap: int = MAX_SEGMENTS) -> DataFrame:
    """Segments (file_id, seg, original_start, original_end, delta, support) of a piecewise map from stored to physical offsets.

    Of equal stored offsets the first physical counts; observations that go back are left out (the kept
    ones rise strictly, so the last kept is the running maximum); runs of one delta are segments; files
    with more than `cap` have no map.
    """
    once = observed.groupBy("file_id", "stored").agg(F.min("physical").alias("physical"))
    w = Window.partitionBy("file_id").orderBy("stored")
    back = F.max("physical").over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = once.withColumn("_b", back).where(F.col("_b").isNull() | (F.col("physical") > F.col("_b")))
    kept = kept.withColumn("delta", F.col("physical") - F.col("stored"))
    new = (F.lag("delta").over(w).isNull() | (F.lag("delta").over(w) != F.col("delta"))).cast("int")
    runs = kept.withColumn("_new", new).withColumn("seg", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seg = runs.groupBy("file_id", "seg", "delta").agg(F.min("stored").alias("original_start"), F.max("stored").alias("original_end"), F.count(F.lit(1)).alias("support"))
    of_file = Window.partitionBy("file_id")
    seg = seg.withColumn("_n", F.max("seg").over(of_file)).where(F.col("_n") <= cap)
    # the outer bounds are open
    seg = seg.withColumn("original_start", F.when(F.col("seg") == 1, F.lit(0).cast("long")).otherwise(F.col("original_start")))
    return seg.withColumn("original_end", F.when(F.col("seg") == F.col("_n"), F.lit((1 << 63) - 1)).otherwise(F.col("original_end"))).select("file_id", F.col("seg").cast("int").alias("seg"), "original_start", "original_end", "delta", "support")


def mapped(central: DataFrame, segments: DataFrame, local: DataFrame) -> DataFrame:
    """central with `physical_offset`: through the map if the header there has the record's name, else its own offset if one does, else null."""
    c = central.join(segments.withColumnRenamed("file_id", "_f"), (F.col("file_id") == F.col("_f")) & F.col("local_header_offset").between(F.col("original_start"), F.col("original_end")), "left").drop("_f")
    c = c.withColumn("_to", F.expr("try_add(local_header_offset, delta)"))
    for target, found in (("_to", "_at"), ("local_header_offset", "_own")):
        heads = local.select(F.col("file_id").alias("_f"), F.col("local_header_offset").alias(found), F.col("raw_name").alias("_name"))
        c = c.join(heads, (F.col("file_id") == F.col("_f")) & (F.col(target) == F.col(found)) & (F.col("raw_name") == F.col("_name")), "left").drop("_f", "_name")
    return c.withColumn("physical_offset", F.coalesce("_at", "_own")).select(*central.columns, "physical_offset")


def gaps(ranges: DataFrame, ends: DataFrame) -> DataFrame:
    """(file_id, unaccounted): whether bytes before the directory belong to no payload (file_id, start, end); ends has file_id and limit."""
    w = Window.partitionBy("file_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    hole = F.col("start") - F.coalesce(F.max("end").over(w), F.lit(0)) >= GAP_BYTES
    seen = ranges.withColumn("_hole", hole).groupBy("file_id").agg(F.bool_or("_hole").alias("_hole"), F.max("end").alias("_end"))
    return ends.join(seen, "file_id", "left").select("file_id", (F.coalesce("_hole", F.lit(False)) | (F.col("limit") - F.coalesce("_end", F.lit(0)) >= GAP_BYTES)).alias("unaccounted"))


def conflicts(central: DataFrame, local: DataFrame) -> DataFrame:
    """(file_id, ordinal, field, central_value, local_value) where a record and its header disagree; sizes of streamed headers are no conflict."""
    heads = local.select(F.col("file_id").alias("_f"), F.col("local_header_offset").alias("_at"), *[F.col(x).alias(f"l_{x}") for x in ("crc32", "compressed_size", "method", "flags")])
    both = central.join(heads, (F.col("file_id") == F.col("_f")) & (F.col("local_header_offset") == F.col("_at"))).drop("_f")
    streamed = F.col("l_flags").bitwiseAND(8) != 0
    rows = both.select("file_id", "ordinal", streamed.alias("_s"), F.expr("stack(3, 'crc32', crc32, l_crc32, 'compressed_size', compressed_size, l_compressed_size, 'method', CAST(method AS BIGINT), CAST(l_method AS BIGINT)) AS (field, central_value, local_value)"))
    known = (F.col("field") == "method") | ~F.col("_s") & (F.col("local_value") != 0)
    return rows.where((F.col("central_value") != F.col("local_value")) & known).drop("_s")


def reconcile(central: DataFrame, local: DataFrame) -> DataFrame:
    """central and the local headers that no record explains: kept if they lie in no claimed payload.

    A header is the same as a record at its offset. Ranges claimed by the directory reject scanned headers
    that they overlap: of the claims that begin before a header's end, the one that reaches farthest tells (a running
    maximum). Scanned headers then claim in order, a fold of one file, for files in which any two of them overlap.
    """
    heads = local.select(F.col("file_id").alias("_f"), F.col("local_header_offset").alias("_at"), F.col("data_offset").alias("_data"))
    claimed = central.join(heads, (F.col("file_id") == F.col("_f")) & (F.col("local_header_offset") == F.col("_at")))
    claimed = claimed.select("file_id", F.col("local_header_offset").alias("_key"), (F.col("_data") + F.col("compressed_size")).alias("_claim"))
    lost = local.join(central.select("file_id", "local_header_offset").distinct(), ["file_id", "local_header_offset"], "left_anti").select(*local.columns)
    to = F.coalesce(F.col("data_offset") + F.col("compressed_size"), F.col("local_header_offset") + 30)
    lost = lost.withColumns({"_from": F.col("local_header_offset"), "_to": to, "_key": to, "_lost": F.lit(True)})
    rows = lost.unionByName(claimed.withColumn("_lost", F.lit(False)), allowMissingColumns=True)
    # a claim that begins where a header ends does not overlap it, so the header comes first
    of_file = Window.partitionBy("file_id")
    reach = F.max("_claim").over(of_file.orderBy("_key", F.desc("_lost")).rowsBetween(Window.unboundedPreceding, 0))
    free = rows.withColumn("_reach", reach).where(F.col("_lost") & (F.col("_reach").isNull() | (F.col("_reach") <= F.col("_from"))))
    before = F.max("_to").over(of_file.orderBy("_from", "name").rowsBetween(Window.unboundedPreceding, -1))
    free = free.withColumn("_meets", F.coalesce(before > F.col("_from"), F.lit(False))).withColumn("_fold", F.max("_meets").over(of_file))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        keep, end = [], None
        pdf = pdf.sort_values(["_from", "name"])
        for at, to in zip(pdf["_from"], pdf["_to"], strict=True):
            ok = end is None or end <= at
            keep.append(ok)
            if ok:
                end = to
        return pdf[keep].drop(columns=["_from", "_to"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in local.schema)
    folded = free.where("_fold").select(*local.columns, "_from", "_to").groupBy("file_id").applyInPandas(fold, types)
    return central.unionByName(free.where("NOT _fold").select(*local.columns)).unionByName(folded)


def surviving_directories(files: DataFrame) -> DataFrame:
    """(file_id, chain, records, delta, proven) of each chain of directory records in a file; proven if all its headers are found at one common delta."""

    def rows(r):
        data = r.content or b""
        names: dict[bytes, int] = {}
        for e in b.scan_local(data):
            names.setdefault(e.name, e.offset)
        for n, chain in enumerate(b.surviving_chains(data)):
            deltas = {names[e.name] - e.offset for e in chain if e.name in names}
            found = sum(e.name in names for e in chain)
            one = len(deltas) == 1
            yield n, len(chain), deltas.pop() if one else None, one and found == len(chain)

    return _per_file(files, "file_id string, chain int, records int, delta long, proven boolean", rows)


def the_surviving(chains: DataFrame) -> DataFrame:
    """The one proven chain of each file that has exactly one."""
    return chains.where("proven").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("file_id"))).where("_n = 1").drop("_n")


def containers(files: DataFrame) -> DataFrame:
    """(file_id, base, end, cd_start, eocd, records) of archives stored inside an archive: each end record whose directory and headers fit one base."""
    return _per_file(files, "file_id string, base long, end long, cd_start long, eocd long, records int", lambda r: zipview.embedded(r.content or b""))


VIEW = "file_id string, declared int, from_directory int, from_scan int, directory string, shift long, segments int, moved int, nested int, rejected int, complete boolean, limits array<string>"


def views(files: DataFrame, limits: zipview.Limits = zipview.Limits()) -> DataFrame:  # noqa: B008
    """How each archive's entries were found: directory, map of shifts, embedded archives, scan, limits reached."""

    def rows(r):
        v = zipview.view(r.content or b"", limits)
        yield v.declared, v.from_directory, len(v.entries) - v.from_directory, v.directory, v.shift, v.segments, v.moved, v.nested, v.rejected, v.complete, list(v.limits)

    return _per_file(files, VIEW, rows)


def owners(points: DataFrame, held: DataFrame, keys: tuple[str, ...] = ("file_id", "offset")) -> DataFrame:
    """points (file_id, offset) with the base of the innermost container that holds each; null outside all."""
    inside = points.join(held.select("file_id", "base", F.col("end").alias("_end")), "file_id").where((F.col("base") <= F.col("offset")) & (F.col("offset") < F.col("_end")))
    inner = inside.groupBy(*keys).agg(F.max("base").alias("owner"))
    return points.join(inner, [*keys], "left")


def extracted(files: DataFrame, limits: zipview.Limits = zipview.Limits()) -> DataFrame:  # noqa: B008
    """(file_id, ordinal, name, status, crc_expected, crc_actual, size, bytes, source) of each entry, of the directory's and those that only the scan tells of."""
    schema = "file_id string, ordinal int, name string, name_valid_utf8 boolean, status string, crc_expected long, crc_actual long, size long, bytes binary, source string"

    def rows(r):
        data = r.content or b""
        for n, (e, where, source) in enumerate(zipview.view(data, limits).entries):
            status, body, crc = ("BAD_LOCAL_HEADER", None, None) if where is None and not e.flags & 0x41 else b.extract_zip(data, e, where)
            yield n, e.name.decode("utf-8", "replace"), _utf8(e.name), status, e.crc32, crc, e.size, body, source

    return _per_file(files, schema, rows)


def export(parts: DataFrame, provenance: str = "provenance") -> DataFrame:
    """parts with `path` and `skipped` (null: exported): the filters in order, then the byte budget, first come first fit."""
    path = exprs.safe_path(F.col("name"))
    first = F.row_number().over(Window.partitionBy("file_id", F.lower("_path")).orderBy("ordinal")) == 1
    attested = F.coalesce(F.col(provenance).isin(*TRUSTED_PROVENANCE), F.lit(False)) if provenance in parts.columns else F.lit(True)
    n = F.coalesce(F.length("bytes"), F.lit(0))
    rows = parts.withColumn("_path", path).withColumn("_first", first)
    why = (
        F.when(~F.col("name_valid_utf8"), "name is not UTF-8")
        .when(F.col("name").endswith("/"), "directory")
        .when(F.col("_path").isNull(), "unsafe path")
        .when(~F.col("_first"), "duplicate path")
        .when(n > EXPORT_ENTRY_BYTES, "too large")
        .when(F.col("status") != "VERIFIED_CRC", F.lower("status"))
        .when(~attested & (n == 0), "unattested empty entry")
        .when(~attested, "unattested")
    )
    rows = rows.withColumn("skipped", why).withColumnRenamed("_path", "path").drop("_first")
    # First come, first fit: a part that does not fit takes nothing of the budget, so this is a fold over one file's parts, not a prefix sum.
    fitting = rows.where("skipped IS NULL").groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", n.cast("long").alias("n")))).alias("p"))
    fold = f"aggregate(p, named_struct('t', 0L, 'k', CAST(array() AS array<int>)), (a, x) -> CASE WHEN a.t + x.n <= {EXPORT_BYTES} THEN named_struct('t', a.t + x.n, 'k', array_append(a.k, x.ordinal)) ELSE a END, a -> a.k)"
    fits = fitting.select(F.col("file_id").alias("_f"), F.explode(F.expr(fold)).alias("_o"))
    rows = rows.join(fits, (F.col("file_id") == F.col("_f")) & (F.col("ordinal") == F.col("_o")), "left")
    return rows.withColumn("skipped", F.when(F.col("skipped").isNull() & F.col("_o").isNull(), "over budget").otherwise(F.col("skipped"))).drop("_f", "_o")
