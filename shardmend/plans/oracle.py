"""The SQL twins of the queries, for an engine that knows nothing of archives: what the round trips must give, and the relational steps written out."""

from __future__ import annotations

from ..functions import dims

_TEXT = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"


def _values(rows: list[tuple]) -> str:
    def lit(v) -> str:
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else repr(v)

    return ", ".join(f"({', '.join(map(lit, r))})" for r in rows)


_RULES = f"""(SELECT * FROM (VALUES {_values([(n, r[0], r[1], r[2], r[3], r[4], r[5], *r[7:11], r[12]) for n, r in enumerate(dims.rules())])})
    t(n, rule_id, category, severity, severity_rank, field, evidence_type, hits_structural, hits_data, hits_metadata, points, confidence))"""
_FINDINGS = f"""SELECT l_orderkey AS file_id, l_linenumber AS seq, l_suppkey * 10 AS start, l_suppkey * 10 + CAST(l_quantity AS BIGINT) AS "end", r.*
    FROM lineitem JOIN {_RULES} r ON r.n = l_partkey % 117"""
_ORDERS = """SELECT o_orderkey AS file_id, ['zip', 'tar', 'gzip', 'raw'][o_orderkey % 4 + 1] AS engine_format, o_orderkey % 9000 AS total_size,
    o_orderkey % 3 = 0 AS manifest_present, o_orderkey % 4 = 0 AS embedded, o_orderkey % 11 = 0 AS capped FROM orders"""
# Which findings a strategy is for.
_APPLIES = {
    "bitflip": "manifest_present AND category = 'BitFlip'",
    "tar-terminator-append": "engine_format = 'tar' AND (rule_id = 'TAR_TERM_001' OR category = 'Truncation')",
    "tar-checksum-fix": "engine_format = 'tar' AND rule_id = 'TAR_UST_001'",
    "gz-magic-restore": "engine_format = 'gzip' AND rule_id = 'GZ_MAGIC_001'",
    "sevenz-signature-restore": "engine_format = 'seven_z' AND rule_id = '7Z_MAGIC_001'",
    "gz-member-salvage": "engine_format = 'gzip'",
    "gz-trailer-recompute": "engine_format = 'gzip' AND rule_id IN ('GZ_ICRC_001', 'GZ_ISIZE_001')",
    "zip-rebuild": "engine_format = 'zip' AND (category = 'StructuralCorruption' OR regexp_matches(rule_id, '^ZIP_(CD|EOCD|LFH)_'))",
    "tar-reorder": "engine_format = 'tar' AND category = 'BlockReorder'",
    "tar-size-resync": "engine_format = 'tar' AND (rule_id IN ('TAR_SIZE_001', 'TAR_UST_001') OR category = 'StructuralCorruption')",
    "zip-crc-fix": "engine_format = 'zip' AND rule_id = 'ZIP_CRC_001'",
    "iso-sector": "engine_format = 'iso9660' AND category = 'MissingData'",
    "tar-continuation-salvage": "engine_format = 'tar'",
    "gz-partial-inflate": "engine_format = 'gzip' AND category = 'Truncation'",
    "partial-extract": "category = 'Truncation'",
    "forensic-carve": "engine_format = 'raw' AND severity = 'Catastrophic'",
}
_PLAN = " UNION ALL ".join(f"SELECT DISTINCT file_id, '{s}' AS strategy, {p} AS priority, '{r}' AS risk, {n} AS n FROM j WHERE {_APPLIES[s]}" for n, (s, p, _, r, _) in enumerate(dims.STRATEGIES))

_CHANCE = f"""WITH f AS ({_FINDINGS}), o AS ({_ORDERS}),
    g AS (SELECT f.file_id, count(*) AS n,
            bool_and(category = 'BitFlip') AS flips, bool_and(rule_id = 'TAR_UST_001') AS tarsum,
            bool_or(rule_id IN ('ZIP_CD_001', 'ZIP_TRUNC_004')) AS zip_gone,
            bool_or(rule_id LIKE 'PDF\\_%' ESCAPE '\\') AND NOT bool_or(rule_id = 'PDF_HDR_001') AS pdf,
            bool_or(rule_id = 'SQ_WAL_001') AS wal,
            (bool_or(suffix(rule_id, '_MAGIC_001')) AND NOT bool_or(rule_id = 'GZ_MAGIC_001')) OR bool_or(rule_id = 'PDF_HDR_001') AS sig,
            bool_or(rule_id = 'SQ_PGSIZE_001') AS pgsize,
            bool_or(category = 'Truncation' AND "end" > 0 AND "end" < floor(total_size * 0.10) AND total_size > 0) AS head_cut,
            bool_or(rule_id IN ('ZIP_TRUNC_004', 'TAR_TRUNC_003')) AS head_rule,
            count(*) FILTER (category = 'MissingData') AS missing,
            bool_or(category = 'StructuralCorruption' AND severity = 'Catastrophic') AS cata,
            bool_or(rule_id IN ('ZIP_EOCD_001', 'ZIP_EOCD_002', 'ZIP_EOCD_003')) AS eocd, bool_or(rule_id = 'ZIP_CD_001') AS cd,
            bool_or(category = 'SecurityThreat') AS threat, sum("end" - start) AS damaged
          FROM f JOIN o ON f.file_id = o.file_id GROUP BY f.file_id),
    p AS (SELECT o.*, g.* EXCLUDE (file_id),
            0.5::DOUBLE + CASE WHEN flips THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN tarsum THEN 0.25::DOUBLE ELSE 0 END
            + CASE WHEN engine_format = 'zip' AND NOT zip_gone THEN 0.20::DOUBLE ELSE 0 END + CASE WHEN pdf THEN 0.10::DOUBLE ELSE 0 END
            + CASE WHEN wal THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN manifest_present THEN 0.18::DOUBLE ELSE 0 END
            + CASE WHEN embedded THEN 0.08::DOUBLE ELSE 0 END
            + CASE WHEN total_size > 0 AND damaged > 0 AND damaged::DOUBLE / nullif(total_size, 0) < 0.01 THEN 0.12::DOUBLE ELSE 0 END
            + CASE WHEN sig THEN -0.60::DOUBLE ELSE 0 END + CASE WHEN pgsize THEN -0.55::DOUBLE ELSE 0 END
            + CASE WHEN head_cut OR head_rule THEN -0.45::DOUBLE ELSE 0 END + CASE WHEN missing > 0 THEN -0.28::DOUBLE * missing ELSE 0 END
            + CASE WHEN cata AND NOT (engine_format = 'zip' AND eocd AND NOT cd) THEN -0.45::DOUBLE ELSE 0 END
            + CASE WHEN NOT manifest_present AND NOT embedded THEN -0.12::DOUBLE ELSE 0 END AS raw
          FROM o LEFT JOIN g ON o.file_id = g.file_id),
    q AS (SELECT *, CASE WHEN n IS NULL THEN 1.0::DOUBLE WHEN threat THEN 0.0::DOUBLE
            WHEN sig OR pgsize OR head_rule THEN greatest(0, least(raw, 0.10::DOUBLE)) ELSE greatest(0.15::DOUBLE, least(raw, 1.0::DOUBLE)) END AS probability FROM p),
    c AS (SELECT *, CASE WHEN probability >= 0.75 THEN 'High' WHEN probability >= 0.40 THEN 'Medium' WHEN probability >= 0.15 THEN 'Low' ELSE 'None' END AS class FROM q)"""

_SPECIMENS = [(n, s[0], s[4]) for n, s in enumerate(dims.SIGNATURES[:19])]
_NAMED = [(0, "zip", "zip"), (1, "tar", "tar"), (2, "gzip", "gzip"), (3, "zip", None), (4, None, None), (5, "vhd", None), (6, None, None)]
_READABLE = ", ".join(f"'{f}'" for f in dims.ENGINE_FORMATS)

SQL: dict[str, str] = {
    "zip_roundtrip": f"SELECT doc_id, 'VERIFIED_CRC' AS status, octet_length(encode(text)) AS n_bytes, sha256(text) AS sha256 FROM {_TEXT}",
    "tar_roundtrip": f"SELECT doc_id, 'Verified' AS kind, octet_length(encode(text)) AS n_bytes, sha256(text) AS sha256 FROM {_TEXT}",
    "tar_members": f"SELECT doc_id, octet_length(encode(text)) AS size, FALSE AS is_link FROM {_TEXT}",
    "zip_members": f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id // 64 ORDER BY doc_id) - 1 AS INTEGER) AS ordinal, octet_length(encode(text)) AS size, FALSE AS encrypted FROM {_TEXT}",
    "gzip_salvage": f"SELECT doc_id, octet_length(encode(text)) AS verified_bytes, CAST(1 AS BIGINT) AS verified_members FROM {_TEXT} WHERE doc_id % 5 <> 0 "
    f"UNION ALL SELECT doc_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM {_TEXT} WHERE doc_id % 5 = 0 AND text <> ''",
    "identify_formats": f"""WITH d AS (SELECT d.doc_id, s.f AS by_content, s.p AS provenance, n.f AS by_name, n.e FROM documents d
            LEFT JOIN (VALUES {_values(_SPECIMENS)}) s(k, f, p) ON d.doc_id % 20 = s.k LEFT JOIN (VALUES {_values(_NAMED)}) n(k, f, e) ON d.doc_id % 7 = n.k)
        SELECT doc_id, by_content, by_name, provenance,
            CASE WHEN by_content = by_name THEN 'Match' WHEN by_content IS NOT NULL AND by_name IS NOT NULL THEN 'Mismatch'
                 WHEN by_content IS NOT NULL THEN 'ContentOnly' WHEN by_name IS NOT NULL THEN 'NameOnly' ELSE 'Unknown' END AS agreement,
            coalesce(by_content, by_name) AS best_effort,
            coalesce(CASE WHEN by_content IN ({_READABLE}) THEN by_content END, e, 'raw') AS engine_format FROM d""",
    "identify_anchored": """SELECT doc_id, ['vhd', 'dmg', 'macrium_x', 'tar', 'iso9660', NULL][doc_id % 6 + 1] AS by_content, ['documented', 'documented', 'documented', 'measured', 'measured', NULL][doc_id % 6 + 1] AS provenance,
            CASE WHEN doc_id % 6 = 5 THEN 'Unknown' ELSE 'ContentOnly' END AS agreement, ['raw', 'raw', 'raw', 'tar', 'iso9660', 'raw'][doc_id % 6 + 1] AS engine_format FROM documents""",
    "block_hashes": f"""WITH d AS (SELECT doc_id, encode(text) AS b, octet_length(encode(text)) AS n FROM {_TEXT} WHERE text <> ''),
            k AS (SELECT doc_id, b, n, unnest(range(0, (n - 1) // 1024 + 1)) AS block_index FROM d)
        SELECT doc_id, block_index, block_index * 1024 AS "offset", least(1024, n - block_index * 1024) AS length,
            sha256(unhex(substring(hex(b), block_index * 2048 + 1, 2048))) AS actual FROM k""",
    "manifest_compare": f"""SELECT doc_id, doc_id % 5 <> 0 AS manifest_present, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS matches,
            CASE WHEN doc_id % 5 = 0 THEN 'unknown' WHEN doc_id % 7 = 0 THEN 'mismatch' ELSE 'verified' END AS status FROM {_TEXT}""",
    "classify_findings": f"""WITH f AS ({_FINDINGS})
        SELECT rule_id, category, severity, confidence, count(*) AS n,
            min(rule_id || ': ' || field || ' at offset 0x' || CASE WHEN start = 0 THEN '0' ELSE printf('%X', start) END || ' (confidence ' || CAST(CAST(round(confidence * 100) AS INTEGER) AS VARCHAR) || '%)') AS first_description
        FROM f WHERE confidence >= 0.5 GROUP BY ALL""",
    "health_scores": f"""WITH f AS ({_FINDINGS}),
            h AS (SELECT file_id, CAST(greatest(0, 100 - sum(points * hits_structural)) AS INTEGER) AS structural, CAST(greatest(0, 100 - sum(points * hits_data)) AS INTEGER) AS data,
                CAST(greatest(0, 100 - sum(points * hits_metadata)) AS INTEGER) AS metadata FROM f GROUP BY file_id),
            o AS (SELECT *, CAST((structural * 4 + data * 4 + metadata * 2 + 5) // 10 AS INTEGER) AS overall FROM h)
        SELECT *, CASE WHEN overall >= 100 THEN 'Intact' WHEN overall >= 80 THEN 'Minor' WHEN overall >= 50 THEN 'Degraded' WHEN overall >= 20 THEN 'Severe' ELSE 'Destroyed' END AS band FROM o""",
    "recoverability_scores": f"""{_CHANCE} SELECT file_id, round(probability, 9) AS probability, class,
            CASE WHEN n IS NULL OR threat THEN 1.0::DOUBLE WHEN capped THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM c""",
    "evidence_breakdown": f"""{_CHANCE}, b AS (SELECT f.file_id, CASE WHEN c.class = 'None' AND severity = 'Catastrophic' THEN 'none'
                WHEN evidence_type IN ('ChecksumMismatch', 'SignatureMismatch') AND f.confidence >= 0.90 THEN 'strong' WHEN f.confidence >= 0.70 THEN 'medium' ELSE 'weak' END AS band
            FROM f JOIN c ON f.file_id = c.file_id)
        SELECT file_id, count(*) FILTER (band = 'strong') AS strong, count(*) FILTER (band = 'medium') AS medium, count(*) FILTER (band = 'weak') AS weak, count(*) FILTER (band = 'none') AS "none" FROM b GROUP BY file_id""",
    "worst_severity": f"WITH f AS ({_FINDINGS}) SELECT file_id, arg_max(severity, severity_rank) AS worst_severity, count(*) AS findings FROM f GROUP BY file_id",
    "merge_bitflips": """WITH r AS (SELECT l_suppkey * 1000 + l_orderkey % 1000 AS file_id, l_orderkey * 10 + l_linenumber AS seq, l_partkey * 20 AS s, l_partkey * 20 + CAST(l_quantity AS BIGINT) * 40 AS e FROM lineitem),
            w AS (SELECT *, max(e) OVER (PARTITION BY file_id ORDER BY s, e, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r),
            i AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY s, e, seq ROWS UNBOUNDED PRECEDING) AS island FROM w)
        SELECT file_id, min(s) AS start, max(e) AS "end", 'Minor' AS severity, count(*) AS merged FROM i GROUP BY file_id, island""",
    "noisy_or": """SELECT l_orderkey, l_linenumber, round(greatest(0.0, least(1.0, 1 - (1 - l_discount) * (1 - l_tax) * (1 - l_quantity / 100))), 9) AS confidence,
            round(least(1.0::DOUBLE, 0.85::DOUBLE + 0.05::DOUBLE * greatest(l_linenumber - 1, 0)), 9) AS flip,
            CASE WHEN l_partkey > l_suppkey * 20 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS oob FROM lineitem""",
    "offset_segments": """WITH o AS (SELECT o_custkey AS file_id, o_orderkey AS s, min(o_orderkey + o_orderkey // 20000 * 100 - CASE WHEN o_orderkey % 17 = 0 THEN 5000 ELSE 0 END) AS p FROM orders GROUP BY 1, 2),
            k AS (SELECT *, max(p) OVER (PARTITION BY file_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM o),
            d AS (SELECT file_id, s, p - s AS delta FROM k WHERE b IS NULL OR p > b),
            n AS (SELECT *, CASE WHEN delta IS NOT DISTINCT FROM lag(delta) OVER (PARTITION BY file_id ORDER BY s) THEN 0 ELSE 1 END AS new FROM d),
            g AS (SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS seg FROM n),
            m AS (SELECT file_id, seg, delta, min(s) AS a, max(s) AS z, count(*) AS support FROM g GROUP BY ALL),
            t AS (SELECT *, max(seg) OVER (PARTITION BY file_id) AS top FROM m)
        SELECT file_id, CAST(seg AS INTEGER) AS seg, CASE WHEN seg = 1 THEN 0 ELSE a END AS original_start, CASE WHEN seg = top THEN 9223372036854775807 ELSE z END AS original_end, CAST(delta AS BIGINT) AS delta, support FROM t WHERE top <= 4""",
    "container_owner": """WITH p AS (SELECT o_custkey AS file_id, o_orderkey + 300 AS "offset", o_orderkey AS point FROM orders),
            h AS (SELECT o_custkey AS file_id, o_orderkey AS base, o_orderkey + 500 + o_orderkey % 7000 AS e FROM orders)
        SELECT p.file_id, p."offset", p.point, max(h.base) AS owner FROM p LEFT JOIN h ON h.file_id = p.file_id AND h.base <= p."offset" AND p."offset" < h.e GROUP BY ALL""",
    "range_lookup": """WITH o AS (SELECT o_custkey % 10 AS k, o_orderkey AS s, o_orderkey + 50 + o_custkey % 200 AS e FROM orders),
            p AS (SELECT DISTINCT l_suppkey % 10 AS k, l_orderkey AS point FROM lineitem)
        SELECT p.k, p.point, count(*) AS n, max(o.s) AS nearest FROM p JOIN o ON o.k = p.k AND p.point >= o.s AND p.point < o.e GROUP BY ALL""",
    "payload_gaps": """WITH r AS (SELECT l_orderkey AS file_id, l_linenumber * 50 - 50 AS s, l_linenumber * 50 - 50 + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
            w AS (SELECT *, s - coalesce(max(e) OVER (PARTITION BY file_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 30 AS hole FROM r),
            g AS (SELECT file_id, bool_or(hole) AS hole, max(e) AS e FROM w GROUP BY file_id)
        SELECT o_orderkey AS file_id, coalesce(hole, FALSE) OR o_orderkey % 400 - coalesce(e, 0) >= 30 AS unaccounted FROM orders LEFT JOIN g ON file_id = o_orderkey""",
    "zip_damage_extract": f"SELECT doc_id, NOT (doc_id % 10 = 3 AND text <> '') AS verified, CASE WHEN NOT (doc_id % 10 = 3 AND text <> '') THEN sha256(text) END AS sha256 FROM {_TEXT}",
    "zip_damage_findings": f"""WITH f AS (SELECT DISTINCT doc_id // 64 AS file_id FROM documents)
        SELECT file_id, rule_id, CAST(1 AS BIGINT) AS n FROM f, (VALUES ('ZIP_EOCD_001'), ('ZIP_CD_001')) r(rule_id) WHERE file_id % 3 = 0
        UNION ALL SELECT doc_id // 64, 'ZIP_CRC_001', count(*) FROM {_TEXT} WHERE doc_id // 64 % 3 <> 0 AND doc_id % 10 = 3 AND text <> '' GROUP BY 1""",
    "zip_lost_headers": f"SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 'local' ELSE 'central' END AS source, octet_length(encode(text)) AS size FROM {_TEXT}",
    "zip_conflicts": f"SELECT doc_id // 64 AS file_id, 'crc32' AS field, count(*) AS n FROM {_TEXT} WHERE doc_id % 9 = 0 AND text <> '' GROUP BY 1",
    "zip_shifted_map": "SELECT doc_id // 64 AS file_id, count(*) AS records, count(*) AS found FROM documents GROUP BY 1",
    "export_members": f"""WITH p AS (SELECT doc_id, text, doc_id % 8 AS k FROM {_TEXT}),
            r AS (SELECT *, CASE WHEN k IN (0, 2) THEN NULL WHEN k = 1 THEN 'Same/Name.txt' WHEN k = 3 THEN 'dir' ELSE 'a/b/c' || doc_id END AS path FROM p),
            n AS (SELECT *, row_number() OVER (PARTITION BY doc_id // 100, lower(path) ORDER BY doc_id) AS r FROM r),
            s AS (SELECT *, CASE WHEN k = 3 THEN 'directory' WHEN path IS NULL THEN 'unsafe path' WHEN r > 1 THEN 'duplicate path' WHEN doc_id % 13 = 0 THEN 'crc_mismatch' END AS skipped FROM n)
        SELECT doc_id, CASE WHEN skipped IS NULL THEN path END AS path, skipped FROM s""",
    "reference_rules": f"""WITH d AS (SELECT doc_id, 15 + octet_length(encode(CASE WHEN length(text) < 40 THEN rpad(text, 40, 'x') ELSE text END)) AS n FROM {_TEXT})
        SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'GEN_TRUNC_001' WHEN 1 THEN 'GEN_STRUCT_001' WHEN 2 THEN 'GEN_FLIP_001' ELSE 'GEN_MISSING_001' END AS rule_id,
            CASE doc_id % 5 WHEN 0 THEN 20 WHEN 1 THEN n WHEN 2 THEN 4 ELSE 3 END AS start FROM d WHERE doc_id % 5 < 4""",
    "tar_recovery": f"""WITH m AS (SELECT doc_id // 64 AS file_id, sum(512 + (octet_length(encode(text)) + 511) // 512 * 512) + 1024 AS n FROM {_TEXT} GROUP BY 1)
        SELECT file_id, 'tar-terminator-append' AS strategy, TRUE AS success, file_id % 2 = 0 AS verified, CASE WHEN file_id % 2 = 0 THEN 'Verified' ELSE 'Unverified' END AS guarantee, CAST(n AS BIGINT) AS n_bytes FROM m WHERE file_id % 3 <> 0""",
    "evidence_gate": """WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey % 2 AS vk, l_orderkey % 2 AS sk, CAST(CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE 16 * (l_linenumber % 3) END AS INTEGER) AS evidence_bits, l_quantity AS e FROM lineitem),
            x AS (SELECT *, CASE WHEN vk = sk AND 20 < CAST(e AS BIGINT) THEN 'tautological verifier' WHEN evidence_bits = 0 THEN 'no independent verifier' END AS error FROM e)
        SELECT l_orderkey, l_linenumber, evidence_bits, error, evidence_bits > 0 AND error IS NULL AS can_emit, evidence_bits >= 32 AND error IS NULL AS raises_health, '2^-' || evidence_bits AS false_accept_bound FROM x""",
    "carve_pieces": f"""WITH d AS (SELECT doc_id, octet_length(encode(text)) AS n FROM {_TEXT})
        SELECT doc_id, CAST(0 AS BIGINT) AS "offset", 5 + n // 2 AS "end" FROM d UNION ALL SELECT doc_id, 5 + n // 2, 11 + n FROM d UNION ALL SELECT doc_id, 11 + n, 15 + n FROM d""",
    "first_rule": f"WITH f AS ({_FINDINGS}) SELECT file_id, rule_id, start FROM f QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY start, seq, rule_id) = 1",
    "strategy_plan": f"""WITH f AS ({_FINDINGS}), o AS ({_ORDERS}), j AS (SELECT * FROM f JOIN o USING (file_id)), p AS ({_PLAN})
        SELECT file_id, CAST(row_number() OVER w AS INTEGER) AS pass, strategy, priority, risk FROM p WINDOW w AS (PARTITION BY file_id ORDER BY priority DESC, n) QUALIFY row_number() OVER w <= 3""",
    "triage_report": f"""WITH z AS (SELECT doc_id // 64 AS file_id, count(*) FILTER (doc_id % 10 = 3 AND text <> '') AS hurt FROM {_TEXT} GROUP BY 1),
            e AS (SELECT file_id, unnest(CASE WHEN file_id % 3 = 0 THEN ['ZIP_EOCD_001', 'ZIP_CD_001'] ELSE list_transform(range(hurt), lambda x: 'ZIP_CRC_001') END) AS rule_id FROM z),
            f AS (SELECT file_id, r.* FROM e JOIN {_RULES} r USING (rule_id)),
            h AS (SELECT file_id, arg_max(severity, severity_rank) AS worst_severity, greatest(0, 100 - sum(points * hits_structural)) AS s, greatest(0, 100 - sum(points * hits_data)) AS d, greatest(0, 100 - sum(points * hits_metadata)) AS m FROM f GROUP BY file_id)
        SELECT file_id, CASE WHEN TRUE THEN 'zip' END AS by_content, 'zip' AS engine_format, 'Match' AS agreement, worst_severity, coalesce(CAST((s * 4 + d * 4 + m * 2 + 5) // 10 AS INTEGER), 100) AS overall FROM z LEFT JOIN h USING (file_id)""",
    "zip_half_directory": f"""WITH b AS (SELECT doc_id // 64 AS k, min(doc_id) AS first FROM documents WHERE doc_id % 16 = 5 GROUP BY 1)
        SELECT doc_id, CASE WHEN first IS NULL OR doc_id < first THEN 'directory' ELSE 'scan' END AS source, TRUE AS verified, sha256(text) AS sha256 FROM {_TEXT} t LEFT JOIN b ON k = doc_id // 64""",
    "format_damage": """SELECT doc_id, ['SQ_TRUNC_001', 'ISO_PVD_001', '7Z_CRC_001', 'PDF_EOF_001', 'GZ_ISIZE_001', 'BZ2_MAGIC_001', 'XZ_MAGIC_001', 'ZST_MAGIC_001', 'LZ4_MAGIC_001', 'TAR_UST_001'][doc_id % 10 + 1] AS rule_id
        FROM documents WHERE doc_id % 3 = 0
        UNION ALL SELECT doc_id, 'SQ_PGSIZE_002' FROM documents WHERE doc_id % 30 = 0""",
    "strategy_outputs": f"""SELECT doc_id, ['gz-magic-restore', 'gz-member-salvage', 'gz-trailer-recompute', 'zip-rebuild', 'zip-crc-fix', 'tar-terminator-append', 'tar-checksum-fix', 'tar-size-resync', 'tar-continuation-salvage'][doc_id % 9 + 1] AS strategy,
        CASE WHEN doc_id % 9 = 7 THEN sha256(encode(text) || unhex(repeat('00', (512 - octet_length(encode(text)) % 512) % 512))) ELSE sha256(text) END AS sha256 FROM {_TEXT}""",
}
