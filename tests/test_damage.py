"""Damage that the queries build must change what it is to change, whatever the text."""

import random

import pytest
from shardmend.functions import bytesio, scratch
from shardmend.operators import detect, recover, zipcore
from shardmend.plans import queries


@pytest.mark.parametrize("fmt", queries._BUILT)
def test_each_kind_of_damage_is_found_at_any_length(fmt):
    """A text of 255 bytes made the byte that was set to 255 in a 7z header what it was."""
    for n in (*range(260), 511, 767):
        assert list(detect.findings_of(fmt, queries._built(fmt, "x" * n, True)))
        assert not list(detect.findings_of(fmt, queries._built(fmt, "x" * n, False)))


def repeated(seed: int) -> str:
    r, words = random.Random(seed), "archive table river stone letter window morning paper green seven".split()
    lines = [" ".join(r.choice(words) for _ in range(r.randint(2, 6))) for _ in range(r.randint(2, 5))]
    return "\n".join(r.choice(lines) for _ in range(r.randint(10, 40)))


#: Of these texts the byte in the middle of the payload may change, and the text stays the same.
SILENT = {73: repeated(725), 83: repeated(9475), 93: repeated(21618)}


@pytest.fixture
def repeats(spark, tmp_path):
    spark.createDataFrame([*SILENT.items(), (74, "whole")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_a_changed_payload_is_never_the_same_text(spark, repeats):
    got = {r.doc_id: r.verified for r in queries.zip_damage_extract(spark, repeats).collect()}
    assert got == {73: False, 83: False, 93: False, 74: True}


def test_one_byte_changes(spark):
    for text in SILENT.values():
        data = bytesio.build_zip([("doc-3.txt", text.encode())])
        d = bytearray(data)
        queries._change(d, bytesio.parse_zip(data).local[0])
        assert sum(a != b for a, b in zip(data, d, strict=True)) == 1


def test_each_changed_payload_is_a_finding(spark, repeats):
    got = {(r.file_id, r.rule_id): r.n for r in queries.zip_damage_findings(spark, repeats).collect()}
    assert got == {(1, "ZIP_CRC_001"): 3}


def test_each_changed_payload_counts_in_the_report(spark, repeats, tmp_path):
    import duckdb
    from shardmend.plans.oracle import SQL

    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = con.execute(f"SELECT file_id, overall FROM ({SQL['triage_report']})").fetchall()
    assert [(r.file_id, r.overall) for r in queries.triage_report(spark, repeats).collect()] == want


@pytest.mark.parametrize("query", [queries._damaged_zips, queries._documents])
def test_files_are_built_in_bounded_batches(spark, repeats, query):
    """The first query of a session, too: a batch of 10,000 archives is all of a task's input."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(rows)
    spark.conf.unset(size)
    query(spark, repeats)
    assert (int(spark.conf.get(rows)), int(spark.conf.get(size))) == (scratch.BATCH_ROWS, scratch.BATCH_BYTES)


def test_archives_are_parsed_once_and_claims_join_no_rows(spark, repeats):
    """Every reading of the entries built, packed and parsed the archives again; each lost header carried all claims of its file."""
    for query in (queries.zip_lost_headers, queries.zip_conflicts, queries.zip_shifted_map):
        plan = query(spark, repeats)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInPandas" not in plan and "collect_list" not in plan


def test_reconcile_equals_a_fold_over_all_ranges(spark):
    """Random claims and headers, each pair compared."""
    r, central, local, want = random.Random(5), [], [], {}
    entry = lambda f, source, n, at, size: (f, source, n, at, at, b"n", f"n{n}", True, 0, 0, 1, size, size, at + 35 if source == "local" else None, False, False)
    for k in range(60):
        f, at, held = str(k), sorted(r.sample(range(0, 1200, 10), 12)), []
        for n, a in enumerate(at):
            size = r.choice((0, 5, 25, 65, 95))
            local.append(entry(f, "local", n, a, size))
            if r.random() < 0.5 and k % 7:
                central.append(entry(f, "central", n, a, size))
                held.append((a, a + 35 + size))
        kept = {c[4] for c in central if c[0] == f}
        for row in (x for x in local if x[0] == f and x[4] not in set(kept)):
            a, z = row[4], row[13] + row[11]
            if not any(p < z and a < q for p, q in held):
                held.append((a, z))
                kept.add(a)
        want[f] = sorted(kept)
    got = zipcore.reconcile(spark.createDataFrame(central, zipcore.ENTRY), spark.createDataFrame(local, zipcore.ENTRY))
    assert got.columns == [c.split()[0] for c in zipcore.ENTRY.split(", ")]
    found = {}
    for row in got.collect():
        found.setdefault(row.file_id, []).append(row.local_header_offset)
    assert {f: sorted(x) for f, x in found.items()} == want


def test_bytes_of_repairs_join_nothing(spark, repeats):
    plan = queries.strategy_outputs(spark, repeats)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_staged_of_a_long_list_joins_bytes_once_and_unsorted(spark, monkeypatch):
    whole = bytesio.build_tar([("a", b"text")])
    files = spark.createDataFrame([("1", "x.tar", whole[:-1024], "tar"), ("2", "x.gz", b"xx" + bytesio.build_gzip(b"text")[2:], "gzip"), ("3", "x", b"?", "raw")], "file_id string, name string, content binary, engine_format string")
    chosen = spark.createDataFrame([("1", "tar-terminator-append", 1, True), ("1", "tar-checksum-fix", 2, None), ("2", "gz-magic-restore", 1, False)], "file_id string, strategy string, pass int, terminal boolean")
    want = [("1", "tar-checksum-fix", None, False, 2, None), ("1", "tar-terminator-append", whole, True, 1, True), ("2", "gz-magic-restore", bytesio.build_gzip(b"text"), True, 1, False)]
    for bound in (recover.BROADCAST_ROWS, 0):
        monkeypatch.setattr(recover, "BROADCAST_ROWS", bound)
        df = recover.staged(files, chosen)
        assert sorted((r.file_id, r.strategy, r.staged and bytes(r.staged), r.did, r["pass"], r.terminal) for r in df.collect()) == want
        assert df.columns == ["file_id", "strategy", "staged", "did", "pass", "terminal"]
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ShuffledHashJoin") == 1 and "SortMergeJoin" not in plan
