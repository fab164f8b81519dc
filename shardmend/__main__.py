"""Command line: PATH [--output DIR] [--files DIR] [--manifest FILE] [--strategy NAME] [--aggressive] [--sign-key HEX]. Prints a line for each file; exit code 0 for whole files, 1 for damage, 2 for errors."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.scratch import written
from .operators import recover
from .plans import triage
from .sources import files as sources


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="shardmend", description="Triage and repair of damaged container files.")
    parser.add_argument("path")
    parser.add_argument("--output", help="folder of the repaired files' table (output_path, content, report)")
    parser.add_argument("--files", help="folder of the repaired files themselves, <name>.recovered with a manifest beside each")
    parser.add_argument("--manifest", help="text file of hashes and names")
    parser.add_argument("--strategy", help="this strategy alone, for every file")
    parser.add_argument("--aggressive", action="store_true", help="all strategies that apply, not the first three")
    parser.add_argument("--sign-key", help="32 bytes in hex, to sign the manifests with")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("shardmend").getOrCreate()
    files = sources.whole_files(spark, args.path)
    manifest = None
    if args.manifest:
        lines = spark.read.text(args.manifest).withColumn("line_no", F.monotonically_increasing_id())
        manifest = sources.manifest(lines)
    report = written(triage.analyze(files.select("file_id", "path", "name", "content", "error"), manifest), "report")
    columns = ["path", "engine_format", "agreement", "findings", "worst_severity", "overall", "class", "error"]
    print("\t".join(columns))
    for row in report.select(*columns).orderBy("path").toLocalIterator():  # partition by partition
        print("\t".join("" if v is None else str(v) for v in row))
    damaged, failed = report.agg(F.coalesce(F.sum("findings"), F.lit(0)), F.count_if(F.col("error").isNotNull())).first()
    if args.output or args.files:
        readable = files.where("error IS NULL").select("file_id", "path", "name", "content")
        done = written(triage.recover_files(readable, manifest, None if args.aggressive else recover.PASSES, args.strategy).where("success"), "recovered")
        named = done.join(files.select("file_id", "path"), "file_id")
        if args.output:
            sources.write_repaired(named.select(sources.output_path(F.col("path"), args.output).alias("output_path"), F.col("output").alias("content"), "strategy", "guarantee", "verified"), args.output)
        if args.files:
            signed = recover.manifest_json(done, readable, bytes.fromhex(args.sign_key) if args.sign_key else None)
            # the sidecar holds the signed text as it was signed, and what it takes to check it
            sidecar = F.to_json(F.struct("manifest", "digest", "signature", "public_key", "key_id"))
            told = named.join(signed.select("file_id", sidecar.alias("manifest")), "file_id")
            sources.write_files(told.select(sources.output_path(F.col("path"), args.files).alias("output_path"), F.col("output").alias("content"), "manifest"))
    return 2 if failed else int(damaged > 0)


if __name__ == "__main__":
    sys.exit(main())
