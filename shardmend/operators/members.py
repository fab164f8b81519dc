"""Member inventories: one table function for each format over whole-file rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions import bytesio as b
from ..functions import zipview
from ..functions.scratch import bounded_batches

SCHEMA = "file_id string, ordinal int, path string, raw_name binary, size long, compressed_size long, offset long, encrypted boolean, stored_crc32 long, is_link boolean, link_target string"


def _name(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def members_of(fmt: str, name: str, data: bytes) -> Iterator[tuple]:
    """Rows of SCHEMA after file_id and ordinal."""
    if fmt == "zip":
        for e, _, _ in zipview.view(data).entries:
            yield _name(e.name), e.name, e.size, e.compressed, e.offset, bool(e.flags & 0x41), e.crc32, e.link, None
    elif fmt == "tar":
        for m in b.walk_tar(data)[0]:
            link = m.kind in (b"1", b"2")
            yield _name(m.name), m.name, m.size, m.size, m.data_offset, False, None, link, _name(m.link) if link else None
    elif fmt == "gzip":
        n = b.gzip_name(data)
        yield _name(n) if n else name.removesuffix(".gz"), n or b"", None, len(data), 0, False, int.from_bytes(data[-8:-4], "little") if len(data) >= 18 else None, False, None
    elif fmt == "iso9660":
        yield name, name.encode(), len(data), len(data), 0, False, None, False, None
    elif fmt == "rar":
        for r in b.rar5_blocks(data):
            if r.kind == 2:
                yield _name(r.name), r.name, r.size, r.packed, r.data_offset, False, r.crc32, False, None
    elif fmt != "sqlite":
        yield name, name.encode(), len(data), len(data), 0, False, None, False, None


def members(files: DataFrame) -> DataFrame:
    """Members of files (file_id, name, content, engine_format)."""
    return _per_file(files, SCHEMA, lambda r: [(n, *m) for n, m in enumerate(members_of(r.engine_format, r.name or "", r.content or b""))])


def _per_file(files: DataFrame, schema: str, rows_of: Callable, columns: tuple[str, ...] = ("file_id", "name", "content", "engine_format")) -> DataFrame:
    """Rows of a Python function of each file; its columns follow file_id."""
    bounded_batches(files.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r.file_id, *x) for r in pdf.itertuples(index=False) for x in rows_of(r)]
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return files.select(*columns).mapInPandas(run, schema)


def rar5_blocks(files: DataFrame) -> DataFrame:
    """Blocks of RAR5 archives, with whether a stored file's bytes verify."""
    schema = "file_id string, block_offset long, kind int, header_ok boolean, name string, packed long, size long, crc32 long, method int, data_offset long, stored_verified boolean"

    def rows(r):
        for k in b.rar5_blocks(r.content or b""):
            yield k.offset, k.kind, k.header_ok, None if k.name is None else _name(k.name), k.packed, k.size, k.crc32, k.method, k.data_offset, b.rar5_stored(r.content, k) is not None

    return _per_file(files, schema, rows)


def sevenz_headers(files: DataFrame) -> DataFrame:
    schema = "file_id string, magic_ok boolean, header_ok boolean, next_offset long, next_size long, next_inside boolean, next_ok boolean"
    return _per_file(files, schema, lambda r: [tuple(b.parse_sevenz(r.content or b""))])


def android_backups(files: DataFrame) -> DataFrame:
    return _per_file(files, "file_id string, status string, tar binary", lambda r: [b.android_backup(r.content or b"")])


def segments(files: DataFrame) -> DataFrame:
    """Salvaged stretches of TAR and gzip files, with their bytes."""
    schema = "file_id string, kind string, name string, source_offset long, source_end long, bytes binary"

    def rows(r):
        walk = b.salvage_tar if r.engine_format == "tar" else b.salvage_gzip
        return [(s.kind, _name(s.name), s.start, s.end, s.body) for s in walk(r.content or b"")]

    return _per_file(files, schema, rows)
