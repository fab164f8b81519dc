"""WARC writing and reading with segment reassembly.

The writer turns pages into archives: blobs of WARC/1.1 records of a bounded size, one row each of a
table in the shared folder (Spark's own committer makes the writing atomic under lost executors, and
any Hadoop file system will do). HTTP payloads are framed as chunked transfers; a block longer than
SEGMENT_BYTES is cut into continuation records. Equal payloads of at least MIN_REVISIT_BYTES are
written once, by the smallest page_id; other pages get revisit records.

The reader parses blobs, groups the records of a segmented one by origin identifier (a group is one
page, not a key of the data), orders them by segment number, verifies the total length and decodes
the chunked framing. A record that fails is returned with its `error`, never dropped.

Null html is an empty payload. A null page_id is kept (null) and never a revisit's target; rows that
repeat a page_id get records of their own, and those with the smallest page_id of a payload are all
responses.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

MIN_REVISIT_BYTES = 100
#: Bytes of a block in one record, of a chunk in the transfer framing, and of an archive (the last record may pass it).
SEGMENT_BYTES, CHUNK_BYTES, ARCHIVE_BYTES = 32 << 10, 8 << 10, 4 << 20
#: Digests (some 100 bytes each) up to which the list of repeated payloads is broadcast.
BROADCAST_ROWS = 300_000
#: Fixed stamp of records, so that repeated writes give equal archives.
DATE = "2024-01-01T00:00:00Z"
_CRLF = b"\r\n"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x\r\n" % len(part), part, _CRLF]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Payload of a chunked body. Raises ValueError where the framing is broken or cut short."""
    out, at = [], 0
    while True:
        end = body.find(_CRLF, at)
        if end < 0:
            raise ValueError("chunk size line missing")
        head = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", head):
            raise ValueError(f"chunk size {head[:20]!r}")
        n, at = int(head, 16), end + 2
        if n == 0:
            return b"".join(out)  # trailer fields may follow
        if body[at + n : at + n + 2] != _CRLF:
            raise ValueError("chunk is cut short")
        out.append(body[at : at + n])
        at += n + 2


def record(kind: str, rid: str, block: bytes, **headers) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", f"WARC-Date: {DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_records(page_id, serial: int, url: str | None, payload: bytes, digest: str, refers_to) -> Iterator[bytes]:
    """The records of one page; `serial` tells repeated page_ids apart."""
    rid = f"urn:page:{'' if page_id is None else page_id}:{serial}"
    uri = re.sub(r"[\s<>]", "", url or "") or "urn:none"
    common = {"WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha256:{digest}"}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload)
        yield record("revisit", rid, block, **common, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Refers_To=f"<urn:page:{refers_to}>", Content_Type="application/http; msgtype=response")
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    kind = {"Content_Type": "application/http; msgtype=response"}
    if len(block) <= SEGMENT_BYTES:
        yield record("response", rid, block, **common, **kind)
        return
    parts = [block[at : at + SEGMENT_BYTES] for at in range(0, len(block), SEGMENT_BYTES)]
    for n, part in enumerate(parts, 1):
        last = {"WARC_Segment_Total_Length": len(block)} if n == len(parts) else {}
        if n == 1:
            yield record("response", rid, part, **common, **kind, WARC_Segment_Number=1)
        else:
            yield record("continuation", f"{rid}:{n}", part, WARC_Target_URI=uri, WARC_Segment_Origin_ID=f"<{rid}>", WARC_Segment_Number=n, **last)


def parse(blob: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, whatever their order. Raises ValueError at broken framing."""
    at = 0
    while at < len(blob):
        end = blob.find(b"\r\n\r\n", at)
        if end < 0 or not blob.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        headers = {}
        for line in blob[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            headers[k.strip().lower()] = v.strip()
        n = int(headers["content-length"])
        block = blob[end + 4 : end + 4 + n]
        if len(block) < n:
            raise ValueError(f"record at byte {at} is cut short")
        yield headers, block
        at = end + 4 + n + 4


def first_pages(hashed: DataFrame) -> DataFrame:
    """digest -> smallest page_id, of payloads long enough that more than one row has. Combined before the shuffle, so a hot payload is one row a task."""
    return hashed.where(F.col("bytes") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null").select(F.col("digest").alias("first_digest"), "first_id")


def write_archives(pages: DataFrame) -> DataFrame:
    """Archives (archive binary) of pages, in the shared folder."""
    small_batches(pages.sparkSession)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    hashed = pages.select("page_id", "url", payload.alias("payload")).select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("bytes"))
    # Digests are joined with the few that repeat: a list short enough is broadcast, so that no html crosses the network; of a
    # longer one AQE splits a hot digest's partition.
    firsts = materialize(first_pages(hashed), "firsts")
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts.hint("merge")
    roles = hashed.join(firsts, (F.col("digest") == F.col("first_digest")) & (F.col("bytes") >= MIN_REVISIT_BYTES), "left")
    revisit = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")), F.col("first_id"))
    rows = roles.select("page_id", "url", "payload", "digest", revisit.alias("refers_to"), F.monotonically_increasing_id().alias("serial"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        size = 0
        for pdf in batches:
            done = []
            ids = [None if pd.isna(x) else int(x) for x in pdf.page_id]
            refs = [None if pd.isna(x) else int(x) for x in pdf.refers_to]
            for page_id, serial, url, body, digest, ref in zip(ids, pdf.serial, pdf.url, pdf.payload, pdf.digest, refs, strict=True):
                for r in page_records(page_id, serial, url, body, digest, ref):
                    held.append(r)
                    size += len(r)
                    if size >= ARCHIVE_BYTES:
                        done.append(b"".join(held))
                        held, size = [], 0
            if done:
                yield pd.DataFrame({"archive": done})
        if held:
            yield pd.DataFrame({"archive": [b"".join(held)]})

    return materialize(rows.mapInPandas(write, "archive binary"), "warc")


_FIELDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


def _finish(headers: dict, block: bytes, keep_payload: bool, total: int | None = None) -> tuple:
    """One page's row from its whole block."""
    page = headers.get("warc-record-id", "").strip("<>").split(":")[2:3]
    page_id = int(page[0]) if page and page[0] else None
    kind, stated = headers.get("warc-type"), headers.get("warc-payload-digest", "").removeprefix("sha256:") or None
    url, error, payload, refers, n = headers.get("warc-target-uri"), None, None, None, None
    try:
        if total is not None and total != len(block):
            raise ValueError(f"segments hold {len(block)} bytes, not {total}")
        head, _, body = block.partition(b"\r\n\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
        if kind == "revisit":
            refers = int(headers["warc-refers-to"].strip("<>").split(":")[2])
            n, digest = int(fields["content-length"]), stated
        else:
            payload = unchunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body
            n, digest = len(payload), hashlib.sha256(payload).hexdigest()
            if stated and stated != digest:
                raise ValueError("payload digest differs")
    except (ValueError, KeyError, IndexError) as e:
        error, digest = str(e), None
    return page_id, url, kind, refers, n, digest, payload if keep_payload else None, error


def read_archives(archives: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Rows of pages from archives; without payload bytes where only digests are wanted."""
    small_batches(archives.sparkSession)  # blobs of ARCHIVE_BYTES

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob in pdf.archive:
                whole, parts = [], []
                try:
                    for headers, block in parse(blob):
                        number, origin = headers.get("warc-segment-number"), headers.get("warc-segment-origin-id")
                        if number is None:
                            whole.append((*_finish(headers, block, keep_payload), None, None, None, None, None))
                        else:
                            total = headers.get("warc-segment-total-length")
                            parts.append((*[None] * 8, origin or headers["warc-record-id"], int(number), None if total is None else int(total), block, None if origin else "\n".join(f"{k}: {v}" for k, v in headers.items())))
                except (ValueError, KeyError) as e:
                    whole.append((*[None] * 7, f"archive: {e}", *[None] * 5))
                yield pd.DataFrame(whole + parts, columns=[*columns, "origin", "number", "total", "block", "headers"]).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64", "number": "Int64", "total": "Int64"})

    columns = [x.split()[0] for x in _FIELDS.split(", ")]
    rows = archives.mapInPandas(split, f"{_FIELDS}, origin string, number long, total long, block binary, headers string")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        """All segments of one record."""
        pdf = pdf.drop_duplicates("number").sort_values("number")
        first = pdf.headers.dropna()
        headers = dict(x.split(": ", 1) for x in first.iloc[0].split("\n")) if len(first) else {"warc-record-id": pdf.origin.iloc[0]}
        total = pdf.total.dropna()
        row = _finish(headers, b"".join(pdf.block), keep_payload, int(total.iloc[0]) if len(total) else -1)
        if [*pdf.number] != [*range(1, len(pdf) + 1)]:
            row = (*row[:-1], row[-1] or "a segment is missing")
        return pd.DataFrame([row], columns=columns).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    # Both sides read the archives (their parsing is cheap beside a shuffle of every payload); only segmented records are dealt by origin.
    whole = rows.where("origin is null").select(*columns)
    joined = rows.where("origin is not null").groupBy("origin").applyInPandas(join, _FIELDS)
    return whole.unionByName(joined)


def archive_digests(pages: DataFrame) -> DataFrame:
    """Write pages, read the archives back, and return each page's digest row. Raises where a record did not survive."""
    rows = read_archives(write_archives(pages), keep_payload=False)
    whole = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("archive: "), "error")).cast("long")).otherwise(F.col("payload_bytes"))
    return rows.select("page_id", whole.alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url")
