import hashlib
import random

import pytest
from shardmend.llm import warc


def brute(rows):
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == body and p is not None]
        first = min(same, default=None)
        again = len(body) >= 100 and first is not None and page_id != first
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rng = random.Random(3)
    big = "".join(rng.choice("abé日\r\n ") for _ in range(70_000))
    rows = [(5, "http://a/ b", "x" * 100), (3, "http://a", "x" * 100), (9, None, "x" * 100), (3, "u", "x" * 100), (1, "u", "y" * 99), (2, "u", "y" * 99), (4, "u", None), (6, "u", ""), (7, "u", big), (8, "u", big), (None, "u", "x" * 100), (None, "u", "z" * 200), (10, "u", "WARC/1.1\r\n\r\n" + big)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.archive_digests(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    whole = warc.read_archives(warc.write_archives(pages)).collect()
    assert sorted((r.payload.decode() for r in whole if r.record_type == "response"), key=len)[-2:] == sorted((big, "WARC/1.1\r\n\r\n" + big), key=len)
    assert all(r.error is None for r in whole)
    assert warc.archive_digests(pages.limit(0)).count() == 0


def test_segments_in_any_order_and_damage(spark):
    body = ("segment " * 20_000).encode()
    recs = list(warc.page_records(7, 0, "http://a", body, hashlib.sha256(body).hexdigest(), None))
    assert len(recs) > 3
    frame = lambda *blobs: spark.createDataFrame([(bytearray(b),) for b in blobs], "archive binary")
    [row] = warc.read_archives(frame(b"".join(recs[2:]), b"".join(recs[1::-1]))).collect()
    assert (row.page_id, bytes(row.payload), row.error) == (7, body, None)
    [row] = warc.read_archives(frame(b"".join(recs[:1] + recs[2:]))).collect()
    assert row.page_id == 7 and row.error
    [row] = warc.read_archives(frame(b"".join(recs[:-1]))).collect()
    assert row.error
    [row] = warc.read_archives(frame(recs[0][:-400])).collect()
    assert row.error.startswith("archive:")


def test_chunked():
    for n in (0, 1, 8191, 8192, 20_000):
        assert warc.unchunked(warc.chunked(b"z" * n)) == b"z" * n
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"x\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)
