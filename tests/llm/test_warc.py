import base64
import hashlib

import pytest

from grove.llm import warc as W

ROWS = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "http://d/\r\nX: y", ""), (5, "http://e/", "é\U0001F600\n"),
        (2, "http://b2/", "same"), (7, "u", "x" * 300_000), (7, "u", "x" * 300_000), (None, "n", "same"), (None, "n2", "alone")]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "e", "e") for r in rows], "page_id long, url string, html string, digest string, payload string")


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_records(spark, min_bytes):
    got = W.read_records(spark, W.write_archive(pages(spark, ROWS), min_bytes=min_bytes)).collect()
    assert len(got) == len(ROWS)
    want = []
    for p, _, html in ROWS:
        same = [q for q, _, h in ROWS if (h or "") == (html or "") and q is not None]
        best = max(same, default=None)
        revisit = p != best and len((html or "").encode()) >= min_bytes
        want.append((p, "revisit" if revisit else "response", best if revisit else None, digest(html), (html or "").encode()))
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_digest, bytes(r.payload)) for r in got), key=str) == sorted(want, key=str)


def test_exact_bytes(spark):
    for r in W.read_records(spark, W.write_archive(pages(spark, ROWS))).collect():
        record = bytes(r.record)
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert record.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
        assert int(fields["Content-Length"]) == len(rest) - 4
        http, _, body = rest[:-4].partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK") and body == (b"" if r.record_type == "revisit" else bytes(r.payload))
        assert fields["WARC-Payload-Digest"] == "sha1:" + r.payload_digest


def test_payload_stored_once_and_verified(spark):
    a = W.write_archive(pages(spark, ROWS))
    stored = spark.read.parquet(a.payloads)
    assert stored.count() == len({h or "" for _, _, h in ROWS})
    bad = W.write_archive(pages(spark, [(1, "u", "other")]))
    mixed = spark.read.parquet(bad.payloads).selectExpr("digest", "cast('forged' as binary) as payload")
    mixed.write.parquet(bad.payloads + "-forged")
    with pytest.raises(Exception, match="does not match"):
        W.read_records(spark, W.Archive(bad.payloads + "-forged", bad.headers)).collect()


def test_empty(spark):
    a = W.write_archive(pages(spark, []))
    assert W.read_records(spark, a).count() == 0
