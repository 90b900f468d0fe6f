"""Content-addressed WARC archive.

An archive has two Parquet tables: ``payloads`` keeps the bytes of each distinct
payload once under its SHA-256, and ``headers`` keeps the exact header bytes of
every record with that digest.  ``read_records`` joins them and gives back each
WARC record byte for byte.

Digests are verified: equal SHA-256 must come with equal SHA-1 and equal length
when an archive is written, and when it is read the stored bytes must hash to
the digest they are stored under; otherwise the job fails.

Of rows with equal payloads of at least ``min_bytes`` bytes, the one with the
largest page_id is a response and the others revisit it; smaller payloads are
all responses.

Defined results: a null html is the empty payload, a null url an empty target;
rows that share the largest page_id and the payload are all responses; a null
page_id sorts below all others; other columns are ignored; an empty table gives
an empty archive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.llm.common import stored
from grove.session import new_work_path

CRLF = "\r\n"
DATE = "2000-01-01T00:00:00Z"  # pages carry no date; a parameter of ``write_archive``
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex (160 bits, no padding): 20 bits at a
    time, looked up in five-bit steps."""
    out = []
    for i in range(8):
        v = F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1
            out.append(F.substring(F.lit(_B32), at, F.lit(1)))
    return F.concat(*out)


@dataclass(frozen=True)
class Archive:
    """Folders of a written archive."""

    payloads: str
    headers: str


def _lines(*fields: tuple[str, Column]) -> Column:
    return F.concat(*(F.concat(F.lit(f"{k}: "), v, F.lit(CRLF)) for k, v in fields))


def record_id(page_id: Column, digest: Column) -> Column:
    """Derived from the row, so that a retried task writes the same."""
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"),
                    F.substring(digest, 1, 32), F.lit(">"))


def page_of(urn: Column) -> Column:
    return F.nullif(F.regexp_extract(urn, r"^<urn:x-page:(-?[0-9]+):", 1), F.lit("")).cast("long")


def field(head: Column, name: str) -> Column:
    """Value of a header field, null if absent."""
    found = F.regexp_extract(head, rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.nullif(found, F.lit(""))


def _clean(c: Column) -> Column:
    """Header values can't hold line ends; they are percent-encoded."""
    return F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write_archive(pages: DataFrame, path: str | None = None, min_bytes: int = 0, date: str = DATE) -> Archive:
    """Writes ``pages`` (page_id, url, html) as an archive."""
    base = path or new_work_path(pages.sparkSession, "warc")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    digest = F.sha2(payload, 256).alias("digest")
    # the bytes go once into their own table; every other step sees digests only
    pages.select(digest, payload.alias("payload")).dropDuplicates(["digest"]).write.parquet(f"{base}/payloads")
    rows = stored(pages.select(
        F.col("page_id").cast("long").alias("page_id"), _clean(F.coalesce(F.col("url").cast("string"), F.lit(""))).alias("url"),
        digest, F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("n_bytes")), "warc-rows")
    groups = rows.groupBy("digest").agg(
        F.max("page_id").alias("response"), F.min("sha1").alias("s1"), F.max("sha1").alias("s2"),
        F.min("n_bytes").alias("n1"), F.max("n_bytes").alias("n2"))
    same = (F.col("s1") == F.col("s2")) & (F.col("n1") == F.col("n2"))
    groups = groups.select("digest", "response", F.when(same, True).otherwise(
        F.raise_error(F.lit("two payloads share a SHA-256 digest"))).alias("verified"))

    heads = rows.join(groups, "digest").where("verified")
    revisit = (F.col("n_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("response"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("n_bytes").cast("string"), F.lit(CRLF + CRLF))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n_bytes"))
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(date)),
              ("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))),
              ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
              ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", length.cast("string"))]
    response = _lines(("WARC-Type", F.lit("response")), *common)
    other = _lines(("WARC-Type", F.lit("revisit")), *common,
                   ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                   ("WARC-Refers-To", record_id(F.col("response"), F.col("digest"))))
    head = F.concat(F.lit(f"WARC/1.1{CRLF}"), F.when(revisit, other).otherwise(response), F.lit(CRLF), http)
    heads.select("digest", head.cast("binary").alias("head")).write.parquet(f"{base}/headers")
    return Archive(f"{base}/payloads", f"{base}/headers")


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """Every record rebuilt: page_id, record_type, refers_to, payload_digest (as
    its headers say), payload (of a revisit: that of its response) and record
    (the exact bytes)."""
    stored_as = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(
        F.raise_error(F.lit("stored payload does not match its digest")).cast("binary"))
    payloads = spark.read.schema("digest string, payload binary").parquet(archive.payloads)
    heads = spark.read.schema("digest string, head binary").parquet(archive.headers)
    both = heads.join(payloads.select("digest", stored_as.alias("payload")), "digest")
    text = F.col("head").cast("string")
    kind = field(text, "WARC-Type")
    body = F.when(kind == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return both.select(
        page_of(field(text, "WARC-Record-ID")).alias("page_id"), kind.alias("record_type"),
        page_of(field(text, "WARC-Refers-To")).alias("refers_to"),
        F.substring(field(text, "WARC-Payload-Digest"), 6, 32).alias("payload_digest"), "payload",
        F.concat(F.col("head"), body, F.lit(CRLF + CRLF).cast("binary")).alias("record"))
