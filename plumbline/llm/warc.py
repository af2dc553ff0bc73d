"""A content-addressed web archive: payloads stored once, record headers apart, records rebuilt by joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import saved

CRLF = "\r\n"
#: Digits of conv(..., 32) and of RFC 4648 base 32, in order.
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@dataclass(frozen=True)
class Archive:
    """headers: page_id, row, digest, header (bytes of the record before its payload). payloads: digest, payload."""

    headers: DataFrame
    payloads: DataFrame


def base32(hex_digest: Column) -> Column:
    """Upper-case base 32 of a hexadecimal digest of a multiple of 40 bits, without padding."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, at, 10), 16, 32), 8, "0") for at in range(1, 41, 10)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


def _line(name: str, value: Column) -> Column:
    """One header line; nothing if the value is null. Line breaks inside a value would end it, so they are encoded."""
    clean = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def _record_id(page_id: Column, row: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))


def write_archive(
    pages: DataFrame,
    date: str = "1970-01-01T00:00:00Z",
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    least_bytes: int = 0,
) -> Archive:
    """Write one WARC record per page into a content-addressed archive in the shared folder.

    The payload is the text in UTF-8 (null: empty). Its SHA-256 is the address; two payloads of one address
    with other SHA-1 or length raise an error. Of records with equal payloads of at least ``least_bytes``, the
    one with the largest page id is the response, the others revisit it; of rows that share that id too,
    the last. A null id is below all others. Payloads are reduced to one per address in each task before
    they are shuffled, so a page copied many times costs no more than one. A null url leaves its header
    line out; other columns are ignored; an empty table gives an empty archive.
    """
    payload = F.coalesce(F.col(html_column), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload")
    )
    listed = saved(
        rows.select(
            "page_id", "url",
            F.sha2("payload", 256).alias("digest"),
            base32(F.sha1("payload")).alias("sha1"),
            F.length("payload").cast("long").alias("bytes"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "warc-listing",
    )
    last = listed.groupBy("digest").agg(
        F.max(F.struct("page_id", "row")).alias("last"),
        F.min("sha1").alias("low"), F.max("sha1").alias("high"), F.min("bytes").alias("least"), F.max("bytes").alias("most"),
    )
    clash = (F.col("low") != F.col("high")) | (F.col("least") != F.col("most"))
    records = listed.join(last, "digest").withColumn(
        "revisit",
        F.when(clash, F.raise_error(F.concat(F.lit("two payloads have the digest "), F.col("digest"))).cast("boolean"))
        .otherwise((F.col("bytes") >= least_bytes) & (F.col("row") != F.col("last.row"))),
    )
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("bytes").cast("string"), F.lit(CRLF + CRLF),
    )
    size = F.length(http) + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("bytes"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("row"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Profile", F.when(F.col("revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("WARC-Refers-To", F.when(F.col("revisit"), _record_id(F.col("last.page_id"), F.col("last.row")))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", size.cast("string")),
        F.lit(CRLF), http,
    )
    headers = saved(records.select("page_id", "row", "digest", header.cast("binary").alias("header")), "warc-headers")
    stored = rows.select(F.sha2("payload", 256).alias("digest"), "payload").groupBy("digest").agg(F.first("payload").alias("payload"))
    return Archive(headers, saved(stored, "warc-payloads"))


def read_archive(archive: Archive) -> DataFrame:
    """Rebuild every record by joining headers with payloads, parse it and verify it.

    The stored payload's own digests are taken afresh where it is read; a record whose header names another
    digest or length raises an error. Columns: page_id, row, record_type, refers_to, payload_digest,
    payload_bytes, payload, and record, the exact bytes (a revisit has no payload in it).
    """
    stored = archive.payloads.select(
        "digest", "payload",
        base32(F.sha1("payload")).alias("payload_digest"),
        F.length("payload").cast("long").alias("payload_bytes"),
        (F.sha2("payload", 256) == F.col("digest")).alias("intact"),
    )
    text = F.col("header").cast("string")
    field = lambda name, pattern: F.regexp_extract(text, rf"\r\n{name}: {pattern}\r\n", 1)
    parsed = archive.headers.select(
        "row", "digest", "header",
        field("WARC-Type", r"(\w+)").alias("record_type"),
        F.nullif(field("WARC-Record-ID", r"<urn:page:(-?\d*):\d+>"), F.lit("")).cast("long").alias("page_id"),
        F.nullif(field("WARC-Refers-To", r"<urn:page:(-?\d*):\d+>"), F.lit("")).cast("long").alias("refers_to"),
        field("WARC-Payload-Digest", r"sha1:(\w+)").alias("named"),
        F.regexp_extract(text, r"\r\n\r\nHTTP/(?s:.*?)\r\nContent-Length: (\d+)\r\n\r\n$", 1).cast("long").alias("named_bytes"),
    )
    sound = F.col("intact") & (F.col("named") == F.col("payload_digest")) & (F.col("named_bytes") == F.col("payload_bytes"))
    return parsed.join(stored, "digest", "left").select(
        "page_id", "row", "record_type", "refers_to",
        F.when(F.coalesce(sound, F.lit(False)), F.col("payload_digest"))
        .otherwise(F.raise_error(F.concat(F.lit("damaged record of row "), F.col("row").cast("string"))).cast("string"))
        .alias("payload_digest"),
        "payload_bytes", "payload",
        F.concat("header", F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b"")), F.lit(CRLF * 2).cast("binary")).alias("record"),
    )
