"""Content-addressed WARC archive.

An archive is two tables. ``payloads`` holds each distinct payload once, under its SHA-256 and
length; ``records`` holds every record's exact header block and the address of its payload. A
record's original bytes are header, payload and the closing blank lines, joined by address. Reading
checks every stored payload against its digest and fails on a mismatch.

Of the records with one payload (from ``least`` bytes on) that with the smallest id is the
``response``; the others are ``revisit`` records that refer to it. Copies are folded by a partial
aggregation before anything is shuffled, and the join that gives records their response is on
narrow rows of two written tables, which Spark can split where one payload is very frequent.

Defined results: a null payload is an empty one, and empty payloads are payloads like others; a
null URL gives an empty target; control characters in a URL are percent-encoded, so no URL can end
a header line; a null id is larger than any other and is never referred to unless it stands alone;
equal rows are records of their own, and of several rows with the smallest id each is a response.
An empty table gives an empty archive. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import shared_folder

_BASE32HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32: four groups of forty bits, eight signs each."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*groups), _BASE32HEX, _BASE32)


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _target(url: Column) -> Column:
    """Control characters and spaces would break a header line."""
    clean = F.coalesce(url, F.lit(""))
    for code in (*range(0x21), 0x7F):
        clean = F.replace(clean, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return clean


def _header(kind: Column, first: Column) -> Column:
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF + CRLF))
    is_revisit = kind == "revisit"
    block = F.length(http) + F.when(is_revisit, F.lit(0)).otherwise(F.col("n_bytes"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind,
        F.lit(f"{CRLF}WARC-Record-ID: "), _urn(F.col("page_id")),
        F.lit(f"{CRLF}WARC-Target-URI: "), F.col("target"),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(is_revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), _urn(first))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), block.cast("string"),
        F.lit(CRLF + CRLF), http,
    )


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Archive ``pages`` (``page_id, url, html``) under ``path``."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    facts = pages.select("page_id", "url", payload.alias("payload")).withColumn("address", F.sha2("payload", 256))
    stored = facts.groupBy("address").agg(F.first("payload").alias("payload"), F.min("page_id").alias("first_id"))
    stored.select("address", F.octet_length("payload").cast("long").alias("n_bytes"), base32_sha1(F.col("payload")).alias("sha1"), "first_id", "payload").write.parquet(f"{path}/payloads")
    known = pages.sparkSession.read.parquet(f"{path}/payloads").select("address", "n_bytes", "sha1", "first_id")
    is_first = F.col("page_id").eqNullSafe(F.col("first_id")) | (F.col("n_bytes") < least)
    kind = F.when(is_first, "response").otherwise("revisit")
    (
        facts.select("page_id", "address", _target(F.col("url")).alias("target"))
        .join(known, "address")
        .select("page_id", "address", _header(kind, F.col("first_id")).alias("header"))
        .write.parquet(f"{path}/records")
    )


def _verified(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads, with digests computed anew; a payload that is not what its address says is an error."""
    stored = spark.read.parquet(f"{path}/payloads").select("address", "payload", "n_bytes")
    same = (F.sha2("payload", 256) == F.col("address")) & (F.octet_length("payload") == F.col("n_bytes"))
    checked = F.when(same, F.col("address")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its address "), F.col("address"))))
    return stored.select(checked.alias("address"), "payload")


def _field(name: str) -> Column:
    return F.regexp_extract("header", rf"(?:^|\r\n){name}: ([^\r]*)\r\n", 1)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record as its header and payload say; the stated digest must be the payload's."""
    records = spark.read.parquet(f"{path}/records")
    found = _verified(spark, path).select("address", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    stated = F.substring(_field("WARC-Payload-Digest"), 6, 32)
    digest = F.when(stated == F.col("payload_digest"), stated).otherwise(F.raise_error(F.concat(F.lit("record and payload differ: "), stated)))
    number = lambda name: F.nullif(F.regexp_extract(_field(name), "<urn:page:(.*)>", 1), F.lit("")).try_cast("long")
    return records.join(found, "address").select(
        number("WARC-Record-ID").alias("page_id"),
        "payload_bytes",
        digest.alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        _field("WARC-Target-URI").alias("target_uri"),
    )


def originals(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, record``: the exact bytes of each record; a revisit has no payload of its own."""
    end = F.lit(CRLF + CRLF).cast("binary")
    empty = F.lit("").cast("binary")
    body = F.when(_field("WARC-Type") == "response", F.col("payload")).otherwise(empty)
    return spark.read.parquet(f"{path}/records").join(_verified(spark, path), "address").select(
        "page_id", F.concat(F.col("header").cast("binary"), body, end).alias("record")
    )


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write an archive to the shared folder and read it back."""
    path = shared_folder(pages.sparkSession, "warc")
    write(pages, path, least)
    return read(pages.sparkSession, path)
