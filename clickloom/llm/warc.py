"""WARC archives without repeated payloads: revisit resolution by payload digest.

Headers alone are shuffled by digest: the smallest page id of a digest is its original, all others become revisits that
refer to it. The decisions, narrow rows, are joined to the payloads by page id, which is even however often a payload occurs, and
records with fresh headers are written as gzip-compressed text files, each a valid stream of WARC records. A written archive
is read with Spark's binary reader and parsed as a stream; a revisit's headers carry its original's id, page, digest and payload length.

Defined results. A null payload is empty. Of rows that repeat a page id and payload the first is the original, the others revisit it. A null
page id comes after all others. Line breaks and spaces in a URL are percent-encoded. An empty table writes no record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir

DATE = "2024-01-01T00:00:00Z"
BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32(digest: Column) -> Column:
    """Upper-case base32 of a SHA-1: four groups of 40 bits are eight digits each."""
    groups = [F.lpad(F.conv(F.substring(F.hex(digest), 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), BASE32_DIGITS, BASE32_LETTERS)


def sha1(text: Column) -> Column:
    return F.unhex(F.sha1(F.coalesce(text, F.lit("")).cast("binary")))


def decide(pages: DataFrame) -> DataFrame:
    """<page_id, digest, origin> of the payloads of <page_id, html> that occur again: headers only, one row per page and payload.

    Dealt by page, so that a payload with very many pages is spread again after its digest has been resolved.
    """
    headers = pages.select("page_id", sha1(F.col("html")).alias("digest"))
    origin = headers.groupBy("digest").agg(F.min("page_id").alias("origin"), F.count("*").alias("copies"))
    again = headers.join(origin.where("copies > 1").drop("copies"), "digest").repartition("page_id")
    return again.groupBy("page_id", "digest").agg(F.first("origin").alias("origin"))


def records(pages: DataFrame, http: str = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n") -> DataFrame:
    """One column, record: a WARC record per row of <page_id, url, html>, revisits without their payload."""
    body = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    decisions = decide(pages).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "origin")
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (sha1(F.col("html")) == F.col("_digest"))
    joined = body.join(decisions, same, "left").withColumn("digest", base32(F.coalesce("_digest", sha1(F.col("html")))))
    turn = F.row_number().over(Window.partitionBy("page_id", "_digest").orderBy("url"))
    joined = joined.withColumn("turn", F.when(F.col("_digest").isNotNull(), turn).otherwise(1))
    joined = joined.withColumn("again", F.col("_digest").isNotNull() & (~F.col("page_id").eqNullSafe(F.col("origin")) | (F.col("turn") > 1)))

    again, digest = F.col("again"), F.col("digest")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    h = F.md5(F.concat_ws("|", page, digest, F.col("turn").cast("string")))
    own = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    url = F.col("url")
    for char, code in (("\r", "%0D"), ("\n", "%0A"), (" ", "%20")):
        url = F.replace(url, F.lit(char), F.lit(code))

    def line(name: str, *value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), *value, F.lit(CRLF))

    # A payload has one response, which its digest names; a revisit has an id of its own.
    response_id = F.concat(F.lit("<urn:sha1:"), digest, F.lit(">"))
    refers = F.concat(
        line("WARC-Refers-To", response_id),
        F.coalesce(line("X-Refers-To-Page-Id", F.col("origin").cast("string")), F.lit("")),
        line("X-Payload-Length", F.octet_length("html").cast("string")),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
    )
    length = F.octet_length(F.lit(http)) + F.when(again, 0).otherwise(F.octet_length("html"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.when(again, F.concat(F.lit("<urn:uuid:"), own, F.lit(">"))).otherwise(response_id)),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.lit("sha1:"), digest),
        F.coalesce(line("X-Page-Id", F.col("page_id").cast("string")), F.lit("")),
        F.when(again, refers).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(CRLF + http),
    )
    # The writer ends each record with a line feed: the last byte of the two line ends that close it.
    return joined.select(F.concat(head, F.when(again, F.lit("")).otherwise(F.col("html")), F.lit("\r\n\r")).alias("record"))


def write_archives(pages: DataFrame, path: str) -> None:
    records(pages).write.option("compression", "gzip").option("lineSep", "\n").text(path)


def _parsed(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a stream."""
    data = b""
    for chunk in chunks:
        data += chunk
        at = 0
        while (end := data.find(b"\r\n\r\n", at)) >= 0:
            head = dict(x.split(": ", 1) for x in data[at:end].decode().split(CRLF)[1:])
            stop = end + 4 + int(head["Content-Length"])
            if len(data) < stop + 4:
                break
            yield head, data[end + 4 : stop]
            at = stop + 4
        data = data[at:]
    if data:
        raise ValueError("the archive ends within a record")


def _unzipped(content: memoryview, step: int = 1 << 20) -> Iterator[bytes]:
    """The text of one or more gzip members."""
    stream = zlib.decompressobj(31)
    for k in range(0, len(content), step):
        part = bytes(content[k : k + step])
        while part:
            yield stream.decompress(part)
            part = stream.unused_data
            if stream.eof:
                stream = zlib.decompressobj(31)


FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_id string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """FIELDS of each record: of a response its payload's size and digest are computed, of a revisit its headers say those of the original."""

    def fields(head: dict[str, str], block: bytes) -> tuple:
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        number = lambda name: int(head[name]) if name in head else None
        if head["WARC-Type"] == "response":
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        else:
            size, digest = number("X-Payload-Length"), head["WARC-Payload-Digest"].removeprefix("sha1:")
        return number("X-Page-Id"), size, digest, head["WARC-Type"], number("X-Refers-To-Page-Id"), head["WARC-Record-ID"], head.get("WARC-Refers-To")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FIELDS.split(", ")]
        types = [pa.int64() if x.endswith("long") else pa.string() for x in FIELDS.split(", ")]
        for batch in batches:
            for content in batch.column("content"):
                rows = [fields(*x) for x in _parsed(_unzipped(memoryview(content.as_buffer())))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(work, FIELDS)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/llm-archives-{uuid.uuid4().hex}"
