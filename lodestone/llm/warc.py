"""WARC archives through Spark's text writer and reader, payloads in chunk rows.

A record whose payload exceeds ``CHUNK`` bytes is written as a first segment and
continuation records, so no writer or reader ever holds more than a chunk of it beyond the
input's own row. The archive is written by Spark's text sink, hence to any file system that
Spark knows, each row one segment. A key drawn at write time opens every segment and is the
reader's record delimiter; a payload cannot hold it, and lengths are checked on reading.
Digests of chunked payloads are carried incrementally over chunk rows in order.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path

CHUNK = 1 << 20
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, from 40-bit pieces of its hex form."""
    x = F.sha1(data)
    part = lambda i: F.lpad(F.conv(F.substring(x, 1 + 10 * i, 10), 16, 32), 8, "0")
    return F.translate(F.upper(F.concat(*(part(i) for i in range(4)))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def chunk_table(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(record_id, chunk_no, chunks, data)`` rows of ``records(record_id, payload)``."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / chunk)).cast("int")
    rows = records.withColumn("chunks", n).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.withColumn("data", F.expr(f"substring(payload, chunk_no * {chunk} + 1, {chunk})")).drop("payload")


def digest_chunks(chunks: DataFrame) -> DataFrame:
    """``(record_id, payload_bytes, payload_digest)`` of ``(record_id, chunk_no, data)``: the
    rows of a record pass one task in order, which holds a hash state and one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, size = None, None, 0
        names = ["record_id", "payload_bytes", "payload_digest"]
        for b in batches:
            done = []
            for rid, data in zip(b.column("record_id").to_pylist(), b.column("data"), strict=True):
                if rid != now:
                    if now is not None:
                        done.append((now, size, base64.b32encode(state.digest()).decode()))
                    now, state, size = rid, hashlib.sha1(), 0  # noqa: S324  what WARC uses
                buffer = data.as_buffer()
                state.update(buffer)
                size += buffer.size
            yield pa.record_batch([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=names)
        if now is not None:
            yield pa.record_batch([[now], [size], [base64.b32encode(state.digest()).decode()]], names=names)

    rows = chunks.select("record_id", "chunk_no", "data").repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return rows.mapInArrow(run, "record_id string, payload_bytes long, payload_digest string")


def write_warc(pages: DataFrame, path: str, key: str, least: int = 0, chunk: int = CHUNK) -> None:
    """Write one response or revisit record per row of ``pages(page_id, url, html)``."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", base32_sha1(F.col("payload"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    again = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.count("*").alias("c"), F.max("page_id").alias("first_id")).where("c > 1 and first_id is not null").drop("c")
    rows = rows.join(materialize(again, "again"), ["digest", "bytes"], "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(), F.lit(False))
    rows = rows.withColumn("revisit", revisit).withColumn("payload", F.when(F.col("revisit"), F.lit("").cast("binary")).otherwise(F.col("payload")))
    rows = chunk_table(rows.withColumn("record_id", F.expr("uuid()")), chunk)
    first = F.col("chunk_no") == 0
    line = lambda name, value, when=None: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) if when is None else F.when(when, F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    text = lambda c: F.col(c).cast("string")
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A")
    block = F.octet_length("data") + F.when(first, len(HTTP)).otherwise(0)
    head = F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Archive-Key: {key}\r\n"),
        line("WARC-Type", F.when(~first, "continuation").when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.col("record_id"), F.when(first, "").otherwise(F.concat(F.lit("-"), text("chunk_no"))), F.lit(">"))),
        line("WARC-Segment-Number", (F.col("chunk_no") + 1).cast("string"), F.col("chunks") > 1),
        line("WARC-Segment-Count", text("chunks"), F.col("chunks") > 1),
        line("WARC-Segment-Origin-ID", F.concat(F.lit("<urn:uuid:"), F.col("record_id"), F.lit(">")), F.col("chunks") > 1),
        line("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", url),
        line("WARC-Page-ID", text("page_id"), F.col("page_id").isNotNull()),
        line("WARC-Profile", F.lit(PROFILE), F.col("revisit")),
        line("WARC-Refers-To-Page-ID", text("first_id"), F.col("revisit")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Payload-Length", text("bytes")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit("\r\n"),
    )
    body = F.concat(F.when(first, HTTP).otherwise(""), F.col("data").cast("string"))
    rows.select(F.concat(head, body).alias("value")).write.option("lineSep", END).text(path)


def read_segments(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Segments of an archive: header fields and the payload's part, lengths checked."""
    rows = spark.read.option("lineSep", f"WARC/1.1\r\nWARC-Archive-Key: {key}\r\n").text(path).where("value <> ''")
    rows = rows.withColumn("head", F.substring_index("value", END, 1)).withColumn("raw", F.col("value").cast("binary"))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)\r?$", 1), F.lit(""))
    rows = rows.select(
        field("WARC-Type").alias("warc_type"),
        F.regexp_extract("head", r"(?m)^WARC-Segment-Origin-ID: <urn:uuid:([^>]*)>", 1).alias("origin"),
        field("WARC-Segment-Number").cast("int").alias("number"),
        field("WARC-Page-ID").cast("long").alias("page_id"),
        field("WARC-Refers-To-Page-ID").cast("long").alias("refers_to"),
        field("WARC-Target-URI").alias("url"),
        field("WARC-Payload-Digest").alias("said_digest"),
        field("WARC-Payload-Length").cast("long").alias("said_bytes"),
        field("Content-Length").cast("int").alias("length"),
        F.octet_length("head").alias("h"),
        "raw",
    )
    short = F.octet_length("raw") < F.col("h") + len(END) + F.col("length")
    rows = rows.withColumn("length", F.when(short | F.col("length").isNull(), F.raise_error(F.lit("a WARC record is cut short")).cast("int")).otherwise(F.col("length")))
    skip = F.when(F.col("warc_type") == "continuation", 0).otherwise(len(HTTP))
    return rows.withColumn("skip", skip).withColumn("data", F.expr(f"substring(raw, h + {len(END)} + skip + 1, length - skip)")).drop("raw", "h", "skip", "length")


def warc_round_trip(pages: DataFrame, least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write ``pages(page_id, url, html, ...)`` as WARC, read it back and report per record
    ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``.

    A null html is an empty payload. Of equal payloads of at least ``least`` bytes the row
    with the largest page_id is a response, the others revisit it; rows that share that
    page_id are responses all, rows without an id revisit, and if no row has an id all are
    responses. Repeated rows are records of their own; further columns are ignored; an empty
    table gives an empty result. The archive lies in the shared folder until the driver's
    Python ends.
    """
    spark = pages.sparkSession
    path, key = scratch_path(spark, "warc"), uuid.uuid4().hex
    write_warc(pages, path, key, least, chunk)
    rows = read_segments(spark, path, key)
    kind = F.when(F.col("warc_type") == "revisit", "revisit").otherwise("response")
    again = F.col("warc_type") == "revisit"
    whole = rows.where("number is null").select(
        "page_id",
        F.when(again, F.col("said_bytes")).otherwise(F.octet_length("data").cast("long")).alias("payload_bytes"),
        F.when(again, F.expr("substring(said_digest, 6)")).otherwise(base32_sha1(F.col("data"))).alias("payload_digest"),
        kind.alias("record_type"),
        "refers_to",
    )
    parts = rows.where("number is not null")
    chunks = parts.select(F.concat_ws(" ", "origin", F.coalesce(F.col("page_id").cast("string"), F.lit("-"))).alias("record_id"), F.col("number").alias("chunk_no"), "data")
    long = digest_chunks(chunks).select(
        F.expr("try_cast(substring_index(record_id, ' ', -1) as long)").alias("page_id"), "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")
    )
    return whole.unionByName(long)
