"""WARC archives with revisit resolution.

Headers (id, payload digest, size) are shuffled by digest, an aggregation with map-side combine names the response
of each payload (the largest id), and headers that are not it become revisit records that refer to it. Records with
fresh headers are then written through Spark's text writer, whose line separator is the empty line that ends a
record, so archives appear in the shared folder with the committer's guarantees; a file holds at most records_per_file
records. Reading parses records by their Content-Length, one file a row, and a join brings each revisit its original.

Defined results: a null payload is the empty payload; empty payloads equal each other. Rows that share an id and a
payload are all responses if theirs is the largest id. A row without an id is a response of its own and is never
referred to. A null url writes no target header; line breaks in a url become spaces. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import scratch_path, ship

#: The digits of base32 and those of Spark's base-32 numbers.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_END = "\r\n"
_HTTP = f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}{_END}"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a string's bytes: 20 bits at a time."""
    digest = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), _DIGITS, _BASE32)


def record_id(page_id: Column) -> Column:
    """A name that follows from the page's id alone."""
    h = F.sha2(F.concat(F.lit("page:"), page_id.cast("string")), 256)
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)))


def resolve(pages: DataFrame, id_col: str, payload: str, at_least: int = 0) -> DataFrame:
    """Headers: id, payload_digest, payload_bytes, refers_to (null for responses); one row an id and payload."""
    body = F.coalesce(F.col(payload), F.lit(""))
    headers = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("page_id"), base32_sha1(body).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"))
    first = headers.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("response"))
    refers = F.when((F.col("payload_bytes") >= at_least) & (F.col("response") != F.col("page_id")), F.col("response"))
    return headers.distinct().join(first, ["payload_digest", "payload_bytes"]).select("page_id", "payload_digest", "payload_bytes", refers.alias("refers_to"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html", at_least: int = 0, date: str = "2026-01-01T00:00:00Z", records_per_file: int = 20_000) -> None:
    """Write deduplicated archives (gzip) below path."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("body"))
    known = resolve(pages, id_col, payload, at_least).select("page_id", "payload_digest", "refers_to")
    own = base32_sha1(F.col("body")).alias("digest")
    joined = rows.select("*", own).alias("r").join(known.alias("k"), F.expr("r.page_id = k.page_id and r.digest = k.payload_digest"), "left")
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(_HTTP), F.when(revisit, F.lit("")).otherwise(F.col("body")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_END))
    maybe = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    header = F.concat(
        F.lit(f"WARC/1.1{_END}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        maybe("WARC-Record-ID", F.concat(F.lit("<"), record_id(F.col("r.page_id")), F.lit(">"))),
        maybe("X-Page-ID", F.col("r.page_id").cast("string")),
        maybe("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        maybe("WARC-Refers-To", F.concat(F.lit("<"), record_id(F.col("refers_to")), F.lit(">"))),
        maybe("X-Refers-To-Page-ID", F.col("refers_to").cast("string")),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(_END),
    )
    out = joined.select(F.concat(header, block).alias("value"))
    out.write.option("lineSep", 2 * _END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse(archive: bytes):
    """Headers and block of each record of an archive."""
    at, end = 0, len(archive)
    while at < end:
        stop = archive.index(b"\r\n\r\n", at)
        lines = archive[at:stop].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record begins here")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        yield headers, archive[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records: page_id, url, record_type, payload_digest (from the header), refers_to, payload, and the payload's own digest and size."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("content")
    schema = "page_id long, url string, record_type string, header_digest string, refers_to long, payload binary, own_digest string, own_bytes long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                records, size = [], 0
                for h, block in parse(zlib.decompress(content.as_py(), 31)):
                    payload = block.partition(b"\r\n\r\n")[2]
                    number = lambda name: int(h[name]) if name in h else None  # noqa: B023, E731
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    records.append((number("x-page-id"), h.get("warc-target-uri"), h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:"), number("x-refers-to-page-id"), payload, digest, len(payload)))
                    size += len(payload)
                    if size > 8 << 20:
                        yield _batch(records, names)
                        records, size = [], 0
                if records:
                    yield _batch(records, names)

    return files.mapInArrow(run, schema)


def _batch(records, names):
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*records), kinds)], names=names)


def resolved(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes and payload_digest of the full payload, record_type, refers_to; revisits are joined to their originals."""
    slim = records.select("page_id", "record_type", "header_digest", "refers_to", "own_digest", "own_bytes")
    originals = slim.where("record_type = 'response'").select(F.col("page_id").alias("o_id"), F.col("own_digest").alias("o_digest"), F.col("own_bytes").alias("o_bytes")).distinct()
    joined = slim.join(originals, (F.col("refers_to") == F.col("o_id")) & (F.col("header_digest") == F.col("o_digest")), "left")
    is_revisit = F.col("record_type") == "revisit"
    return joined.select(
        "page_id", F.when(is_revisit, F.col("o_bytes")).otherwise(F.col("own_bytes")).alias("payload_bytes"),
        F.when(is_revisit, F.col("o_digest")).otherwise(F.col("own_digest")).alias("payload_digest"), "record_type", "refers_to",
    )


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write archives to a fresh place in the shared folder and read them back, resolved."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, **options)
    return resolved(read(pages.sparkSession, path))
