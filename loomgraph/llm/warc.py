"""WARC archives: writing with segments, revisits and chunked framing; reassembly.

Archives are written by Spark's text writer, so any store that Spark writes will do:
a row is a record (bytes, passed through as they are) and the line separator is the
blank line that ends a record.  Payloads over segment_bytes are split into a first
record and continuation records, and HTTP blocks carry chunked transfer framing.

Reading: files are parsed where they lie, by Content-Length; nothing in a payload can
be mistaken for a header.  Whole records are decoded at once, without a shuffle.
Segments alone are grouped by their origin, ordered by segment number, checked
against the total length and decoded.  Revisits find their response by a join on the
record id.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import fresh_path, written
from loomgraph.session import ship

#: Name space of record ids: a page's ids follow from its number.
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
CRLF = b"\r\n"
#: Bytes of records in an Arrow batch, about.
BATCH_BYTES = 8_000_000


@dataclass(frozen=True)
class Archive:
    """segment_bytes: of a block in one record. chunk_bytes: of transfer framing.
    records_per_file: bounds a file's size. min_bytes: smaller payloads never are revisits."""

    segment_bytes: int = 16_384
    chunk_bytes: int = 4_096
    records_per_file: int = 1_000
    min_bytes: int = 0
    date: str = "2024-01-31T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str, part: int = 0) -> str:
    """The id of a page's record (or of its part-th segment): pages that share an id but not a
    payload have records of their own, a null id has as well; repeated rows repeat theirs."""
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}/{digest}/{part}')}>"


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        line = body.index(CRLF, at)
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + size])
        at = line + 2 + size
        if len(out[-1]) != size or body[at : at + 2] != CRLF:
            raise ValueError("broken chunk")
        at += 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, _, body = block.partition(CRLF + CRLF)
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the blank line at its end, which the writer adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers).encode()
    return b"WARC/1.1\r\n" + head + b"Content-Length: %d\r\n\r\n" % len(block) + block


def page_records(page_id, url: str | None, payload: bytes, refers_to, how: Archive) -> Iterator[bytes]:
    """The records of a page: a revisit, a response, or a response and its continuations."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    digest = base32_sha1(payload)
    own = ("WARC-Record-ID", record_id(page_id, digest))
    common = [("WARC-Target-URI", target), ("WARC-Date", how.date), ("WARC-Payload-Digest", f"sha1:{digest}"), *([] if page_id is None else [("X-Page-Id", str(page_id))])]
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        more = [("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        yield _record([("WARC-Type", "revisit"), own, *common, *more, kind], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, how.chunk_bytes)
    parts = [block[i : i + how.segment_bytes] for i in range(0, len(block), how.segment_bytes)]
    first = [("WARC-Segment-Number", "1")] if len(parts) > 1 else []
    yield _record([("WARC-Type", "response"), own, *common, *first, kind], parts[0])
    for k, part in enumerate(parts[1:], 2):
        headers = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, digest, k)), ("WARC-Date", how.date), ("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", own[1]), ("WARC-Segment-Number", str(k))]
        if k == len(parts):
            headers.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record(headers, part)


def with_responses(pages: DataFrame, how: Archive) -> DataFrame:
    """pages (page_id, url, html) with refers_to: of equal payloads of at least min_bytes
    the largest id is the response (null), the others refer to it; rows that share that
    id are responses all. A null id is below all others; where all are null, all are responses.

    The payloads that occur twice or more are a written table of one narrow row each, so
    that Spark broadcasts it if it is small; else a digest has one row on that side, and
    the many rows of a hot digest can be split."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", payload.alias("html")).withColumn("sha", F.sha1("html")).withColumn("size", F.octet_length("html"))
    best = keyed.where(F.col("size") >= how.min_bytes).groupBy("sha", "size").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1")
    best = written(best.select("sha", "size", "best"), "payloads")
    out = keyed.join(best, ["sha", "size"], "left")
    return out.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("best")), F.col("best")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, how: Archive = Archive(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes one record or more a page below path, as gzipped WARC files.

    A null html is an empty payload, a null url becomes urn:none. Ids are whole numbers; a null
    one has no X-Page-Id and is read back as null. Repeated rows are records of their own, with
    equal record ids; rows that share an id but not a payload have different ones. Other columns
    of pages are not read. An empty table writes no record. A file holds no more than
    records_per_file records, each of segment_bytes and its headers."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for page in batch.to_pylist():
                for record in page_records(page["page_id"], page["url"], page["html"], page["refers_to"], how):
                    out.append(record)
                    size += len(record)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    records = with_responses(src, how).mapInArrow(run, "record binary")
    out = records.select(F.col("record").cast("string").alias("value")).write
    out.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", how.records_per_file).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive: headers (names in lower case) and block."""
    if data[:2] == b"\x1f\x8b":
        out, rest = [], data
        while rest[:2] == b"\x1f\x8b":  # a member a record, or one for all
            d = zlib.decompressobj(31)
            out.append(d.decompress(rest) + d.flush())
            rest = d.unused_data
        data = b"".join(out)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(CRLF + CRLF, at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError(f"record {headers.get('warc-record-id')} is cut short")
        yield headers, block
        at = end + 4 + size


#: A record as it is read: digest is computed from the payload of a whole response, declared is the header's.
RECORD = "record_id string, origin string, number int, total long, page_id long, record_type string, refers_to long, refers_id string, declared string, digest string, payload binary"


def _row(h: dict[str, str], block: bytes) -> dict:
    number = int(h.get("warc-segment-number", 0))
    whole = h["warc-type"] == "response" and not number
    payload = http_payload(block) if whole else block if number else None
    as_int = lambda k: int(h[k]) if k in h else None
    return {
        "record_id": h["warc-record-id"], "origin": h.get("warc-segment-origin-id", h["warc-record-id"]), "number": number, "total": as_int("warc-segment-total-length"), "page_id": as_int("x-page-id"),
        "record_type": h["warc-type"], "refers_to": as_int("x-refers-to-page"), "refers_id": h.get("warc-refers-to"), "declared": h.get("warc-payload-digest", "").removeprefix("sha1:"),
        "digest": base32_sha1(payload) if whole else None, "payload": payload,
    }


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The responses, revisits and continuations of the archives below path, columns
    RECORD; a segment's payload is its part of the block. Other records are passed over.
    Raises if a record is cut short."""
    ship(spark)
    schema = pa.schema([("record_id", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("refers_id", pa.string()), ("declared", pa.string()), ("digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows, size = [], 0
                for h, block in parse(data):
                    if h.get("warc-type") in ("response", "revisit", "continuation"):
                        rows.append(_row(h, block))
                        size += len(block)
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def responses(records: DataFrame) -> DataFrame:
    """page_id, record_id, payload and digest of each response among records (columns
    RECORD). Segments are grouped by origin, ordered by number, checked against the total
    length and decoded. Raises if a segment is missing or a length or digest disagrees."""
    ship(records.sparkSession)
    out = "record_id string, page_id long, digest string, payload binary"
    whole = records.where("record_type = 'response' AND number = 0").select("record_id", "page_id", F.when(F.col("digest") == F.col("declared"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("digest of "), "record_id"))).alias("digest"), "payload")
    parts = records.where("number > 0").groupBy("origin").agg(
        F.collect_list(F.struct("number", "payload")).alias("parts"), F.max("total").alias("total"), F.max("page_id").alias("page_id"), F.max(F.when(F.col("record_type") == "response", F.col("declared"))).alias("declared"),
    )
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                # a record that is there n times has each of its segments n times
                segments: dict[int, bytes] = {x["number"]: x["payload"] for x in row["parts"]}
                times, uneven = divmod(len(row["parts"]), len(segments))
                block = b"".join(segments[i] for i in sorted(segments))
                if uneven or sorted(segments) != list(range(1, len(segments) + 1)) or len(block) != row["total"]:
                    raise ValueError(f"segments of {row['origin']} don't add up to {row['total']}")
                payload = http_payload(block)
                digest = base32_sha1(payload)
                if digest != row["declared"]:
                    raise ValueError(f"digest of {row['origin']}")
                yield pa.RecordBatch.from_pylist([{"record_id": row["origin"], "page_id": row["page_id"], "digest": digest, "payload": payload}] * times, schema)

    return whole.unionByName(parts.mapInArrow(run, out))


def captures(records: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest of each response and
    revisit among records; a revisit's are those of the response it refers to."""
    got = responses(records).select("record_id", "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"))
    got = written(got, "responses")
    own = got.select("page_id", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "payload_bytes", "payload_digest")
    by_id = got.groupBy("record_id").agg(F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"))
    revisits = records.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", F.col("refers_id").alias("record_id"), "declared")
    again = revisits.join(by_id, "record_id", "left")
    same = F.when(F.col("declared") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("no response with this payload: "), "record_id")))
    return own.unionByName(again.select("page_id", "record_type", "refers_to", "payload_bytes", same.alias("payload_digest")))


def round_trip(pages: DataFrame, how: Archive = Archive(), path: str | None = None) -> DataFrame:
    """Writes pages as archives (below path; by default in the shared folder), reads them
    back and returns their captures: digests and lengths are those of what was read."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archives(pages, path, how)
    return captures(written(read_archives(spark, path), "records"))
