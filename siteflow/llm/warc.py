"""WARC archives of pages: deduplicated writing, and a reader that salvages damaged files.

A file is a row of gzip members, one record each. The reader checks each member (its checksum, the version line, the
lengths, the digest of the payload). Where a check fails it looks for the next gzip magic or, inside plain text, the
next version line from which a whole record follows, goes on there and reports the gap in bytes.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, work_dir, write_file

VERSION = b"WARC/1.1\r\n"
GZIP = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_bytes(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None = None) -> bytes:
    """A gzip member. Without a payload: a revisit of the page refers_to."""
    body = HTTP + payload if payload is not None else HTTP
    uri = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}\n{url}\n{digest}")
    one_line = lambda x: str(x).replace("\r", "%0D").replace("\n", "%0A")
    head = [("WARC-Type", "revisit" if payload is None else "response"), ("WARC-Record-ID", f"<urn:uuid:{uri}>"), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body))), ("X-Payload-Length", str(size))]
    head += [("WARC-Target-URI", one_line(url))] if url is not None else []
    head += [("X-Page-ID", str(page_id))] if page_id is not None else []
    head += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", str(refers_to))] if payload is None else []
    raw = VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class Record(NamedTuple):
    headers: dict[str, str]
    body: bytes

    @property
    def payload(self) -> bytes:
        return self.body.partition(b"\r\n\r\n")[2]


def parse_record(raw: bytes, at: int = 0) -> tuple[Record, int]:
    """The record that starts at a place, and the place after it; ValueError if a check fails."""
    if raw[at : at + 5] != b"WARC/":
        raise ValueError("no version line")
    end = raw.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("headers don't end")
    try:
        lines = raw[at:end].decode().split("\r\n")[1:]
    except UnicodeDecodeError as e:
        raise ValueError("headers aren't UTF-8") from e
    headers = dict(x.split(": ", 1) for x in lines if ": " in x)
    if not headers.get("Content-Length", "").isdigit():
        raise ValueError("no length")
    body = raw[end + 4 : (stop := end + 4 + int(headers["Content-Length"]))]
    if raw[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("the record doesn't end where its length says")
    record = Record(headers, body)
    want = headers.get("WARC-Payload-Digest", "").partition(":")[2]
    if headers.get("WARC-Type") == "response" and want and hashlib.sha256(record.payload).hexdigest() != want:
        raise ValueError("wrong payload digest")
    return record, stop + 4


class Gap(NamedTuple):
    """Bytes start to end of the file hold no whole record; inner: the place in a member's decompressed text."""

    start: int
    end: int
    reason: str
    inner: tuple[int, int] | None = None


VERSION_LINE = re.compile(rb"WARC/1\.[01]\r?\n")


def proven_record(raw: bytes, at: int, trusted: bool) -> tuple[Record, int]:
    """parse_record; where the place is not trusted or in the middle of a line, a digest of the payload must prove it."""
    record, nxt = parse_record(raw, at)
    if not (trusted and (at == 0 or raw[at - 1 : at] == b"\n")) and not (record.headers.get("WARC-Type") == "response" and record.headers.get("WARC-Payload-Digest", "").startswith("sha256:")):
        raise ValueError("no digest tells whether it is whole")
    return record, nxt


def inflate(raw: bytes, at: int) -> tuple[bytes, int | None, str]:
    """What a gzip member's start gives, the place after the member (None if it isn't whole), and what is wrong with it."""
    z, parts, place = zlib.decompressobj(31), [], at
    view = memoryview(raw)
    try:
        while place < len(raw) and not z.eof:
            parts.append(z.decompress(view[place : place + 4096]))
            place += 4096
        return b"".join(parts), (min(place, len(raw)) - len(z.unused_data) if z.eof else None), "" if z.eof else "member cut short"
    except zlib.error as e:
        # the last step's bytes up to the damage
        z = zlib.decompressobj(31)
        parts = [z.decompress(view[at:place])] if place > at else []
        try:
            for k in range(place, min(place + 4096, len(raw))):
                parts.append(z.decompress(view[k : k + 1]))
        except zlib.error:
            pass
        return b"".join(parts), None, str(e)


def records_of(plain: bytes, whole: bool) -> Iterator[Record | tuple[int, int, str]]:
    """The records of a member's text and the stretches between that hold none. Without its checksum (not whole), only
    records whose payload agrees with a digest count."""
    place, bad, why = 0, -1, ""
    while place < len(plain):
        try:
            record, nxt = proven_record(plain, place, whole)
        except ValueError as e:
            bad, why = (place, str(e)) if bad < 0 else (bad, why)
            m = VERSION_LINE.search(plain, place + 1)
            place = m.start() if m else len(plain)
            continue
        if bad >= 0:
            yield bad, place, why
            bad = -1
        yield record
        place = nxt
    if bad >= 0:
        yield bad, len(plain), why


def salvage(raw: bytes) -> Iterator[Record | Gap]:
    """All records that pass their checks, in order, and the byte ranges between them that hold none.

    A damaged or cut member gives the records before the damage; the next member is looked for behind it. In a member or
    plain file with a damaged record the next version line is; one in the middle of a line counts if a digest proves its record. (Where a damaged record quotes
    a whole record on lines of its own, nothing tells that from a record.)
    """
    at, bad, why = 0, -1, ""
    while at < len(raw):
        if raw.startswith(GZIP, at):
            plain, nxt, wrong = inflate(raw, at)
            found = list(records_of(plain, nxt is not None))
            if nxt is not None and any(isinstance(x, Record) for x in found):
                if bad >= 0:
                    yield Gap(bad, at, why)
                    bad = -1
                for x in found:
                    yield x if isinstance(x, Record) else Gap(at, nxt, x[2], x[:2])
                at = nxt
                continue
            if bad < 0:
                bad, why = at, wrong or next((x[2] for x in found if not isinstance(x, Record)), "no record")
            yield from (x for x in found if isinstance(x, Record))
        else:
            try:
                record, nxt = proven_record(raw, at, True) if bad >= 0 else parse_record(raw, at)
            except ValueError as e:
                bad, why = (at, str(e)) if bad < 0 else (bad, why)
            else:
                if bad >= 0:
                    yield Gap(bad, at, why)
                    bad = -1
                yield record
                at = nxt
                continue
        line = VERSION_LINE.search(raw, at + 1)
        steps = [x for x in (raw.find(GZIP, at + 1), line.start() if line else -1) if x > 0]
        at = min(steps, default=len(raw))
    if bad >= 0:
        yield Gap(bad, len(raw), why)


def write_warcs(pages: DataFrame, path: str, least: int = 100, file_bytes: int = 32 << 20) -> DataFrame:
    """Write pages(page_id, url, html) as gzipped WARC files under path and return the manifest (file, records).

    Null html is an empty payload, null url has no target line; rows without page_id are responses. Repeated rows of
    one page_id: each has its record, of equal payloads the first by url is the response. An empty table writes no files.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    first = pages.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("bytes")).where(f"bytes >= {least}")
    copies = first.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    # by digest and page: which response each copy points to; a row for each page that has copies
    revisits = first.join(copies, "digest").groupBy("page_id", "digest").agg(F.first("refers_to").alias("refers_to"), F.count("*").alias("times"))
    revisits = keep(revisits, "warc-revisits")
    full = pages.withColumn("digest", F.sha2("html", 256)).join(revisits, ["page_id", "digest"], "left")
    own = F.col("refers_to").isNull() | (F.col("refers_to") == F.col("page_id"))
    again = own & (F.coalesce("times", F.lit(1)) > 1)
    if revisits.where("times > 1 and page_id = refers_to").take(1):
        # rows repeated with the group's smallest page_id: the first by url is the response
        first_one = F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("url")) == 1
        full = full.where(~again).withColumn("own", own).unionByName(full.where(again).withColumn("own", first_one))
    else:
        full = full.withColumn("own", own)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        pid, seq, held, parts, rows = TaskContext.get().partitionId(), 0, 0, [], []

        def close() -> None:
            nonlocal seq, held
            name = f"pages-{pid:06d}-{seq:05d}.warc.gz"
            write_file(f"{path}/{name}", b"".join(parts))
            rows.append((name, len(parts)))
            seq, held = seq + 1, 0
            parts.clear()

        for batch in batches:
            for page, url, html, digest, to, own in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "html", "digest", "refers_to", "own")), strict=True):
                payload = html.encode()
                parts.append(record_bytes(page, url, payload if own else None, digest, len(payload), None if own else to))
                held += len(parts[-1])
                if held >= file_bytes:
                    close()
        if parts:
            close()
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["file", "records"]).astype({"file": "string", "records": "int64"}), preserve_index=False)

    manifest = full.mapInArrow(write, "file string, records long")
    return keep(manifest, "warc-manifest")


def read_warcs(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The records of all files under path, and the gaps: (file, start, end, inner_start, inner_end, reason).

    strict: a gap ends the reading with an error instead. Files without any record give their gap; a file is one task's.
    """
    fields = "file string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary, gap_start long, gap_end long, inner_start long, inner_end long, reason string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("file", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("gap_start", pa.int64()), ("gap_end", pa.int64()), ("inner_start", pa.int64()), ("inner_end", pa.int64()), ("reason", pa.string())])
        for batch in batches:
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for x in salvage(raw.as_buffer().to_pybytes()):
                    if isinstance(x, Gap):
                        if strict:
                            raise ValueError(f"{file}: bytes {x.start} to {x.end} hold no record: {x.reason}")
                        rows.append((file, None, None, "gap", None, None, None, None, x.start, x.end, *(x.inner or (None, None)), x.reason))
                    else:
                        h = x.headers
                        whole = h["WARC-Type"] == "response"
                        number = lambda k, h=h: int(h[k]) if k in h else None
                        payload = x.payload if whole else None
                        # what a response holds is counted anew; a revisit has only what its headers say
                        digest = hashlib.sha256(payload).hexdigest() if whole else h["WARC-Payload-Digest"].partition(":")[2]
                        rows.append((file, number("X-Page-ID"), h.get("WARC-Target-URI"), h["WARC-Type"], digest, len(payload) if whole else number("X-Payload-Length"), number("X-Refers-To-Page-ID"), payload, None, None, None, None, None))
                        size += len(payload or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "content")
    rows = files.mapInArrow(read, fields)
    records = rows.where("record_type != 'gap'").drop("gap_start", "gap_end", "inner_start", "inner_end", "reason")
    gaps = rows.where("record_type = 'gap'").select("file", F.col("gap_start").alias("start"), F.col("gap_end").alias("end"), "inner_start", "inner_end", "reason")
    return records, gaps


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages as archives and read them back; what was just written must have no gap. Odd rows are as in write_warcs."""
    spark = pages.sparkSession
    path = path or work_dir(spark, "warc")
    if not write_warcs(pages, path).take(1):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_warcs(spark, path, strict=True)[0].select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows for DuckDB.
WARC_SQL = """
SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id <> min(page_id) OVER (PARTITION BY coalesce(html, '')) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id <> min(page_id) OVER (PARTITION BY coalesce(html, '')) THEN min(page_id) OVER (PARTITION BY coalesce(html, '')) END AS refers_to
FROM pages
"""
