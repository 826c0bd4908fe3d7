"""WARC archives of gzip members: written by tasks, read back by tasks that each scan a byte range.

A reader task looks for the gzip magic in its range, takes a candidate for a member if it decodes to a WARC header, and
owns the records whose members start inside its range; a member that ends behind the range is read to its end.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fresh, opened, written

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
STEP = 1 << 16
PIECE = 4 << 20  # bytes of payloads in one batch of the reader
SCHEMA = ("path string, offset long, warc_type string, page_id long, url string, refers_to long, "
          "payload_bytes long, payload_digest string, stated_digest string, payload binary")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member; a revisit has the HTTP head alone and names the record that holds the payload."""
    http = HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    packed = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packed.compress("\r\n".join(head).encode() + b"\r\n\r\n") + packed.compress(block) + packed.compress(b"\r\n\r\n") + packed.flush()


def write(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) and returns the archives as (path, bytes).

    Of the rows with equal payloads (null is empty) that with the largest page_id is the response and the others revisit
    it; rows with a null page_id are responses, as are repeated rows of the largest id. Each task writes archives of its
    own name: a repeated task writes new ones, and the rows returned name those of the attempt that counted.
    """
    kind = F.sha2(F.coalesce("html", F.lit("")), 256)
    known = pages.select("page_id", kind.alias("payload_key")).where("page_id IS NOT NULL").distinct()
    first = known.groupBy("payload_key").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits = known.join(first, "payload_key").where("page_id <> refers_to")
    rows = (pages.select("page_id", "url", "html").withColumn("payload_key", kind)
            .join(revisits, ["page_id", "payload_key"], "left").select("page_id", "url", "html", "refers_to"))

    def save(batches):
        store, place = opened(folder)
        store.create_dir(place, recursive=True)
        name, size, out = f"part-{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or store.open_output_stream(f"{place}/{name}", compression=None)
                member = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to, date)
                out.write(member)
                size += len(member)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64())], ["path", "bytes"])

    return rows.mapInArrow(save, "path string, bytes long")


def read(archives: DataFrame, split: int = 8 << 20) -> DataFrame:
    """The records of archives (path, bytes), by tasks over ranges of `split` bytes.

    A record comes once, wherever ranges begin. Bytes that are no gzip member with a WARC header are passed over, and so
    are damaged members and those whose Content-Length is no number or more than is there. A page number that is none is null. payload is null in a revisit; payload_bytes and payload_digest are taken from
    the payload read, stated_digest from the header.
    """
    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("begin")
    ranges = archives.select("path", "bytes", begins)
    # by number, so that ranges (short rows, long work) are not put together again
    tasks = max(1, min(ranges.count(), 16 * archives.sparkSession.sparkContext.defaultParallelism))
    return ranges.repartition(tasks).mapInArrow(_ranges(split), SCHEMA)


def _ranges(split: int):
    def scan(batches):
        for batch in batches:
            for path, size, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, place = opened(path)
                with store.open_input_file(place) as file:
                    held, weight = [], 0
                    for row in members(file, begin, min(begin + split, size), size):
                        held.append((path, *row))
                        weight += 300 + len(row[-1] or b"")
                        if weight > PIECE:
                            yield _batch(held)
                            held, weight = [], 0
                    if held:
                        yield _batch(held)

    return scan


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def members(file, begin: int, end: int, size: int):
    """The records whose members start in [begin, end) of an open file of `size` bytes."""
    file.seek(begin)
    data = file.read(min(end - begin + len(MAGIC) - 1, size - begin))
    at = data.find(MAGIC)
    while 0 <= at < end - begin:
        found = _member(file, data, at, begin, size)
        if found:
            parsed = _parsed(found[0])
            if parsed:
                yield (begin + at, *parsed)
            at = data.find(MAGIC, at + found[1])
        else:
            at = data.find(MAGIC, at + 1)


def _member(file, data: bytes, at: int, begin: int, size: int) -> tuple[bytes, int] | None:
    """The content and the length of the member at data[at], or None if there is none."""
    unpack, parts, fed = zlib.decompressobj(31), [], 0
    try:
        while not unpack.eof:
            piece = data[at + fed : at + fed + STEP]
            if not piece:
                file.seek(begin + at + fed)
                piece = file.read(STEP)
                if not piece:
                    return None
            parts.append(unpack.decompress(piece))
            fed += len(piece)
            head = parts[0] if len(parts[0]) >= 5 else b"".join(parts)
            if not b"WARC/".startswith(head[:5]) and head[:5] != b"WARC/":
                return None
            if len(parts) > 1 and len(parts[0]) < 5:
                parts = [head]
    except zlib.error:
        return None
    return b"".join(parts), fed - len(unpack.unused_data)


def _parsed(content: bytes) -> tuple | None:
    head, found, rest = content.partition(b"\r\n\r\n")
    if not found:
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    size = fields.get("content-length", str(len(rest)))
    if not re.fullmatch("[0-9]{1,18}", size) or int(size) > len(rest):
        return None
    block = rest[: int(size)]
    kind, stated = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    number = lambda name: int(fields[name]) if re.fullmatch("-?[0-9]{1,18}", fields.get(name, "")) else None
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    return (kind, number("x-page-id"), fields.get("warc-target-uri"), number("x-refers-to-page-id"),
            None if payload is None else len(payload), None if payload is None else digest(payload), stated, payload)


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written as archives in the shared folder and read back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    A revisit has the size of the payload that it names. Empty tables give no rows.
    """
    spark = pages.sparkSession
    archives = written(write(pages, fresh(spark, "warc")), "archives")
    records = written(read(archives).drop("payload", "path", "offset", "url"), "records")
    full = records.where("warc_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    sizes = full.where("page_id IS NOT NULL").select(
        F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated_digest"), "payload_bytes").distinct()
    again = records.where("warc_type = 'revisit'").drop("payload_bytes", "payload_digest").join(sizes, ["refers_to", "stated_digest"], "left").select(
        "page_id", "payload_bytes", F.col("stated_digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to")
    return full.unionByName(again)
