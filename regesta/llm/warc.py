"""Operator 4: WARC archives and a splittable reader.

Writer: one gzip member a record; equal payloads are stored once, in the response record with the largest key, and
the others are revisit records that refer to it. Reader: a task gets a byte range of an archive and looks for the
gzip magic; a candidate counts if the member inflates to a WARC version line with a complete header block whose
Content-Length is the member's length, and whose gzip checksum holds. A task owns the records whose members begin in
its range; the last one may end beyond it. So ranges need no index, and every record has one owner.

A record is held in memory whole; files are read a block at a time. In archives of other writers a payload that holds
another WARC's members, stored without compression, could be taken for records when a range begins inside it; this
writer compresses such members again until no candidate is left inside.

Nulls: a null payload is empty; a null url is an empty header; a null key is smaller than any other and is returned as null. Rows
that share key and payload with the response are response records too. Empty tables give no archive and no rows.
Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import picked, shared_dir, stored

MAGIC = b"\x1f\x8b\x08"
HEAD_END = b"\r\n\r\n"
ROLL_BYTES, SPLIT_BYTES, BLOCK = 256 << 20, 16 << 20, 1 << 20
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def compressed(data: bytes, level: int, strategy: int, piece: int) -> bytes:
    """data as a gzip member; the compressor starts anew after every piece bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31, 9, strategy)
    return b"".join(z.compress(data[i : i + piece]) + z.flush(zlib.Z_FULL_FLUSH) for i in range(0, len(data), piece)) + z.flush()


def member(data: bytes) -> bytes:
    """data as a gzip member in which no other record begins. A magic from which nothing of a record inflates within
    the member, such as one in its checksum and length, is no record: the reader judges it by what follows, as here."""
    for level, strategy, piece in ((6, zlib.Z_DEFAULT_STRATEGY, 1 << 40), (6, zlib.Z_HUFFMAN_ONLY, 1 << 40), (6, zlib.Z_FIXED, 1 << 40), (6, zlib.Z_DEFAULT_STRATEGY, 1021), (6, zlib.Z_HUFFMAN_ONLY, 251)):
        out = compressed(data, level, strategy, piece)
        at = out.find(MAGIC, 1)
        while at >= 0 and inflate(out[at:], whole=True) is None:
            at = out.find(MAGIC, at + 1)
        if at < 0:
            return out
    raise ValueError("payload can't be stored unambiguously")


def record(key: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    """The record's bytes, not compressed. Keys are written as given; a null key has no X-Key header."""
    body = b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:key:{'' if key is None else key}>"]
    head += [f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url or '')}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}"]
    head += [f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8"]
    if key is not None:
        head.append(f"X-Key: {key}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"WARC-Refers-To: <urn:key:{refers_to}>")
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + HEAD_END + body + HEAD_END


def inflate(buffer: bytes, whole: bool = False) -> tuple[dict[str, str], bytes, int] | None | str:
    """(headers, payload, member length) of the record whose member begins the buffer, None if none does, "more" if
    the buffer ends too early to tell. whole: the buffer ends where a member ends; a candidate of which not even the
    version line inflates is none then."""
    z = zlib.decompressobj(31)
    try:
        first = z.decompress(buffer[:4096], 64)
        if not first.startswith(b"WARC/"):
            return "more" if len(first) < 5 and b"WARC/".startswith(first) and not z.eof and len(buffer) < 4096 and not whole else None
        z = zlib.decompressobj(31)
        data = z.decompress(buffer)
    except zlib.error:
        return None
    if not z.eof:
        return "more"
    head, found, body = data.partition(HEAD_END)
    if not found:
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not length.isdigit() or len(body) != int(length) + 4 or not body.endswith(HEAD_END):
        return None
    return fields, body[: int(length)], len(buffer) - len(z.unused_data)


def read_range(handle, size: int, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records whose members begin at start..end-1."""
    at, buffer, base = start, b"", start  # buffer holds the file from base on

    def fill(least: int) -> None:
        nonlocal buffer
        while base + len(buffer) < min(size, least):
            handle.seek(base + len(buffer))
            got = handle.read(min(size - base - len(buffer), max(BLOCK, len(buffer))))
            if not got:
                return
            buffer += got

    while at < end:
        if at > base + BLOCK:
            buffer, base = buffer[at - base :], at
        fill(at + BLOCK)
        hit = buffer.find(MAGIC, at - base)
        if hit < 0:
            at = max(at + 1, base + len(buffer) - len(MAGIC) + 1)
            if base + len(buffer) >= size:
                return
            continue
        at = base + hit
        if at >= end:
            return
        got = inflate(buffer[hit:])
        while got == "more" and base + len(buffer) < size:
            fill(base + len(buffer) + max(BLOCK, len(buffer) - hit))
            got = inflate(buffer[hit:])
        if got is None or got == "more":
            at += 1
            continue
        yield got[0], got[1]
        at += got[2]


def decided(pages: DataFrame, key_col: str, url_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """key, url, payload, revisit, refers_to."""
    base = picked(pages, key=key_col, url=url_col, payload=payload_col).withColumn("payload", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")))
    base = base.withColumn("same", F.unhex(F.sha2("payload", 256)))
    groups = base.where(F.octet_length("payload") >= least_bytes).groupBy(F.col("same").alias("group")).agg(F.max("key").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.where("n > 1").drop("n"), "warc-groups")
    joined = base.join(groups, F.col("same") == F.col("group"), "left")
    revisit = F.col("group").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    return joined.select("key", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Archives in folder; a row each: name, bytes, records. Payloads under least_bytes are all response records."""
    rows = decided(pages, key_col, url_col, payload_col, least_bytes)
    rows = rows.select(F.col("key").cast("string"), "url", "payload", "revisit", F.col("refers_to").cast("string"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, size, count, done = None, "", 0, 0, []
        for batch in batches:
            for i in range(batch.num_rows):
                key, url, payload, revisit, refers = (batch.column(k)[i].as_py() for k in range(5))
                if out is None:
                    (out, name), size, count = files.create(folder, "part"), 0, 0
                data = member(record(key, url, payload, refers, revisit))
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= roll_bytes:
                    out.close()
                    done.append((name, size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, count))
        yield pa.RecordBatch.from_pylist([dict(zip(("name", "bytes", "records"), x)) for x in done], schema=pa.schema([("name", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return stored(rows.mapInArrow(write, "name string, bytes long, records long"), "warc-manifest")


def read_warc(manifest: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """key string, url, payload_bytes, payload_digest, record_type, refers_to string, payload (null in revisits)."""
    ranges = manifest.select("name", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    tasks = max(1, min(100_000, manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1))
    spread = ranges.repartition(int(tasks), "name", "start") if tasks > 1 else ranges
    schema = pa.schema([("key", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows, held = [], 0
                with files.open_input(folder, r["name"]) as handle:
                    for fields, body in read_range(handle, r["bytes"], r["start"], min(r["bytes"], r["start"] + split_bytes)):
                        revisit = fields["warc-type"] == "revisit"
                        refers = fields.get("warc-refers-to", "")[9:-1]
                        rows.append(dict(zip(schema.names, (fields.get("x-key"), fields.get("warc-target-uri"), int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], refers if revisit and refers else None, None if revisit else body))))
                        held += len(body)
                        if len(rows) >= 1000 or held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spread.mapInArrow(scan, "key string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    rows = read_warc(manifest, folder)
    return rows.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def base32_sql(hexes: str) -> str:
    """DuckDB: bare base32 of a 20-byte digest given in hex; each 10 hex digits are 8 letters."""
    alphabet = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    part = lambda i: f"CAST('0x' || substr({hexes}, {1 + 10 * i}, 10) AS BIGINT)"
    return " || ".join(f"substr({alphabet}, CAST(1 + (({part(i)} >> {5 * (7 - k)}) & 31) AS INTEGER), 1)" for i in range(4) for k in range(8))


ORACLE = f"""
WITH hashed AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS first FROM hashed)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, {base32_sql("h")} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM firsts
"""
