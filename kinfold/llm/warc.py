"""Operator 2: WARC archives compressed record by record with an embedded Zstandard dictionary.

An archive is a leading skippable frame that holds a dictionary built from the
archive's own records, then one Zstandard frame for each record. Spark's text
writer puts the frames into files, so any store and its commit protocol will do:
the line separator is an empty skippable frame, which every decoder passes over.
"""

from __future__ import annotations

import base64
import hashlib
import math
import struct
import uuid
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import hot_keys, scratch, written

#: Fixed values of the format: the magic of a dictionary frame, of an empty frame between records, of Zstandard.
DICT_MAGIC, GAP, ZSTD_MAGIC = b"\x5d\x2a\x4d\x18", "P*M\x18\0\0\0\0", b"\x28\xb5\x2f\xfd"
#: Payload bytes an archive should hold, bytes of records read before its dictionary is built, and the most the dictionary has.
ARCHIVE_BYTES, TRAIN_BYTES, DICT_BYTES = 32 << 20, 4 << 20, 64 << 10
LEVEL = 3
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_uri(page_id: int | None, sha1_hex: str, place: str = "") -> str:
    """The identifier of a record by page and payload, and by its place where that isn't enough."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id} {sha1_hex} {place}').urn}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None, date: str, place: str = "") -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the response's headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_uri(page_id, sha1_hex, place),
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha1:{base32(sha1_hex)}",
        "WARC-Refers-To": None if refers_to is None else record_uri(refers_to, sha1_hex),
        "WARC-Profile": None if refers_to is None else REVISIT,
        "X-Page-ID": page_id,
        "X-Refers-To-Page-ID": refers_to,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of at most a tenth of the samples; None where they are too few or too short to build one."""
    size = min(DICT_BYTES, sum(map(len, samples)) // 10)
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL) if size >= 256 else None
    except zstandard.ZstdError:
        return None


def frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The frames of one archive, the dictionary's first. Holds TRAIN_BYTES of records and one more."""
    held: list[bytes] = []
    size = 0
    for one in records:
        held.append(one)
        size += len(one)
        if size >= TRAIN_BYTES:
            break
    built = dictionary(held)
    if built is not None:
        packed = zstandard.ZstdCompressor(level=19).compress(built.as_bytes())
        yield DICT_MAGIC + struct.pack("<I", len(packed)) + packed
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=built, write_checksum=True, write_content_size=True)
    yield from map(pack.compress, held)
    yield from map(pack.compress, records)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at ``at`` ends, from its headers alone."""
    if 0x184D2A50 <= int.from_bytes(data[at : at + 4], "little") <= 0x184D2A5F:
        return at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    checksum = 4 * bool(data[at + 4] & 4)
    at += zstandard.frame_header_size(data[at : at + 18])
    while True:
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at + checksum


def read_records(archive: bytes) -> Iterator[bytes]:
    """The records of an archive in order, each decompressed on its own."""
    data, at, built = memoryview(archive), 0, None
    unpack = zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(data, at)
        if data[at : at + 4] == DICT_MAGIC:
            raw = bytes(data[at + 8 : end])
            built = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == ZSTD_MAGIC else raw)
            unpack = zstandard.ZstdDecompressor(dict_data=built)
        elif data[at : at + 4] == ZSTD_MAGIC:
            yield unpack.decompress(data[at:end])
        at = end


def parse(one: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = one.partition(b"\r\n\r\n")
    warc = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    return warc, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def plan_records(pages: DataFrame, min_bytes: int, archive_bytes: int) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null: a response), dealt out archive by archive."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    sums = written(rows.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.max(F.length("payload")).cast("bigint").alias("bytes")), "warc-sums")
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") * F.col("bytes")), F.lit(0)).alias("bytes")).first()
    shared = sums.where((F.col("n") > 1) & (F.col("bytes") >= min_bytes)).select(F.col("digest").alias("__digest"), "first_id")
    refers = F.when(F.col("page_id") != F.col("first_id"), F.col("first_id")).otherwise(F.when(F.col("page_id").isNull(), F.col("first_id")))
    few = F.broadcast(hot_keys(sums, "digest", "n", total["n"]).withColumnRenamed("digest", "__hot"))
    hot = rows.join(few, F.col("digest") == F.col("__hot"), "left_semi").join(F.broadcast(shared.join(few, F.col("__digest") == F.col("__hot"), "left_semi")), F.col("digest") == F.col("__digest"), "left")
    rest = rows.join(few, F.col("digest") == F.col("__hot"), "left_anti").repartition(max(1, math.ceil(total["bytes"] / archive_bytes)), "digest")
    rest = rest.join(shared, F.col("digest") == F.col("__digest"), "left")
    return hot.unionByName(rest).select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record for every row of ``pages`` (page_id, url, html) to archives under ``path``.

    Of equal payloads of at least ``min_bytes`` the smallest page_id is the
    response and the others revisit it. Payloads with over 1/256 of the rows
    are archived where they lie, the rest dealt out by digest into archives of
    about ``archive_bytes``.

    Defined cases: a null html is an empty payload; a null page_id is never the
    one referred to, unless all are null: then all are responses; repeated rows
    of the smallest id are all responses; every record has an identifier of its
    own, but for such repeated rows of a payload with over 1/256 of the rows, which
    share theirs where they lie in different archives; a null url has no target header, and one with line
    breaks is written, and reads back, with %0D and %0A for them; a very long
    payload is one record; an empty table gives no records; other columns are left
    out.
    """

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            first: set[tuple[int, str]] = set()  # responses of this archive that a revisit may refer to
            for batch in found:
                for row in zip(*batch.columns, strict=True):
                    page_id, url, payload, digest, refers = (x.as_py() for x in row)
                    referred = page_id is not None and refers is None and (page_id, digest) not in first
                    if referred:
                        first.add((page_id, digest))
                    place = "" if referred else f"{TaskContext.get().partitionId()} {next(number)}"
                    yield record(page_id, url, payload, digest, refers, date, place)

        number = count()

        kept: list[bytes] = []
        for frame in frames(records()):
            kept.append(frame)
            if len(kept) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary())], ["frame"])
                kept = []
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary())], ["frame"])

    planned = plan_records(pages, min_bytes, archive_bytes).mapInArrow(batches, "frame binary")
    planned.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", GAP).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for a revisit) of every record.

    A response's digest and size are taken from the payload read, and a payload
    that differs from its recorded digest fails the job; a revisit carries both
    in its headers.
    """

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in found:
            for archive in batch.column(0):
                rows, size = [], 0
                for one in read_records(archive.as_py()):
                    warc, http, payload = parse(one)
                    digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = warc["WARC-Type"] == "response"
                    if response and base32(hashlib.sha1(payload).hexdigest()) != digest:
                        raise ValueError(f"payload of {warc['WARC-Record-ID']} differs from its digest")
                    page_id, refers = warc.get("X-Page-ID"), warc.get("X-Refers-To-Page-ID")
                    rows.append((page_id and int(page_id), warc.get("WARC-Target-URI"), len(payload) if response else int(http["Content-Length"]), digest, warc["WARC-Type"], refers and int(refers), payload if response else None))
                    size += len(payload)
                    if size > 8 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(batches, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back, without the payloads."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path).drop("payload")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(p.h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN g ON p.h = g.h
"""
