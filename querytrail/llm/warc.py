"""Operator 10: WARC records in seekable Zstandard bundles, written and read through Spark."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .tables import read

FRAME_BYTES = 256 * 1024        # plain bytes of records that make a frame
BUNDLE_BYTES = 8 * 1024 * 1024  # compressed bytes that make a bundle
ID_PREFIX = "urn:x-page:"

# Fixed values of the seekable format and of WARC.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
UNKNOWN_DATE = "1970-01-01T00:00:00Z"

BUNDLES = ("bundle string, archive binary, "
           "entries array<struct<record_id: string, frame: int, at: long, length: long>>")
RECORDS = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long, url string, payload binary")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"{ID_PREFIX}{'none' if pd.isna(page_id) else int(page_id)}"


def page_of(urn: str) -> int | None:
    tail = urn.strip("<>").removeprefix(ID_PREFIX)
    return None if tail == "none" else int(tail)


def warc_record(page_id, url, payload: bytes, refers_to) -> bytes:
    """One record; with ``refers_to`` a revisit, whose block has no payload."""
    revisit = not pd.isna(refers_to)
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {UNKNOWN_DATE}"]
    if isinstance(url, str):
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: <{record_id(refers_to)}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
             "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer: a skippable frame listing compressed and plain size of every frame."""
    body = b"".join(struct.pack("<II", *sizes) for sizes in frames)
    body += struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def frame_spans(archive: bytes) -> list[tuple[int, int, int]]:
    """Offset, compressed size and plain size of every frame, from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", archive[-9:])
    if magic != SEEKABLE_MAGIC or flags:
        raise ValueError("not a seekable bundle")
    at, spans, table = 0, [], len(archive) - 9 - 8 * n
    for i in range(n):
        packed, plain = struct.unpack_from("<II", archive, table + 8 * i)
        spans.append((at, packed, plain))
        at += packed
    return spans


def read_frame(archive: bytes, span: tuple[int, int, int]) -> bytes:
    at, packed, plain = span
    return zstandard.ZstdDecompressor().decompress(archive[at:at + packed], max_output_size=plain)


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record that begins at ``at``, and where the next one does."""
    blank = data.index(b"\r\n\r\n", at)
    lines = data[at:blank].decode().split("\r\n")
    head = dict(line.split(": ", 1) for line in lines[1:])
    begin = blank + 4
    end = begin + int(head["Content-Length"])
    http_end = data.index(b"\r\n\r\n", begin) + 4
    http = dict(line.split(": ", 1) for line in data[begin:http_end - 4].decode().split("\r\n")[1:])
    payload = data[http_end:end]
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = head["WARC-Type"] == "revisit"
    if not revisit and base32_sha1(payload) != digest:
        raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
    return {"page_id": page_of(head["WARC-Record-ID"]),
            "payload_bytes": int(http["Content-Length"]), "payload_digest": digest,
            "record_type": head["WARC-Type"],
            "refers_to": page_of(head["WARC-Refers-To"]) if revisit else None,
            "url": head.get("WARC-Target-URI"),
            "payload": None if revisit else payload}, end + 4


def _bundled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part = TaskContext.get().partitionId()
    packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
    count, frame, archive, frames, entries = 0, bytearray(), bytearray(), [], []

    def close_frame() -> None:
        if frame:
            packed = packer.compress(bytes(frame))
            frames.append((len(packed), len(frame)))
            archive.extend(packed)
            frame.clear()

    def bundle() -> pd.DataFrame:
        nonlocal count
        row = (f"{part:06d}-{count:06d}", bytes(archive) + seek_table(frames), list(entries))
        count += 1
        archive.clear(), frames.clear(), entries.clear()
        return pd.DataFrame([row], columns=["bundle", "archive", "entries"])

    for batch in batches:
        for row in batch.itertuples(index=False):
            payload = b"" if row.html is None else row.html.encode()
            data = warc_record(row.page_id, row.url, payload, row.refers_to)
            entries.append({"record_id": record_id(row.page_id), "frame": len(frames),
                            "at": len(frame), "length": len(data)})
            frame += data
            if len(frame) >= FRAME_BYTES:
                close_frame()
                if len(archive) >= BUNDLE_BYTES:
                    yield bundle()
    close_frame()
    if entries:
        yield bundle()


def _records(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def _unbundled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for archive in batch["archive"]:
            for span in frame_spans(archive):
                data, at, rows = read_frame(archive, span), 0, []
                while at < len(data):
                    row, at = parse_record(data, at)
                    rows.append(row)
                yield _records(rows)


def _fetched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for archive, wanted in zip(batch["archive"], batch["wanted"], strict=True):
            spans = frame_spans(archive)
            for entry in wanted:
                data = read_frame(archive, spans[entry["frame"]])
                yield _records([parse_record(data, entry["at"])[0]])


def with_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, refers_to``: of equal payloads the largest page_id is the response.

    Only digests met more than once reach the join, with one row each; a digest that a third
    of the pages share is counted before the shuffle and its pages may be split in the join.
    """
    digested = pages.select("page_id", "url", "html",
                            F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    repeats = digested.groupBy("digest").agg(
        F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    other = F.col("page_id").isNull() | (F.col("page_id") < F.col("best"))
    return digested.join(repeats, "digest", "left").select(
        "page_id", "url", "html",
        F.when(other & F.col("best").isNotNull(), F.col("best")).alias("refers_to"))


def write_bundles(pages: DataFrame, path: str) -> None:
    """Write pages as WARC records in seekable Zstandard bundles.

    A bundle is one row: its name, its bytes (independent frames of about 256 KiB of whole
    records, then a footer with the seek table) and the entries that map record identifiers to
    a frame and an offset in it. Bundles are rows of a table that Spark writes, so they reach
    any store; a bundle's bytes are a complete file, about 8 MiB and one record at most.

    A NULL html is an empty payload, a NULL url gives no target line, a NULL page_id counts
    as smaller than any other. Rows that repeat the largest page_id of a payload are all
    responses. An empty table gives an empty table of bundles. Extra columns are left out.
    """
    with_revisits(pages).mapInPandas(_bundled, BUNDLES).write.parquet(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the bundles, frame by frame; response payloads are checked."""
    return (spark.read.schema(BUNDLES).parquet(path).select("archive")
            .mapInPandas(_unbundled, RECORDS))


def fetch_records(spark: SparkSession, path: str, page_ids: list[int]) -> DataFrame:
    """Single records: of each bundle only the frames that hold them are unpacked."""
    ids = [record_id(i) for i in page_ids]
    bundles = spark.read.schema(BUNDLES).parquet(path)
    wanted = F.filter("entries", lambda e: e["record_id"].isin(ids)).alias("wanted")
    return (bundles.select("archive", wanted).where(F.size("wanted") > 0)
            .mapInPandas(_fetched, RECORDS))


def op10_seekable_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Write all pages as bundles, read them back, and report every record."""
    path = scratch_path(spark, "warc")
    write_bundles(read(spark, folder, "pages"), path)
    return read_bundles(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
