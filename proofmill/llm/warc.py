"""WARC records in seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames of whole records, a skippable frame with the record index and, at
the end, the seek table of the Zstandard seekable format: compressed and plain size of each frame. The index maps record
ids to frame and offset in it, so one record is read by decompressing one frame.

Of records with equal payloads, the one with the smallest page_id is a response and the others are revisits of it, if the
payload has least bytes or more; shorter ones are all responses. Null payloads are empty. Rows that share page_id and
payload with the response are responses too; a null page_id never is what others refer to, and such rows are responses.
A record's id comes from page_id, payload and, in a bundle, how often these came before; a revisit names its response's id.
Very long payloads are frames of their own. Tables without rows make no bundle; columns besides the three aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import new_path, record, split_join, stored

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 32 << 20, 3
SKIPPABLE, INDEX, SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, sha: str, again: int = 0) -> str:
    """The id of the record of a page and payload, and of those that repeat both in a bundle."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{sha}" + f":{again}" * bool(again)).urn


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, again: int = 0) -> tuple[str, bytes]:
    """A record's id and bytes. A revisit has no payload; digest and length are those of the full one."""
    sha = digest(payload)
    name = record_id(page_id, sha, again)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha}", f"X-Payload-Length: {len(payload)}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(url.splitlines()))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        body += payload
    else:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head += [f"WARC-Profile: {profile}", f"WARC-Refers-To: <{record_id(refers_to, sha)}>", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class Bundle:
    def __init__(self, frame_bytes: int = FRAME_BYTES) -> None:
        self.frame_bytes, self.size = frame_bytes, 0
        self.frames: list[tuple[bytes, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.repeats: Counter[str] = Counter()
        self.open: list[bytes] = []
        self.plain = 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)

    def add_page(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> None:
        first = record_id(page_id, digest(payload))
        self.add(*warc_record(page_id, url, payload, refers_to, self.repeats[first]))
        self.repeats[first] += 1

    def add(self, name: str, data: bytes) -> None:
        self.index.append((name, len(self.frames), self.plain, len(data)))
        self.open.append(data)
        self.plain += len(data)
        if self.plain >= self.frame_bytes:
            self.cut()

    def cut(self) -> None:
        if self.open:
            frame = self.compressor.compress(b"".join(self.open))
            self.frames.append((frame, self.plain))
            self.size += len(frame)
            self.open, self.plain = [], 0

    def bytes(self) -> bytes:
        self.cut()
        index = self.compressor.compress("\n".join(f"{n} {f} {o} {s}" for n, f, o, s in self.index).encode())
        index = struct.pack("<II", INDEX, len(index)) + index
        entries = b"".join(struct.pack("<II", len(f), n) for f, n in self.frames) + struct.pack("<II", len(index), 0)
        footer = struct.pack("<IBI", len(self.frames) + 1, 0, SEEKABLE)
        return b"".join(f for f, _ in self.frames) + index + struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame; the last one is the record index."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE or flags & 0x80:
        raise ValueError("not a seekable bundle")
    at, out = 0, []
    for c, p in struct.iter_unpack("<II", data[-9 - 8 * n : -9]):
        out.append((at, c, p))
        at += c
    return out


def record_index(data: bytes) -> dict[str, tuple[int, int, int]]:
    at, size, _ = seek_table(data)[-1]
    lines = zstandard.decompress(data[at + 8 : at + size]).decode().splitlines()
    return {n: (int(f), int(o), int(s)) for n, f, o, s in (x.split(" ") for x in lines)}


def read_record(data: bytes, name: str) -> bytes:
    """One record, by its id: only its frame is decompressed."""
    frame, offset, size = record_index(data)[name]
    at, length, _ = seek_table(data)[frame]
    return zstandard.decompress(data[at : at + length])[offset : offset + size]


def parse(data: bytes):
    """(headers, body) of each record in plain WARC bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + size]
        at = end + 8 + size


def records(data: bytes):
    for at, size, plain in seek_table(data)[:-1]:
        yield from parse(zstandard.decompress(data[at : at + size], max_output_size=plain))


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, sha, refers_to) of the rows that are revisits. pages has page_id and html as bytes."""
    rows = pages.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= least)).select("page_id", F.unhex(F.sha1("html")).alias("sha"))
    rows = stored(rows, "digests")
    first = rows.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"), F.count("*").alias("n")).where("refers_to < last")
    found = split_join(rows, stored(first.select("sha", "refers_to", "n"), "responses"), ["sha"])
    return found.where("page_id > refers_to").select("page_id", "sha", "refers_to").distinct()


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, bundle_bytes: int = BUNDLE_BYTES) -> tuple[str, DataFrame]:
    """Returns the folder and the manifest, one row per bundle of a task that ended: file, records, bytes."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("html"))
    known = stored(revisits(rows, least), "revisits")
    joined = rows.withColumn("sha", F.unhex(F.sha1("html"))).join(known, ["page_id", "sha"], "left").select("page_id", "url", "html", "refers_to")
    folder = new_path(pages.sparkSession, "warc")
    schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(it):
        bundle = Bundle()

        def flush():
            data = bundle.bytes()
            return record(schema, [files.write(folder, "pages", data)], [len(bundle.index)], [len(data)])

        for b in it:
            for row in zip(*(b.column(k) for k in range(4))):
                bundle.add_page(*(x.as_py() for x in row))
                if bundle.size >= bundle_bytes:
                    yield flush()
                    bundle = Bundle()
        if bundle.index:
            yield flush()

    return folder, stored(joined.mapInArrow(run, "file string, records long, bytes long"), "manifest")


def read(folder: str, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if wanted, payload) of each record of the bundles.

    A response's digest and length are those of the payload as read.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload)
    spark = manifest.sparkSession
    columns = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    if manifest.isEmpty():  # no bundle, no folder
        return spark.createDataFrame([], columns)
    found = spark.read.format("binaryFile").load(folder).select(F.substring_index("path", "/", -1).alias("file"), "content")

    def run(it):
        number = lambda x: None if x is None else int(x)
        for b in it:
            for content in b.column(0):
                rows, held = [], 0
                for head, body in records(content.as_py()):
                    kind = head["WARC-Type"]
                    payload = body.split(b"\r\n\r\n", 1)[1] if kind == "response" else None
                    size, sha = (int(head["X-Payload-Length"]), head["WARC-Payload-Digest"][5:]) if payload is None else (len(payload), digest(payload))
                    rows.append((number(head.get("X-Page-ID")), head.get("WARC-Target-URI"), size, sha, kind, number(head.get("X-Refers-To-Page-ID")), *[payload] * with_payload))
                    held += size
                    if held > 8 << 20:
                        yield record(schema, *zip(*rows))
                        rows, held = [], 0
                if rows:
                    yield record(schema, *zip(*rows))

    kept = found.join(manifest.select("file"), "file").select("content")
    return kept.mapInArrow(run, columns)
