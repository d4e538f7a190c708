"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent frames, each holding whole records, and a skippable frame at the end with a seek
table (compressed and decompressed size of each frame), in the public seekable format, so that any zstd tool reads the
whole and a reader with the table reads one frame. An index maps record ids to (file, frame, offset in the frame).

Bundles are written by the tasks straight into the shared folder. Each attempt writes files of its own name, and only
those named in the index, which Spark commits once, count; what a lost attempt left behind is never read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import BROADCAST_BYTES, prepare, scratch, stored

LEAST = 100  #: bytes of a payload that others may revisit
FRAME = 1 << 20  #: bytes of records in a frame, about; a longer record has its own
BUNDLE = 128 << 20  #: compressed bytes of a bundle, about
LEVEL = 3

#: Fixed values of the seekable format: magic numbers of the skippable frame and of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit without a body. The length of the full payload is a header."""
    url = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "urn:none")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, body, end) of the record at an offset."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(line.split(": ", 1) for line in lines)
    size = int(head["Content-Length"])
    return head, data[end + 4 : end + 4 + size], end + 8 + size


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def _unpack(frame: bytes, plain: int) -> bytes:
    data = zstandard.ZstdDecompressor().decompressobj().decompress(frame)
    if len(data) != plain:
        raise ValueError("a frame differs from the seek table")
    return data


def read_table(read, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of each frame; read(offset, n) gives bytes of a bundle of that size."""
    frames, flags, magic = struct.unpack("<IBI", read(size - 9, 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    each = 12 if flags & 0x80 else 8
    raw = read(size - 9 - frames * each, frames * each)
    out, at = [], 0
    for i in range(frames):
        packed, plain = struct.unpack_from("<II", raw, i * each)
        out.append((at, packed, plain))
        at += packed
    return out


class Bundles:
    """Writes records to bundles under a folder; place() tells where each went."""

    def __init__(self, folder: str):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root)
        self.out, self.rows, self.pack = None, [], zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def add(self, key, data: bytes) -> None:
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.warc.zst"
            self.out, self.sizes, self.done, self.frame, self.held = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None), [], 0, [], 0
        self.rows.append((key, self.name, len(self.sizes), self.held, len(data)))
        self.frame.append(data)
        self.held += len(data)
        if self.held >= FRAME:
            self._flush()
            if self.done >= BUNDLE:
                self.close()

    def _flush(self) -> None:
        if self.frame:
            packed = self.pack.compress(b"".join(self.frame))
            self.out.write(packed)
            self.sizes.append((len(packed), self.held))
            self.done += len(packed)
            self.frame, self.held = [], 0

    def close(self) -> None:
        if self.out is not None:
            self._flush()
            self.out.write(seek_table(self.sizes))
            self.out.close()
            self.out = None

    def place(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        return pd.DataFrame(rows, columns=["page_id", "file", "frame", "at", "size"])


def _write(folder: str):
    def run(batches):
        to = Bundles(folder)
        for pdf in batches:
            for i, url, payload, digest, other in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["digest"], pdf["refers_to"]):
                to.add(i, record(i, url, bytes(payload), digest, other))
            if len(to.rows) > 50_000:
                yield to.place()
        to.close()
        yield to.place()

    return run


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Writes a record per row of pages(page_id, url, html, ...) to bundles in folder; returns the stored index
    (page_id, file, frame, at, size).

    Payload: html in UTF-8, null as empty. Of the records with equal payloads of at least `least` bytes, the one with
    the smallest page_id is the response (all of them, if several rows have that id) and the others revisit it;
    smaller payloads are all responses. A null page_id is never the smallest unless all are null; then all are
    responses. page_id is a whole number, or a string of one. A very long payload is a frame of its own, held by one
    task. Only digests and ids meet in the aggregation and, where the repeated digests exceed a broadcast, in the join
    by digest, so a payload that a third of all pages share is an id and a digest a row there; the pages themselves
    then meet their answer by id and digest.
    """
    prepare(pages.sparkSession)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256))
    again = base.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").select("digest", "original")
    again = stored(again, "repeats")
    if again.count() * 160 <= BROADCAST_BYTES:
        rows = base.join(F.broadcast(again), "digest", "left")
    else:
        known = base.select("page_id", "digest").distinct().join(again, "digest").select(F.col("page_id").alias("i"), F.col("digest").alias("d"), "original")
        rows = base.join(known, base["page_id"].eqNullSafe(known["i"]) & (base["digest"] == known["d"]), "left")
    rows = rows.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original")))
    named = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", F.col("refers_to").cast("string").alias("refers_to"))
    index = named.mapInPandas(_write(folder), "page_id string, file string, frame int, at long, size long")
    return stored(index.withColumn("page_id", F.col("page_id").cast("long")), "warc-index")


def _read(folder: str):
    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for pdf in batches:
            for file in pdf["file"]:
                with fs.open_input_file(f"{root}/{file}") as f:

                    def read(at, n):
                        f.seek(at)
                        return f.read(n)

                    for k, (at, packed, plain) in enumerate(read_table(read, f.size())):
                        out = []
                        data = _unpack(read(at, packed), plain)
                        pos = 0
                        while pos < len(data):
                            head, body, end = parse(data, pos)
                            key = head["WARC-Record-ID"][len("<urn:page:") : -1]
                            other = head.get("WARC-Refers-To", "")[len("<urn:page:") : -1]
                            digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                            kind = head["WARC-Type"]
                            if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                                raise ValueError(f"{file}: damaged record {key}")
                            size = len(body) if kind == "response" else int(head["X-Payload-Length"])
                            out.append((None if key == "null" else int(key), size, digest, kind, int(other) if other else None, file, k, pos, end - pos, head["WARC-Target-URI"]))
                            pos = end
                        made = pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "frame", "at", "size", "uri"])
                        yield made.astype({"page_id": "Int64", "refers_to": "Int64"})

    return run


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, frame int, at long, size long, uri string"


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """All records of the bundles that the index names, read back frame by frame, bundles in parallel; digests are
    checked."""
    files = index.select("file").distinct()
    return files.repartition(max(1, files.count())).mapInPandas(_read(folder), READ)


def fetch(folder: str, file: str, frame: int, at: int, size: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: reads the seek table and one frame."""
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{root}/{file}") as f:

        def read(pos, n):
            f.seek(pos)
            return f.read(n)

        start, packed, plain = read_table(read, f.size())[frame]
        data = _unpack(read(start, packed), plain)
    head, body, _ = parse(data[at : at + size])
    return head, body


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the archives of pages and reads them back: one row per record, as read."""
    folder = folder or scratch(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)
