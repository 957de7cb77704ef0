"""WARC bundles as seekable Zstandard files.

A bundle is a file of independent Zstandard frames, each with whole records up
to ``frame_bytes``; then a skippable frame with the record index (record id,
frame, offset inside the frame, length) and, as footer, the seek table of the
Zstandard seekable format (compressed and plain size of every frame). Any
Zstandard tool can unpack a bundle; with the footer one record is read by
unpacking one frame.

Records with equal payloads of at least ``min_bytes`` bytes are stored once:
the one with the greatest page_id is the response, the others are revisits
that refer to it. Payload digests are SHA-1 in base32.

Bundles go to a folder of the shared file system, opened through
``pyarrow.fs`` by URI. A task writes under a name of its own attempt and
reports it only when the file is closed; readers follow the reports, so what a
lost attempt left is never read.

Defined cases: null html is an empty payload. Null url leaves the target
out. A null page_id is never the one referred to; a group of null ids only is
all responses. Repeated rows of the winning id are all responses. Line ends and
other control characters of a url are percent-encoded in the header. An empty
table writes no bundle.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from base64 import b32encode

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, shared_folder
from .text import pieces, short_batches

#: fixed values of the Zstandard formats
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
SALTS = 16
#: tasks that read archives back
MOST_TASKS = 100_000


def digest(payload: bytes) -> str:
    return b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page) -> str:
    return f"urn:x-page:{'null' if page is None else page}"


def record(page, url, payload: bytes, refers_to=None) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id(page)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes):
    """Records of an unpacked frame: (header fields, block)."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        size = int(fields["Content-Length"])
        yield fields, data[end + 4:end + 4 + size]
        at = end + 4 + size + 4


class BundleWriter:
    """Writes one bundle; ``close`` adds the index and the seek table."""

    def __init__(self, out, frame_bytes, level):
        import zstandard

        self.out, self.frame_bytes, self.zip = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames, self.index, self.buffer, self.plain = [], [], bytearray(), 0

    def add(self, rid: str, data: bytes):
        if self.buffer and len(self.buffer) + len(data) > self.frame_bytes:
            self.flush()
        self.index.append((rid, len(self.frames), len(self.buffer), len(data)))
        self.buffer += data
        self.plain += len(data)

    def flush(self):
        if self.buffer:
            packed = self.zip.compress(bytes(self.buffer))
            self.out.write(packed)
            self.frames.append((len(packed), len(self.buffer)))
            self.buffer = bytearray()

    def close(self):
        self.flush()
        listed = "".join(f"{rid}\t{f}\t{o}\t{n}\n" for rid, f, o, n in self.index).encode()
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(listed)) + listed)
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        self.out.close()


def seek_table(f) -> list[tuple[int, int, int]]:
    """(start, packed size, plain size) of every frame of an open bundle."""
    size = f.size()
    f.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table at the end of the file")
    f.seek(size - 9 - 8 * count)
    raw, at, out = f.read(8 * count), 0, []
    for k in range(count):
        packed, plain = struct.unpack_from("<II", raw, 8 * k)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(f, entry) -> bytes:
    import zstandard

    f.seek(entry[0])
    return zstandard.ZstdDecompressor().decompress(f.read(entry[1]), max_output_size=entry[2])


def read_record(uri: str, frame: int, offset: int, length: int) -> bytes:
    """One record by the index: a single frame is unpacked."""
    where, path = fs.FileSystem.from_uri(uri)
    with where.open_input_file(path) as f:
        return read_frame(f, seek_table(f)[frame])[offset:offset + length]


def revisits(pages: DataFrame, min_bytes=0) -> DataFrame:
    """page_id, refers_to of the pages whose payload another page holds.

    Only ids and digests move. A digest's rows are summed before the shuffle,
    and the way back is salted, so a payload that a third of all pages share
    stays spread out.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.sha1(payload).alias("sha"), F.octet_length(payload).alias("size")).filter(F.col("size") >= min_bytes)
    groups = rows.groupBy("sha", "size").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"), F.count("*").alias("n"))
    groups = groups.filter("n > 1 and refers_to is not null").select("sha", "size", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return rows.join(groups, ["sha", "size", "salt"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha", "refers_to").distinct()


def write(pages: DataFrame, folder: str, min_bytes=0, frame_bytes=1 << 18, bundle_bytes=1 << 26, level=3) -> DataFrame:
    """Writes the bundles and returns the index: bundle, record_id, frame, offset, length."""
    twins = revisits(short_batches(pages), min_bytes).withColumnRenamed("page_id", "_page").withColumnRenamed("sha", "_sha")
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    # page_id is the main key, so the payload's hash only tells repeated ids apart
    same = rows["page_id"].eqNullSafe(twins["_page"]) & (F.sha1(rows["html"]) == twins["_sha"])
    rows = rows.join(twins, same, "left").select("page_id", "url", "html", "refers_to")

    def put(batches):
        where, path = fs.FileSystem.from_uri(folder)
        where.create_dir(path)
        writer = None
        for b in pieces(batches, "html"):
            for page, url, html, other in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if writer is None:
                    name = f"part-{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(where.open_output_stream(f"{path}/{name}", compression=None), frame_bytes, level)
                writer.add(record_id(page), record(page, url, html.encode(), other))
                if writer.plain >= bundle_bytes:
                    yield closed(writer, f"{folder}/{name}")
                    writer = None
        if writer is not None:
            yield closed(writer, f"{folder}/{name}")

    def closed(writer, name):
        writer.close()
        cols = list(zip(*writer.index, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([name] * len(cols[0])), *(pa.array(c) for c in cols)], names=["bundle", "record_id", "frame", "offset", "length"])

    return durable(rows.mapInArrow(put, "bundle string, record_id string, frame long, offset long, length long"))


def read(spark, index: DataFrame) -> DataFrame:
    """Reads whole bundles back: page_id, payload_bytes, payload_digest, record_type, refers_to, url, intact."""
    number = lambda x: None if (got := x.strip("<>").rpartition(":")[2]) == "null" else int(got)

    def rows(bundle):
        where, path = fs.FileSystem.from_uri(bundle)
        with where.open_input_file(path) as f:
            for entry in seek_table(f):
                for fields, block in parse(read_frame(f, entry)):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    kind, stated = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                    intact = kind == "revisit" or (digest(payload) == stated and len(payload) == size)
                    yield (number(fields["WARC-Record-ID"]), size, stated, kind, number(fields["WARC-Refers-To"]) if kind == "revisit" else None,
                           fields.get("WARC-Target-URI"), intact)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, intact boolean"

    def get(batches):
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
        names = [x.split()[0] for x in schema.split(", ")]
        for b in batches:
            for bundle in b.column("bundle").to_pylist():
                cols = list(zip(*rows(bundle), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    bundles = durable(index.select("bundle").distinct())
    # names are a few bytes, so a count of tasks is stated; adaptive execution leaves a stated one alone
    return bundles.repartition(max(1, min(bundles.count(), MOST_TASKS)), "bundle").mapInArrow(get, schema)


def archive_folder(spark) -> str:
    """A new folder for archives below the cluster's shared one."""
    return f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
