"""WARC archives as seekable Zstandard bundles.

Every task packs the records of its rows into bundles: files of independent
Zstandard frames, each with whole records, closed by a skippable frame with the
seek table (sizes and checksums of all frames). The index, written beside them,
maps a record to its bundle, its frame and its place inside the frame, so that
one frame is enough to read it. A bundle's name is new in every task attempt and
only bundles of attempts that Spark committed are in the index; files of lost
attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbook.session import ensure_checkpoint_dir, materialize

#: Uncompressed bytes of records after which a frame, and compressed bytes after which a bundle, is closed.
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 1 << 28
LEAST_REVISIT = 1000
#: Frames that a task reads back, about.
FRAMES_A_TASK = 32

#: Fixed values of the seekable format: frame magic, footer magic, descriptor with checksums.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
WITH_CHECKSUMS = 0x80
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<III")

INDEX = "record_id string, page string, bundle string, frame int, place int, length int"
READ = ("page string, record_id string, url string, record_type string, refers_to string, payload binary, "
        "payload_bytes long, payload_digest string")


def filesystem(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder that driver and executors share."""
    if folder.startswith("/") or folder.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), re.sub(r"^file:/*", "/", folder)
    return pyarrow.fs.FileSystem.from_uri(folder)


def record_id(page: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}')}>"


def to_record(page: str | None, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to: str | None, date: str) -> bytes:
    """One WARC record; a revisit has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else quote(url, safe=" !\"#$%&'()*+,/:;<=>?@[\\]^_`{|}~-.")),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Refers-To", record_id(refers_to, digest) if revisit else None),
        ("Page-Id", page), ("Refers-To-Page", refers_to if revisit else None), ("Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: memoryview, at: int) -> tuple[dict, int]:
    """The record at a place of a frame, and where the next one begins."""
    end = bytes(data[at:at + 65536]).find(b"\r\n\r\n")
    end = at + end if end >= 0 else bytes(data[at:]).index(b"\r\n\r\n") + at
    fields = dict(line.split(": ", 1) for line in bytes(data[at:end]).decode().split("\r\n")[1:])
    start, size = end + 4, int(fields["Content-Length"])
    block = bytes(data[start:start + size])
    stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    record = {
        "page": fields.get("Page-Id"), "record_id": fields["WARC-Record-ID"], "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"], "refers_to": fields.get("Refers-To-Page"), "payload": None,
        "payload_bytes": int(fields["Payload-Length"]), "payload_digest": stated,
    }
    if record["record_type"] == "response":
        payload = block[block.index(b"\r\n\r\n") + 4:]
        found = hashlib.sha1(payload).hexdigest()
        if found != stated or len(payload) != record["payload_bytes"]:
            raise ValueError(f"record {record['record_id']} is damaged")
        record |= {"payload": payload, "payload_digest": found, "payload_bytes": len(payload)}
    return record, start + size + 4


class Bundle:
    """A file of frames; ``close`` appends the seek table."""

    def __init__(self, folder: str):
        system, path = filesystem(folder)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.file = system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.compress = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        self.entries: list[bytes] = []
        self.size = 0

    def add(self, frame: bytes) -> int:
        packed = self.compress(frame)
        self.file.write(packed)
        self.entries.append(ENTRY.pack(len(packed), len(frame), xxhash.xxh64_intdigest(frame) & 0xFFFFFFFF))
        self.size += len(packed)
        return len(self.entries) - 1

    def close(self) -> None:
        table = b"".join(self.entries) + FOOTER.pack(len(self.entries), WITH_CHECKSUMS, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.file.close()


class Reader:
    """Frames of a bundle by number, through its seek table."""

    def __init__(self, folder: str, name: str):
        system, path = filesystem(folder)
        self.file = system.open_input_file(f"{path}/{name}")
        self.file.seek(self.file.size() - FOOTER.size)
        count, descriptor, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != SEEKABLE or descriptor != WITH_CHECKSUMS:
            raise ValueError(f"{name} has no seek table")
        self.file.seek(self.file.size() - FOOTER.size - count * ENTRY.size)
        self.entries = list(ENTRY.iter_unpack(self.file.read(count * ENTRY.size)))
        self.starts = [0]
        for packed, _, _ in self.entries:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, number: int) -> bytes:
        packed, size, checksum = self.entries[number]
        self.file.seek(self.starts[number])
        data = zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=size)
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {number} is damaged")
        return data


def roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
          least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """(page, url, payload, digest, revisit, refers_to) per row: which records repeat the payload of another."""
    payload = F.coalesce(F.col(body_col).cast("binary"), F.lit(b"").cast("binary"))
    plain = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn(
        "digest", F.sha1("payload"))
    copies = (
        plain.filter(F.octet_length("payload") >= least_revisit).groupBy("digest")
        .agg(F.max("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("digest", "first_id")
    )
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    return plain.join(copies, "digest", "left").select(
        F.col("id").cast("string").alias("page"), "url", "payload", "digest", revisit.alias("revisit"),
        F.when(revisit, F.col("first_id")).cast("string").alias("refers_to"))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
          frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of ``pages`` under ``folder``, which all executors reach, and return the written index.

    A null payload counts as empty. Of rows with equal payloads of 1000 bytes or
    more, those with the largest id are responses and the others revisits of it;
    rows that repeat that id with the same payload are responses too. A null id
    or url leaves its field out. A payload longer than a frame has a frame of its
    own. An empty table writes nothing. The index has ``INDEX``'s columns.
    """
    system, path = filesystem(folder)
    system.create_dir(path, recursive=True)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle, waiting, places = None, bytearray(), []

        def flush() -> pd.DataFrame:
            nonlocal bundle, waiting, places
            bundle = bundle or Bundle(folder)
            frame = bundle.add(bytes(waiting))
            out = pd.DataFrame([(r, p, bundle.name, frame, at, n) for r, p, at, n in places],
                               columns=["record_id", "page", "bundle", "frame", "place", "length"])
            waiting, places = bytearray(), []
            if bundle.size >= bundle_bytes:
                bundle.close()
                bundle = None
            return out

        for batch in batches:
            for row in batch.itertuples(index=False):
                record = to_record(row.page, row.url, row.payload, row.digest, row.revisit, row.refers_to, date)
                if waiting and len(waiting) + len(record) > frame_bytes:
                    yield flush()
                places.append((record_id(row.page, row.digest), row.page, len(waiting), len(record)))
                waiting += record
        if places:
            yield flush()
        if bundle:
            bundle.close()

    return materialize(roles(pages, id_col, url_col, body_col).mapInPandas(pack, INDEX))


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """All records of the bundles that ``index`` names, frame by frame (``READ``'s columns)."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, name = None, None
        for batch in batches:
            for row in batch.sort_values(["bundle", "frame"]).itertuples(index=False):
                if row.bundle != name:
                    reader, name = Reader(folder, row.bundle), row.bundle
                data, at, records = memoryview(reader.frame(row.frame)), 0, []
                while at < len(data):
                    record, at = parse_record(data, at)
                    records.append(record)
                yield pd.DataFrame(records)

    frames = index.select("bundle", "frame").distinct()
    frames = frames.repartitionByRange(max(1, -(-frames.count() // FRAMES_A_TASK)), "bundle", "frame")
    return frames.mapInPandas(unpack, READ)


def fetch(index: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """The records whose record_id is in ``wanted``: only their frames are read."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (bundle, frame), rows in batch.groupby(["bundle", "frame"]):
                data = memoryview(Reader(folder, bundle).frame(frame))
                yield pd.DataFrame([parse_record(data, at)[0] for at in rows.place])

    return index.join(wanted.select("record_id").distinct(), "record_id", "left_semi").mapInPandas(unpack, READ)


def archive_folder(spark) -> str:
    """A new folder for bundles in the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/warc/{uuid.uuid4().hex}"
