"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame per record.

Writing: pages with equal payloads are found by digest; the one with the smallest id becomes a response, the others revisit
it. Each task writes archives of bounded size, with a dictionary trained on the archive's own first records. Reading: the
dictionary is taken from the skippable frame (where it may be compressed), every frame must hold exactly one record, and
version line, headers, lengths and digests are checked; what does not hold raises ``ArchiveError``.

Defined cases: null html is an empty payload; a null url is written without a target; line breaks and spaces in a url are
percent-encoded in the header; rows that share the smallest page id of a payload are all responses; payloads shorter than
``least`` bytes are always responses; a null page id is written without a name, counts as largest and is never revisited;
an empty table gives no archive.

Archives go to the shared folder under names no other attempt has; the manifest says which count.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path
from .common import salted_lookup, stored, text_slices

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1"
DATE = "2000-01-01T00:00:00Z"
NAME = "urn:page:"
MANIFEST = "part int, seq int, path string, n_records long"
RECORDS = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
           "payload_digest string, payload binary")
ARCHIVE_BYTES = 32 << 20
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 64 << 10


class ArchiveError(ValueError):
    """An archive breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_header(url: str) -> str:
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A record's bytes. A revisit keeps the HTTP header, whose Content-Length tells the size of the payload it leaves out."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    name = f"{NAME}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"),
              ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", url_header(url)))
    fields.append(("WARC-Payload-Digest", "sha1:" + digest(payload)))
    fields.append(("WARC-Block-Digest", "sha1:" + digest(block)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{NAME}{refers_to}>"),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def split_head(data: bytes, what: str) -> tuple[str, dict[str, str], bytes]:
    """First line, headers by lower-case name, and what follows the empty line."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        raise ArchiveError(f"{what}: headers do not end")
    first, *lines = head.decode().split("\r\n")
    fields: dict[str, str] = {}
    for line in lines:
        key, colon, value = line.partition(":")
        if not colon or not key.strip():
            raise ArchiveError(f"{what}: bad header line {line[:80]!r}")
        if key.strip().lower() in fields:
            raise ArchiveError(f"{what}: {key} stands twice")
        fields[key.strip().lower()] = value.strip()
    return first, fields, rest


def number(fields: dict[str, str], key: str) -> int:
    value = fields.get(key, "")
    if not value.isascii() or not value.isdigit():
        raise ArchiveError(f"bad {key} {value!r}")
    return int(value)


def parse(data: bytes) -> dict:
    """A record's values from its bytes, after every check."""
    version, fields, rest = split_head(data, "record")
    if version.encode() not in (VERSION, b"WARC/1.0"):
        raise ArchiveError(f"bad version line {version[:40]!r}")
    for key in ("warc-type", "warc-record-id", "warc-date"):
        if not fields.get(key):
            raise ArchiveError(f"no {key}")
    size = number(fields, "content-length")
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ArchiveError("block is not as long as Content-Length says")
    block = rest[:size]
    if "sha1:" + digest(block) != fields.get("warc-block-digest", "sha1:" + digest(block)):
        raise ArchiveError("block digest differs")
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        raise ArchiveError(f"unknown record type {kind!r}")
    status, http, payload = split_head(block, "HTTP")
    if not status.startswith("HTTP/"):
        raise ArchiveError("block is no HTTP message")
    length = number(http, "content-length")
    algorithm, _, expected = fields.get("warc-payload-digest", "").partition(":")
    if algorithm != "sha1" or len(expected) != 32:
        raise ArchiveError("bad payload digest")
    refers = None
    if kind == "response":
        if len(payload) != length or digest(payload) != expected:
            raise ArchiveError("payload differs from its length or digest")
    else:
        if payload:
            raise ArchiveError("a revisit holds a payload")
        refers = page_of(fields.get("warc-refers-to", ""))
        if refers is None:
            raise ArchiveError("a revisit refers to no record")
    return {"page_id": page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind,
            "refers_to": refers, "payload_bytes": length, "payload_digest": expected,
            "payload": payload if kind == "response" else None}


def page_of(name: str) -> int | None:
    if not (name.startswith("<") and name.endswith(">")):
        raise ArchiveError(f"bad record name {name[:60]!r}")
    return int(name[1 + len(NAME):-1]) if name[1:].startswith(NAME) else None


def compress(records: list[bytes]) -> Iterator[bytes]:
    """An archive's parts: the skippable frame, then a frame for each record."""
    import zstandard

    held, sample = 0, []
    for r in records:
        if held >= SAMPLE_BYTES:
            break
        sample.append(r)
        held += len(r)
    try:
        trained = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, held // 16)), sample, k=512, d=8, level=3)
    except zstandard.ZstdError:
        # Too little to train on: records as they are serve as dictionary.
        trained = zstandard.ZstdCompressionDict(b"".join(sample)[:1024] or VERSION, zstandard.DICT_TYPE_RAWCONTENT)
    body = zstandard.ZstdCompressor(level=3).compress(trained.as_bytes())
    yield struct.pack("<II", SKIPPABLE, len(body)) + body
    writer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
    for r in records:
        yield writer.compress(r)


def frames(file, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Contents of the frames of an open archive, one after the other."""
    import zstandard

    head = file.read(8)
    if len(head) < 8:
        raise ArchiveError("no leading frame")
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise ArchiveError("no dictionary in the leading frame")
    raw = file.read(size)
    if len(raw) != size:
        raise ArchiveError("the dictionary is cut off")
    try:
        if raw[:4] == struct.pack("<I", FRAME):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        data = file.read(chunk)
        while data:
            frame, parts = reader.decompressobj(), []
            while not frame.eof:
                if not data:
                    raise ArchiveError("the last frame is cut off")
                parts.append(frame.decompress(data))
                data = frame.unused_data if frame.eof else b""
                data = data or file.read(chunk)
            yield b"".join(parts)
    except zstandard.ZstdError as e:
        raise ArchiveError(str(e)) from e


def decide(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html with ``refers_to``: the smallest page id of the same payload, null for responses."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("_sum", F.unhex(F.sha1(F.col("html").cast("binary"))))
    first = rows.select("_sum", "page_id").groupBy("_sum").agg(F.min("page_id").alias("_first"))
    found = salted_lookup(rows, first, "_sum", F.struct("page_id", "url"))
    revisit = (F.octet_length("html") >= least) & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return found.select("page_id", "url", "html", F.when(revisit, F.col("_first")).alias("refers_to"))


def write(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the archives below the shared folder; returns their manifest."""
    folder = fresh_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        filesystem, root = FileSystem.from_uri(folder)
        part, rows, held, size = TaskContext.get().partitionId(), [], [], 0

        def close() -> None:
            name = f"{part:06d}-{len(rows):06d}-{uuid.uuid4().hex}.warc.zst"
            filesystem.create_dir(root, recursive=True)
            with filesystem.open_output_stream(f"{root}/{name}") as out:
                for frame in compress(held):
                    out.write(frame)
            rows.append({"part": part, "seq": len(rows), "path": f"{folder}/{name}", "n_records": len(held)})
            held.clear()

        for batch in batches:
            for piece in text_slices(batch, "html"):
                for page_id, url, html, refers in zip(*(c.to_pylist() for c in piece.columns)):
                    held.append(record(page_id, url, html.encode(), refers))
                    size += len(held[-1])
                    if size >= ARCHIVE_BYTES:
                        close()
                        size = 0
        if held:
            close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_records", pa.int64())]))

    return stored(decide(pages, least).mapInArrow(run, MANIFEST), "warc-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """All records of the archives; ``payload`` is null for revisits."""
    spark = manifest.sparkSession
    tasks = max(1, min(manifest.count(), int(spark.conf.get("spark.sql.shuffle.partitions")) * 4))
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for path, expected in zip(*(c.to_pylist() for c in batch.columns)):
                filesystem, name = FileSystem.from_uri(path)
                count, held, size = 0, [], 0
                with filesystem.open_input_stream(name) as file:
                    for data in frames(file):
                        held.append(parse(data))
                        count, size = count + 1, size + len(data)
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)
                if count != expected:
                    raise ArchiveError(f"{path} holds {count} records, not {expected}")

    return manifest.select("path", "n_records").repartition(tasks).mapInArrow(run, RECORDS)
