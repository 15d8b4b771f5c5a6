"""Token-id files: one array of ids, Elias-Fano coded document boundaries.

A file holds the ids of consecutive documents (16 bits an id where the vocabulary allows), the end of each document as an
Elias-Fano sequence and the document ids as another one; no 64-bit table. ``TokenFile`` opens one document by select
without reading the rest. Documents are dealt to tasks by ranges of their id, so files in order of (part, seq) hold them in
ascending order.

Defined cases: a null text is an empty text and has the end id alone; null document ids come first; rows with equal ids
stay rows of their own; an empty table gives no file and an empty manifest; other columns are not read.

Files go to the shared folder under names no other attempt has; the manifest, written as Parquet, names the ones that
count, so lost or repeated tasks leave nothing that is read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import fresh_path
from .chunks import ByteLevel
from .common import filled, stored, text_slices
from .elias_fano import EliasFano

MAGIC = b"TOKIDS01"
_HEAD = struct.Struct("<8sBQQQQqQ")
IDS_PER_FILE = 4 << 20
MANIFEST = "part int, seq int, path string, n_docs long, n_ids long"
READ = "doc_id long, start long, n_tokens long, ids binary"


def _open(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def pack_file(doc_ids: np.ndarray, n_null: int, ids: np.ndarray, sizes: np.ndarray, wide: bool) -> bytes:
    """One file's bytes. ``doc_ids`` ascend; the first ``n_null`` documents have none."""
    low = int(doc_ids[0]) if len(doc_ids) else 0
    ends = EliasFano.build(np.cumsum(sizes)).to_bytes()
    keys = EliasFano.build((doc_ids.astype(object) - low).astype(np.uint64)).to_bytes()
    head = _HEAD.pack(MAGIC, 4 if wide else 2, len(sizes), len(ids), len(ends), len(keys), low, n_null)
    return b"".join([head, ends, keys, ids.astype("<u4" if wide else "<u2").tobytes()])


class TokenFile:
    """Random access over one file; ids are read from the open file when asked for."""

    def __init__(self, file):
        self.file = file
        head = file.read(_HEAD.size)
        if len(head) < _HEAD.size or head[:8] != MAGIC:
            raise ValueError("not a token-id file")
        _, self.width, self.n_docs, self.n_ids, ends, keys, self.low, self.n_null = _HEAD.unpack(head)
        self.ends = EliasFano.from_bytes(file.read(ends))
        self.keys = EliasFano.from_bytes(file.read(keys))
        self.first = _HEAD.size + ends + keys
        if file.size() != self.first + self.n_ids * self.width:
            raise ValueError("token-id file has another length than its header says")

    def __len__(self) -> int:
        return self.n_docs

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.low + self.keys.select(i - self.n_null)

    def doc_ids(self, i: int, j: int) -> pa.Array:
        """Document ids of a stretch; those without one come first in the file."""
        none = max(0, min(j, self.n_null) - i)
        # Differences to the lowest id, added in 64 bits that wrap around.
        named = self.keys.stretch(max(0, i - self.n_null), j - self.n_null) + np.uint64(self.low % (1 << 64))
        return pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(named.view(np.int64), pa.int64())])

    def ids(self, start: int, end: int) -> np.ndarray:
        self.file.seek(self.first + start * self.width)
        return np.frombuffer(self.file.read((end - start) * self.width), f"<u{self.width}").astype("<u4")

    def document(self, i: int) -> np.ndarray:
        return self.ids(*self.bounds(i))


def write(docs: DataFrame, encoder: Callable[[], ByteLevel], end_id: int, vocabulary: int,
          key: str = "doc_id", text: str = "text", ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """Write the files below the shared folder; returns the manifest."""
    folder = fresh_path(docs.sparkSession, "token-ids")
    wide = vocabulary > 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _open(folder)
        coder, part, rows = None, TaskContext.get().partitionId(), []
        keys: list[int | None] = []
        held_ids: list[np.ndarray] = []
        held_sizes: list[np.ndarray] = []

        def close() -> None:
            ids, sizes = np.concatenate(held_ids), np.concatenate(held_sizes)
            n_null = sum(k is None for k in keys)
            named = np.array([k for k in keys if k is not None], np.int64)
            path = f"{root}/{part:06d}-{len(rows):06d}-{uuid.uuid4().hex}.ids"
            filesystem.create_dir(root, recursive=True)
            with filesystem.open_output_stream(path) as out:
                out.write(pack_file(named, n_null, ids, sizes, wide))
            rows.append((part, len(rows), f"{folder}/{path.rsplit('/', 1)[1]}", len(sizes), len(ids)))
            keys.clear(), held_ids.clear(), held_sizes.clear()

        count = 0
        for batch in batches:
            for piece in text_slices(batch, "text", 10 << 20):
                coder = coder or encoder()
                ids, sizes = coder.encode(filled(piece.column("text")))
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, end_id)
                sizes = sizes + 1
                keys.extend(piece.column("doc_id").to_pylist())
                held_ids.append(ids.astype(np.uint32 if wide else np.uint16))
                held_sizes.append(sizes)
                count += len(ids)
                if count >= ids_per_file:
                    close()
                    count = 0
        if keys:
            close()
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                ["part", "seq", "path", "n_docs", "n_ids"])

    # Rows that share an id, or have none, are dealt by where they were read.
    ordered = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"),
                          F.monotonically_increasing_id().alias("at")).repartitionByRange(
        "doc_id", "at").sortWithinPartitions("doc_id", "at")
    return stored(ordered.mapInArrow(run, MANIFEST), "token-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Documents back from the files: id, ids before it over all files, number of ids, ids (little-endian, 32 bits).

    The running start is a window over one row a file.
    """
    spark = manifest.sparkSession
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    tasks = max(1, min(manifest.count(), int(spark.conf.get("spark.sql.shuffle.partitions")) * 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns)):
                filesystem, name = _open(path)
                with filesystem.open_input_file(name) as file:
                    yield from documents(TokenFile(file), base)

    return placed.repartition(tasks).mapInArrow(run, READ)


def documents(file: TokenFile, base: int, group: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """All documents of a file, about ``group`` ids at a time.

    Where a group ends is bisected over ``select``; ends and ids of its documents are read from their stretch of the code.
    """
    i, start = 0, 0
    while i < len(file):
        j = max(i + 1, file.ends.reach(start + group, i, min(len(file), i + group)))
        ends = file.ends.stretch(i, j).astype(np.int64)
        bounds = np.concatenate([[start], ends])
        keys = file.doc_ids(i, j)
        blob = pa.Array.from_buffers(pa.binary(), j - i, [
            None, pa.py_buffer(((bounds - start) * 4).astype(np.int32)), pa.py_buffer(file.ids(start, int(ends[-1])))])
        yield pa.RecordBatch.from_arrays(
            [keys, pa.array(bounds[:-1] + base), pa.array(np.diff(bounds)), blob], ["doc_id", "start", "n_tokens", "ids"])
        i, start = j, int(ends[-1])


def load(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")
