"""Packing by powers of two: documents are cut into pieces whose lengths are powers of two, equal lengths share a bucket.

A document of n ids gives n // largest pieces of the largest length, then one piece for each one-bit of the rest, longest
first. Every piece is a sequence of its own, so none crosses documents and none needs padding; training takes batches from
one bucket at a time. Nothing is shuffled: pieces come out of the tasks that read the texts, and sequence numbers are
unique because each task counts in a range of its own.

Defined cases: a null text is an empty text and has the end id alone (one piece of length 1); rows with equal or null ids
stay rows of their own; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ByteLevel
from .common import filled, text_slices

LONGEST = 4096
PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, bucket int, "
          "sequence_id long, `offset` long")
# Sequence numbers a task may use.
_RANGE = 1 << 33


def cut(sizes: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """For documents of ``sizes`` ids: the document and the length of each piece, in order."""
    bits = longest.bit_length() - 1
    whole = sizes // longest
    powers = 1 << np.arange(bits - 1, -1, -1)
    rest = (sizes[:, None] & powers) > 0
    counts = np.concatenate([whole[:, None], rest.astype(np.int64)], axis=1)
    lengths = np.concatenate([[longest], powers])
    owner = np.repeat(np.arange(len(sizes)), counts.sum(axis=1))
    return owner, np.repeat(np.tile(lengths, len(sizes)), counts.ravel())


def pack(docs: DataFrame, encoder: Callable[[], ByteLevel], end_id: int, longest: int = LONGEST,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece; ``ids`` are its ids (little-endian, 32 bits), ``bucket`` the exponent of its length."""
    if longest & (longest - 1) or longest < 2:
        raise ValueError("the longest sequence must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number = None, TaskContext.get().partitionId() * _RANGE
        for batch in batches:
            for part in text_slices(batch, "text", 4 << 20):
                coder = coder or encoder()
                ids, sizes = coder.encode(filled(part.column("text")))
                ids = np.insert(ids, np.cumsum(sizes), end_id).astype("<u4")
                sizes = sizes + 1
                owner, lengths = cut(sizes, longest)
                ends = np.cumsum(lengths)
                first = np.cumsum(sizes) - sizes
                blob = pa.Array.from_buffers(pa.binary(), len(ends), [
                    None, pa.py_buffer((np.concatenate([[0], ends]) * 4).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(pa.array(owner)), pa.array(ends - lengths - first[owner]),
                    pa.array(lengths), blob, pa.array(sizes[owner]),
                    pa.array(np.log2(lengths).astype(np.int32)), pa.array(number + np.arange(len(ends))),
                    pa.array(np.zeros(len(ends), np.int64))],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "bucket", "sequence_id", "offset"])
                number += len(ends)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per length, for loaders that draw batches of one length."""
    pieces.write.partitionBy("bucket").parquet(path)
