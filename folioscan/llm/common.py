"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path

SLICE_BYTES = 12 << 20
SALTS = 16


def text_slices(batch: pa.RecordBatch, column: str,
                limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds at most ``limit`` bytes of text, or one row; whole rows only."""
    sizes = text_bytes(batch.column(column))
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start, batch.num_rows - start)


def text_bytes(texts: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def filled(texts: pa.Array) -> pa.Array:
    """Null texts are empty texts."""
    import pyarrow.compute as pc

    return pc.fill_null(texts, "")


def ragged_take(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``index`` of a ragged array, one after the other, and the length of each."""
    sizes = offsets[index + 1] - offsets[index]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(offsets[index] - (ends - sizes), sizes)
    return flat[shift + np.arange(total)], sizes


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once in the shared folder and go on from the files: lineage ends here."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drawn(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """At most ``n`` rows, drawn by the hash of some columns; a sample to fit a model on.

    Rows are counted first, and all but about twice as many are dropped where they are read, so what is sorted does not
    grow with the table.
    """
    total, wanted, scale = rows.count(), 2 * n + 200, 1 << 30
    if total > wanted:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit(1), *by), F.lit(scale)) < int(wanted / total * scale))
    return rows.orderBy(F.xxhash64(*by), *by).limit(n)


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, salt: Column,
                  how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join many rows to a table with one row a key; a hot key's rows go to ``salts`` tasks.

    ``table`` should be narrow: each of its rows is repeated ``salts`` times.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def record_batches(rows: Iterable[dict], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)
