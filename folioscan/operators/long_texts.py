"""Texts of any length, kept as parts: no value and no task holds a whole group.

Where a part starts is a running sum over narrow rows (``ordered``, safe for hot groups); texts are dealt by (group, part), so a
long group is put together in as many tasks as it has parts. Parts that follow each other, joined by the separator, are the text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .ordered import Running, ordered

PART_CHARS = 16_000_000


def text_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, sep: str,
               limit: int = PART_CHARS) -> DataFrame:
    """keys, start, n_pieces, n_chars and text of each part; ``start`` counts the characters of the whole text before it.

    A part takes the pieces that start in the same stretch of ``limit`` characters, so it is shorter than ``limit`` and one
    piece. ``order`` names a piece of its group once. Null pieces are none; null keys are a group; empty pieces keep their
    separator; other columns are not read; an empty table gives no parts.
    """
    names = [*keys, *order]
    rows = df.filter(F.col(text).isNotNull()).select(*names, text)
    sizes = durable(rows.select(*names, (F.length(text) + len(sep)).cast("bigint").alias("_size")))
    starts = ordered(sizes, keys, order).running(
        Running("_before", "sum", F.col("_size"), before=True)).result().select(*names, F.col("_before").cast("bigint"))
    starts = starts.toDF(*(f"_{n}" for n in names), "_before")
    placed = rows.join(starts, _same(names)).withColumn("_part", F.floor(F.col("_before") / limit))
    pieces = F.array_sort(F.collect_list(F.struct("_before", *order, text)))
    return placed.groupBy(*keys, "_part").agg(
        F.min("_before").alias("start"), F.count(F.lit(1)).alias("n_pieces"),
        F.array_join(F.transform(pieces, lambda r: r[text]), sep).alias(text)).select(
        *keys, "start", "n_pieces", F.length(text).cast("bigint").alias("n_chars"), text)


def _same(names: Sequence[str]) -> Column:
    """Nulls are equal to each other; the other side's names begin with one more line."""
    same = F.col(names[0]).eqNullSafe(F.col(f"_{names[0]}"))
    for n in names[1:]:
        same &= F.col(n).eqNullSafe(F.col(f"_{n}"))
    return same


def write_parts(parts: DataFrame, keys: Sequence[str], path: str) -> None:
    """Parts in files of consecutive stretches; ``read_text`` and the manifest read them without a shuffle of texts."""
    parts.repartitionByRange(*keys, "start").sortWithinPartitions(*keys, "start").write.mode("overwrite").parquet(path)


def manifest(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many parts, pieces and characters a whole text has; its parts' texts are not read."""
    return parts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_parts"), F.sum("n_pieces").alias("n_pieces"),
        F.max(F.col("start") + F.col("n_chars")).alias("n_chars"))


def read_text(parts: DataFrame, text: str, sep: str, **group: object) -> Iterator[str]:
    """One group's text, part by part in order; the caller holds one part at a time, never the whole."""
    for k, v in group.items():
        parts = parts.filter(F.col(k).eqNullSafe(F.lit(v)))
    for i, start in enumerate(r["start"] for r in parts.select("start").sort("start").toLocalIterator()):
        piece = parts.filter(F.col("start") == start).select(text).first()[text]
        yield sep + piece if i else piece
