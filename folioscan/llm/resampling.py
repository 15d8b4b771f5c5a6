"""Importance resampling towards a target corpus: hashed word n-grams, gains by bucket, Gumbel noise, exact top share.

Features are runs of one to ``width`` words; each falls into a bucket by the crc32 of its bytes. Counts of all documents and
of all target texts give every bucket a gain, the scaled log ratio of its smoothed shares. The table of gains has a fixed
number of entries, so it travels with the tasks as an array, and a document's weight is the mean of the entries its features
point at. Noise that depends on the id alone turns taking the highest scores into a draw without replacement.

The highest scores are found without sorting the table: the cut-off is bisected as a number, with exact counts over the
stored scores, four halvings to a job, then the id among the rows tied at that score. Only the drawn rows are range-
partitioned, for their ranks.

Defined cases: a null or empty text has no features and weight 0. Rows without an id have a weight but no score and no
part in the draw. Rows that share an id stand for themselves; alike ones are told apart by where they were stored. Other
columns are not read. Without target texts or documents the smoothed shares still hold; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import filled, stored, text_slices

# A-Z become lower case, other ASCII but letters and digits separates words, bytes of other letters stay.
_WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
HALVINGS = 4


@dataclass(frozen=True)
class Settings:
    """``percent`` of the documents of ``least_words`` or more are drawn; ``seed`` goes into the noise."""

    width: int = 2
    buckets: int = 10_000
    scale: int = 1000
    percent: int = 25
    least_words: int = 20
    seed: int = 7


def buckets_of(text: str, width: int, buckets: int) -> tuple[list[int], int]:
    """(bucket of every feature, number of words)."""
    words = text.encode().translate(_WORD_BYTES).split()
    sums = [crc32(w) for w in words]
    found = [c % buckets for c in sums]
    for n in range(1, width):
        # The checksum goes on from that of the shorter run.
        sums = [crc32(w, crc32(b" ", c)) for c, w in zip(sums, words[n:])]
        found += [c % buckets for c in sums]
    return found, len(words)


def features(rows: DataFrame, settings: Settings, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep``, n_words and the array of buckets."""
    width, buckets = settings.width, settings.buckets
    kinds = [rows.select(c).schema[0].dataType.simpleString() for c in keep]
    schema = ", ".join([f"`{c}` {k}" for c, k in zip(keep, kinds)] + ["n_words long", "buckets array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_text"):
                found = [buckets_of(t, width, buckets) for t in filled(part.column("_text")).to_pylist()]
                ends = np.cumsum([0] + [len(b) for b, _ in found], dtype=np.int32)
                flat = np.fromiter((b for bs, _ in found for b in bs), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep]
                    + [pa.array([n for _, n in found], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat))],
                    [*keep, "n_words", "buckets"])

    return rows.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def _counts(coded: DataFrame, name: str) -> DataFrame:
    return coded.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gains(source: DataFrame, target: DataFrame, settings: Settings) -> np.ndarray:
    """Gain of every bucket, from the features of all documents and of all target texts; ``buckets`` rows whatever the size."""
    everything = Window.partitionBy()
    counts = source.sparkSession.range(settings.buckets).withColumnRenamed("id", "bucket").join(
        _counts(source, "s"), "bucket", "left").join(_counts(target, "t"), "bucket", "left").select(
        "bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"])
    size = float(settings.buckets)
    ratio = ((F.col("t") + 1) * (F.sum("s").over(everything) + size)) / (
        (F.col("s") + 1) * (F.sum("t").over(everything) + size))
    rows = counts.select("bucket", F.floor(F.lit(float(settings.scale)) * F.log(ratio)).alias("gain")).collect()
    out = np.zeros(settings.buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["gain"]
    return out


def weighed(coded: DataFrame, table: np.ndarray, key: str) -> DataFrame:
    """``key``, n_words, n_features and the floored mean gain."""
    kind = coded.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(table[lists.flatten().to_numpy()])])
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("n_words"), pa.array(n),
                 pa.array((total[ends] - total[ends - n]) // np.maximum(n, 1))],
                [key, "n_words", "n_features", "weight"])

    return coded.mapInArrow(run, f"`{key}` {kind}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int, scale: int) -> Column:
    """Gumbel noise from the first 32 bits of a digest of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def cutoff(rows: DataFrame, wanted: int, columns: list[str]) -> list[int]:
    """Values that as many rows as wanted come up to, in ascending order of whole-number columns.

    Fewer columns than given come back when all rows tied so far are wanted. Each job counts exactly at all points the next
    halvings of the interval can ask for; no job returns more than one row.
    """
    found: list[int] = []
    for c in columns:
        low, high, n = rows.agg(F.min(c), F.max(c), F.count("*")).first()
        if n == wanted and found:
            break
        while low < high:
            marks = sorted({low + (high - low) * i // 2 ** HALVINGS for i in range(2 ** HALVINGS)})
            held = rows.agg(*[F.count_if(F.col(c) <= m) for m in marks]).first()
            enough = next((i for i, n in enumerate(held) if n >= wanted), len(marks))
            low, high = (low if enough == 0 else marks[enough - 1] + 1), (high if enough == len(marks) else marks[enough])
        wanted -= rows.filter(F.col(c) < low).count()
        found.append(low)
        rows = rows.filter(F.col(c) == low)
    return found


def up_to(columns: list[str], values: list[int]) -> Column:
    """Is the row at or before the values in lexicographic order?"""
    cases = [functools.reduce(operator.and_, [F.col(c) == v for c, v in zip(columns[:i], values)], F.lit(True))
             & (F.col(columns[i]) < v) for i, v in enumerate(values)]
    ties = functools.reduce(operator.and_, [F.col(c) == v for c, v in zip(columns, values)])
    return F.coalesce(functools.reduce(operator.or_, cases, ties), F.lit(False))


def ranked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Add rank (from 1): range-partitioned by the columns, numbered inside blocks, blocks shifted by those before."""
    n = F.monotonically_increasing_id()
    blocks = stored(rows.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_at", n).select(
        "*", F.shiftright("_at", 33).alias("_block")), "ranked")
    # One row a block.
    before = F.sum("n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    shift = blocks.groupBy("_block").agg(F.count("*").alias("n"), F.min("_at").alias("_from")).select(
        "_block", (F.coalesce(before, F.lit(0)) - F.col("_from") + 1).alias("_shift"))
    return blocks.join(F.broadcast(shift), "_block").withColumn("rank", F.col("_at") + F.col("_shift")).drop(
        "_at", "_block", "_shift")


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), key: str = "doc_id",
             text: str = "text") -> DataFrame:
    """``key``, n_features, weight, score and rank (null for rows not drawn) of every document."""
    spark = docs.sparkSession
    coded = stored(features(docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text)), settings, text,
                            (key,)), "features")
    table = gains(coded, features(target, settings, text), settings)
    score = F.col("weight") + noise(F.col(key), settings.seed, settings.scale)
    rows = stored(weighed(coded, table, key).select("*", score.alias("score")).select(
        "*", (-F.col("score")).alias("_loss"), F.monotonically_increasing_id().alias("_row")), "scores")
    fit = (F.col("n_words") >= settings.least_words) & F.col("score").isNotNull()
    able = rows.filter(fit)
    wanted = able.count() * settings.percent // 100
    columns = ["_loss", key, "_row"]
    shown = [key, "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return rows.select(*shown, none)
    taken = fit & up_to(columns, cutoff(able, wanted, columns))
    drawn = ranked(rows.filter(taken).select(*shown, "_loss", "_row"), columns)
    return drawn.select(*shown, "rank").unionAll(rows.filter(~taken).select(*shown, none))
