"""Greedy packing of ordered episodes into parts of bounded duration, for books of any size.

Where a part starts depends on everything before it in the book. Ordinary books are packed in one
go, batch after batch. A hot book, cut into blocks, is packed block by block in parallel from a guessed
carry (time already in the open part); guesses are corrected until every block's carry equals
what the block before it really leaves. Most blocks forget their carry at the first cut, so two
or three rounds are usual; the result is exact after any number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed as K
from .ordered import BLOCK, Ordered, ordered


def _cuts(ms: np.ndarray, limit: int, carry: int) -> tuple[np.ndarray, int]:
    """Part number of each row relative to the open part, and the time left in the last part.

    ``carry`` is -1 where no part is open yet, so the first row never cuts.
    """
    n = len(ms)
    total = np.concatenate([[0], np.cumsum(ms)])
    part = np.zeros(n, dtype=np.int64)
    at, number, room = 0, 0, limit - max(carry, 0)
    opened = carry >= 0
    while at < n:
        end = int(np.searchsorted(total, total[at] + room, side="right")) - 1
        # A new part takes its first row whatever its size; an overfull open part takes none.
        end = min(max(end, at if opened else at + 1), n)
        part[at:end] = number
        if end == n:
            base = (limit - room) + int(total[n] - total[at])
            return part, base
        at, number, room, opened = end, number + 1, limit, False
    return part, max(carry, 0)


def _runs(keys: pd.DataFrame) -> list[tuple[int, int]]:
    """Start and end of each stretch of equal keys in consecutive rows."""
    changed = (keys != keys.shift()).any(axis=1).to_numpy()
    starts = np.flatnonzero(changed).tolist()
    return list(zip(starts, [*starts[1:], len(keys)]))


def pack_parts(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], duration: str,
               max_hours: float = K.PART_HOURS) -> DataFrame:
    """Add ``part_no`` (from 1): an episode opens a new part when it would overflow this one.

    An episode over the limit stands alone; unknown durations count as zero.
    """
    limit = int(max_hours * 3600 * 1000)
    ms = F.floor(F.coalesce(F.greatest(F.col(duration), F.lit(0.0)), F.lit(0.0)) * 1000
                 ).cast("bigint")
    sheet = ordered(df.withColumn("_ms", ms), keys, order)
    rows, names = sheet.rows(), [*sheet.keys, BLOCK]
    carries = None if sheet.blocks is None else _settle(sheet, limit)
    if carries is None:
        rows = rows.withColumns({"_carry": F.lit(-1).cast("bigint"),
                                 "_before": F.lit(0).cast("bigint")})
    else:
        rows = rows.join(F.broadcast(carries), names, "left").withColumns({
            "_carry": F.coalesce("_carry", F.lit(-1)), "_before": F.coalesce(
                "_before", F.lit(0))})
    kept = [c for c in df.columns if c != "_ms"]
    schema = T.StructType([rows.schema[c] for c in kept] + [
        T.StructField("part_no", T.LongType())])

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Groups lie one after another; one that goes on in the next batch keeps its open part.
        last, carry, number = None, -1, 1
        for pdf in batches:
            out = np.empty(len(pdf), dtype=np.int64)
            for start, end in _runs(pdf[names]):
                head = pdf.iloc[start]
                key = tuple(head[n] for n in names)
                if key != last:
                    last, carry, number = key, int(head["_carry"]), int(head["_before"]) + 1
                part, carry = _cuts(pdf["_ms"].to_numpy()[start:end], limit, carry)
                out[start:end] = number + part
                number = int(out[end - 1])
            yield pdf[kept].assign(part_no=out)

    return _in_order(rows, sheet).mapInPandas(fill, schema)


def _in_order(rows: DataFrame, sheet: Ordered) -> DataFrame:
    """Every block in one task, its rows in order; tasks hold many blocks but one batch at a time."""
    names = [*sheet.keys, BLOCK]
    return rows.repartition(*names).sortWithinPartitions(*names, *sheet.order)


def _settle(sheet: Ordered, limit: int) -> DataFrame | None:
    """Carry and part count at the start of every block that continues a book.

    Works only on books that span blocks. What reaches the driver is one short row per
    (book, block) of those: at most twice the number of partitions.
    """
    spark, names = sheet.blocks.sparkSession, [*sheet.keys, BLOCK]
    totals = sheet.blocks.groupBy(*names).agg(F.sum("_ms").alias("total"))
    spans = totals.groupBy(*sheet.keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    chain = totals.join(F.broadcast(spans), list(sheet.keys)).orderBy(*names).collect()
    if not chain:
        return None
    fields = [sheet.blocks.schema[n] for n in names]
    asks = T.StructType([*fields, T.StructField("_carry", T.LongType())])
    replies = T.StructType([*asks.fields, T.StructField("left", T.LongType()),
                            T.StructField("cuts", T.LongType())])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_group: dict | None = None
        for pdf in batches:
            done = []
            for start, end in _runs(pdf[names]):
                head = pdf.iloc[start]
                key = {n: head[n] for n in names}
                if open_group is None or any(open_group[n] != key[n] for n in names):
                    if open_group:
                        done.append(open_group)
                    open_group = {**key, "_carry": int(head["_carry"]),
                                  "left": int(head["_carry"]), "cuts": 0}
                part, left = _cuts(pdf["_ms"].to_numpy()[start:end], limit, open_group["left"])
                open_group["left"] = left
                open_group["cuts"] += int(part[-1])
            yield pd.DataFrame(done, columns=replies.names)
        if open_group:
            yield pd.DataFrame([open_group], columns=replies.names)

    known: dict[tuple, tuple[int, int]] = {}
    while True:
        asked, walk, last, carry, before = [], [], None, -1, 0
        for row in chain:
            block = tuple(row[n] for n in names)
            if block[:-1] != last:
                last, carry, before = block[:-1], -1, 0
            walk.append((*block, carry, before))
            if carry >= 0 and carry + row["total"] <= limit:
                carry += row["total"]
                continue
            hit = known.get((block, carry))
            if hit is None:
                asked.append((*block, carry))
                # Any earlier answer for the block is the best guess of what it leaves.
                hit = known.get((block, None), (max(carry, 0), 0))
            carry, before = hit[0], before + hit[1]
        if not asked:
            break
        wanted = F.broadcast(spark.createDataFrame(asked, asks))
        answers = _in_order(sheet.blocks.join(wanted, names), sheet).mapInPandas(measure, replies)
        for a in answers.collect():
            block = tuple(a[n] for n in names)
            known[block, a["_carry"]] = known[block, None] = (a["left"], a["cuts"])
    schema = T.StructType([*asks.fields, T.StructField("_before", T.LongType())])
    return spark.createDataFrame(walk, schema)
