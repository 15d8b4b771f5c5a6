"""Hard negatives for anchors: rows of another label whose score lies in a window below that of a positive.

Components are quantised to whole numbers, so scores are exact and ties are ties. Anchors, a stated set, meet all rows in
cells of an anchor block and a shard of rows. What a cell finds is packed into one binary key

    anchor | descending score | positives first | id

and shuffled by anchor with the keys sorted inside partitions. One streaming pass then sees each anchor's rows from the
highest score down: a positive opens its window, every negative is held against the few windows open, and only counters are
kept. A window ends below its positive, so it is always open before its negatives come.

Two rounds keep the shuffle small without changing a result. The first shuffles what can be among an anchor's positives (the
best of every chunk of rows) and streams out the windows. The second shuffles the positives and, for each window, what can
be among its first negatives in the chunk. Both numbers are bounded for each chunk, so nothing grows with the rows of a label.

Defined cases: rows with a null id, label or vector, or a null or non-finite component (also after scaling) take no part;
vectors are compared with those of their own length. Zero vectors take part. Rows of one kind (same label as the anchor, or
another) that share id and score count once; of several anchor rows with one id the least by label, then vector, stands. Ties
go to the smaller id. Other columns are not read. Anchors without a positive, and positives without a negative in the window,
give no rows; so does an empty table. Scores that pass a 64-bit integer raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import matrix

KEY = 25
_KEYS = "key binary"
Emit = Callable[["Anchors", slice, np.ndarray, np.ndarray, "Chunk"], tuple]


@dataclass(frozen=True)
class Settings:
    """Windows are ``low`` to ``high`` percent of the positive's score; ``shard`` and ``block`` set the size of cells."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256
    shard: int = 16_384
    block: int = 16_384
    chunk: int = 8_192
    strip: int = 128


def bounds(score: int, settings: Settings) -> tuple[int, int]:
    """Whole scores s with low * score <= 100 * s <= high * score."""
    return -(-settings.low * score // 100), settings.high * score // 100


# Keys

def _ordered(values: np.ndarray) -> np.ndarray:
    """Eight bytes each that sort like the signed values."""
    return (values.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)


def _values(raw: np.ndarray) -> np.ndarray:
    return (np.ascontiguousarray(raw).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def pack_keys(anchor: np.ndarray, score: np.ndarray, negative: int, ids: np.ndarray) -> pa.Array:
    n = len(ids)
    raw = np.empty((n, KEY), np.uint8)
    raw[:, :8], raw[:, 8:16], raw[:, 16], raw[:, 17:] = _ordered(anchor), _ordered(~score), negative, _ordered(ids)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * KEY, KEY, dtype=np.int32)),
                                                  pa.py_buffer(raw.tobytes())])


def unpack_keys(keys: pa.Array) -> tuple[list[int], list[int], list[int], list[int]]:
    """anchors, scores, kinds, ids."""
    raw = np.frombuffer(b"".join(keys.to_pylist()), np.uint8).reshape(-1, KEY)
    return (_values(raw[:, :8]).tolist(), (~_values(raw[:, 8:16])).tolist(), raw[:, 16].tolist(),
            _values(raw[:, 17:]).tolist())


def sorted_keys(keys: DataFrame) -> DataFrame:
    """The secondary sort: dealt by the anchor's bytes, whole keys in order inside a partition."""
    return keys.repartition(F.substring("key", 1, 8)).sortWithinPartitions("key")


# Cells

@dataclass(frozen=True)
class Anchors:
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    scores: list[list[int]]


@dataclass(frozen=True)
class Chunk:
    """Rows of a shard in order of id; ``spare``: rows beyond one an id."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    spare: int

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Chunk:
        order = np.argsort(ids, kind="stable")
        ids, labels, vectors = ids[order], labels[order], vectors[order]
        if len(np.unique(ids)) < len(ids):
            # Rows repeated whole stand once.
            whole = sorted(set(zip(ids.tolist(), labels.tolist(), map(tuple, vectors.tolist()))))
            ids, labels = np.array([w[0] for w in whole], np.int64), np.array([w[1] for w in whole], np.int64)
            vectors = np.array([w[2] for w in whole], float).reshape(len(whole), vectors.shape[1])
        return cls(ids, labels, vectors, len(ids) - len(np.unique(ids)))


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole inner products times the number of rows, plus more for earlier rows: distinct, in order of (score, id)."""
    n = len(b)
    most = max(1.0, np.abs(a).max(initial=0)) * max(1.0, np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0 ** 53 and most * n < 2.0 ** 61:
        score = (a @ b.T).astype(np.int64)
    else:
        whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b)]
        score = whole[0] @ whole[1].T if a.shape[1] else np.zeros((len(a), n), object)
        if np.abs(score).max(initial=0) >= 1 << 61:
            raise OverflowError("scores pass a 64-bit integer")
    return score * n + np.arange(n - 1, -1, -1)


def cells(rows: DataFrame, anchors: DataFrame, emit: Emit, negative: int, settings: Settings) -> DataFrame:
    """Packed keys of what ``emit`` picks from each chunk of rows for a strip of anchors."""
    n_rows, n_anchors = rows.count(), anchors.count()
    shards, blocks = max(1, -(-n_rows // settings.shard)), max(1, -(-n_anchors // settings.block))
    deal = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # The part a row is read in goes into its shard, so that an id repeated many times is spread as well.
    spot = F.pmod(F.xxhash64("vec_id", F.spark_partition_id()), F.lit(shards)).cast("int")
    sides = ["dim", "shard", "block", "part", "vec_id", "label", "vector", "scores"]
    dim = F.size("vector").alias("dim")
    theirs = rows.select(dim, spot.alias("shard"), deal(blocks).alias("block"), F.lit(1).alias("part"), "vec_id", "label",
                         "vector", F.array().cast("array<long>").alias("scores")).select(*sides)
    ours = anchors.select(dim, deal(shards).alias("shard"),
                          F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("part"),
                          "vec_id", "label", "vector", "scores").select(*sides)
    place = ["dim", "shard", "block", "part"]

    def picked(held: Anchors, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk.of(*(np.concatenate(p) for p in zip(*parts)))
        n = len(chunk.ids)
        for start in range(0, len(held.ids), settings.strip):
            at = slice(start, start + settings.strip)
            ranks = _ranks(held.vectors[at], chunk.vectors)
            same = held.labels[at][:, None] == chunk.labels[None, :]
            anchor, rank = emit(held, at, ranks, same, chunk)
            if len(anchor):
                score, place = ((rank // n).astype(np.int64), n - 1 - (rank % n).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pack_keys(held.ids[at][anchor], score, negative, chunk.ids[place])], ["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, anchors_in, held, parts, size = None, [], None, [], 0
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in place], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(keys)]):
                part, where = batch.slice(start, end - start), tuple(keys[start][:3])
                if where != at:
                    if parts:
                        yield from picked(held, parts)
                    at, anchors_in, held, parts, size = where, [], None, [], 0
                values = (part.column("vec_id").to_numpy(), part.column("label").to_numpy(),
                          np.floor(settings.scale * vectors_of(part)))
                if keys[start][3] == 0:
                    anchors_in.append((*values, part.column("scores").to_pylist()))
                    continue
                if not anchors_in:
                    continue
                if held is None:
                    ids, labels, vectors, scores = zip(*anchors_in)
                    held = Anchors(np.concatenate(ids), np.concatenate(labels), np.concatenate(vectors), sum(scores, []))
                for first in range(0, len(values[0]), settings.chunk):
                    parts.append(tuple(v[first:first + settings.chunk] for v in values))
                    size += len(parts[-1][0])
                    if size >= settings.chunk:
                        yield from picked(held, parts)
                        parts, size = [], 0
        if parts:
            yield from picked(held, parts)

    return ours.unionAll(theirs).repartition("dim", "shard", "block").sortWithinPartitions(*place).mapInArrow(run, _KEYS)


def vectors_of(part: pa.RecordBatch) -> np.ndarray:
    """Rows of one length, which may be none."""
    column = part.column("vector")
    return matrix(column) if len(column.flatten()) else np.zeros((len(column), 0))


# What a chunk can add

def best_positives(settings: Settings) -> Emit:
    def emit(held: Anchors, at: slice, ranks: np.ndarray, same: np.ndarray, chunk: Chunk) -> tuple:
        other = chunk.ids[None, :] != held.ids[at][:, None]
        none = ranks.min() - 1
        ranks = np.where(same & other, ranks, none)
        k = min(settings.positives + chunk.spare, len(chunk.ids))
        top = np.partition(ranks, -k, axis=1)[:, -k:] if ranks.dtype != object else np.sort(ranks, axis=1)[:, -k:]
        found = top > none
        return np.nonzero(found)[0], top[found]

    return emit


def first_negatives(settings: Settings) -> Emit:
    def emit(held: Anchors, at: slice, ranks: np.ndarray, same: np.ndarray, chunk: Chunk) -> tuple:
        n, take = len(chunk.ids), settings.negatives + chunk.spare
        none = ranks.min() - 1
        ranks = np.sort(np.where(same, none, ranks), axis=1)
        anchors, found = [], []
        for i, (row, scores) in enumerate(zip(ranks, held.scores[at])):
            picks: set[int] = set()
            for score in scores:
                low, high = bounds(score, settings)
                end = int(np.searchsorted(row, high * n + n, "left"))
                picks.update(r for r in row[max(0, end - take):end].tolist() if r >= low * n and r > none)
            anchors += [i] * len(picks)
            found += picks
        return np.array(anchors, np.int64), np.array(found, ranks.dtype)

    return emit


# Streams over sorted keys

def _stream(keys: DataFrame, schema: str, names: list[str], kinds: list[pa.DataType], reader: Callable) -> DataFrame:
    arrow = pa.schema(list(zip(names, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = reader()
        for batch in batches:
            rows = [r for key in zip(*unpack_keys(batch.column("key"))) for r in seen(*key)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=arrow)

    return sorted_keys(keys).mapInArrow(run, schema)


def open_windows(keys: DataFrame, settings: Settings) -> DataFrame:
    """anchor_id, positive_id, positive_score: the first positives of each anchor."""
    most = settings.positives

    def reader():
        last, count = None, 0

        def see(anchor: int, score: int, kind: int, row: int) -> list[tuple]:
            nonlocal last, count
            if last == (anchor, score, row):
                return []
            count = count + 1 if last and last[0] == anchor else 1
            last = (anchor, score, row)
            return [(anchor, row, score)] if count <= most else []

        return see

    names = ["anchor_id", "positive_id", "positive_score"]
    return _stream(keys, ", ".join(f"{n} long" for n in names), names, [pa.int64()] * 3, reader)


def first_in_windows(keys: DataFrame, settings: Settings) -> DataFrame:
    """The first negatives in the window of each positive; at most ``positives`` counters are held."""
    most = settings.negatives

    def reader():
        last, windows = None, []

        def see(anchor: int, score: int, kind: int, row: int) -> list[tuple]:
            nonlocal last, windows
            if last == (anchor, score, kind, row):
                return []
            if last is None or last[0] != anchor:
                windows = []
            last = (anchor, score, kind, row)
            if kind == 0:
                windows.append([row, score, *bounds(score, settings), 0])
                return []
            out = []
            for w in windows:
                if w[4] < most and w[2] <= score <= w[3]:
                    w[4] += 1
                    out.append((anchor, w[0], w[4], row, w[1], score))
            return out

        return see

    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    kinds = [pa.int32() if n == "rank" else pa.int64() for n in names]
    return _stream(keys, ", ".join(f"{n} {'int' if n == 'rank' else 'long'}" for n in names), names, kinds, reader)


def _positive_keys(windows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            anchor, row, score = (b.column(c).to_numpy() for c in ("anchor_id", "positive_id", "positive_score"))
            yield pa.RecordBatch.from_arrays([pack_keys(anchor, score, 0, row)], ["key"])

    return windows.mapInArrow(run, _KEYS)


def mine(table: DataFrame, anchors: Column, settings: Settings = Settings(), key: str = "vec_id", label: str = "label",
         vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows that ``anchors`` holds for."""
    v = F.col("vector")
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                        F.col(vector).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    scaled = lambda x: F.lit(float(settings.scale)) * x.cast("double")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(scaled(x)) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~bad)
    asked = stored(rows.filter("asks").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("a")).select(
        "vec_id", "a.label", "a.vector", F.array().cast("array<long>").alias("scores")), "anchors")
    found = cells(rows, asked, best_positives(settings), 0, settings)
    windows = stored(open_windows(found, settings), "windows")
    scores = windows.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list("positive_score").alias("scores"))
    ready = stored(asked.drop("scores").join(scores, "vec_id"), "open-anchors")
    negatives = cells(rows, ready, first_negatives(settings), 1, settings)
    return first_in_windows(_positive_keys(windows).unionAll(negatives), settings)
