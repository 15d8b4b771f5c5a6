"""Nearest neighbours by inner product: multi-index hashing over learned rotated binary codes, floats decide.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, so that the largest inner product is the
smallest angle. Codes are signs after rotations that iterative quantisation learns on a bounded sample; the index then
covers every row. Codes are split into substrings, each with its own table of buckets. To find every code within Hamming
radius R, each of m substrings is probed within floor(R / m): by the pigeonhole principle one of them must be that close.
Vectors of the codes found are then ranked by the inner product in double precision.

First, substrings about as wide as the logarithm of the table (at most 16 bits) are keys that Spark deals out: rows by their
values, queries by the values within ``flips`` bits of theirs. A unit of work holds the buckets of many values; a bucket
larger than a unit is split. A pair that meets in several substrings counts in the first. Queries that find ``enough`` codes
within m * (flips + 1) - 1 bits are answered there.

Others have no near codes: their radius grows beyond what single buckets hold. For them the index is dealt in shards of
bounded size and queries in blocks; in a cell of the two the radius grows, one more bit per byte at a time, until it holds
``wanted`` codes of the shard. When the buckets to probe hold more entries than the shard has codes, the shard's codes are
compared directly: the same set comes out.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do vectors of
another length than most; rows with a null id take no part; the query's own id is never a candidate; ties go to the
smaller id; an empty table gives no rows; fewer candidates than ``k`` are all given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drawn, stored
from .vectors import kind_of, matrix, usable

_BITS = np.array([bin(b).count("1") for b in range(256)], np.uint8)


@dataclass(frozen=True)
class Settings:
    """``sample`` rows train the rotations; ``wanted`` codes a shard are reranked for queries that probing did not answer.

    ``unit`` entries of a substring's table go together, ``pairs`` are compared at once.
    """

    k: int = 20
    sample: int = 10_000
    rotations: int = 4
    rounds: int = 20
    wanted: int = 512
    shard: int = 8192
    queries: int = 4096
    flips: int = 1
    enough: int = 80
    unit: int = 8192
    pairs: int = 1 << 18


@dataclass(frozen=True)
class Coder:
    """Signs of ``(x - mean) @ rotation``; ``norm`` is the largest norm of all rows."""

    norm: float
    mean: np.ndarray
    rotation: np.ndarray

    def extend(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        rest = np.zeros(len(vectors)) if query else np.sqrt(
            np.maximum(self.norm ** 2 - (vectors ** 2).sum(axis=1), 0))
        return np.concatenate([vectors, rest[:, None]], axis=1)

    def codes(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Bytes of the code, one substring a byte."""
        x = self.extend(vectors, query)
        if query:
            # A query's length does not matter; give it the length all rows have.
            x = x * (self.norm / np.linalg.norm(x, axis=1, keepdims=True))
        return np.packbits((x - self.mean) @ self.rotation > 0, axis=1)


def learn(sample: np.ndarray, norm: float, settings: Settings) -> Coder:
    """Iterative quantisation, from several random starts that are put side by side."""
    coder = Coder(norm, np.zeros(sample.shape[1] + 1), np.zeros((0, 0)))
    x = coder.extend(sample, query=False)
    mean = x.mean(axis=0)
    x = x - mean
    d = x.shape[1]
    rng = np.random.default_rng(11)
    parts = []
    for _ in range(settings.rotations):
        turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(settings.rounds):
            z = x @ turn
            u, _, v = np.linalg.svd(x.T @ np.where(z > 0, 1.0, -1.0))
            turn = u @ v
        parts.append(turn)
    rotation = np.concatenate(parts, axis=1)
    return Coder(norm, mean, rotation[:, : rotation.shape[1] // 8 * 8])


class MultiIndex:
    """One table a substring (a byte): codes sorted by their value there."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.starts = np.stack([np.searchsorted(codes[self.order[:, s], s], np.arange(257))
                                for s in range(codes.shape[1])])
        self.masks = [np.array([sum(1 << b for b in c) for c in combinations(range(8), t)], np.int64) for t in range(9)]

    def distances(self, code: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        return _BITS[(self.codes if rows is None else self.codes[rows]) ^ code].sum(axis=1, dtype=np.int64)

    def within(self, code: np.ndarray, wanted: int) -> np.ndarray:
        """Every code within the smallest radius m * (t + 1) - 1 that holds ``wanted`` codes (or all there are)."""
        n, m = self.codes.shape
        seen: list[np.ndarray] = []
        entries = 0
        for t in range(9):
            probes = code.astype(np.int64)[:, None] ^ self.masks[t][None, :]
            first, last = (self.starts[np.arange(m)[:, None], probes + e] for e in (0, 1))
            entries += int((last - first).sum())
            if entries >= n:
                far = self.distances(code)
                if wanted >= n:
                    return np.arange(n)
                # Smallest radius on the same scale that holds enough.
                need = np.partition(far, wanted - 1)[wanted - 1]
                return np.flatnonzero(far <= need)
            for s in range(m):
                seen += [self.order[a:b, s] for a, b in zip(first[s], last[s]) if b > a]
            rows = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
            rows = rows[self.distances(code, rows) <= m * (t + 1) - 1]
            if len(rows) >= wanted:
                return rows
        return np.arange(n)


def best(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, targets: np.ndarray, coder: Coder,
         settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the best ``k`` of a shard for each query."""
    index = MultiIndex(coder.codes(vectors))
    codes = coder.codes(targets, query=True)
    out = []
    for q, target, code in zip(queries, targets, codes):
        rows = index.within(code, settings.wanted + 1)
        rows = rows[ids[rows] != q]
        score = (vectors[rows] * target).sum(axis=1)
        top = np.lexsort((ids[rows], -score))[: settings.k]
        out.append((np.full(len(top), q), ids[rows[top]], score[top]))
    return tuple(np.concatenate(c) for c in zip(*out))


def top(queries: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the best ``k`` of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, queries))
    first = np.r_[True, np.diff(queries[order]) != 0] if len(order) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[place < k]


def meet(part: int, rows: dict[str, np.ndarray], asked: dict[str, np.ndarray], radius: int, settings: Settings
         ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """query, id, score of the best in a unit, and on the first row of each query how many codes are within the radius."""
    order = np.argsort(rows["value"], kind="stable")
    rows = {k: v[order] for k, v in rows.items()}
    first = np.searchsorted(rows["value"], asked["value"], "left")
    sizes = np.searchsorted(rows["value"], asked["value"], "right") - first
    at, held = 0, np.cumsum(sizes)
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(held, held[at] - sizes[at] + settings.pairs, "right")))
        n = sizes[at:stop]
        q = np.repeat(np.arange(at, stop), n)
        e = np.repeat(first[at:stop] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = stop
        apart = np.bitwise_count(asked["code"][q] ^ rows["code"][e])
        good = (apart.sum(axis=1) <= radius) & (apart[:, :part] > settings.flips).all(axis=1)
        good &= asked["id"][q] != rows["id"][e]
        q, e = q[good], e[good]
        if len(q):
            score = (asked["vector"][q] * rows["vector"][e]).sum(axis=1)
            query, ids = asked["id"][q], rows["id"][e]
            best_k = top(query, ids, score, settings.k)
            name, head, count = *np.unique(query[best_k], return_index=True), np.unique(query, return_counts=True)[1]
            codes = np.zeros(len(best_k), np.int64)
            codes[head] = count
            yield query[best_k], ids[best_k], score[best_k], codes


def probed(rows: DataFrame, coder: Coder, n: int, settings: Settings) -> DataFrame:
    """query_id, vec_id, score, codes: the best rows that each query finds in the buckets of wide substrings."""
    width = min(16, max(8, n.bit_length()))
    parts = max(1, min(64, coder.rotation.shape[1]) // width)
    radius = parts * (settings.flips + 1) - 1

    def values(vectors: np.ndarray, query: bool) -> pa.Array:
        bits = np.unpackbits(coder.codes(vectors, query), axis=1)[:, : parts * width].reshape(len(vectors), -1, width)
        got = bits @ (1 << np.arange(width, dtype=np.int32))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * bits.shape[1]),
                                        pa.array(got.ravel().astype(np.int32)))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("vector"))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, values(x, False), values(x, True)], [*batch.schema.names, "code", "probe"])

    kind = rows.schema["vector"].dataType.simpleString()
    codes = stored(rows.select("vec_id", "asks", "vector").mapInArrow(
        coded, f"vec_id long, asks boolean, vector {kind}, code array<int>, probe array<int>"), "codes")
    masks = F.array(*[F.lit(sum(1 << b for b in c)) for t in range(settings.flips + 1) for c in combinations(range(width), t)])
    big = stored(codes.select(F.posexplode("code").alias("part", "value")).groupBy("part", "value").count().filter(
        F.col("count") > settings.unit).select("part", "value", F.ceil(F.col("count") / settings.unit).cast("int").alias("cuts")),
        "hot-buckets")
    entries = codes.select("vec_id", "vector", "code", F.posexplode("code").alias("part", "value")).join(
        big, ["part", "value"], "left").withColumn(
        "cut", F.coalesce(F.pmod(F.xxhash64("vec_id"), F.col("cuts")).cast("int"), F.lit(0)))
    probes = codes.filter("asks").select("vec_id", "vector", F.col("probe").alias("code"), F.posexplode("probe").alias(
        "part", "near")).withColumn("value", F.explode(F.transform(masks, lambda x: F.col("near").bitwiseXOR(x)))).join(
        big, ["part", "value"], "left").withColumn(
        "cut", F.explode(F.sequence(F.lit(0), F.coalesce("cuts", F.lit(1)) - 1)))
    # Values share units by hash; a cut of a large bucket is dealt like a value of its own.
    unit = F.pmod(F.xxhash64("value", "cut"), F.lit(-(-n // settings.unit))).alias("unit")
    both = entries.select("part", unit, "cut", F.lit(False).alias("asks"), "value", "vec_id", "code", "vector").unionAll(
        probes.select("part", unit, "cut", F.lit(True).alias("asks"), "value", "vec_id", "code", "vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            whole = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            asks = whole.pop("asks")
            if asks.any() and not asks.all():
                for got in meet(at[0], {k: v[~asks] for k, v in whole.items()}, {k: v[asks] for k, v in whole.items()},
                                radius, settings):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], ["query_id", "vec_id", "score", "codes"])

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in ("part", "unit", "cut")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(keys)]):
                if tuple(keys[start]) != at:
                    yield from close()
                    at, held = tuple(keys[start]), []
                some = batch.slice(start, end - start)
                held.append({"asks": some.column("asks").to_numpy(zero_copy_only=False), "id": some.column("vec_id").to_numpy(),
                             "value": some.column("value").to_numpy(), "code": matrix(some.column("code"), np.int32),
                             "vector": matrix(some.column("vector"))})
        yield from close()

    return both.repartition("part", "unit", "cut").sortWithinPartitions("part", "unit", "cut").mapInArrow(
        run, "query_id long, vec_id long, score double, codes long")


def search(table: DataFrame, queries: Column, settings: Settings = Settings(), key: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score, probed: the rows that ``queries`` holds for against all rows.

    ``probed`` tells queries that the buckets of wide substrings answered.
    """
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(kind_of(table, vector)).alias("vector"),
                        F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    dims = rows.groupBy(F.size("vector").alias("dim")).agg(
        F.count("*").alias("n"), F.count_if("asks").alias("asks"),
        F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("square")).collect()
    schema = "query_id long, vec_id long, score double"
    if not dims:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, probed boolean")
    most = max(dims, key=lambda r: (r["n"], r["dim"]))
    rows = rows.filter(F.size("vector") == most["dim"])
    sample = drawn(rows, settings.sample, "vec_id").select("vector")
    coder = learn(np.array([r["vector"] for r in sample.collect()], float), float(np.sqrt(most["square"])), settings)
    near = stored(probed(rows, coder, most["n"], settings), "probed")
    done = stored(near.groupBy("query_id").agg(F.sum("codes").alias("codes")).filter(
        F.col("codes") >= settings.enough).select("query_id"), "answered")
    near = near.join(done, "query_id").select("query_id", "vec_id", "score")
    still = rows.filter("asks").join(done.withColumnRenamed("query_id", "vec_id"), "vec_id", "left_anti")
    asking = still.count()
    shards = -(-most["n"] // settings.shard) if asking else 1
    blocks = max(1, -(-asking // settings.queries))
    spot = F.xxhash64(F.lit(3), "vec_id")
    deal = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = rows.select(F.pmod(spot, F.lit(shards)).cast("int").alias("shard"), deal(blocks).alias("block"),
                        F.lit(False).alias("asks"), "vec_id", "vector")
    asked = still.select(deal(shards).alias("shard"), F.pmod(spot, F.lit(blocks)).cast("int").alias("block"),
                                       F.lit(True).alias("asks"), "vec_id", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            ids, asks, vectors = (np.concatenate([h[i] for h in held]) for i in range(3))
            if asks.all() or not asks.any():
                return
            got = best(ids[~asks], vectors[~asks], ids[asks], vectors[asks], coder, settings)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], ["query_id", "vec_id", "score"])

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in ("shard", "block")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(keys)]):
                if tuple(keys[start]) != at:
                    yield from close()
                    at, held = tuple(keys[start]), []
                part = batch.slice(start, end - start)
                held.append((part.column("vec_id").to_numpy(), part.column("asks").to_numpy(zero_copy_only=False),
                             matrix(part.column("vector"))))
        yield from close()

    cells = index.unionAll(asked).repartition("shard", "block").sortWithinPartitions("shard", "block")
    found = near.withColumn("probed", F.lit(True))
    if asking:
        found = found.unionAll(cells.mapInArrow(run, schema).withColumn("probed", F.lit(False)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= settings.k).select(
        "query_id", "rank", "vec_id", "score", "probed")
