"""All pairs of vectors within a cosine threshold, by an exact metric range join.

On unit vectors cosine >= c is Euclidean distance <= r = sqrt(2 - 2c). Pivots (a bounded sample of the vectors) partition
the vectors: each lives in the cell of its nearest pivot. By the triangle inequality a vector x can have a partner in cell
j only if d(x, p_j) - d(x, p_home) <= 2r; by the same geometry its distance to the plane between the two pivots must be at
most r. Only then it also visits cell j, and only if j comes before its own cell, so every pair meets once. Cells join
independently; large ones are cut into pairs of blocks of bounded size.

Equal vectors are one class before anything moves. A unit of work reports counts of links and a forest that joins the same
vectors, never pairs. Candidates are found in single precision with a margin and decided in double precision.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths never link; rows that share an id are told apart by their vectors only; a null id has a null component;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn, stored
from .components import components
from .vectors import kind_of, lists, matrix, usable

BLOCK = 8192
MOST_PIVOTS = 4096
DISTANCES = 1 << 22
MARGIN = 1e-4


def pivots(classes: DataFrame, count: int, dim: int) -> np.ndarray:
    """At most ``MOST_PIVOTS`` unit vectors, drawn by hash."""
    rows = drawn(classes.filter(F.size("vector") == dim), count, "class_id").collect()
    got = np.array([r["vector"] for r in rows], float)
    return units_of(got)


def units_of(raw: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled by the largest component first, so that no square overflows or vanishes."""
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def visits(unit: np.ndarray, points: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each vector, and which cells before it must see it."""
    squares = np.maximum(2 - 2 * unit @ points.T, 0)
    far = np.sqrt(squares)
    home = far.argmin(axis=1)
    at = np.arange(len(unit))
    apart = np.sqrt(np.maximum(2 - 2 * points @ points.T, 0))[home]
    slack = 1e-9
    near = far - far[at, home][:, None] <= 2 * radius + slack
    near &= squares - squares[at, home][:, None] <= 2 * radius * apart + slack
    near &= np.arange(len(points))[None, :] < home[:, None]
    return home, near


def how_many(n: int, block: int) -> int:
    """Several pivots for small tables already, and cells of about one block up to ``MOST_PIVOTS`` of them."""
    return max(1, min(MOST_PIVOTS, max(-(-n // block), round(n ** 0.25))))


def place(classes: DataFrame, points: dict[int, np.ndarray], radius: float) -> DataFrame:
    """Rows of cells: dim, cell, visitor, class_id, n, vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("vector").offsets.to_numpy())
            for dim in np.unique(sizes):
                same = batch.filter(pa.array(sizes == dim))
                step = max(1, DISTANCES // len(points[int(dim)]))
                for at in range(0, same.num_rows, step):
                    part = same.slice(at, step)
                    raw = matrix(part.column("vector"))
                    unit = units_of(raw)
                    home, near = visits(unit, points[int(dim)], radius)
                    row, cell = np.nonzero(near)
                    rows = np.concatenate([np.arange(len(home)), row])
                    for start in range(0, len(rows), 20_000):
                        some = rows[start: start + 20_000]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(some), dim, np.int32)),
                            pa.array(np.concatenate([home, cell])[start: start + 20_000].astype(np.int32)),
                            pa.array(np.arange(start, start + len(some)) >= len(home)),
                            part.column("class_id").take(pa.array(some)), part.column("n").take(pa.array(some)),
                            lists(raw[some], kind)], ["dim", "cell", "visitor", "class_id", "n", "vector"])

    kind = kind_of(classes, "vector")
    return classes.select("class_id", "n", "vector").mapInArrow(
        run, f"dim int, cell int, visitor boolean, class_id long, n long, vector {kind}")


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give all that the pairs (a, b) connect the smallest label among them, in place."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label[:] = further


def links(raw: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted link counts and joint labels of all rows, from the pairs of ``left`` and ``right`` rows."""
    # A power of two changes no digit and keeps squares in range.
    raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1, keepdims=True))[1])
    norm = np.linalg.norm(raw, axis=1)
    unit = (raw / norm[:, None]).astype(np.float32)
    within = np.array_equal(left, right)
    count, label = np.zeros(len(raw), np.int64), np.arange(len(raw))
    for start in range(0, len(left), 512):
        rows = left[start: start + 512]
        a, b = np.nonzero(unit[rows] @ unit[right].T >= least - MARGIN)
        a, b = rows[a], right[b]
        if within:
            a, b = a[a < b], b[a < b]
        for at in range(0, len(a), 100_000):
            x, y = a[at: at + 100_000], b[at: at + 100_000]
            sure = np.einsum("ij,ij->i", raw[x], raw[y]) / (norm[x] * norm[y]) >= least
            x, y = x[sure], y[sure]
            count += np.bincount(x, weights=weight[y], minlength=len(raw)).astype(np.int64)
            count += np.bincount(y, weights=weight[x], minlength=len(raw)).astype(np.int64)
            join_labels(label, x, y)
    return count, label


def joined(units: DataFrame, least: float) -> DataFrame:
    """class_id, the label it is joined to, links found; rows of a unit (dim, cell, i, j) come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            ids = np.concatenate([h[0] for h in held])
            side = np.concatenate([h[2] for h in held])
            left = np.flatnonzero(side == 0)
            right = left if at[3] < 0 else np.flatnonzero(side == 1)
            if len(left) and len(right):
                count, label = links(np.concatenate([h[3] for h in held]), np.concatenate([h[1] for h in held]),
                                     left, right, least)
                some = np.flatnonzero(count)
                if len(some):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[some]), pa.array(ids[label[some]]), pa.array(count[some])], ["a", "b", "links"])

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in ("dim", "cell", "i", "j")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(keys)]):
                unit = tuple(keys[start].tolist())
                if unit != at:
                    yield from close()
                    at, held = unit, []
                part = batch.slice(start, end - start)
                held.append((part.column("class_id").to_numpy(), part.column("n").to_numpy(),
                             part.column("side").to_numpy(), matrix(part.column("vector"))))
        yield from close()

    return units.mapInArrow(run, "a long, b long, links long")


def range_join(table: DataFrame, least: float = 0.9, key: str = "vec_id", vector: str = "embedding",
               block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``table``."""
    radius = float(np.sqrt(max(0.0, 2 - 2 * least)))
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(kind_of(table, vector)).alias("vector"))
    # 128 bits name a vector.
    rows = rows.withColumn("h1", F.when(usable(F.col("vector")), F.xxhash64("vector"))).withColumn(
        "h2", F.xxhash64(F.lit(7), "vector"))
    facts = stored(rows.select("vec_id", "h1", "h2"), "vector-keys")
    classes = stored(rows.filter("h1 is not null and vec_id is not null").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("class_id"), F.count("*").alias("n"), F.first("vector").alias("vector")), "vector-classes")
    dims = {r["dim"]: r["count"] for r in classes.groupBy(F.size("vector").alias("dim")).count().collect()}
    points = {d: pivots(classes, how_many(n, block), d) for d, n in dims.items()}
    placed = stored(place(classes, points, radius), "cells")
    # One row per cell: at most MOST_PIVOTS for each length of vectors.
    sizes = placed.groupBy("dim", "cell").agg(
        F.ceil(F.count_if(~F.col("visitor")) / block).cast("int").alias("homes"),
        F.ceil(F.count_if("visitor") / block).cast("int").alias("guests"))
    dealt = placed.join(F.broadcast(sizes), ["dim", "cell"])
    own = F.pmod(F.xxhash64("class_id"), F.greatest("homes", F.lit(1))).cast("int")
    guest = F.pmod(F.xxhash64("class_id"), F.greatest("guests", F.lit(1))).cast("int")
    unit = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    # j: -1 a home block with itself, then later home blocks, then blocks of visitors.
    later = F.when(F.col("homes") > 1, F.sequence(F.lit(0), F.col("homes") - 1)).otherwise(F.array().cast("array<int>"))
    at_home = F.concat(
        F.array(unit(own, F.lit(-1), 0)),
        F.transform(F.filter(later, lambda k: k > own), lambda k: unit(own, k, 0)),
        F.transform(F.filter(later, lambda k: k < own), lambda k: unit(k, own, 1)),
        F.transform(F.when(F.col("guests") > 0, F.sequence(F.lit(0), F.col("guests") - 1)).otherwise(
            F.array().cast("array<int>")), lambda k: unit(own, F.col("homes") + k, 0)))
    visiting = F.transform(F.when(F.col("homes") > 0, F.sequence(F.lit(0), F.col("homes") - 1)).otherwise(
        F.array().cast("array<int>")), lambda k: unit(k, F.col("homes") + guest, 1))
    units = dealt.withColumn("u", F.explode(F.when(F.col("visitor"), visiting).otherwise(at_home))).select(
        "dim", "cell", "u.i", "u.j", "u.side", "class_id", "n", "vector")
    found = stored(joined(units.repartition("dim", "cell", "i", "j").sortWithinPartitions("dim", "cell", "i", "j"), least),
                   "vector-links")
    roots = components(found.select("a", "b"))
    counts = found.groupBy(F.col("a").alias("class_id")).agg(F.sum("links").alias("links"))
    result = stored(classes.select("h1", "h2", "class_id", "n").join(counts, "class_id", "left").join(
        roots.select(F.col("v").alias("class_id"), "root"), "class_id", "left").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("root", "class_id").alias("root")), "class-links")
    out = facts.join(result, ["h1", "h2"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("root", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
