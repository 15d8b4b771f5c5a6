"""Near-duplicate documents by SetSketch: registers, bands of registers, joint likelihood, confirmation on full sets.

A register is the exponentially spaced, truncated minimum of one random number per shingle: floor(1 - log_b x), cut to
[0, q + 1]. Registers merge by maximum and are locality-sensitive, so equal bands of them make candidates.

Steps: (1) one pass over the texts gives each document's set size, a key of its set, and its bands; equal sets become one
class. (2) Classes that share a band are linked to the smallest class of that band, and the components of these links are
clusters: two classes that share any band are in one cluster. (3) A cluster is cut into blocks and each pair of blocks is
one unit of work of bounded size. Within it the Jaccard similarity of every pair is estimated from both sketches by maximum
likelihood; pairs whose estimate could be a link are compared on full sets, unless links found before already join them.
A unit gives a spanning forest of confirmed links, never all pairs. (4) Components of the confirmed links are the groups.

With 32 bands of 5 registers a pair of similarity 0.8 shares no band once in 300,000; an estimate from 160 registers is off
by the margin of 0.16 (five standard deviations) less often than that.

Defined cases: null, empty and all-blank texts have an empty set and link with nothing; texts with fewer words than a
shingle have their whole word sequence as the one shingle; rows that share a document id count as copies of whatever their
texts are; a null id stays a row of its own, with a null component; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, stored, text_slices
from .chunks import distinct
from .components import components

_U = np.uint64


@dataclass(frozen=True)
class Settings:
    """Shingles of ``width`` words; a link is 100 * intersection >= ``percent`` * union.

    ``base``, ``rate`` and ``top`` are b, a and q of the sketch. Blocks hold about ``block`` classes.
    """

    width: int = 5
    percent: int = 80
    bands: int = 32
    band: int = 5
    base: float = 1.001
    rate: float = 20.0
    top: int = 65_534
    margin: float = 0.16
    block: int = 256

    @property
    def registers(self) -> int:
        return self.bands * self.band


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


class Shingler:
    """Sets of shingle hashes of texts; the hash of a word is kept for the batch only."""

    def __init__(self, settings: Settings):
        self.settings = settings
        self.factors = multipliers(settings.width + 1)

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        ends = lists.offsets.to_numpy()
        ends = (ends - ends[0]).astype(np.int64)
        words, at = distinct(lists.flatten())
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), _U, len(words))
        empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False).astype(bool)
        keep = ~empty[at]
        kept = np.concatenate([[0], np.cumsum(keep)])
        ends = kept[ends]
        flat = hashes[at[keep]]
        k, out = self.settings.width, []
        joined = np.zeros(max(0, len(flat) - k + 1), _U)
        for i in range(k):
            joined = mix(joined + flat[i: i + len(joined)] * self.factors[i])
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(joined[a: b - k + 1]))
            elif b > a:
                whole = np.array([b - a], _U)
                for i in range(b - a):
                    whole = mix(whole + flat[a + i: a + i + 1] * self.factors[i])
                out.append(whole)
            else:
                out.append(np.zeros(0, _U))
        return out


class Sketcher:
    def __init__(self, settings: Settings):
        self.settings = settings
        self.factors = multipliers(settings.registers * 2)[settings.registers:]

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """Registers (rows: sets) of sets that are not empty."""
        out = np.empty((len(sets), self.settings.registers), np.uint16)
        start = 0
        while start < len(sets):
            # So many sets at a time that their hashes stay in the processor's cache.
            end, held = start + 1, len(sets[start])
            while end < len(sets) and held + len(sets[end]) <= 16_384:
                held += len(sets[end])
                end += 1
            flat = np.concatenate(sets[start:end])
            first = np.cumsum([0, *map(len, sets[start: end - 1])])
            least = np.empty((self.settings.registers, end - start), _U)
            for i, f in enumerate(self.factors):
                least[i] = np.minimum.reduceat(flat * f, first)
            out[start:end] = self.levels(least).T
            start = end
        return out

    def levels(self, least: np.ndarray) -> np.ndarray:
        """Registers of uniform minima: the exponential they stand for, spaced by powers of the base, cut at both ends."""
        s = self.settings
        x = -np.log1p(-((least >> _U(11)).astype(float) + 0.5) / 2.0 ** 53) / s.rate
        return np.clip(np.floor(1 - np.log(x) / np.log(s.base)), 0, s.top + 1).astype(np.uint16)

    def band_keys(self, registers: np.ndarray) -> np.ndarray:
        s = self.settings
        keys = np.repeat(np.arange(s.bands, dtype=_U)[None, :], len(registers), axis=0)
        parts = registers.reshape(len(registers), s.bands, s.band).astype(_U)
        for i in range(s.band):
            keys = mix(keys * _U(0x9E3779B97F4A7C15) + parts[:, :, i] + _U(1))
        return keys.view(np.int64)


def merge(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(one, two)


def likely_jaccard(above: np.ndarray, below: np.ndarray, n_one: np.ndarray, n_two: np.ndarray,
                   registers: int, base: float) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from how many registers of one are above, below those of two."""
    u = n_one / (n_one + n_two)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    same = registers - above - below

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-12, 1) * (base - 1) / base) / np.log(base)

    def fit(j: np.ndarray) -> np.ndarray:
        p, q = chance(u - v * j), chance(v - u * j)
        return above * np.log(p) + below * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))

    # The likelihood has one maximum; golden sections close in on it.
    a, b = np.zeros(len(u)), most.copy()
    g = (np.sqrt(5) - 1) / 2
    for _ in range(20):
        c, d = b - g * (b - a), a + g * (b - a)
        left = fit(c) >= fit(d)
        a, b = np.where(left, a, c), np.where(left, d, b)
    return (a + b) / 2


def linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    small, large = (one, two) if len(one) <= len(two) else (two, one)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(small) + len(large) - both)


def confirm(ids: list[int], sets: list[np.ndarray], registers: np.ndarray, left: np.ndarray, right: np.ndarray,
            settings: Settings) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows ``left`` and rows ``right`` (equal arrays: among themselves)."""
    sizes = np.array([len(s) for s in sets], float)
    within = left is right or np.array_equal(left, right)
    m, found = settings.registers, []
    for start in range(0, len(left), 64):
        rows = left[start: start + 64]
        for again in range(0, len(right), 256):
            cols = right[again: again + 256]
            x, y = registers[rows][:, None, :], registers[cols][None, :, :]
            above, below = (x > y).sum(axis=2), (x < y).sum(axis=2)
            # An estimate is never far above the share of equal registers, taken with the cut of unequal sizes.
            ratio = np.minimum(sizes[rows][:, None], sizes[cols][None, :]) / np.maximum(
                sizes[rows][:, None], sizes[cols][None, :])
            hope = (m - above - below >= 0.4 * m) & (100 * ratio >= settings.percent)
            if within:
                hope &= rows[:, None] < cols[None, :]
            r, c = np.nonzero(hope)
            if len(r):
                j = likely_jaccard(above[r, c], below[r, c], sizes[rows[r]], sizes[cols[c]], m, settings.base)
                good = j >= settings.percent / 100 - settings.margin
                found.append(np.stack([j[good], rows[r[good]], cols[c[good]]]))
    if not found:
        return []
    pairs = np.concatenate(found, axis=1)
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for k in np.argsort(-pairs[0], kind="stable"):
        a, b = int(pairs[1, k]), int(pairs[2, k])
        ra, rb = root(a), root(b)
        if ra != rb and linked(sets[a], sets[b], settings.percent):
            parent[max(ra, rb)] = min(ra, rb)
            edges.append((ids[a], ids[b]))
    return edges


def sketches(docs: DataFrame, settings: Settings, key: str, text: str) -> DataFrame:
    """doc_id, n_shingles, set_key (null for an empty set) and the band keys of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sketch = Shingler(settings), Sketcher(settings)
        for batch in batches:
            for part in text_slices(batch, "text", 4 << 20):
                sets = shingles(filled(part.column("text")))
                full = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                if full:
                    for i, row in zip(full, sketch.band_keys(sketch([sets[i] for i in full]))):
                        bands[i] = row
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "set_key", "bands"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def confirmed(units: DataFrame, settings: Settings) -> DataFrame:
    """Links of each unit of work; rows: cluster, i, j, block, doc_id, text. Units come sorted, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(settings)
        held: list[tuple[int, int, bytes]] = []
        at = None

        def close() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            sets = [np.frombuffer(data, _U) for _, _, data in held]
            blocks = np.array([b for _, b, _ in held])
            left = np.flatnonzero(blocks == at[1])
            right = left if at[1] == at[2] else np.flatnonzero(blocks == at[2])
            return confirm([d for d, _, _ in held], sets, sketch(sets), left, right, settings)

        edges: list[tuple[int, int]] = []
        for batch in batches:
            cluster, i, j, block, doc, data = (c.to_pylist() for c in batch.columns)
            for unit, b, d, s in zip(zip(cluster, i, j), block, doc, data):
                if unit != at:
                    edges += close()
                    at, held = unit, []
                held.append((d, b, s))
            if len(edges) > 10_000:
                yield _edges(edges)
                edges = []
        edges += close()
        if edges:
            yield _edges(edges)

    return units.mapInArrow(run, "a long, b long")


def _edges(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges)], ["a", "b"])


def sets_of(rows: DataFrame, settings: Settings) -> DataFrame:
    """The text of each row replaced by its set (sorted 64-bit hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(settings)
        for batch in batches:
            for part in text_slices(batch, "text", 4 << 20):
                sets = shingles(filled(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array([s.tobytes() for s in sets], pa.binary())],
                    [*part.schema.names[:-1], "set"])

    return rows.mapInArrow(run, "cluster long, size long, doc_id long, `set` binary")


def groups(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    facts = stored(sketches(docs, settings, key, text), "sketches")
    classes = stored(facts.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("rep", F.explode("bands").alias("band"))
    shared = stored(banded.groupBy("band").agg(F.min("rep").alias("first"), F.count("*").alias("n")).filter(
        "n > 1").select("band", "first"), "bands")
    near = components(banded.join(shared, "band").select(F.col("rep").alias("a"), F.col("first").alias("b")))
    sizes = stored(near.groupBy("root").agg(F.count("*").alias("size")), "sizes")
    members = stored(near.join(sizes, "root").select(
        F.col("root").alias("cluster"), "size", F.col("v").alias("doc_id")), "members")
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # The same plan at every size: texts move once, to the members.
    sets = sets_of(members.hint("merge").join(texts, "doc_id").select("cluster", "size", "doc_id", "text"), settings)
    blocks = F.ceil(F.col("size") / settings.block).cast("int")
    placed = sets.withColumn("_n", blocks).withColumn("block", F.pmod(F.xxhash64("doc_id"), "_n").cast("int"))
    units = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select(
        "cluster", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "block", "doc_id", "set")
    dealt = units.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    joined = components(confirmed(dealt, settings))
    roots = stored(classes.select("set_key", "rep").join(
        joined.select(F.col("v").alias("rep"), "root"), "rep", "left").select(
        "set_key", F.coalesce("root", "rep").alias("root")), "class-roots")
    placed = facts.select("doc_id", "n_shingles", "set_key").join(roots, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
