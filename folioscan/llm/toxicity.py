"""Toxicity by a linear classifier that counterfactual identity swaps regularise.

A text is read in windows of 400 words that overlap by half, and its score is that of its worst window, so a toxic passage
counts alike in a short text and anywhere in a long one. Features are the words of a window and their first four and five
letters, valued by the logarithm of how often they occur. The classifier is a logistic regression with an L1 penalty, fitted
on a bounded sample of labelled rows: every document stands for its worst window, first by how far its features are from
chance, then by the fitted weights, until the choice settles or the rounds are over. For every such window that names a group
(an identity term), copies are made in which each term is replaced by each other of its set; the squared changes of the score
between window and copies are added to the loss, so a term earns no weight for the company it keeps in the labels and neutral
mentions of a group stay neutral.

Features are counted and chosen by Spark; what the driver gets is the chosen features of the sampled windows.

Scoring looks at whole texts: words are dictionary-encoded, each distinct word is compared with the few selected features
once, and a window's score adds the weights of the distinct features it holds.

Defined cases: null and empty texts hold no feature and get the score of the bias; labels that are null are not used; of
repeated labels for a document the largest counts; a sample with no toxic or no clean row gives no weights and a bias below
zero; an existing column named like the score is replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import ChunkTable, distinct
from .common import drawn, filled, ragged_take, stored, text_slices

# Sets of terms that name groups; within a set each may stand for another.
IDENTITY = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("she", "he"), ("her", "his"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrant", "refugee", "citizen", "native"), ("immigrants", "refugees", "citizens", "natives"),
    ("disabled", "blind", "deaf"), ("old", "young", "elderly"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
TOXIC_ROWS, CLEAN_ROWS = 2_500, 5_000
# Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 400, 200
# Texts are read in slices of so many bytes.
SLICE = 4 << 20
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’…–—¿¡"


@dataclass(frozen=True)
class Settings:
    """``toxic_rows`` and ``clean_rows`` bound the sample the classifier is fitted on."""

    toxic_rows: int = TOXIC_ROWS
    clean_rows: int = CLEAN_ROWS
    least_rows: int = 4
    least_far: float = 3.0
    features: int = 4_000
    l1: float = 0.05
    swap: float = 1.0
    steps: int = 400
    rounds: int = 4
    identity: tuple[tuple[str, ...], ...] = IDENTITY


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[int, float] = field(default_factory=dict)


def word_features(word: str) -> list[int]:
    """Hashes of a word's features; none for a word without letters or digits."""
    word = word.strip(EDGE).lower()
    if not word:
        return []
    found = [zlib.crc32(("w" + word).encode())]
    found += [zlib.crc32(f"{n}{word[:n]}".encode()) for n in (4, 5) if len(word) >= n]
    return found


def swaps(sets: Sequence[Sequence[str]]) -> list[dict[str, str]]:
    """One copy after the other: for each term the next of its set, the one after next, and so on."""
    return [{t: s[(i + k) % len(s)] for s in sets if k < len(s) for i, t in enumerate(s)}
            for k in range(1, max(map(len, sets), default=1))]


def strength(count: np.ndarray) -> np.ndarray:
    """A feature's value: how often it occurs in the window."""
    return np.log1p(count)


def n_windows(words: np.ndarray) -> np.ndarray:
    """Windows that cover so many words, one at least."""
    return 1 + np.maximum(0, -(-(words - WINDOW) // STRIDE))


def windows(text: str) -> list[Counter]:
    """How often each bare word occurs, window by window."""
    names = [w.strip(EDGE).lower() for w in text.split()]
    return [Counter(names[j * STRIDE: j * STRIDE + WINDOW]) for j in range(int(n_windows(np.array(len(names)))))]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """doc, toxic and text of the sampled labelled documents."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))

    def some(label: int, n: int) -> DataFrame:
        return drawn(known.filter(F.col("toxic") == label), n, "doc_id")

    # At most toxic_rows + clean_rows rows are broadcast.
    chosen = F.broadcast(some(1, settings.toxic_rows).unionAll(some(0, settings.clean_rows)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    return stored(rows.select(F.monotonically_increasing_id().alias("doc"), "toxic", "text"), "toxicity-sample")


def selected(rows: DataFrame, n: int, n_toxic: int, settings: Settings) -> list[tuple[int, float]]:
    """(hash, distance) of the features that are furthest from chance, counted over documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                for toxic, text in zip(part.column("toxic").to_pylist(), filled(part.column("text")).to_pylist()):
                    words = {w.strip(EDGE).lower() for w in text.split()}
                    found = pa.array(sorted({f for w in words for f in word_features(w)}), pa.int64())
                    yield pa.RecordBatch.from_arrays([found, pa.array([toxic] * len(found), pa.int64())], ["f", "toxic"])

    rate = n_toxic / n
    held, bad = F.col("held"), F.col("bad")
    # How far a feature's toxic rows are from what chance would give, in standard deviations.
    far = (bad - held * rate) / F.sqrt(held * (rate * (1 - rate)) + 1e-9)
    counted = rows.select("toxic", "text").mapInArrow(run, "f long, toxic long").groupBy("f").agg(
        F.count("*").alias("held"), F.sum("toxic").alias("bad")).filter(held >= settings.least_rows)
    best = counted.select("f", far.alias("far")).filter(F.abs("far") >= settings.least_far).orderBy(
        F.abs("far").desc(), "f").limit(settings.features)
    return sorted((r["f"], r["far"]) for r in best.collect())


def sampled_windows(rows: DataFrame, chosen: Sequence[int], settings: Settings) -> DataFrame:
    """doc, toxic, place, copy, held: (feature, count) of the chosen features of every window (copy 0) and its copies."""
    place = {f: i for i, f in enumerate(chosen)}
    others = swaps(settings.identity)
    named = {t for s in settings.identity for t in s}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}

        def counted(words: Counter) -> bytes:
            held: Counter = Counter()
            for w, n in words.items():
                if w not in known:
                    known[w] = [place[f] for f in word_features(w) if f in place]
                for f in known[w]:
                    held[f] += n
            return np.array(sorted(held.items()), np.int32).reshape(-1, 2).tobytes()

        def read(part: pa.RecordBatch) -> Iterator[tuple]:
            for doc, toxic, text in zip(*(part.column(c).to_pylist() for c in ("doc", "toxic", "text"))):
                for at, words in enumerate(windows(text or "")):
                    own = counted(words)
                    yield doc, toxic, at, 0, own
                    if named.isdisjoint(words):
                        continue
                    for k, other in enumerate(others):
                        swapped: Counter = Counter()
                        for w, n in words.items():
                            swapped[other.get(w, w)] += n
                        copy = counted(swapped)
                        if copy != own:
                            yield doc, toxic, at, k + 1, copy

        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*read(part)), kinds)],
                                                 ["doc", "toxic", "place", "copy", "held"])

    return rows.mapInArrow(run, "doc long, toxic int, place int, copy int, held binary")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on the driver: sample and features are bounded by the settings, whatever the tables hold."""
    rows = sample(docs, labels, settings)
    n, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    bias = float(np.log((n_toxic + 1) / (n - n_toxic + 3)))
    if not 0 < n_toxic < n:
        return Model(min(bias, -1.0))
    chosen = selected(rows, n, n_toxic, settings)
    if not chosen:
        return Model(bias)
    found = sampled_windows(rows, [f for f, _ in chosen], settings).collect()
    return fit_windows(sorted(found, key=lambda r: r[:4]), [f for f, _ in chosen], np.array([x for _, x in chosen]), bias,
                       settings)


def fit_windows(rows: list, names: list[int], far: np.ndarray, bias: float, settings: Settings) -> Model:
    """Fit, choose each document's worst window by what was fitted, and fit again. ``rows`` are in order."""
    read = lambda r: np.frombuffer(r["held"], np.int32).reshape(-1, 2)
    own = [r for r in rows if r["copy"] == 0]
    held = [read(r) for r in own]
    copies: list[list[np.ndarray]] = []
    for r in rows:
        copies.append([]) if r["copy"] == 0 else copies[-1].append(read(r))
    docs = np.unique([r["doc"] for r in own], return_inverse=True)[1]
    row = np.repeat(np.arange(len(held)), [len(h) for h in held])
    flat = np.concatenate([*held, np.zeros((0, 2), np.int32)])
    values = strength(flat[:, 1])
    chosen, w = None, np.append(far, bias)
    for _ in range(settings.rounds):
        z = np.bincount(row, weights=w[flat[:, 0]] * values, minlength=len(held))
        # The last of each document in order of its score, earlier windows after later ones of the same score.
        order = np.lexsort((-np.arange(len(held)), z, docs))
        worst = order[np.append(np.flatnonzero(np.diff(docs[order])), len(order) - 1)]
        if chosen is not None and (worst == chosen).all():
            break
        chosen = worst
        w = fit_rows([own[i]["toxic"] for i in chosen], [held[i] for i in chosen], [copies[i] for i in chosen],
                     len(names), bias, settings)
    return Model(float(w[-1]), {int(f): float(v) for f, v in zip(names, w) if v})


def fit_rows(toxic: list[int], own: list[np.ndarray], copies: list[list[np.ndarray]], k: int, bias: float,
             settings: Settings) -> np.ndarray:
    """Weights of the features, then the bias."""
    y = np.array(toxic, float)
    n, n_toxic = len(y), float(sum(toxic))

    def matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = np.concatenate([*rows, np.zeros((0, 2), np.int32)])
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), flat[:, 0], strength(flat[:, 1])

    r, c, v = matrix(own)
    ra, ca, va = matrix([o for o, cs in zip(own, copies) for _ in cs])
    rb, cb, vb = matrix([x for cs in copies for x in cs])
    pairs = sum(map(len, copies))
    m = max(1, pairs)
    w = np.zeros(k + 1)
    w[k] = bias
    ahead, speed = w.copy(), 1.0
    largest = np.bincount(r, weights=v * v, minlength=n).max(initial=1) + 1
    # Both classes weigh the same.
    share = np.where(y == 1, 0.5 / n_toxic, 0.5 / (n - n_toxic))
    step = 1.0 / (0.25 * largest / 4 + 2 * settings.swap * bool(pairs) * 4)

    def gradient(w: np.ndarray) -> np.ndarray:
        z = np.bincount(r, weights=w[c] * v, minlength=n) + w[k]
        error = (1 / (1 + np.exp(-z)) - y) * share
        g = np.append(np.bincount(c, weights=error[r] * v, minlength=k), error.sum())
        if pairs:
            change = (np.bincount(ra, weights=w[ca] * va, minlength=pairs)
                      - np.bincount(rb, weights=w[cb] * vb, minlength=pairs)) * (2 * settings.swap / m)
            g[:k] += np.bincount(ca, weights=change[ra] * va, minlength=k)
            g[:k] -= np.bincount(cb, weights=change[rb] * vb, minlength=k)
        return g

    for _ in range(settings.steps):
        g = gradient(ahead)
        new = ahead - step * g
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - step * settings.l1 / n, 0)
        if g @ (new - w) > 0:
            speed = 1.0
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead = new + (speed - 1) / faster * (new - w)
        w, speed = new, faster
    return w


class Scorer:
    def __init__(self, model: Model):
        self.bias = model.bias
        self.place = {f: i for i, f in enumerate(model.weights)}
        self.weights = np.array([*model.weights.values(), 0.0])
        self.table = ChunkTable(lambda words: [
            [self.place[f] for f in word_features(w) if f in self.place] for w in words.to_pylist()])

    def __call__(self, texts: pa.Array) -> np.ndarray:
        lists = pc.ascii_split_whitespace(texts)
        ends = lists.offsets.to_numpy()
        ends = (ends - ends[0]).astype(np.int64)
        words, at = distinct(lists.flatten())
        flat, offsets, row = self.table.rows(words)
        # White space at an end leaves an empty piece there, which is no word.
        real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False).astype(bool)
        before = np.concatenate([[0], np.cumsum(real[at])])
        many = n_windows(np.diff(before[ends]))
        first = np.concatenate([[0], np.cumsum(many)])
        at = row[at]
        hits = np.flatnonzero(offsets[at + 1] > offsets[at])
        found, sizes = ragged_take(flat, offsets, at[hits])
        text = np.searchsorted(ends, hits, "right") - 1
        nth = (before[hits] - before[ends[text]]) // STRIDE
        # A word lies in the window that starts in its stride and in those before that still reach it.
        window, feature = [], []
        for back in range(WINDOW // STRIDE):
            inside = np.repeat((nth >= back) & (nth - back < many[text]), sizes)
            window.append(np.repeat(first[text] + nth - back, sizes)[inside])
            feature.append(found[inside])
        each, count = np.unique(np.concatenate(window) * len(self.weights) + np.concatenate(feature), return_counts=True)
        values = self.weights[each % len(self.weights)] * strength(count)
        z = np.bincount(each // len(self.weights), weights=values, minlength=int(first[-1]))
        if not len(texts):
            return z
        return 1 / (1 + np.exp(-self.bias - np.maximum.reduceat(z, first[:-1])))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """All columns and rows of ``docs`` with the score of each whole text, between 0 and 1."""
    kept = [c for c in docs.columns if c != out]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in text_slices(batch, text, SLICE):
                yield part.append_column(out, pa.array(scorer(filled(part.column(text)))))

    return docs.select(*kept).mapInArrow(run, schema)
