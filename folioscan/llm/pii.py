"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what patterns miss.

Patterns give the base spans (email, ip, card, phone); a match that fails its check is dropped. The field labels the tokens
that hold a digit or ``@``; any other token is outside by rule, so runs of neighbouring tokens are separate chains. Equal or
similar tokens of a document - same letters, or same seven and more digits however written - are joined by skip edges to one
hub, two hops from any mention to any other however many there are. A hub hands on what the surest other mention says (of
two mentions that is the plain skip edge), so many vague mentions do not outvote a sure one. Loopy messages are passed until
those of the document settle. A number whose pattern fails because another one
follows it, or that is written once with and once without its prefix, is found that way.

The field is fitted by pseudo-likelihood on a bounded sample of documents, with the base spans as labels; tokens inside
matches that failed their check are left open. Tokens unlike any seen are outside by prior. A span is added when its label
is likelier than ``sure`` and it meets no base span; base spans stay.

Every search is linear in the text. Defined cases: null and empty texts have no spans; positions are code points, ends
exclusive; ties sort by kind as listed above; repeated rows and null ids stay rows of their own; an empty table, or one
without digits and ``@``, gives a field that adds nothing; existing columns named like the results are replaced.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drawn, filled, text_slices

KINDS = ("email", "ip", "card", "phone")
SPAN = "array<struct<kind: string, start: int, end: int>>"
Span = tuple[int, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
# A match starts at the first digit of a run or nowhere in it.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+").finditer
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_NOT_DIGIT = re.compile("[^0-9]+")
_TRIGGER = re.compile("[0-9@]").search
_TOKEN_END = re.compile(r"\s|\Z").search
_RUN = re.compile("[0-9]+|[^\\W0-9_]+")


@dataclass(frozen=True)
class Settings:
    """``sample`` documents at most are used to fit the field."""

    sample: int = 3_000
    buckets: int = 1 << 12
    l2: float = 0.02
    outside: float = 3.0
    steps: int = 600
    rounds: int = 12
    settled: float = 1e-4
    sure: float = 0.75


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """(start, kind, end) of what the patterns hold for, in order, and the matches that failed their check."""
    spans = [(a, 0, b) for a, b in emails(text)]
    failed = []
    if _TRIGGER(text):
        for m in _IP(text):
            good = all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
            (spans if good else failed).append((m.start(), 1, m.end()))
        for m in _CARD(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
            elif len(digits) >= 14:
                failed.append((m.start(), 2, m.end()))
        for m in _PHONE(text):
            good = 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15
            (spans if good else failed).append((m.start(), 3, m.end()))
    spans.sort()
    return spans, sorted((a, b) for a, _, b in failed)


def tokens(text: str) -> list[tuple[int, int]]:
    """Tokens that hold a digit or ``@``, without the punctuation around them."""
    found = []
    m = _TRIGGER(text)
    while m:
        start = m.start()
        while start and not text[start - 1].isspace():
            start -= 1
        end = _TOKEN_END(text, m.start()).start()
        a, b = start, end
        while b > a and text[b - 1] in ".,;:!?\"'":
            b -= 1
        while a < b and text[a] in "\"'":
            a += 1
        if a < b:
            found.append((a, b))
        m = _TRIGGER(text, end)
    return found


LABELS = 1 + 2 * len(KINDS)
FAR = -30.0


def begin(kind: int) -> int:
    return 1 + 2 * kind


def allowed() -> np.ndarray:
    """Which label may follow which: the inside of a kind needs the same kind before it."""
    ok = np.ones((LABELS, LABELS), bool)
    for kind in range(len(KINDS)):
        inside = begin(kind) + 1
        ok[:, inside] = False
        ok[[begin(kind), inside], inside] = True
    return ok


def shape(word: str) -> str:
    """Runs of digits by their length, runs of letters as one sign; long numbers with what their check says."""
    if "@" in word:
        return "@" + _RUN.sub(lambda m: "d" if m[0].isdigit() else "a", word)
    digits = _NOT_DIGIT.sub("", word)
    if len(digits) >= 14:
        return f"n{len(digits)}{luhn(digits)}{_RUN.sub('', word)[:3]}"
    parts = word.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        return f"ip{all(len(p) < 4 and int(p) <= 255 for p in parts)}"
    return _RUN.sub(lambda m: f"d{min(len(m[0]), 20)}" if m[0].isdigit() else "a", word)[:24]


def likeness(word: str) -> str:
    """Tokens with the same likeness share a hub."""
    digits = _NOT_DIGIT.sub("", word)
    return digits if len(digits) >= 7 and "@" not in word else word.strip("()[]<>").lower()


@dataclass
class Graph:
    """Nodes of many documents: feature buckets, chain edges, skip edges from mention to hub, where chains start, document.

    A hub is named by the node after its last mention.
    """

    features: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    first: np.ndarray
    doc: np.ndarray


def graph(texts: list[str], found: list[list[tuple[int, int]]], buckets: int) -> Graph:
    features, chain, skip, first = [], [], [], []
    n = 0
    for text, spans in zip(texts, found):
        words = [text[a:b] for a, b in spans]
        shapes = [shape(w) for w in words]
        joined = [i > 0 and not text[spans[i - 1][1]: spans[i][0]].strip(" \t.,;:!?\"'") for i in range(len(spans))]
        alike: dict[str, list[int]] = {}
        for i, s in enumerate(shapes):
            before = shapes[i - 1] if joined[i] else "-"
            after = shapes[i + 1] if i + 1 < len(spans) and joined[i + 1] else "-"
            names = ("bias", "s" + s, "p" + before, "n" + after, f"b{before}|{s}", f"a{s}|{after}")
            features.append([zlib.crc32(x.encode()) % buckets for x in names])
            first.append(not joined[i])
            if joined[i]:
                chain.append((n + i - 1, n + i))
            alike.setdefault(likeness(words[i]), []).append(n + i)
        for mentions in alike.values():
            if len(mentions) > 1:
                skip += [(i, mentions[-1] + 1) for i in mentions]
        n += len(spans)
    return Graph(np.array(features, np.int32).reshape(-1, 6), np.array(chain, np.int64).reshape(-1, 2),
                 np.array(skip, np.int64).reshape(-1, 2), np.array(first, bool),
                 np.repeat(np.arange(len(found)), [len(f) for f in found]))


def labels(spans: list[tuple[int, int]], base: list[Span], failed: list[tuple[int, int]]) -> list[int]:
    """Label of each token by the base spans; -1 (open) inside a match that failed."""
    out, starts = [], [b[0] for b in base]
    for a, b in spans:
        at = bisect_left(starts, b) - 1
        if at >= 0 and base[at][2] > a:
            start, kind, _ = base[at]
            out.append(begin(kind) + (start < a and bool(out) and out[-1] >= begin(kind) and out[-1] <= begin(kind) + 1))
        else:
            out.append(-1 if any(x < b and y > a for x, y in failed) else 0)
    return out


@dataclass(frozen=True)
class Field:
    emission: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def scores(self, g: Graph) -> np.ndarray:
        e = self.emission[g.features].sum(axis=1)
        inside = np.arange(2, LABELS, 2)
        e[np.ix_(g.first, inside)] = FAR
        return e

    def marginals(self, g: Graph, rounds: int, settled: float = 1e-4) -> np.ndarray:
        """Loopy sum-product over the chains and hubs of all documents at once, damped, until a document's messages settle.

        A document is looked at every ``rounds`` rounds, so it does not depend on its neighbours when it is done. One that
        still swings after four hundred rounds and four for each of its tokens is damped more and more.
        """
        local = self.scores(g)
        total, n_docs = local.copy(), int(g.doc.max(initial=-1)) + 1
        chain, (mention, name) = g.chain, g.skip.T
        hub = np.unique(name, return_inverse=True)[1]
        ahead, back = np.zeros((len(chain), LABELS)), np.zeros((len(chain), LABELS))
        shared = np.zeros((len(mention), LABELS))
        patience = 400 + 4 * np.bincount(g.doc, minlength=n_docs)
        edges, ends = np.arange(len(chain)), np.arange(len(mention))
        done = 0
        while len(edges) or len(ends):
            (a, b), m = chain[edges].T, mention[ends]
            f, r, h = ahead[edges], back[edges], shared[ends]
            # Hubs numbered without gaps: what is left changes only between looks.
            group = np.unique(hub[ends], return_inverse=True)[1]
            first = np.concatenate([[0], np.cumsum(np.bincount(group))[:-1]]).astype(int)
            of_edge, of_end = g.doc[a], g.doc[m]
            nodes = np.unique(np.concatenate([a, b, m]))
            for _ in range(max(1, rounds)):
                done += 1
                step = 0.5 ** (1 + np.maximum(0, done - patience + 49) // 50)
                total[nodes] = local[nodes]
                np.add.at(total, b, f)
                np.add.at(total, a, r)
                total[m] += h
                f_new, r_new = _through(total[a] - r, self.chain), _through(total[b] - f, self.chain.T)
                rest = total[m] - h
                h_new = _through(rest[_surest_other(rest, group, first)], self.skip)
                moved = np.zeros(n_docs)
                for old, new, doc in ((f, f_new, of_edge), (r, r_new, of_edge), (h, h_new, of_end)):
                    change = step[doc][:, None] * (new - old)
                    old += change
                    np.maximum.at(moved, doc, np.abs(change).max(axis=1, initial=0))
            ahead[edges], back[edges], shared[ends] = f, r, h
            going = moved > settled
            edges, ends = edges[going[of_edge]], ends[going[of_end]]
        belief = local.copy()
        np.add.at(belief, chain[:, 1], ahead)
        np.add.at(belief, chain[:, 0], back)
        belief[mention] += shared
        return _softmax(belief)


def _through(x: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Messages across an edge: sums over the sender's labels, the largest of each is 0."""
    out = np.log(np.exp(x - x.max(axis=1, keepdims=True)) @ np.exp(pair))
    return out - out.max(axis=1, keepdims=True)


def _surest_other(rest: np.ndarray, group: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each mention the surest one among the others of its hub, the earliest of equals."""
    if not len(rest):
        return np.zeros(0, int)
    sure = np.round(_softmax(rest).max(axis=1), 9)
    order = np.lexsort((np.arange(len(group)), -sure, group))
    best, second = order[first], order[first + 1]
    return np.where(best[group] == np.arange(len(group)), second[group], best[group])


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def fit_graph(g: Graph, y: np.ndarray, settings: Settings) -> Field:
    """Pseudo-likelihood: each label given its chain neighbours and the other labels of its hub, by Adam on all nodes."""
    prior = np.zeros((settings.buckets, LABELS))
    prior[zlib.crc32(b"bias") % settings.buckets, 0] = settings.outside
    bar = np.where(allowed(), 0.0, FAR)
    size = settings.buckets * LABELS
    w = np.zeros(size + 2 * LABELS * LABELS)
    known = np.flatnonzero(y >= 0)
    if not len(known):
        return Field(prior, bar, np.zeros((LABELS, LABELS)))
    target = np.eye(LABELS)[y[known]]
    ok = lambda e: e[(y[e] >= 0).all(axis=1)] if len(e) else e
    chain = ok(g.chain)
    # What the other mentions of a hub are labelled, on average.
    mention, hub = g.skip[y[g.skip[:, 0]] >= 0].T
    hub = np.unique(hub, return_inverse=True)[1]
    own = np.eye(LABELS)[y[mention]]
    held = np.zeros((len(np.unique(hub)), LABELS))
    np.add.at(held, hub, own)
    others = (held[hub] - own) / np.maximum(1, np.bincount(hub)[hub] - 1)[:, None]

    def unpack(w: np.ndarray) -> Field:
        emission = prior + w[:size].reshape(-1, LABELS)
        c, s = w[size:].reshape(2, LABELS, LABELS)
        return Field(emission, c + bar, (s + s.T) / 2)

    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, settings.steps + 1):
        field = unpack(w)
        z = field.scores(g)
        a, b = chain.T
        np.add.at(z, b, field.chain[y[a]])
        np.add.at(z, a, field.chain.T[y[b]])
        z[mention] += others @ field.skip
        d = np.zeros_like(z)
        d[known] = (_softmax(z[known]) - target) / len(known)
        ge = np.zeros((settings.buckets, LABELS))
        for i in range(g.features.shape[1]):
            np.add.at(ge, g.features[:, i], d)
        gc, gs = np.zeros((LABELS, LABELS)), others.T @ d[mention]
        np.add.at(gc, y[a], d[b])
        np.add.at(gc.T, y[b], d[a])
        grad = np.concatenate([ge.ravel(), gc.ravel(), ((gs + gs.T) / 2).ravel()]) + settings.l2 * w / len(known)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return unpack(w)


def fit(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> Field:
    """Fit on the driver, on tokens of at most ``sample`` documents drawn by hash of their id and text."""
    some = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    chosen = drawn(some, settings.sample, "_key", "text").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = part.column("text").to_pylist()
                found = [tokens(t) for t in texts]
                g = graph(texts, found, settings.buckets)
                y = [x for t, f in zip(texts, found) for x in labels(f, *base_spans(t))]
                yield pa.RecordBatch.from_arrays([pa.array([b]) for b in (
                    g.features.tobytes(), g.chain.tobytes(), g.skip.tobytes(), g.first.tobytes(),
                    np.array(y, np.int64).tobytes())], ["features", "chain", "skip", "start", "y"])

    parts = chosen.mapInArrow(run, "features binary, chain binary, skip binary, start binary, y binary").collect()
    read = lambda name, kind: [np.frombuffer(p[name], kind) for p in parts]
    ys = read("y", np.int64)
    shift = np.cumsum([0, *map(len, ys)])
    edges = lambda name: np.concatenate(
        [e.reshape(-1, 2) + s for e, s in zip(read(name, np.int64), shift)] + [np.zeros((0, 2), np.int64)])
    g = Graph(np.concatenate([f.reshape(-1, 6) for f in read("features", np.int32)] + [np.zeros((0, 6), np.int32)]),
              edges("chain"), edges("skip"), np.concatenate([*read("start", bool), np.zeros(0, bool)]),
              np.zeros(shift[-1], np.int64))
    return fit_graph(g, np.concatenate([*ys, np.zeros(0, np.int64)]), settings)


def added_spans(texts: list[str], base: list[list[Span]], field: Field, settings: Settings) -> list[list[Span]]:
    """Spans the field adds to each text."""
    found = [tokens(t) for t in texts]
    out: list[list[Span]] = [[] for _ in texts]
    g = graph(texts, found, settings.buckets)
    if not len(g.features):
        return out
    p = field.marginals(g, settings.rounds, settings.settled)
    label = p.argmax(axis=1)
    # What counts is the kind; begin and inside share its mass.
    mass = p[:, 1::2] + p[:, 2::2]
    sure = mass.max(axis=1) >= settings.sure
    label = np.where(sure & (label > 0), label, 0)
    at = 0
    for i, spans in enumerate(found):
        held: list[list[int]] = []
        before = 0
        for (a, b), y in zip(spans, label[at: at + len(spans)].tolist()):
            kind = (y - 1) // 2
            if y and y % 2 == 0 and held and before and held[-1][1] == kind:
                held[-1][2] = b
            elif y:
                held.append([a, kind, b])
            before = y
        at += len(spans)
        ends = base[i]
        starts = [s[0] for s in ends]
        for a, kind, b in held:
            k = bisect_left(starts, b) - 1
            if not any(ends[j][2] > a for j in range(max(0, k - 3), k + 1)):
                out[i].append((a, kind, b))
    return out


def find(docs: DataFrame, field: Field, settings: Settings = Settings(), text: str = "text", base: str = "base",
         spans: str = "spans") -> DataFrame:
    """All columns and rows with the base spans and all spans of each whole text, in order."""
    kept = [c for c in docs.columns if c not in (base, spans)]
    kind = T.StructType.fromDDL(f"a {SPAN}")["a"].dataType
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(base, kind), T.StructField(spans, kind)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def column(rows: list[list[Span]]) -> pa.Array:
        flat = [s for r in rows for s in r]
        struct = pa.StructArray.from_arrays(
            [pa.array([KINDS[k] for _, k, _ in flat], pa.string()), pa.array([a for a, _, _ in flat], pa.int32()),
             pa.array([b for _, _, b in flat], pa.int32())], fields=list(arrow.value_type))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text):
                whole = filled(part.column(text))
                some = np.flatnonzero(pc.match_substring_regex(whole, "[0-9@]").to_numpy(zero_copy_only=False))
                texts = whole.take(pa.array(some)).to_pylist()
                own = [base_spans(t)[0] for t in texts]
                more = added_spans(texts, own, field, settings)
                first: list[list[Span]] = [[] for _ in range(len(whole))]
                every: list[list[Span]] = [[] for _ in range(len(whole))]
                for i, a, b in zip(some.tolist(), own, more):
                    first[i], every[i] = a, sorted(a + b)
                yield part.append_column(base, column(first)).append_column(spans, column(every))

    return docs.select(*kept).mapInArrow(run, schema)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame, field: Field, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans are replaced as one."""
    schema = docs.schema

    def mask(value: str, spans: list[Span]) -> str:
        held: list[list[int]] = []
        for a, kind, b in sorted(spans):
            if held and a < held[-1][2]:
                held[-1][2] = max(b, held[-1][2])
            else:
                held.append([a, kind, b])
        parts, at = [], 0
        for a, kind, b in held:
            parts += [value[at:a], f"[{KINDS[kind].upper()}]"]
            at = b
        return "".join([*parts, value[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text):
                at = part.schema.get_field_index(text)
                column = part.column(at)
                hit = pc.fill_null(pc.match_substring_regex(column, "[0-9@]"), False)
                if pc.any(hit).as_py():
                    texts = column.filter(hit).to_pylist()
                    own = [base_spans(t)[0] for t in texts]
                    more = added_spans(texts, own, field, settings)
                    column = pc.replace_with_mask(column, hit, pa.array(
                        [mask(t, x + y) for t, x, y in zip(texts, own, more)], column.type))
                yield part.set_column(at, part.schema.field(at), column)

    return docs.mapInArrow(run, schema)
