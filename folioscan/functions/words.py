"""Word error rate and the spans it compares."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed as K
from .text import let, spoken_words

# What a diagonal holds that no path has come to.
_UNSEEN = -(1 << 40)
# Runs of equal words longer than this are followed one diagonal at a time, in growing strides.
_STEPS = 6
# Up to this many pairs of words the full table is the quicker way.
SHORT_CELLS = 1 << 20
# Pairs with more words than this are counted one by one; shorter ones share bands of so many cells.
_LONG_WORDS, _BAND_CELLS = 8192, 1 << 18
# Words whose ids are found together.
_ID_WORDS = 1 << 19
# One code point per distinct word, from the first supplementary plane on.
_FIRST_SYMBOL = 0x10000


def boundary_words(reference: Column, hypothesis: Column, side: Column | str) -> Column:
    """As many reference words as the hypothesis has, from the head or the tail."""
    n, size = F.size(hypothesis), F.size(reference)
    s = F.lit(side) if isinstance(side, str) else side
    take = F.least(n, size)
    first = F.when(s == "head", F.lit(1)).otherwise(size - take + 1)
    return F.when(take > 0, F.slice(reference, first, take)).otherwise(
        F.array().cast("array<string>"))


def _run(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common start."""
    at, step, most = 0, 64, min(len(a), len(b))
    while at < most:
        end = min(at + step, most)
        other = np.flatnonzero(a[at:end] != b[at:end])
        if len(other):
            return at + int(other[0])
        at, step = end, step * 2
    return most


def edit_counts(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int]:
    """(distance, substitutions, insertions, deletions) between two sequences of word ids.

    A band of diagonals around the one of the start widens by one a side with each edit. Every diagonal holds how far into
    ``a`` the edits spent so far can lead, and how many of them were substitutions; words that agree cost nothing. Diagonals
    from which the end is out of reach of the largest possible distance are dropped, so the band narrows again. Time grows
    with the length times the distance, memory with the length alone. Of equally long ways one is counted: that which leads
    further first, then substitutions before deletions before insertions.
    """
    start = _run(a, b)
    a, b = a[start:], b[start:]
    end = _run(a[::-1], b[::-1])
    a, b = a[:len(a) - end], b[:len(b) - end]
    n, m = len(a), len(b)
    goal, most = m - n, max(n, m)
    if not n or not m:
        return most, 0, m, n
    # Words past the ends, which agree with none, stop all runs.
    left, right = np.append(a, -1), np.append(b, -2)
    far = np.full(n + m + 3, _UNSEEN, np.int64)
    swaps = np.zeros(n + m + 3, np.int64)
    middle = n + 1
    diagonals = np.arange(-middle, m + 2)
    room = np.minimum(n, m - diagonals)
    far[middle] = 0
    for spent in range(1, most + 1):
        spare = most - spent
        low, high = max(-spent, -n, goal - spare) + middle, min(spent, m, goal + spare) + middle + 1
        here, above, below = slice(low, high), slice(low + 1, high + 1), slice(low - 1, high - 1)
        swap, drop, add = far[here] + 1, far[above] + 1, far[below]
        at = np.maximum(np.maximum(swap, drop), add)
        counted = np.where(at == swap, swaps[here] + 1, np.where(at == drop, swaps[above], swaps[below]))
        at = np.minimum(at, room[here])
        shift = diagonals[here]
        going = np.flatnonzero(left[at] == right[at + shift])
        for _ in range(_STEPS):
            if not len(going):
                break
            at[going] += 1
            going = going[left[at[going]] == right[at[going] + shift[going]]]
        for i in going:
            at[i] += _run(a[at[i]:], b[at[i] + shift[i]:])
        far[here], swaps[here] = at, counted
        if far[goal + middle] >= n:
            swapped = int(swaps[goal + middle])
            return spent, swapped, (spent - swapped + goal) // 2, (spent - swapped - goal) // 2
    raise AssertionError("the largest distance always reaches the end")


def _together(pairs: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """``edit_counts`` of many pairs of like size without common starts and ends: a row of the band for each pair."""
    n, m = (np.array([len(pair[side]) for pair in pairs], np.int32)[:, None] for side in (0, 1))
    # The words of all pairs in a row; after each pair's a word that agrees with none.
    left, right = (np.concatenate([x for pair in pairs for x in (pair[side], [stop])]).astype(np.int32)
                   for side, stop in ((0, -1), (1, -2)))
    left_at, right_at = (np.cumsum(np.append([[0]], size[:-1] + 1, 0), 0, dtype=np.int32) for size in (n, m))
    counts = np.zeros((len(pairs), 4), np.int64)
    middle = int(n.max()) + 1
    far = np.full((len(pairs), middle + int(m.max()) + 2), -(1 << 30), np.int32)
    swaps = np.zeros_like(far)
    far[:, middle] = 0
    goal, most, row = m - n, np.maximum(n, m), np.arange(len(pairs))
    open_ = np.ones(len(pairs), bool)
    spent = 0
    while open_.any():
        spent += 1
        spare = most - spent
        low = np.maximum(np.maximum(-spent, -n), goal - spare)
        high = np.where(open_[:, None], np.minimum(np.minimum(spent, m), goal + spare), low - 1)
        first, last = int(low[open_].min()), int(high[open_].max())
        shift = np.arange(first, last + 1, dtype=np.int32)
        start, stop = first + middle, last + middle + 1
        here, above, below = far[:, start:stop], far[:, start + 1:stop + 1], far[:, start - 1:stop - 1]
        inside = (shift >= low) & (shift <= high)
        swap, drop = here + 1, above + 1
        at = np.maximum(np.maximum(swap, drop), below)
        counted = np.where(at == swap, swaps[:, start:stop] + 1, np.where(
            at == drop, swaps[:, start + 1:stop + 1], swaps[:, start - 1:stop - 1]))
        at = np.where(inside, np.minimum(at, np.minimum(n, m - shift)), n)
        i = (left_at + at).ravel()
        j = (right_at + np.where(inside, at + shift, m)).ravel()
        before = i.copy()
        going, steps = np.flatnonzero(left[i] == right[j]), 0
        while len(going) and (steps < _STEPS or len(going) > 16):
            i[going] += 1
            j[going] += 1
            going, steps = going[left[i[going]] == right[j[going]]], steps + 1
        for cell in going:
            k = cell // len(shift)
            i[cell] += _run(left[i[cell]:left_at[k, 0] + n[k, 0]], right[j[cell]:right_at[k, 0] + m[k, 0]])
        at += (i - before).reshape(at.shape)
        np.copyto(here, at, where=inside)
        np.copyto(swaps[:, start:stop], counted, where=inside)
        lines = np.arange(len(far))
        ended = np.flatnonzero(open_ & (far[lines, (goal + middle).ravel()] >= n.ravel()))
        if len(ended):
            swapped = swaps[ended, goal[ended, 0] + middle].astype(np.int64)
            net = goal[ended, 0]
            counts[row[ended]] = np.stack([np.full(len(ended), spent), swapped, (spent - swapped + net) // 2,
                                           (spent - swapped - net) // 2], 1)
            open_[ended] = False
            if 4 * open_.sum() <= 3 * len(open_):
                n, m, goal, most, row, left_at, right_at, far, swaps, open_ = (
                    x[open_] for x in (n, m, goal, most, row, left_at, right_at, far, swaps, open_))
    return counts


def many_edit_counts(pairs: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """``edit_counts`` of each pair, one line each; pairs of like size go through their bands together."""
    counts = np.zeros((len(pairs), 4), np.int64)
    short = []
    for k, (a, b) in enumerate(pairs):
        if len(a) + len(b) > _LONG_WORDS:
            counts[k] = edit_counts(a, b)
            continue
        start = _run(a, b)
        a, b = a[start:], b[start:]
        end = _run(a[::-1], b[::-1])
        a, b = a[:len(a) - end], b[:len(b) - end]
        if len(a) and len(b):
            short.append((len(a) + len(b), k, a, b))
        else:
            counts[k] = max(len(a), len(b)), 0, len(b), len(a)
    short.sort(key=lambda pair: pair[:2], reverse=True)
    while short:
        group, short = short[:(size := max(1, _BAND_CELLS // (short[0][0] + 3)))], short[size:]
        counts[[k for _, k, _, _ in group]] = _together([(a, b) for _, _, a, b in group])
    return counts


_COUNTS = ("distance", "substitutions", "insertions", "deletions")


def _counted(lists: Sequence[pa.Array]) -> np.ndarray:
    """Counts of reference and hypothesis lists that follow each other in turn."""
    ids = pa.concat_arrays(lists).dictionary_encode("encode").indices.to_numpy()
    parts = np.split(ids, np.cumsum([len(words) for words in lists])[:-1])
    return many_edit_counts([*zip(parts[::2], parts[1::2])])


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in _COUNTS]))
def _errors(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    known = np.array([r.is_valid and h.is_valid for r, h in zip(reference, hypothesis)], bool)
    rows = np.zeros((len(known), len(_COUNTS)), np.int64)
    held: list[pa.Array] = []
    places: list[int] = []
    size = 0
    for i in np.flatnonzero(known):
        pair = [reference[int(i)].values, hypothesis[int(i)].values]
        words = len(pair[0]) + len(pair[1])
        if held and size + words > _ID_WORDS:
            rows[places] = _counted(held)
            held, places, size = [], [], 0
        held += pair
        places.append(i)
        size += words
    if held:
        rows[places] = _counted(held)
    return pa.StructArray.from_arrays(
        [pa.array(rows[:, i], mask=~known) for i in range(len(_COUNTS))], list(_COUNTS), mask=pa.array(~known))


def word_errors(reference: Column, hypothesis: Column) -> Column:
    """Least word edits that turn the reference into the hypothesis, by kind; null if either is null.

    Words become ids of their row, so there is no limit to how many distinct ones it has. Give plain columns: expressions
    with lambdas are worked out in a select before.
    """
    return _errors(reference, hypothesis)


def _symbol(index: Column) -> Column:
    code = F.lpad(F.hex(index + _FIRST_SYMBOL), 8, "0")
    return F.decode(F.unhex(code), "UTF-32")


def _short_distance(reference: Column, hypothesis: Column) -> Column:
    """The built-in distance of characters, with a character for every distinct word."""
    def encoded(ws: Column, symbols: Column) -> Column:
        return F.array_join(F.transform(ws, lambda w: F.element_at(symbols, w)), "")

    vocabulary = F.array_distinct(F.concat(reference, hypothesis))
    table = let(vocabulary, lambda v: F.map_from_arrays(v, F.transform(v, lambda w, i: _symbol(i))))
    return let(table, lambda m: F.levenshtein(encoded(reference, m), encoded(hypothesis, m))).cast("bigint")


def word_distance(reference: Column, hypothesis: Column) -> Column:
    """Edit distance in words; null if either is null. Give plain columns, as for ``word_errors``.

    The full table of a short pair is quickly filled where the row is. Longer pairs go to the band; both are exact.
    """
    short = F.size(reference).cast("bigint") * F.size(hypothesis) <= SHORT_CELLS
    far = _errors(F.when(~short, reference), F.when(~short, hypothesis))["distance"]
    return F.coalesce(F.when(short, _short_distance(reference, hypothesis)), far)


def error_rate(reference: Column, hypothesis: Column) -> Column:
    """Distance over reference words, at most 1; an empty reference fits only an empty text."""
    return rate_of(word_distance(reference, hypothesis), F.size(reference), F.size(hypothesis))


def rate_of(distance: Column, n_ref: Column, n_hyp: Column) -> Column:
    return F.when(n_ref == 0, F.when(n_hyp == 0, 0.0).otherwise(1.0)).otherwise(
        F.least(distance / n_ref, F.lit(1.0)))


def text_error_rate(reference: Column, hypothesis: Column) -> Column:
    return error_rate(spoken_words(reference), spoken_words(hypothesis))


def expected_seconds(words: Column, least_minutes: float = 1.0) -> Column:
    """Narration time of a text, with a floor in minutes."""
    return F.greatest(words / K.WORDS_PER_MINUTE, F.lit(least_minutes)) * 60
