"""Tables of distinct chunks: a tokenizer sees each chunk once, ids come back by position.

A chunk is a stretch of text whose tokens do not depend on its neighbours. Texts are split and dictionary-encoded by Arrow,
the tokenizer encodes the distinct chunks a worker has not met yet, and numpy gathers the ids of every position. A worker
keeps up to ``keep`` chunks for later batches; further ones are encoded per batch, so memory stays bounded.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ragged_take

KEEP = 1_500_000
# White space of any definition; texts in which some touches other are encoded whole where white space makes tokens.
_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_RUNS = _WS + _WS
_MARKED = r"[A-Za-zÀ-ÖØ-öø-ÿ][.,;:!?]\z"
_WORDS = r"\A ?[A-Za-zÀ-ÖØ-öø-ÿ]+\z"


class ChunkTable:
    """Ids of chunks, encoded by ``encode`` (an array of texts to a list of id lists) when first met."""

    def __init__(self, encode: Callable[[pa.Array], list[Sequence[int]]], keep: int = KEEP):
        self.encode, self.keep = encode, keep
        self.known = pa.array([], pa.string())
        self.flat = np.zeros(0, np.uint32)
        self.offsets = np.zeros(1, np.int64)

    def rows(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, their offsets and, for every chunk, its row among them. Chunks must be distinct."""
        row = pc.fill_null(pc.index_in(chunks, value_set=self.known), -1).to_numpy(
            zero_copy_only=False).astype(np.int64)
        absent = np.flatnonzero(row < 0)
        if not len(absent):
            return self.flat, self.offsets, row
        new = chunks.take(pa.array(absent))
        with no_collection():
            ids = self.encode(new)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate([self.flat, np.fromiter(
            chain.from_iterable(ids), np.uint32, int(sizes.sum()))])
        offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
        first = len(self.offsets) - 1
        row[absent] = first + np.arange(len(absent))
        kept = min(max(0, self.keep - first), len(new))
        if kept:
            self.known = pa.concat_arrays([self.known, new.slice(0, kept)])
            self.offsets = offsets[: first + kept + 1].copy()
            self.flat = flat[: self.offsets[-1]].copy()
        return flat, offsets, row


@contextmanager
def no_collection():
    """Millions of short-lived lists hold no cycles; looking for some would cost more than making them."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def distinct(pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct strings and, for every position, the number of its string."""
    coded = pieces.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = [], 256
    for b in range(256):
        if b in plain:
            letters.append(chr(b))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


class ByteLevel:
    """Encoder over a ``tokenizers`` file with byte-level words.

    ``spaced``: a word's token begins with the space before it, texts keep all white space. Otherwise white space only
    separates words and letters are lower-cased by the file's normaliser.
    """

    def __init__(self, path: str, spaced: bool, keep: int = KEEP):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        # Tokens that the library looks for in the raw text; texts with one are encoded whole.
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.spaced = spaced
        self.letters = dict(enumerate(byte_letters()))
        self.table = ChunkTable(self._encode, keep)
        self.marks = np.zeros(256, np.uint32)
        for mark in ".,;:!?":
            self.marks[ord(mark)] = self._library([mark])[0][0]
        self.line = self._library(["\n"])[0] if spaced else []

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, chunks: pa.Array) -> list[Sequence[int]]:
        """Plain words go straight to the library's model, anything else through its whole pipeline."""
        plain = pc.match_substring_regex(chunks, _WORDS).to_numpy(zero_copy_only=False).astype(bool)
        text = "\n".join(chunks.filter(pa.array(plain)).to_pylist())
        if not self.spaced:
            text = text.lower()
        words = text.encode().decode("latin-1").translate(self.letters).split(self.letters[10])
        tokens = self.whole.model.tokenize
        out = np.empty(len(chunks), object)
        if plain.any():
            out[plain] = _objects([[t.id for t in tokens(w)] for w in words])
        if not plain.all():
            out[~plain] = _objects(self._library(chunks.filter(pa.array(~plain)).to_pylist()))
        return out.tolist()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        try:
            return self._encoded(texts)
        finally:
            # Buffers of this call would else stay with the allocator.
            pa.default_memory_pool().release_unused()

    def _encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = self._lines if self.spaced else lambda some: self._pieces(pc.ascii_split_whitespace(some))
        alone = np.zeros(len(texts), bool)
        if self.spaced:
            alone |= pc.match_substring_regex(texts, _RUNS).to_numpy(zero_copy_only=False).astype(bool)
        for token in self.added:
            alone |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False).astype(bool)
        if not alone.any():
            return split(texts)
        flat, count = split(texts.filter(pa.array(~alone)))
        whole = self._library(texts.filter(pa.array(alone)).to_pylist())
        sizes = np.zeros(len(texts), np.int64)
        sizes[~alone], sizes[alone] = count, [len(x) for x in whole]
        flat = np.concatenate([flat, *[np.asarray(x, np.uint32) for x in whole]])
        began = np.concatenate([[0], np.cumsum(np.concatenate([sizes[~alone], sizes[alone]]))])
        order = np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone)])
        row = np.empty(len(texts), np.int64)
        row[order] = np.arange(len(texts))
        return ragged_take(flat, began, row)[0], sizes

    def _lines(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A line break between other characters is a token, and the next line begins like a text."""
        lists = pc.split_pattern(texts, "\n")
        ends = _ends(lists)
        ids, sizes = self._pieces(pc.split_pattern(lists.flatten(), " "))
        if len(sizes) == len(texts):
            return ids, sizes
        last = np.zeros(len(sizes), bool)
        last[ends[1:] - 1] = True
        total = np.cumsum(sizes)
        ids = np.insert(ids, total[~last], self.line[0])
        total = np.concatenate([[0], np.cumsum(sizes + ~last)])
        return ids, total[ends[1:]] - total[ends[:-1]]

    def _pieces(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        ends = _ends(lists)
        names, at = distinct(lists.flatten())
        # A mark behind a letter at the end of a word is a token of its own.
        marked = pc.match_substring_regex(names, _MARKED)
        stems = pc.if_else(marked, pc.utf8_slice_codeunits(names, 0, -1), names)
        marked = marked.to_numpy(zero_copy_only=False).astype(bool)
        tail = np.frombuffer(names.buffers()[2] or b"", np.uint8)[
            np.frombuffer(names.buffers()[1], np.int32)[1 + names.offset:][: len(names)][marked] - 1]
        if self.spaced:
            # The first piece of a line has no space before it.
            first = ends[:-1]
            heads, place = np.unique(at[first], return_inverse=True)
            stems = pa.concat_arrays([pc.binary_join_element_wise("", stems, " "), stems.take(pa.array(heads))])
            marks = np.concatenate([marked, marked[heads]])
            code = np.zeros(len(names), np.uint32)
            code[marked] = self.marks[tail]
            code = np.concatenate([code, code[heads]])[marks]
            at = at.astype(np.int64)
            at[first] = len(names) + place
        else:
            marks, code = marked, self.marks[tail]
        chunks, where = distinct(stems)
        flat, offsets, row = self.table.rows(chunks)
        flat, sizes = ragged_take(flat, offsets, row[where])
        flat = np.insert(flat, np.cumsum(sizes)[marks], code)
        offsets = np.concatenate([[0], np.cumsum(sizes + marks)])
        ids, sizes = ragged_take(flat, offsets, at)
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids, total[ends[1:]] - total[ends[:-1]]


def _ends(lists: pa.ListArray) -> np.ndarray:
    ends = lists.offsets.to_numpy()
    return (ends - ends[0]).astype(np.int64)


def _objects(lists: list) -> np.ndarray:
    out = np.empty(len(lists), object)
    out[:] = lists
    return out
