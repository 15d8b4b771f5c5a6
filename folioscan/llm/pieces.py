"""SentencePiece ids by a table of distinct marked words.

In a vocabulary where white-space marks stand only at the front of a piece, no piece crosses from a word to the mark of the
next one. Each run of marks with the word behind it is therefore segmented apart: the library sees each distinct marked word
once, and ids come back by position. Texts with runs of spaces are cut by a pattern, texts that hold the mark itself go
through the library whole, as does every text when the model's normaliser is not the identity.

Defined cases: a null text is an empty text and has the end id alone; ties, repeated rows and null ids stay rows of their
own; an empty table gives no rows; other columns are kept by ``encode`` only if asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkTable, distinct, no_collection
from .common import filled, ragged_take, text_slices

MARK = "▁"
_UNITS = re.compile(r" *[^ ]+| +").findall


class Pieces:
    def __init__(self, path: str, keep: int = 1_500_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table = ChunkTable(self._encode, keep)
        self.alone = [self.model.piece_to_id(MARK)]
        self.apart = self._front_marks() and self._identity()

    def _front_marks(self) -> bool:
        front = re.compile(f"{MARK}*[^{MARK}]*").fullmatch
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        return all(map(front, pieces))

    def _identity(self) -> bool:
        """Does the normaliser keep texts as they are, but for the mark put before them?"""
        probe = " a  béé①Ａ\n\tC  "
        return self.model.normalize(probe) == MARK + probe.replace(" ", MARK)

    def _encode(self, words: pa.Array) -> list[Sequence[int]]:
        out = self.model.encode(words.to_pylist(), num_threads=1)
        # An empty word is a mark alone; the library would give no id at all.
        return [ids or self.alone for ids in out]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each."""
        n = len(texts)
        flags = lambda x: x.to_numpy(zero_copy_only=False).astype(bool)
        whole = flags(pc.match_substring(texts, MARK)) | np.full(n, not self.apart)
        runs = flags(pc.match_substring_regex(texts, r"\A |  ")) & ~whole
        empty = flags(pc.equal(pc.binary_length(texts), 0))
        plain = ~(whole | runs | empty)
        flats, sizes, order = [], np.zeros(n, np.int64), []
        if plain.any():
            flat, count = self._units(pc.split_pattern(texts.filter(pa.array(plain)), " "))
            flats.append(flat)
            sizes[plain] = count
            order.append(np.flatnonzero(plain))
        if runs.any():
            units = [[u[1:] for u in _UNITS(" " + t)] for t in texts.filter(pa.array(runs)).to_pylist()]
            flat, count = self._units(pa.array(units, pa.list_(pa.string())))
            flats.append(flat)
            sizes[runs] = count
            order.append(np.flatnonzero(runs))
        if whole.any():
            ids = self.model.encode(texts.filter(pa.array(whole)).to_pylist(), num_threads=1)
            flats.append(np.concatenate([np.asarray(x, np.uint32) for x in ids]))
            sizes[whole] = [len(x) for x in ids]
            order.append(np.flatnonzero(whole))
        if len(order) < 2 and not empty.any():
            return flats[0] if flats else np.zeros(0, np.uint32), sizes
        order = np.concatenate([*order, np.flatnonzero(empty)])
        row = np.empty(n, np.int64)
        row[order] = np.arange(n)
        flat = np.concatenate([*flats, np.zeros(0, np.uint32)])
        return ragged_take(flat, np.concatenate([[0], np.cumsum(sizes[order])]), row)[0], sizes

    def _units(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        ends = lists.offsets.to_numpy()
        ends = (ends - ends[0]).astype(np.int64)
        words, at = distinct(lists.flatten())
        flat, offsets, row = self.table.rows(words)
        ids, sizes = ragged_take(flat, offsets, row[at])
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids, total[ends[1:]] - total[ends[:-1]]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", decode: bool = False) -> DataFrame:
    """``key`` and ``ids`` (with the end id) of each whole text; with ``decode`` also the text the library makes of them."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>" + ", decoded string" * decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            for part in text_slices(batch, "text", 4 << 20):
                coder = coder or Pieces(path)
                ids, sizes = coder.encode(filled(part.column("text")))
                ids = np.insert(ids, np.cumsum(sizes), coder.model.eos_id()).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(sizes + 1)])
                columns = [part.column(key), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))]
                if decode:
                    with no_collection():
                        columns.append(pa.array([coder.model.decode(ids[a:b].tolist())
                                                 for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [key, "ids", "decoded"][: len(columns)])

    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, schema)
