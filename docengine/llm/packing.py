"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A length r belongs to the class k with capacity / (k + 1) < r <= capacity / k, and a bin of class k takes
exactly k documents of it; the smallest documents, beyond the last class, follow one another in a bin of
their own. Each worker packs the documents of its partition on its own, in one pass. A bin with its k
documents has some room left. A sliver is filled at once with the beginning of the next document; other bins
wait until their room adds up to so many sequences as a document's class says, so that it is mostly long
documents, whose own bins would leave the most room, that are cut to fill them. What is left at a worker's
end, one begun bin for each class at most, goes into full sequences and, last, into ones whose lengths are
powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import give_back, slices, small_batches, text_of
from docengine.llm.tokens import encoder, with_end

CAPACITY = 4096
#: Bytes of text that are encoded at a time.
SLICE = 4 << 20
#: Documents of at most capacity / (CLASSES + 1) ids follow one another.
CLASSES = 32
#: Room of fewer ids does not wait. So at most LATEST * capacity / SLIVER bins wait.
SLIVER = 64
#: A document of class k is cut to fill room once that adds up to min(k, LATEST) sequences.
LATEST = 8
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bin_class int"


class Piece(NamedTuple):
    """Ids [start, start + len(ids)) of the nth document added; bin_class is its class where it counts in a bin of that class."""

    nth: int
    doc: int | None
    start: int
    ids: np.ndarray
    total: int
    bin_class: int | None

    def cut(self, n: int) -> tuple[Piece, Piece]:
        """The first n ids and the others, of no class: a cut document fills room."""
        return self._replace(ids=self.ids[:n], bin_class=None), self._replace(start=self.start + n, ids=self.ids[n:], bin_class=None)


class Packer:
    """Takes documents one by one; done holds the finished sequences."""

    def __init__(self, capacity: int = CAPACITY, classes: int = CLASSES):
        self.capacity, self.classes, self.nth = capacity, classes, 0
        self.open: dict[int, list[Piece]] = {k: [] for k in range(1, classes + 1)}
        self.gaps: list[tuple[int, list[Piece]]] = []
        self.room = 0
        self.stream: list[Piece] = []
        self.stream_room = capacity
        self.done: list[list[Piece]] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.nth += 1
        piece = Piece(self.nth, doc, 0, ids, len(ids), 1)
        while len(piece.ids) >= self.capacity:
            first, piece = piece.cut(self.capacity)
            self.done.append([first._replace(bin_class=1)])
        if not len(piece.ids):
            return
        k = self.capacity // len(piece.ids)
        fills = self.room >= min(k, LATEST) * self.capacity
        while len(piece.ids) and (fills or self.gaps and self.gaps[-1][0] < SLIVER):
            room, pieces = self.gaps.pop()
            self.room -= room
            first, piece = piece.cut(room)
            pieces.append(first)
            self._close(room - len(first.ids), pieces)
        if not len(piece.ids):
            return
        k = self.capacity // len(piece.ids)
        if k > self.classes:
            self._follow(piece)
            return
        pieces = self.open[k]
        pieces.append(piece._replace(bin_class=k))
        if len(pieces) == k:
            self.open[k] = []
            self._close(self.capacity - sum(len(p.ids) for p in pieces), pieces)

    def _close(self, room: int, pieces: list[Piece]) -> None:
        if room:
            self.gaps.append((room, pieces))
            self.room += room
        else:
            self.done.append(pieces)

    def _follow(self, piece: Piece) -> None:
        while len(piece.ids):
            first, piece = piece.cut(self.stream_room)
            self.stream.append(first)
            self.stream_room -= len(first.ids)
            if not self.stream_room:
                self.done.append(self.stream)
                self.stream, self.stream_room = [], self.capacity

    def finish(self) -> None:
        """What is left goes into the room of full bins, then into full sequences and ones of powers of two."""
        rest = [p._replace(bin_class=None) for pieces in [*self.open.values(), self.stream] for p in pieces]
        full, self.gaps, self.room = sorted(self.gaps, key=lambda g: g[0]), [], 0
        self.open, self.stream, self.stream_room = {k: [] for k in self.open}, [], self.capacity
        while full and sum(len(p.ids) for p in rest) < sum(room for room, _ in full):
            rest += [p._replace(bin_class=None) for p in full.pop()[1]]  # the emptiest bin is taken apart
        left = sum(len(p.ids) for p in rest)
        room, pieces = 0, []
        for piece in rest:
            while len(piece.ids):
                if not room:
                    if full:
                        room, pieces = full.pop()
                    else:
                        room, pieces = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1), []
                    self.done.append(pieces)
                first, piece = piece.cut(room)
                pieces.append(first)
                room, left = room - len(first.ids), left - len(first.ids)


def _merged(sequence: list[Piece]) -> list[Piece]:
    """Neighbours that continue each other in one document, made one piece."""
    out: list[Piece] = []
    for piece in sequence:
        if out and out[-1].nth == piece.nth and out[-1].start + len(out[-1].ids) == piece.start:
            out[-1] = out[-1]._replace(ids=np.concatenate([out[-1].ids, piece.ids]))
        else:
            out.append(piece)
    return out


def pack(docs: DataFrame, tokenizer: str, end: int = 2, with_ids: bool = False, remember: bool = True) -> DataFrame:
    """Pieces of the documents (doc_id, text): each id of text plus the end id lies in one piece.

    Null and empty texts are the end id alone; repeated rows and rows without an id are documents of their own.
    Equal lengths keep their order. A sequence's number holds its worker's partition above bit 40. bin_class is
    the class of a document that lies in a bin of it, null where it fills room or is a rest. with_ids adds the
    ids of a piece as 32-bit little-endian bytes. Without remember a worker forgets its encoder after each task:
    slower, but other stages find its memory free.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts, packer = encoder(tokenizer, "word").encode, Packer()
        number = TaskContext.get().partitionId() << 40

        def rows() -> pa.RecordBatch:
            nonlocal number
            out: list[tuple] = []
            for sequence in packer.done:
                offset = 0
                for p in _merged(sequence):
                    data = p.ids.tobytes()
                    out.append((p.doc, p.start, len(p.ids), zlib.crc32(data), p.total, number, offset, p.bin_class, data))
                    offset += len(p.ids)
                number += 1
            packer.done = []
            columns = list(zip(*out, strict=True)) or [()] * 9
            names = [x.split() for x in PIECES.split(", ")]
            arrays = {n: pa.array(c, pa.int64() if kind == "long" else pa.int32()) for (n, kind), c in zip(names, columns, strict=False)}
            return pa.RecordBatch.from_pydict(arrays | ({"ids": pa.array(columns[8], pa.binary())} if with_ids else {}))

        for batch in slices(batches, size=SLICE):
            ids, offsets = with_end(*encode_texts(text_of(batch)), end)
            ids = ids.astype("<u4")
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                packer.add(doc, ids[a:b].copy())
            yield rows()
        packer.finish()
        yield rows()
        if not remember:
            encoder.cache_clear()
            del encode_texts
            give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return small_batches(rows).mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))
