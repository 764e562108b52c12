"""Repeated-window search: anchors, and a count-min sketch of them.

Every window of ``width`` units (words or bytes) has an anchor: the smallest
hash among its ``gram``-unit substrings.  Equal windows have equal anchors, so
a window whose anchor occurs once in the corpus is certainly unique.  The
sketch counts anchors: each partition sketches its own, the partitions'
sketches are added cell by cell in distributed chunks, and what remains is one
bit a cell, "two or more".  Its width follows the input up to a stated bound,
so what is broadcast is bounded; a fuller sketch lets more windows through to
the exact pass and never loses one.

``repeated_anchors`` gives bits of the same form that fill more slowly: the
chunks count anchors by 32 further bits of their hash, and only those that do
occur twice set cells.  Anchors that occur once take no room in what is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum

U = np.uint64
ROWS = 2
CHUNK = 16
#: Cells of a chunk of repeated_anchors, in bits.
FINE = 15
MIN_BITS = 20
#: At most 2 rows of 2 ** 29 cells, one bit each: 128 MB.
MAX_BITS = 29
#: A task hands on its part of the sketch after so many anchors.
FLUSH = 1 << 21
_SALT = [U(0x2545F4914F6CDD1D), U(0x9FB21C651E98DF25)]


@dataclass(frozen=True)
class Piece:
    """Windows of a run of texts: start unit, owner text, anchor place and hash."""

    at: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    anchor: np.ndarray


def anchored(values: np.ndarray, first: np.ndarray, width: int, gram: int) -> Piece:
    """Windows and anchors of unit ``values``; text j owns ``first[j]:first[j+1]``."""
    grams = textnum.rolling(values, gram, 0)
    place = textnum.sliding_argmin(grams, width - gram + 1)
    if not len(place):
        none = np.zeros(0, np.int64)
        return Piece(none, none, none, none.astype(np.uint64))
    room = np.maximum(np.diff(first) - width + 1, 0)
    owner = np.repeat(np.arange(len(room)), room)
    at = np.arange(len(owner)) + np.repeat(first[:-1] - (np.cumsum(room) - room), room)
    place = place[at]
    return Piece(at, owner, place, grams[place])


def changes(p: Piece) -> np.ndarray:
    """True where a window's anchor is not the one of the window before it."""
    new = np.ones(len(p.at), dtype=bool)
    if len(new):
        new[1:] = (p.place[1:] != p.place[:-1]) | (p.owner[1:] != p.owner[:-1])
    return new


def _cells(anchor: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (textnum.mix(anchor ^ _SALT[row]) >> U(64 - bits)).astype(np.int64)


def sketch_bits(units: float, per_unit: float, room: float) -> int:
    """Width so that ``room`` cells stand for each expected anchor, within bounds."""
    want = max(1.0, units * per_unit * room)
    return int(min(MAX_BITS, max(MIN_BITS, np.round(np.log2(want)))))


Split = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def repeated_cells(texts: DataFrame, split: Split, width: int, gram: int, bits: int) -> np.ndarray:
    """The merged sketch of the single text column: ROWS x 2 ** bits bits, packed."""

    def partition_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = [], 0
        for batch in batches:
            data, offsets = textnum.buffers(batch.column(0))
            for a, b in textnum.pieces(offsets):
                p = anchored(*split(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), width, gram)
                seen.append(p.anchor[changes(p)])
                held += len(seen[-1])
                if held > FLUSH:
                    yield from counted(np.concatenate(seen))
                    seen, held = [], 0
        if held:
            yield from counted(np.concatenate(seen))

    def counted(anchors: np.ndarray) -> Iterator[pa.RecordBatch]:
        for row in range(ROWS):
            cell = np.sort(_cells(anchors, row, bits))
            head = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
            more = np.diff(np.r_[head, len(cell)]) > 1
            cell = cell[head]
            cut = np.searchsorted(cell, np.arange((1 << bits >> CHUNK) + 1) << CHUNK)
            low = (cell & ((1 << CHUNK) - 1)).astype(np.uint16)
            rows = [(row, c, low[s:e][~more[s:e]].tobytes(), low[s:e][more[s:e]].tobytes()) for c, (s, e) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if e > s]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["row", "chunk", "once", "more"])

    def merged(table: pa.Table) -> pa.Table:
        count = np.zeros(1 << CHUNK, dtype=np.uint8)
        for once, more in zip(table["once"], table["more"], strict=True):
            at = np.frombuffer(once.as_buffer(), np.uint16)
            count[at] = np.minimum(count[at] + 1, 2)
            count[np.frombuffer(more.as_buffer(), np.uint16)] = 2
        return pa.table({"row": table["row"][:1], "chunk": table["chunk"][:1], "twice": pa.array([np.packbits(count > 1, bitorder="little").tobytes()], pa.binary())})

    parts = texts.mapInArrow(partition_sketch, "row int, chunk int, once binary, more binary").groupBy("row", "chunk").applyInArrow(merged, "row int, chunk int, twice binary")
    size = 1 << (CHUNK - 3)
    out = np.zeros((ROWS, 1 << bits >> 3), dtype=np.uint8)
    for r in parts.collect():
        out[r["row"], r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(r["twice"], np.uint8)
    return out


def _dealt(anchor: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunk of an anchor, and the 32 bits that tell it from others there."""
    mixed = textnum.mix(anchor ^ _SALT[0])
    deal = bits - FINE
    return (mixed >> U(64 - deal)).astype(np.int64), (mixed << U(deal) >> U(32)).astype(np.uint32)


def _fine_cells(rest: np.ndarray, row: int) -> np.ndarray:
    return (textnum.mix(rest.astype(np.uint64) ^ _SALT[row]) >> U(64 - FINE)).astype(np.int64)


def repeated_anchors(texts: DataFrame, split: Split, width: int, gram: int, bits: int) -> np.ndarray:
    """ROWS x 2 ** bits bits, packed, of the anchors that occur twice or more in the single text column."""
    chunk_count = 1 << bits - FINE

    def partition_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = [], 0
        for batch in batches:
            data, offsets = textnum.buffers(batch.column(0))
            for a, b in textnum.pieces(offsets):
                p = anchored(*split(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), width, gram)
                seen.append(p.anchor[changes(p)])
                held += len(seen[-1])
                if held > FLUSH:
                    yield dealt(np.concatenate(seen))
                    seen, held = [], 0
        if held:
            yield dealt(np.concatenate(seen))

    def dealt(anchors: np.ndarray) -> pa.RecordBatch:
        chunk, rest = _dealt(anchors, bits)
        code = np.sort(chunk << 32 | rest)
        head = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        more = np.diff(np.r_[head, len(code)]) > 1
        code = code[head]
        cut = np.searchsorted(code, np.arange(chunk_count + 1) << 32)
        rest = code.astype(np.uint32)
        rows = [(c, rest[s:e][~more[s:e]].tobytes(), rest[s:e][more[s:e]].tobytes()) for c, (s, e) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if e > s]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["chunk", "once", "more"])

    def merged(table: pa.Table) -> pa.Table:
        once, more = (np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in table[c]), np.uint32) for c in ("once", "more"))
        once = np.sort(once)
        twice = np.concatenate([once[1:][once[1:] == once[:-1]], more])
        cells = np.zeros((ROWS, 1 << FINE), dtype=bool)
        for row in range(ROWS):
            cells[row, _fine_cells(twice, row)] = True
        return pa.table({"chunk": table["chunk"][:1], "twice": pa.array([np.packbits(cells, axis=1, bitorder="little").tobytes()], pa.binary())})

    parts = texts.mapInArrow(partition_anchors, "chunk int, once binary, more binary").groupBy("chunk").applyInArrow(merged, "chunk int, twice binary")
    size = 1 << (FINE - 3)
    out = np.zeros((ROWS, chunk_count, size), dtype=np.uint8)
    for r in parts.collect():
        out[:, r["chunk"]] = np.frombuffer(r["twice"], np.uint8).reshape(ROWS, size)
    return out.reshape(ROWS, -1)


def among_repeated(sketch: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """As maybe_repeated, for the bits of repeated_anchors."""
    bits = int(sketch.shape[1]).bit_length() + 2
    chunk, rest = _dealt(anchor, bits)
    hit = np.ones(len(anchor), dtype=bool)
    for row in range(ROWS):
        cell = chunk << FINE | _fine_cells(rest, row)
        hit &= (sketch[row][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
    return hit


def maybe_repeated(sketch: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """True where the sketch estimates two or more; never False for a repeat."""
    bits = int(sketch.shape[1]).bit_length() + 2
    hit = np.ones(len(anchor), dtype=bool)
    for row in range(ROWS):
        cell = _cells(anchor, row, bits)
        hit &= (sketch[row][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
    return hit


@dataclass(frozen=True)
class Chunk:
    """Runs of candidate windows: first and last+1 window, by index into a Piece."""

    lo: np.ndarray
    hi: np.ndarray


def chunks(p: Piece, sketch: np.ndarray, every: int, test: Callable[[np.ndarray, np.ndarray], np.ndarray] = maybe_repeated) -> Chunk:
    """Maximal runs of windows estimated repeated, cut where one anchor in
    ``every`` begins; where to cut depends on the windows alone."""
    new = changes(p)
    head = np.flatnonzero(new)
    kept = np.zeros(0, bool) if not len(head) else test(sketch, p.anchor[head])
    cut = kept & (textnum.mix(p.anchor[head] ^ U(0x632BE59BD9B4E019)) % U(every) == 0)
    cut[1:] |= kept[1:] & (~kept[:-1] | (p.owner[head[1:]] != p.owner[head[1:] - 1]))
    if len(cut):
        cut[0] = kept[0]
    end = np.r_[head[1:], len(new)]
    # A run ends where the next anchor isn't kept, or another run begins.
    last = kept.copy()
    last[:-1] &= ~kept[1:] | cut[1:]
    return Chunk(head[cut], end[last])


def total_bytes(docs: DataFrame, text: str) -> float:
    return float(docs.agg(F.sum(F.octet_length(text).cast("double"))).first()[0] or 0)
