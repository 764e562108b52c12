"""SentencePiece encoding and decoding in numpy batches.

A model is read from its file into sorted 64-bit keys of the pieces' characters.
A batch's texts are cut into words where no piece can reach across; each
distinct word is encoded once, and words of equal length advance together: the
hashes of all their substrings, each made from the one a character shorter,
probe the sorted keys, and

* for unigram models a Viterbi pass moves over the positions, its vectorised
  maxima storing the length of the best last piece as a backpointer;
* for byte-pair models, whose segmentation is not the best-scoring path, each
  step takes every word's best-scoring (then leftmost) pair of neighbours with
  a vectorised maximum over the same probes and merges it.  Words of
  more than ``LONG`` characters merge by a heap, which takes the same steps.

Both may be had from one set of probes (``encode_both``): the merges of a
byte-pair model, and the best path over the same pieces and scores.

Hashes only find: words that are taken for equal, and the pieces of each word,
are compared with the text byte by byte.

Characters without a piece become byte pieces where the model has them, else
the unknown piece (one for a run of them).

Defined cases: a null text has null ids, an empty one none; very long texts and
words are encoded whole; repeated rows have equal ids; an empty table gives an
empty result; models that rewrite characters before encoding (a precompiled map)
are refused; ids outside the vocabulary are an error; decoding replaces bytes
that aren't UTF-8.  Extra columns are left alone.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import shared, textnum

U = np.uint64
BATCH_BYTES = 1 << 20
LONG = 96
#: Probes that stand in memory at a time, and the high bits by which keys are found.
PROBES, SLOT_BITS = 1 << 20, 20
UNKNOWN_PENALTY = 10.0
_SPACE = b"\xe2\x96\x81"
# Fixed values of the model file's format: kinds of pieces, kinds of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass(frozen=True)
class Pieces:
    """A vocabulary; its size is the model's, whatever the input."""

    text: list[bytes]  # with a plain space for the mark of one
    score: np.ndarray
    kind: np.ndarray
    model: int
    dummy_prefix: bool
    squeeze: bool

    def __post_init__(self) -> None:
        own = [i for i, k in enumerate(self.kind) if k in (NORMAL, USER) and self.text[i]]
        key = _keys([self.text[i] for i in own])
        order = np.argsort(key, kind="stable")
        put = object.__setattr__
        put(self, "key", key[order])
        put(self, "id", np.array(own, dtype=np.int32)[order])
        chars = [len(self.text[i].decode("utf-8", "replace")) for i in own]
        put(self, "longest", max(chars, default=1))
        # Where the keys with the same high bits begin.
        slot = np.searchsorted(key[order] >> U(64 - SLOT_BITS), np.arange((1 << SLOT_BITS) + 1, dtype=np.uint64)).astype(np.int32)
        put(self, "slot", slot)
        put(self, "gain", np.r_[-np.inf, self.score])  # by id + 1
        put(self, "unk", int(np.flatnonzero(self.kind == UNKNOWN)[0]) if (self.kind == UNKNOWN).any() else 0)
        byte = np.full(256, -1, dtype=np.int32)
        for i in np.flatnonzero(self.kind == BYTE):
            byte[int(self.text[i][3:5], 16)] = i
        put(self, "byte", byte)
        size = np.array([len(t) for t in self.text], dtype=np.int64)
        put(self, "pool", np.frombuffer(b"".join(self.text), np.uint8))
        put(self, "sizes", size)
        put(self, "bases", np.cumsum(size) - size)
        put(self, "least", float(min((self.score[i] for i in own), default=0.0)))
        long = [self.text[i] for i, c in zip(own, chars, strict=True) if c > 1]
        # Words may be cut before a run of spaces if no piece has one after another character ...
        put(self, "cuts", all(b" " not in t.lstrip(b" ") for t in long))
        # ... and around a byte that no longer piece has.
        inside = np.zeros(256, dtype=bool)
        inside[np.frombuffer(b"".join(long), np.uint8)] = True
        inside[128:] = True
        put(self, "alone", ~inside)


def _characters(data: np.ndarray) -> np.ndarray:
    """The bytes of the character that begins at each place, as one number."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    lead = data >= 0xC0
    size = np.ones(len(data), dtype=np.int64)
    size = 1 + (data >= 0xC0).astype(np.uint8) + (data >= 0xE0) + (data >= 0xF0)
    out = data.astype(np.uint64)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        out[more] |= padded[more + k].astype(np.uint64) << U(8 * k)
    return out


def _hashes(chars: np.ndarray, reach: int) -> Iterator[np.ndarray]:
    """For each length up to ``reach``: hashes of the substrings from each place
    of words that stand in columns, one character a row."""
    one = textnum.mix(chars + U(0x2545F4914F6CDD1D))
    level = one
    yield level
    for m in range(2, reach + 1):
        level = textnum.joined(level[:-1], one[m - 1 :])
        yield level


def _keys(texts: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(texts), np.uint8)
    start = np.flatnonzero(np.r_[(data & 0xC0) != 0x80, True])
    edge = np.searchsorted(start, np.r_[0, np.cumsum([len(t) for t in texts])])
    code, size = _characters(data), np.diff(edge)
    out = np.zeros(len(texts), dtype=np.uint64)
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        *_, whole = _hashes(code[start[edge[own] + np.arange(n)[:, None]]], int(n))
        out[own] = whole[0]
    return out


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = raw[at]
            at, value, shift = at + 1, value | (b & 127) << shift, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = number(at)
        kind = tag & 7
        if kind == 0:
            value, at = number(at)
            yield tag >> 3, value
        else:
            size, at = number(at) if kind == 2 else ((8, at) if kind == 1 else (4, at))
            yield tag >> 3, raw[at : at + size]
            at += size


def parse(raw: bytes) -> Pieces:
    """The vocabulary of a serialised model."""
    text, score, kind = [], [], []
    model, prefix, squeeze, charsmap = UNIGRAM, True, True, b""
    for field, value in _fields(raw):
        if field == 1:
            own = dict(_fields(value))
            text.append(bytes(own.get(1, b"")).replace(_SPACE, b" "))
            score.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
            kind.append(own.get(3, NORMAL))
        elif field == 2:
            model = dict(_fields(value)).get(3, UNIGRAM)
        elif field == 3:
            own = dict(_fields(value))
            charsmap, prefix, squeeze = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
    if charsmap:
        raise ValueError("the model rewrites characters before encoding; only identity models are supported")
    if model not in (UNIGRAM, BPE):
        raise ValueError(f"model type {model} is neither unigram nor byte-pair")
    return Pieces(text, np.array(score, dtype=np.float64), np.array(kind), model, prefix, squeeze)


def load(spark: SparkSession, path: str) -> Pieces:
    """Read a model by any path that Spark reads."""
    local = path.removeprefix("file://") if path.startswith(("file://", "/")) else None
    if local is not None:
        with open(local, "rb") as f:
            return parse(f.read())
    return parse(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))


def _probe(p: Pieces, key: np.ndarray) -> np.ndarray:
    """The id of each key's piece, or -1."""
    flat = key.ravel()
    out = np.full(len(flat), -1, dtype=np.int32)
    place = (flat >> U(64 - SLOT_BITS)).astype(np.int32)
    at = p.slot[place]
    some = np.flatnonzero(p.slot[1:][place] > at)
    at, end, want = at[some], p.slot[place[some] + 1], flat[some]
    while len(some):
        same = p.key[at] == want
        out[some[same]] = p.id[at[same]]
        at += 1
        more = ~same & (at < end)
        some, at, end, want = some[more], at[more], end[more], want[more]
    return out.reshape(key.shape)


def _table(p: Pieces, chars: np.ndarray) -> np.ndarray:
    """ids[m - 1, s, w]: the piece of m characters from character s of word w, or -1."""
    size, words = chars.shape
    reach = min(size, p.longest)
    out = np.full((reach, size, words), -1, dtype=np.int32)
    for m, key in enumerate(_hashes(chars, reach)):
        out[m, : size - m] = _probe(p, key)
    return out


def viterbi(table: np.ndarray, gain: np.ndarray, unknown: float) -> np.ndarray:
    """starts[s, w]: true where the best path of word w starts a piece at s; ``gain`` by id + 1."""
    reach, size, words = table.shape
    best = np.full((size + 1, words), -np.inf)
    best[0] = 0
    back = np.zeros((size + 1, words), dtype=np.int32)
    for end in range(1, size + 1):
        top = np.full(words, -np.inf)
        for m in range(1, min(reach, end) + 1):
            ids = table[m - 1, end - m]
            total = gain[ids + 1]
            if m == 1:
                total = np.where(ids >= 0, total, unknown)
            total += best[end - m]
            better = total >= top  # longer pieces win ties
            if m > 1:
                better &= ids >= 0
            np.copyto(top, total, where=better)
            np.copyto(back[end], m, where=better)
        best[end] = top
    starts = np.zeros((size, words), dtype=bool)
    at = np.full(words, size)
    while (go := np.flatnonzero(at > 0)).size:
        at[go] -= back[at[go], go]
        starts[at[go], go] = True
    return starts


def merges(table: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """starts[s, w] after merging each word's best pair of neighbours, again and again."""
    reach, size, words = table.shape
    starts = np.ones((size, words), dtype=bool)
    if size < 2:
        return starts
    after = np.repeat(np.arange(1, size + 2)[:, None], words, axis=1)  # the piece behind the one at s
    before = np.repeat(np.arange(-1, size)[:, None], words, axis=1)

    def pair(s: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What the piece at s and the one behind it gain as one."""
        e = after[s, w]
        f = after[np.minimum(e, size), w]
        m = f - s
        good = (e < size) & (m <= reach)
        ids = table[np.where(good, m, 1) - 1, s, w]
        return np.where(good, gain[ids + 1], -np.inf)

    value = np.full((size, words), -np.inf)
    value[: size - 1] = gain[table[1, : size - 1] + 1]
    live = np.arange(words)
    while len(live):
        top, at = value[0, live], np.zeros(len(live), dtype=np.int64)
        for s in range(1, size - 1):
            own = value[s, live]
            better = own > top
            np.copyto(top, own, where=better)
            at[better] = s
        go = top > -np.inf
        live, at = live[go], at[go]
        second = after[at, live]
        end = after[second, live]
        after[at, live] = end
        starts[second, live] = False
        value[second, live] = -np.inf
        inner = end < size
        before[end[inner], live[inner]] = at[inner]
        value[at, live] = pair(at, live)
        left = before[at, live]
        has = left >= 0
        value[left[has], live[has]] = pair(left[has], live[has])
    return starts


def _heap_merges(table: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """The same for one long word, table[m - 1, s], in the order of a heap."""
    reach, size = table.shape
    end, before, starts = list(range(1, size + 1)), list(range(-1, size - 1)), np.ones(size, dtype=bool)
    heap: list[tuple[float, int, int, int]] = []

    def offer(s: int) -> None:
        if s >= 0 and end[s] < size:
            e = end[s]
            f = end[e]
            if f - s <= reach and table[f - s - 1, s] >= 0:
                heapq.heappush(heap, (-gain[table[f - s - 1, s] + 1], s, e, f))

    for s in range(size):
        offer(s)
    while heap:
        _, s, e, f = heapq.heappop(heap)
        if not starts[s] or end[s] != e or e >= size or not starts[e] or end[e] != f:
            continue
        end[s], starts[e] = f, False
        if f < size:
            before[f] = s
        offer(before[s])
        offer(s)
    return starts


def _words(p: Pieces, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans that no piece reaches across, in order."""
    n = len(data)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    if p.cuts and n:
        space = data == 32
        cut[1:n] |= space[1:] & ~space[:-1]
    if n:
        alone = p.alone[data] & (data != 32)
        cut[:n] |= alone
        cut[1:] |= alone
    edge = np.flatnonzero(cut)
    return edge[:-1], edge[1:]


def _pieces(p: Pieces, data: np.ndarray, edge: np.ndarray, table: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column, id) of the pieces that begin at ``starts``, in order."""
    size = len(starts)
    row, s = np.nonzero(starts.T)
    nxt = np.where(np.r_[row[1:], -1] == row, np.r_[s[1:], size], size)
    ids = table[nxt - s - 1, s, row]
    lo, hi = edge[s, row], edge[nxt, row]
    known = ids >= 0
    # The hashes found these pieces; their bytes must be the text's.
    n, base = p.sizes[ids[known]], p.bases[ids[known]]
    total = np.cumsum(n)
    flat = np.arange(total[-1] if len(total) else 0)
    if (n != hi[known] - lo[known]).any() or (p.pool[flat + np.repeat(base - (total - n), n)] != data[flat + np.repeat(lo[known] - (total - n), n)]).any():
        raise ArithmeticError("two pieces have one 64-bit key; change the key's constant")
    if known.all():
        return row, ids
    if (p.byte >= 0).all():  # byte pieces in place of a character without a piece
        times = np.where(known, 1, hi - lo)
        spread = np.repeat(np.arange(len(ids)), times)
        inner = np.arange(len(spread)) - np.repeat(np.cumsum(times) - times, times)
        place = np.minimum(lo[spread] + inner, len(data) - 1)
        return row[spread], np.where(known[spread], ids[spread], p.byte[data[place]])
    keep = np.ones(len(ids), dtype=bool)
    keep[1:] = ~(~known[1:] & ~known[:-1] & (row[1:] == row[:-1]))
    return row[keep], np.where(known[keep], ids[keep], p.unk)


def _encode_words(p: Pieces, data: np.ndarray, lo: np.ndarray, hi: np.ndarray, models: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each model kind, (flat ids, edges) of the given spans."""
    start = np.r_[(data & 0xC0) != 0x80, True]
    char = np.flatnonzero(start)
    rank = np.cumsum(start) - 1
    code = _characters(data)
    first, chars = rank[lo], rank[hi] - rank[lo]
    parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in models]  # word, id
    for size in np.unique(chars):
        own = np.flatnonzero(chars == size)
        step = max(1, PROBES // (int(size) * min(int(size), p.longest)))
        for at in range(0, len(own), step):
            w = own[at : at + step]
            edge = char[first[w] + np.arange(size + 1)[:, None]]
            table = _table(p, code[edge[:-1]])
            for model, got in zip(models, parts, strict=True):
                if model == UNIGRAM:
                    starts = viterbi(table, p.gain, p.least - UNKNOWN_PENALTY)
                elif size <= LONG:
                    starts = merges(table, p.gain)
                else:
                    starts = np.stack([_heap_merges(table[:, :, k], p.gain) for k in range(len(w))], axis=1)
                row, ids = _pieces(p, data, edge, table, starts)
                got.append((w[row], ids))
    out = []
    for got in parts:
        word = np.concatenate([x[0] for x in got]) if got else np.zeros(0, np.int64)
        ids = np.concatenate([x[1] for x in got]) if got else np.zeros(0, np.int32)
        out.append((ids[np.argsort(word, kind="stable")].astype(np.int32), np.r_[0, np.cumsum(np.bincount(word, minlength=len(lo)))]))
    return out


def _distinct(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one place of each distinct span, which of them each span is)."""
    _, at, inverse = np.unique(textnum.span_hashes(data, lo, hi), return_index=True, return_inverse=True)
    like, size = at[inverse], hi - lo
    differ = size != size[like]
    total = np.cumsum(size)
    flat = np.arange(total[-1] if len(total) else 0)
    far = np.minimum(flat + np.repeat(lo[like] - (total - size), size), len(data) - 1)
    wrong = data[flat + np.repeat(lo - (total - size), size)] != data[far]
    differ[np.repeat(np.arange(len(lo)), size)[wrong]] = True
    odd = np.flatnonzero(differ)  # equal hashes, other bytes: each stands for itself
    inverse[odd] = len(at) + np.arange(len(odd))
    return np.r_[at, odd], inverse


def encode_batch(p: Pieces, texts: pa.Array, models: Sequence[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each model kind (the model's own if none is given), (flat ids, edges) of whole texts."""
    models = models or (p.model,)
    data, offsets = textnum.buffers(texts)
    out: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in models]
    for a, b in textnum.pieces(offsets, BATCH_BYTES):
        raw = [data[offsets[k] : offsets[k + 1]].tobytes().replace(_SPACE, b" ") for k in range(a, b)]
        if p.squeeze:
            raw = [b" ".join(x for x in t.split(b" ") if x) for t in raw]
        if p.dummy_prefix:
            raw = [b" " + t if t else t for t in raw]
        own = np.frombuffer(b"".join(raw), np.uint8)
        edge = np.r_[0, np.cumsum([len(t) for t in raw])].astype(np.int64)
        lo, hi = _words(p, own, edge)
        at, inverse = _distinct(own, lo, hi)
        of_text = np.searchsorted(lo, edge, "left")
        for put, (ids, cut) in zip(out, _encode_words(p, own, lo[at], hi[at], models), strict=True):
            size = np.diff(cut)[inverse]
            total = np.r_[0, np.cumsum(size)]
            got = ids[np.arange(total[-1]) + np.repeat(cut[:-1][inverse] - total[:-1], size)]
            ends = total[of_text]
            if not (p.byte >= 0).all() and len(got):  # a run of unknown pieces is one, across words too
                keep = np.ones(len(got), dtype=bool)
                keep[1:] = ~((got[1:] == p.unk) & (got[:-1] == p.unk))
                keep[ends[:-1][ends[:-1] < len(got)]] = True
                ends = np.r_[0, np.cumsum(keep)][ends]
                got = got[keep]
            put.append((got, np.diff(ends)))
    return [(np.concatenate([x[0] for x in put]), np.r_[0, np.cumsum(np.concatenate([x[1] for x in put]))]) if put else (np.zeros(0, np.int32), np.zeros(1, np.int64)) for put in out]


def decode_batch(p: Pieces, flat: np.ndarray, edges: np.ndarray) -> list[str]:
    """The texts of whole id sequences."""
    if len(flat) and (flat.min() < 0 or flat.max() >= len(p.text)):
        raise ValueError("an id is outside the vocabulary")
    out_bytes = [b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else bytes([int(t[3:5], 16)]) if k == BYTE else t for t, k in zip(p.text, p.kind, strict=True)]
    size = np.array([len(t) for t in out_bytes], dtype=np.int64)
    base = np.r_[0, np.cumsum(size)][:-1]
    pool = np.frombuffer(b"".join(out_bytes), np.uint8)
    texts = []
    lo = 0
    while lo < len(edges) - 1:  # a bounded number of ids at a time
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + BATCH_BYTES // 4, "right")) - 1)
        ids = flat[edges[lo] : edges[hi]]
        n = size[ids]
        total = np.r_[0, np.cumsum(n)]
        raw = pool[np.arange(total[-1]) + np.repeat(base[ids] - total[:-1], n)].tobytes()
        cut = total[edges[lo : hi + 1] - edges[lo]]
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            t = raw[a:b]
            texts.append((t[1:] if p.dummy_prefix and t[:1] == b" " else t).decode("utf-8", "replace"))
        lo = hi
    return texts


def _lists(got: tuple[np.ndarray, np.ndarray], texts: pa.Array) -> pa.Array:
    flat, edges = got
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat), mask=texts.is_null() if texts.null_count else None)


def _broadcast(model: Pieces) -> Broadcast:
    """The model for the tasks, whose batches of text are bounded by bytes."""
    spark = SparkSession.active()
    shared.bound_batches(spark)
    return spark.sparkContext.broadcast(model)


def encode(model: Pieces, text: str | Column) -> Column:
    """The ids of each whole text."""
    shared_model = _broadcast(model)

    @F.arrow_udf("array<int>")
    def sentencepiece_ids(texts: pa.Array) -> pa.Array:
        return _lists(encode_batch(shared_model.value, texts)[0], texts)

    return sentencepiece_ids(text)


def encode_both(model: Pieces, text: str | Column) -> Column:
    """struct(merged, best) of each whole text: ids by byte-pair merges, and of the
    best-scoring path by Viterbi, over one vocabulary."""
    shared_model = _broadcast(model)

    @F.arrow_udf("struct<merged: array<int>, best: array<int>>")
    def sentencepiece_both(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([_lists(x, texts) for x in encode_batch(shared_model.value, texts, (BPE, UNIGRAM))], ["merged", "best"])

    return sentencepiece_both(text)


def decode(model: Pieces, ids: str | Column) -> Column:
    """The text of each id sequence."""
    shared_model = _broadcast(model)

    @F.arrow_udf("string")
    def sentencepiece_text(rows: pa.Array) -> pa.Array:
        size = np.where(rows.is_valid().to_numpy(zero_copy_only=False), np.diff(rows.offsets.to_numpy()), 0)
        got = decode_batch(shared_model.value, rows.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(size)])
        return pa.array([t if ok else None for t, ok in zip(got, rows.is_valid().to_pylist(), strict=True)], pa.string())

    return sentencepiece_text(ids)
