"""Numpy kernels over Arrow string buffers: words, rolling hashes, minimizers.

Every kernel works on the concatenated UTF-8 bytes of a bounded batch of whole
texts; no per-row Python strings are built.  A null text counts as an empty one.

Two kinds of hashes are told apart.  ``rolling`` is a sum of powers with
wrap-around: equal windows have equal hashes, but unequal ones can be built that
collide, so it only ever picks anchors and filters.  Whatever puts units into one
class uses hashes whose every step is mixed (``span_hashes``, ``window_hashes``),
128-bit digests, or the bytes themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 20
_RNG = np.random.default_rng(20240229)
_BYTE = [_RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1) for _ in range(2)]
_BASE = [U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)]
_INV = [U(pow(int(b), -1, 1 << 64)) for b in _BASE]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """``base ** i`` (or its inverse) for ``i < n``, cached and grown by doubling."""
    got = _powers.get((which, inverse))
    if got is None or len(got) < n:
        size = max(1 << 12, 1 << int(n - 1).bit_length())
        got = np.empty(size, dtype=np.uint64)
        got[0] = 1
        done = 1
        base = (_INV if inverse else _BASE)[which]
        while done < size:
            step = U(pow(int(base), done, 1 << 64))
            got[done : 2 * done] = got[:done] * step
            done *= 2
        _powers[which, inverse] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche (the public splitmix64 finaliser) of each element."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null rows have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (a longer text stands alone)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def prefix(values: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums of ``values[i] * base ** -i``, led by 0."""
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(values * powers(which, len(values), True), out=out[1:])
    return out


def rolling(values: np.ndarray, width: int, which: int) -> np.ndarray:
    """Filter hash of every ``width`` consecutive values (empty if there are fewer)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    pre = prefix(values, which)
    return mix((pre[width:] - pre[:n]) * powers(which, n))


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of the words ``[^\\x20\\x09-\\x0D]+`` of all
    texts, and for each text the number of words before it (one more entry).
    ``gap`` marks the bytes between words."""
    n = len(data)
    solid = np.empty(n + 2, dtype=np.int8)
    solid[0] = solid[-1] = 0
    solid[1:-1] = ~gap[data]
    edge = np.diff(solid)
    start = np.flatnonzero(edge[:-1] == 1) if n else np.zeros(0, np.int64)
    end = np.flatnonzero(edge[1:] == -1) + 1 if n else np.zeros(0, np.int64)
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < n)])
    if len(cuts):  # a word never runs from one text into the next
        joined = cuts[(solid[cuts] == 1) & (solid[cuts + 1] == 1)]
        if len(joined):
            start = np.sort(np.concatenate([start, joined]))
            end = np.sort(np.concatenate([end, joined]))
    return start, end, np.searchsorted(start, offsets, "left")


_STEP = [(U(0x9FB21C651E98DF25), U(0xD6E8FEB86659FD93)), (U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB))]
_FIRST_BYTES = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], dtype=np.uint64)
#: Longer spans are hashed one by one.
SPAN_BYTES = 64


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of the bytes of each span, taken in eights, every step mixed."""
    size = end - start
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    key, odd = _STEP[which]
    out = mix((size.astype(np.uint64) * odd ^ eight[start] & _FIRST_BYTES[np.minimum(size, 8)]) + key)
    for done in range(8, SPAN_BYTES, 8):
        own = np.flatnonzero(size > done)
        if not len(own):
            return out
        block = eight[start[own] + done] & _FIRST_BYTES[np.minimum(size[own] - done, 8)]
        out[own] = mix(out[own] * odd ^ block)
    own = np.flatnonzero(size > SPAN_BYTES)
    if len(own):
        raw, secret = data.tobytes(), int(key).to_bytes(8, "little")
        long = b"".join(hashlib.blake2b(raw[s:e], digest_size=8, key=secret).digest() for s, e in zip(start[own].tolist(), end[own].tolist(), strict=True))
        out[own] = np.frombuffer(long, "<u8")
    return out


def joined(a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of two neighbours from theirs; no sum, so order and place count."""
    key, odd = _STEP[which]
    x = a * odd
    x ^= x >> U(32)
    x += b
    x *= key
    x ^= x >> U(29)
    return x


def window_hashes(values: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Mixed hash of every ``width`` consecutive values, by doubling the span."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    level, span, done, out, left = values, 1, 0, None, width
    while True:
        if left & 1:
            part = level[done : done + n]
            out = part if out is None else joined(out, part, which)
            done += span
        left >>= 1
        if not left:
            return mix(out.copy())
        level = joined(level[:-span], level[span:], which)
        span *= 2


def digests(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(len(lo), 2) signed halves of the 128-bit BLAKE2b digest of each span."""
    out = b"".join(hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(lo.tolist(), hi.tolist(), strict=True))
    return np.frombuffer(out, "<i8").reshape(-1, 2)


def one_spaced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end) of the words with one space after each."""
    size = end - start
    total = np.cumsum(size)
    out = np.full(int(size.sum()) + len(size), 32, dtype=np.uint8)
    flat = np.arange(int(size.sum()))
    out[flat + np.repeat(np.arange(len(size)), size)] = data[flat + np.repeat(start - (total - size), size)]
    own = total - size + np.arange(len(size))
    return out, own, own + size


def byte_values(data: np.ndarray, which: int) -> np.ndarray:
    return _BYTE[which][data]


_BLOCK_BITS = 21


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest of every ``width`` consecutive keys.

    Keys compare by their high bits; the low bits, of a fixed number, give way
    to the position inside a block, so that one minimum carries its index and
    equal windows choose the same place wherever they stand.
    """
    n = len(keys) - width + 1
    out = np.empty(max(n, 0), dtype=np.int64)
    low = U((1 << _BLOCK_BITS) - 1)
    step = (1 << _BLOCK_BITS) - width
    place = np.arange(min(len(keys), 1 << _BLOCK_BITS), dtype=np.uint64)
    for at in range(0, n, step):
        part = keys[at : at + step + width - 1]
        best = (part & ~low) | place[: len(part)]
        span = 1
        while 2 * span <= width:
            best = np.minimum(best[: len(best) - span], best[span:])
            span *= 2
        m = len(part) - width + 1
        if span < width:
            best = np.minimum(best[:m], best[width - span : width - span + m])
        out[at : at + m] = (best[:m] & low).astype(np.int64) + at
    return out
