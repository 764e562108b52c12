"""Equal ``width``-byte strings of a bounded block, by its Burrows-Wheeler transform.

The suffixes of the concatenated segments are ordered by their first 64 bytes,
which fixes the transform as far as strings of up to 63 bytes can tell.  Intervals
are then expanded breadth first by backward extension: the interval of w gives
those of every cw, and where such an interval ends at a boundary without a
common-prefix value, the value is the length reached.  Values thus appear in
increasing order; at ``width`` the search stops, and boundaries still without
a value separate suffixes that share at least ``width`` bytes.
"""

from __future__ import annotations

import numpy as np

DEPTH = 64


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first keys): suffixes by their first DEPTH bytes, and each one's first 8 bytes."""
    n = len(text)
    padded = np.zeros(n + 8, dtype=np.uint64)
    padded[:n] = text
    key = np.zeros(n, dtype=np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | padded[j : j + n]
    order = np.argsort(key)
    head = key
    done = 8
    rank = np.empty(n, dtype=np.int64)
    ordered = key[order]
    rank[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
    while done < DEPTH:
        if rank[order[-1]] == n - 1:
            break
        after = np.zeros(n, dtype=np.int64)
        after[: max(n - done, 0)] = rank[done:] + 1
        pair = rank * np.int64(n + 1) + after
        order = np.argsort(pair)
        ordered = pair[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
        done *= 2
    return order, head


def boundaries(text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, apart): ``apart[i]`` if suffixes order[i-1] and order[i] share fewer than ``width`` bytes.

    ``text`` ends in at least one zero byte, and no window of interest holds a zero.
    """
    if not 8 <= width < DEPTH:
        raise ValueError(f"strings of 8 to {DEPTH - 1} bytes can be told apart, not of {width}")
    n = len(text)
    order, head = suffix_order(text)
    last = text[order - 1]
    # LF: where the suffix one byte longer stands.
    by_byte = np.argsort(last, kind="stable")
    follow = np.empty(n, dtype=np.int64)
    follow[by_byte] = np.arange(n)
    value = np.full(n + 1, -1, dtype=np.int16)
    value[0] = value[n] = 0
    # Values below 8 follow from the first eight bytes, which the order was begun with.
    ordered = head[order]
    differ = ordered[1:] ^ ordered[:-1]
    length = np.zeros(n - 1, dtype=np.int16)
    for j in range(1, 8):
        length += differ < np.uint64(1) << np.uint64(64 - 8 * j)
    known = np.flatnonzero(differ) + 1
    value[known] = length[known - 1]
    start = np.r_[0, known]
    end = np.r_[known, n]
    seed = np.flatnonzero((value[end] == 7) & (end < n))
    lo, hi = start[seed], end[seed]
    for reached in range(8, width):
        if not len(lo):
            break
        size = hi - lo
        one = size == 1
        new_lo, new_hi = [follow[lo[one]]], [follow[lo[one]] + 1]
        lo, size = lo[~one], size[~one]
        if len(lo):
            own = np.repeat(np.arange(len(lo)), size)
            at = np.arange(len(own)) + np.repeat(lo - (np.cumsum(size) - size), size)
            code = own << 8 | last[at]
            by = np.argsort(code, kind="stable")
            code = code[by]
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            begin = follow[at[by[first]]]
            new_lo.append(begin)
            new_hi.append(begin + np.diff(np.r_[first, len(code)]))
        lo, hi = np.concatenate(new_lo), np.concatenate(new_hi)
        fresh = value[hi] < 0
        lo, hi = lo[fresh], hi[fresh]
        value[hi] = reached
    return order, value[:n] >= 0


def equal_windows(body: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, offset, class) of every ``width``-byte window of the segments;
    windows of one class are equal.  The segments are parts of UTF-8 texts, so
    the byte 0xff is free to separate them."""
    size = np.array([len(b) for b in body], dtype=np.int64)
    text = np.frombuffer(b"\xff".join(body) + b"\xff" * (DEPTH + 1), np.uint8)
    text = text + np.uint8(1)  # 0xff, which UTF-8 never has, becomes the zero separator
    order, apart = boundaries(text, width)
    begin = np.r_[0, np.cumsum(size + 1)][:-1]
    kind = np.cumsum(apart)
    segment = np.searchsorted(begin, order, "right") - 1
    offset = order - begin[segment]
    whole = offset + width <= size[segment]
    return segment[whole], offset[whole], kind[whole]
