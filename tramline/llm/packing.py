"""Best-fit packing into sequences of several permitted lengths.

A sequence of length c costs ``c + c * c / attention + overhead``: its tokens,
the attention over them, and what every sequence costs besides.  Short
sequences are cheap for each token if they can be filled, long ones are needed
for long pieces and waste least; which mix is best depends on the pieces.

Pieces are taken by falling length.  Each goes into the open bin that it fills
best.  If none has room, every permitted length that holds it is tried on the
pieces still to come: how far would it be filled, taking the longest that fit?
The length with the least cost for each token so held is opened.  At the end
every bin shrinks to the smallest permitted length that holds its contents.  A
document longer than the largest permitted length fills whole bins of that
length and packs its remainder.

Documents are dealt to shards by the hash of their id and text; only ids and
lengths move, a shard has about ``SHARD`` documents at every size of input, and
the bins left half full cost a vanishing share.

Defined cases: a null text or one without words (or a null length) gives one
row without a bin; null ids are documents like any other; equal lengths are
taken by id, then by row; repeated rows are packed as documents of their own;
very long texts count whole; an empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared, textnum

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: What a sequence costs besides its tokens, in tokens.
OVERHEAD = 32
#: A sequence of this length costs as much for its attention as for its tokens.
ATTENTION = 32768
SHARD = 8192

_PLACED = "bin_id long, capacity int, at int, doc_id long, piece int, first_token long, n_tokens int"


def word_count(text: str | Column) -> Column:
    """Number of words of each whole text; null texts have none."""

    @F.arrow_udf("bigint")
    def count_words(texts: pa.Array) -> pa.Array:
        data, offsets = textnum.buffers(texts)
        parts = [np.diff(textnum.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[2]) for a, b in textnum.pieces(offsets)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())

    return count_words(text)


def cost(length: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    """What one sequence of ``length`` costs, in tokens."""
    return length + length * length / attention + overhead


class _Coming:
    """The pieces still to come, by size; bit s of ``some`` is set while there is one of size s."""

    def __init__(self, sizes: Sequence[int]) -> None:
        self.count, self.some = Counter(sizes), 0
        for s in self.count:
            self.some |= 1 << s

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.some &= ~(1 << size)

    def fill(self, room: int) -> int:
        """Tokens that the longest fitting pieces would bring into ``room``."""
        left, some = room, self.some
        while left and (some := some & ((1 << (left + 1)) - 1)):
            size = some.bit_length() - 1
            left -= size * min(self.count[size], left // size)
            some &= ~(1 << size)
        return room - left


def best_fit(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD, attention: int = ATTENTION) -> tuple[list[int], list[int], list[int]]:
    """(bin of each size, start within the bin, capacity of each bin).

    ``sizes`` fall and are at most the largest length.
    """
    lengths = sorted(lengths)
    price = {c: cost(c, overhead, attention) for c in lengths}
    coming = _Coming(sizes)
    room: dict[int, list[int]] = {}  # free space -> bins, a bit of ``free`` for each
    free = 0
    bins, starts, used = [], [], []
    for size in sizes:
        size = int(size)
        coming.take(size)
        fitting = free >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            own = room[space].pop()
            if not room[space]:
                free &= ~(1 << space)
        else:
            space = min((c for c in lengths if c >= size), key=lambda c: (price[c] / (size + coming.fill(c - size)), c))
            own = len(used)
            used.append(0)
        bins.append(own)
        starts.append(used[own])
        used[own] += size
        if space > size:
            room.setdefault(space - size, []).append(own)
            free |= 1 << (space - size)
    return bins, starts, [next(c for c in lengths if c >= u) for u in used]


def pack(docs: DataFrame, *, doc_id: str = "doc_id", tokens: str | Column | None = None, text: str = "text", lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD, attention: int = ATTENTION, shard: int = SHARD) -> DataFrame:
    """One row a piece: bin_id, capacity, at (start in the bin), doc_id, piece,
    first_token (start in the document), n_tokens.  Without ``tokens``, words count."""
    n = F.col(tokens) if isinstance(tokens, str) else word_count(text) if tokens is None else tokens
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(n.cast("long"), F.lit(0)).alias("n"), *([shared.text_key(text).alias("key")] if text in docs.columns else []))
    shards = max(1, -(-docs.count() // shard))
    most = max(lengths)

    def shard_bins(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        n, own = table["n"].to_numpy(), np.arange(table.num_rows)
        ids = table["doc_id"].to_numpy() if not table["doc_id"].null_count else np.where(table["doc_id"].is_null().to_numpy(), -1, table["doc_id"].fill_null(0).to_numpy())
        order = np.lexsort((n, ids))
        whole = n // most
        of = np.concatenate([np.repeat(own[order], whole[order]), order[n[order] % most > 0]])
        size = np.concatenate([np.full(int(whole.sum()), most), n[order][n[order] % most > 0] % most])
        piece = np.concatenate([np.arange(int(whole.sum())) - np.repeat(np.cumsum(whole[order]) - whole[order], whole[order]), whole[order][n[order] % most > 0]])
        by = np.argsort(-size, kind="stable")
        of, size, piece = of[by], size[by], piece[by]
        bins, starts, capacity = best_fit(size.tolist(), lengths, overhead, attention)
        bins_ = np.array(bins, dtype=np.int64)
        got = pa.table(
            {
                "bin_id": pa.array(bins_ + (key[0].as_py() << 32), pa.int64()), "capacity": pa.array(np.array(capacity, dtype=np.int32)[bins_] if bins else [], pa.int32()), "at": pa.array(starts, pa.int32()),
                "doc_id": table["doc_id"].combine_chunks().take(pa.array(of, pa.int64())), "piece": pa.array(piece, pa.int32()), "first_token": pa.array(piece * most, pa.int64()), "n_tokens": pa.array(size, pa.int32()),
            }
        )
        bare = np.flatnonzero(n <= 0)
        nothing = [pa.nulls(len(bare), t) for t in (pa.int64(), pa.int32(), pa.int32())]
        zeros = [pa.array(np.zeros(len(bare), d)) for d in (np.int32, np.int64, np.int32)]
        return pa.concat_tables([got, pa.Table.from_arrays([*nothing, table["doc_id"].combine_chunks().take(pa.array(bare, pa.int64())), *zeros], names=got.column_names)])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), *rows.columns), F.lit(shards))).select("shard", "doc_id", "n")
    return dealt.groupBy("shard").applyInArrow(shard_bins, _PLACED)
