"""Suffix-array dedup: bytes covered by repeated ``width``-byte strings.

A byte goes if a ``width``-byte string that covers it also starts in a
document with a smaller id; strings are judged on the input and never cross
documents.

1. The strings' anchors are counted (``windows.repeated_anchors``), which rules
   out most of the unique strings.  What is left stands in runs that are cut by
   content.
2. Runs are grouped by 128-bit digest: all but those of the smallest document go.
3. The first holders' runs are sketched again and cut into segments, one for
   each anchor; from here on the anchors take ``TURNS`` turns.  Equal segments
   become one, with its smallest document and the number of its places, before
   anything is dealt.
4. Distinct segments are dealt to blocks by anchor.  In each block a
   Burrows-Wheeler transform and threshold-bounded interval expansion
   (``bwt``) put equal strings into classes, and the smallest document of a
   class keeps it.
5. An anchor with more than ``HOT`` distinct segments is dealt to several
   blocks.  A block gives one row for each of its classes, and rows with the
   same bytes meet in a pre-aggregated minimum.
6. What a segment loses goes back to each of its places by its bytes.

Defined cases: a null text is an empty one; a text of fewer than ``width``
bytes is left alone; very long texts count whole; rows with equal ids never remove bytes from each other; a
row whose id is null is left alone and removes nothing; an empty table gives
an empty result; extra columns are kept and may have any name.  What is kept
may cut a character, so it is binary.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bwt, shared, textnum, windows

WIDTH = 50
CUT_EVERY = 16
BLOCK_BYTES = 1 << 20
#: Segments overlap and weigh several times their text, so anchors take turns.
TURNS = 2
#: Distinct segments of one anchor that a block takes; at most 2 * WIDTH bytes each.
HOT = 1 << 14
_TURN = np.uint64(0x8CB92BA72F3D8DD7)
_RUNS = "c1 long, c2 long, id long, key long, at int, n int, body binary"
_SEGMENTS = "anchor long, id long, key long, at int, body binary"
_CLASSED = "body binary, runs array<struct<at: int, n: int, low: bigint>>, string binary, low long, times long, members array<struct<body: binary, at: int>>"


def _gram(width: int) -> int:
    return max(1, width // 2)


def _split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return textnum.byte_values(data, 0), offsets


def _slices(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    return pa.array([raw[s:e] for s, e in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())


def repeated_strings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, key, at, n): runs of n strings from byte ``at`` that also start in a
    document with a smaller id.  ``key`` is the text's own hash."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), shared.text_key(text).alias("key"), F.col(text).alias("text")).where("id is not null")
    gram = _gram(width)
    per_unit = 2 / (width - gram + 2)
    sketch = context.broadcast(windows.repeated_anchors(rows.select("text"), _split, width, gram, windows.sketch_bits(windows.total_bytes(rows, "text"), per_unit, 2)))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textnum.buffers(batch["text"])
            for a, b in textnum.pieces(offsets):
                d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                values = textnum.byte_values(d, 0)
                p = windows.anchored(values, o, width, gram)
                c = windows.chunks(p, sketch.value, CUT_EVERY, windows.among_repeated)
                if not len(c.lo):
                    continue
                lo, hi = p.at[c.lo], p.at[c.hi - 1] + width
                raw = d.tobytes()
                whole = textnum.digests(raw, lo, hi)
                body = _slices(raw, lo, hi)
                owner = p.owner[c.lo]
                take = pa.array(owner + a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(whole[:, 0]), pa.array(whole[:, 1]), batch["id"].take(take), batch["key"].take(take), pa.array((lo - o[owner]).astype(np.int32)), pa.array((hi - lo - width + 1).astype(np.int32)), body],
                    ["c1", "c2", "id", "key", "at", "n", "body"],
                )

    found = shared.written(rows.mapInArrow(runs, _RUNS), "runs")
    sketch.destroy()
    # Written, so that a run which very many texts share is split between tasks in the join.
    holder = found.groupBy("c1", "c2").agg(F.min("id").alias("holder"), F.count(F.lit(1)).alias("times")).where("times > 1")
    holder = shared.written(holder.select("c1", "c2", "holder"), "holders")
    placed = shared.written(found.join(holder, ["c1", "c2"], "left").select("id", "key", "at", "n", F.when(F.coalesce(F.col("id") == F.col("holder"), F.lit(True)), F.col("body")).alias("body")), "placed")
    later, own = placed.where("body is null").select("id", "key", "at", "n"), placed.where("body is not null").select("id", "key", "at", "body")
    shared.discard(found)
    shared.discard(holder)
    again = context.broadcast(windows.repeated_anchors(own.select("body"), _split, width, gram, windows.sketch_bits(windows.total_bytes(own, "body"), per_unit, 4)))

    def segments(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textnum.buffers(batch["body"])
            for a, b in textnum.pieces(offsets):
                d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                p = windows.anchored(textnum.byte_values(d, 0), o, width, gram)
                head = np.flatnonzero(windows.changes(p))
                tail = np.r_[head[1:], len(p.at)]
                kept = textnum.mix(p.anchor[head] ^ _TURN) % np.uint64(TURNS) == turn
                kept[kept] = windows.among_repeated(again.value, p.anchor[head[kept]])
                head, tail = head[kept], tail[kept]
                if not len(head):
                    continue
                owner = p.owner[head]
                lo, hi = p.at[head], p.at[tail - 1] + width
                take = pa.array(owner + a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p.anchor[head].view(np.int64)), batch["id"].take(take), batch["key"].take(take), pa.array((batch["at"].take(take).to_numpy() + lo - o[owner]).astype(np.int32)), _slices(d.tobytes(), lo, hi)],
                    ["anchor", "id", "key", "at", "body"],
                )

    later = shared.written(later, "later")
    for turn in range(TURNS):
        places = shared.written(own.mapInArrow(partial(segments, turn=turn), _SEGMENTS), "segments")
        later = later.unionAll(_later_places(places, width))
    again.destroy()
    shared.discard(placed)
    return later


def _later_places(places: DataFrame, width: int) -> DataFrame:
    """(id, key, at, n) of the segments' strings that have a smaller document; ``places`` is discarded."""
    # The bytes of a segment settle its anchor.
    kinds = shared.written(places.groupBy("anchor", "body").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("times")), "segment-kinds")
    blocks = max(1, -(-(kinds.agg(F.sum(F.octet_length("body") + 1)).first()[0] or 0) // BLOCK_BYTES))
    # At most 1 / HOT of the segments' anchors.
    hot = shared.written(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("crowd")).where(F.col("crowd") > HOT).select("anchor", F.ceil(F.col("crowd") / HOT).alias("deals")), "hot-anchors")
    dealt = kinds.join(hot, "anchor", "left").withColumn("hot", F.col("deals").isNotNull())
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("anchor", F.when(F.col("hot"), F.pmod(F.xxhash64("body"), "deals"))), F.lit(blocks)))

    def block(table: pa.Table) -> pa.Table:
        body = [x.as_buffer().to_pybytes() for x in table["body"]]
        least, times, hot = (table[c].to_numpy() for c in ("low", "times", "hot"))
        segment, offset, kind = bwt.equal_windows(body, width)
        head = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]) if len(kind) else np.zeros(0, np.int64)
        size = np.diff(np.r_[head, len(kind)])
        low = np.minimum.reduceat(least[segment], head) if len(head) else np.zeros(0, np.int64)
        often = np.add.reduceat(times[segment], head) if len(head) else np.zeros(0, np.int64)
        # Classes of one block: back to runs of each segment, in order.
        show = np.repeat((often > 1) & ~hot[segment[head]], size)
        s, o, v = segment[show], offset[show], np.repeat(low, size)[show]
        by = np.lexsort((o, s))
        s, o, v = s[by], o[by], v[by]
        first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (o[1:] != o[:-1] + 1) | (v[1:] != v[:-1])]) if len(s) else np.zeros(0, np.int64)
        n = np.diff(np.r_[first, len(s)])
        s, o, v = s[first], o[first], v[first]
        own, count = np.unique(s, return_counts=True)
        runs = pa.StructArray.from_arrays([pa.array(o, pa.int32()), pa.array(n, pa.int32()), pa.array(v, pa.int64())], ["at", "n", "low"])
        runs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), runs)
        # Classes of an anchor that several blocks share: one row each.
        open_ = np.flatnonzero(hot[segment[head]]) if len(head) else head
        within = np.repeat(hot[segment[head]], size) if len(head) else np.zeros(0, bool)
        strings = [body[i][k : k + width] for i, k in zip(segment[head[open_]].tolist(), offset[head[open_]].tolist(), strict=True)]
        members = pa.StructArray.from_arrays([pa.array([body[i] for i in segment[within].tolist()], pa.binary()), pa.array(offset[within], pa.int32())], ["body", "at"])
        members = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size[open_])], pa.int32()), members)
        a, b = len(own), len(open_)
        return pa.table(
            {
                "body": pa.concat_arrays([pa.array([body[i] for i in own.tolist()], pa.binary()), pa.nulls(b, pa.binary())]),
                "runs": pa.concat_arrays([runs, pa.nulls(b, runs.type)]),
                "string": pa.concat_arrays([pa.nulls(a, pa.binary()), pa.array(strings, pa.binary())]),
                "low": pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(low[open_], pa.int64())]),
                "times": pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(often[open_], pa.int64())]),
                "members": pa.concat_arrays([pa.nulls(a, members.type), members]),
            }
        )

    classed = shared.written(dealt.select("block", "hot", "body", "low", "times").groupBy("block").applyInArrow(block, _CLASSED), "classes")
    shared.discard(kinds)
    lost = classed.where("body is not null").select("body", "runs")
    if hot.limit(1).count():
        open_ = classed.where("string is not null").select("string", "low", "times", "members")
        met = open_.groupBy("string").agg(F.min("low").alias("least"), F.sum("times").alias("all")).where(F.col("all") > 1)
        strings = open_.join(met, "string").select("least", F.inline("members"))
        # A segment has at most ``width`` strings.
        lost = lost.unionAll(strings.groupBy("body").agg(F.collect_list(F.struct("at", F.lit(1).alias("n"), F.col("least").alias("low"))).alias("runs")))
    hit = places.join(lost, "body").select("id", "key", F.col("at").alias("from"), F.inline("runs")).where("id > low").select("id", "key", (F.col("from") + F.col("at")).alias("at"), "n")
    hit = shared.written(hit, "removed-strings")
    shared.discard(places)
    shared.discard(classed)
    return hit


def _cut(text: pa.Array, runs: pa.Array, width: int) -> pa.Array:
    """struct(kept, n_bytes, n_removed, spans) for each row."""
    data, offsets = textnum.buffers(text)
    length = np.diff(runs.offsets.to_numpy())
    flat = runs.flatten()
    at, n = flat.field("at").to_numpy(), flat.field("n").to_numpy()
    edge = np.r_[0, np.cumsum(length)]
    kept, removed, span_at, span_n, span_count = [], [], [], [], []
    for a, b in textnum.pieces(offsets):
        d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        lo, hi = edge[a], edge[b]
        base = np.repeat(o[:-1], length[a:b]) + at[lo:hi]
        cover = np.zeros(len(d) + 1, dtype=np.int64)
        np.add.at(cover, base, 1)
        np.add.at(cover, base + n[lo:hi] + width - 1, -1)
        gone = np.cumsum(cover[:-1]) > 0
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        inner = o[:-1][o[:-1] < len(d)]
        begin[inner] = gone[inner]  # a run ends with its text
        stop = gone.copy()
        stop[:-1] &= ~gone[1:]
        ends = o[1:][o[1:] > 0] - 1
        stop[ends] = gone[ends]
        s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        owner = np.searchsorted(o, s, "right") - 1
        span_at.append(s - o[owner])
        span_n.append(e - s)
        span_count.append(np.bincount(owner, minlength=b - a))
        out = d[~gone]
        cuts = np.r_[0, np.cumsum(~gone)][o]
        removed.append(np.diff(o) - np.diff(cuts))
        kept.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.binary()))
    if not kept:
        kept, removed, span_at, span_n, span_count = [pa.array([], pa.binary())], *([np.zeros(0, np.int64)] for _ in range(4))
    spans = pa.StructArray.from_arrays([pa.array(np.concatenate(x), pa.int32()) for x in (span_at, span_n)], ["at", "n"])
    spans = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.concatenate(span_count))], pa.int32()), spans)
    return pa.StructArray.from_arrays([pa.concat_arrays(kept), pa.array(np.diff(offsets), pa.int64()), pa.array(np.concatenate(removed), pa.int64()), spans], ["kept", "n_bytes", "n_removed", "spans"])


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, into: str = "dedup") -> DataFrame:
    """``docs`` with a column ``into``: struct(kept, n_bytes, n_removed, spans of removed bytes)."""
    found = repeated_strings(docs, doc_id=doc_id, text=text, width=width)
    ours = [shared.unused(f"own_{n}", docs.columns) for n in ("id", "key", "runs")]
    by_text = found.groupBy("id", "key").agg(F.collect_list(F.struct("at", "n")).alias("runs")).toDF(*ours)

    @F.arrow_udf("struct<kept: binary, n_bytes: bigint, n_removed: bigint, spans: array<struct<at: int, n: int>>>")
    def cut_bytes(texts: pa.Array, runs: pa.Array) -> pa.Array:
        return _cut(texts, runs, width)

    joined = docs.join(by_text, (docs[doc_id].cast("long") == by_text[ours[0]]) & (shared.text_key(docs[text]) == by_text[ours[1]]), "left")
    return joined.withColumn(into, cut_bytes(docs[text], F.coalesce(by_text[ours[2]], F.array().cast("array<struct<at:int,n:int>>")))).select(*docs.columns, into)
