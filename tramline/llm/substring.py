"""Substring dedup over words, behind a count-min prefilter.

A window is ``width`` consecutive words.  A word goes if a window that covers
it also starts in a document with a smaller id; windows are judged on the
input.  Words are runs of bytes other than space and 0x09-0x0D.

1. Partition sketches of the windows' anchors are merged (``windows``): windows
   that the sketch calls unique are certainly unique.
2. The remaining windows are kept as runs, cut by content.  Runs are grouped
   exactly by 128-bit hash: all but those of the smallest document go.
3. The first holders' runs are sketched again; their windows whose anchor may
   stand in two of them are grouped exactly, one by one, which finds repeats
   across runs that differ.
4. Covered windows return to their documents and the words are cut out.

Grouped minima are pre-aggregated and joined back by key, so a passage that a
third of all documents share neither fills one task nor makes pairs.

Defined cases: a null text has no words and an empty result; a text of fewer
than ``width`` words is left alone; very long texts and words count whole; rows with equal ids never remove words from
each other; a row whose id is null is left alone and removes nothing; an empty
table gives an empty result; extra columns are kept and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, textnum, windows

WIDTH = 50
CUT_EVERY = 4
_RUNS = "c1 long, c2 long, id long, key long, at int, n int, body binary"
_WINDOWS = "h1 long, h2 long, id long, key long, at int"


def _gram(width: int) -> int:
    return max(1, width // 2)


def _split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = textnum.words(data, offsets)
    return textnum.span_hashes(data, start, end), first


def repeated_windows(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, key, at, n): runs of n windows from word ``at`` that also start in a
    document with a smaller id.  ``key`` is the text's own hash."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), shared.text_key(text).alias("key"), F.col(text).alias("text")).where("id is not null")
    gram = _gram(width)
    bits = windows.sketch_bits(windows.total_bytes(rows, "text") / 5, 2 / (width - gram + 2), 8)
    sketch = spark.sparkContext.broadcast(windows.repeated_cells(rows.select("text"), _split, width, gram, bits))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textnum.buffers(batch["text"])
            for a, b in textnum.pieces(offsets):
                d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                start, end, first = textnum.words(d, o)
                p = windows.anchored(textnum.span_hashes(d, start, end), first, width, gram)
                c = windows.chunks(p, sketch.value, CUT_EVERY)
                if not len(c.lo):
                    continue
                lo, hi = p.at[c.lo], p.at[c.hi - 1] + width  # words of the run
                plain, lo_byte, hi_byte = textnum.one_spaced(d, start, end)
                raw = plain.tobytes()
                lo_byte, hi_byte = lo_byte[lo], hi_byte[hi - 1]
                whole = textnum.digests(raw, lo_byte, hi_byte)
                owner = p.owner[c.lo]
                body = [raw[s:e] for s, e in zip(lo_byte.tolist(), hi_byte.tolist(), strict=True)]
                take = pa.array(owner + a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(whole[:, 0]), pa.array(whole[:, 1]), batch["id"].take(take), batch["key"].take(take), pa.array((lo - first[owner]).astype(np.int32)), pa.array((hi - lo - width + 1).astype(np.int32)), pa.array(body, pa.binary())],
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
    bits = windows.sketch_bits(windows.total_bytes(own, "body") / 5, 2 / (width - gram + 2), 8)
    again = spark.sparkContext.broadcast(windows.repeated_cells(own.select("body"), _split, width, gram, bits))

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textnum.buffers(batch["body"])
            for a, b in textnum.pieces(offsets):
                d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                start, end, first = textnum.words(d, o)
                one = textnum.span_hashes(d, start, end)
                p = windows.anchored(one, first, width, gram)
                head = np.flatnonzero(windows.changes(p))
                kept = np.repeat(windows.maybe_repeated(again.value, p.anchor[head]), np.diff(np.r_[head, len(p.at)]))
                lo, owner = p.at[kept], p.owner[kept]
                h = [textnum.window_hashes(one if w == 0 else textnum.span_hashes(d, start, end, w), width, w)[lo].view(np.int64) for w in (0, 1)]
                take = pa.array(owner + a)
                at = batch["at"].take(take).to_numpy() + lo - first[owner]
                yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), batch["id"].take(take), batch["key"].take(take), pa.array(at.astype(np.int32))], ["h1", "h2", "id", "key", "at"])

    each = shared.written(own.mapInArrow(singles, _WINDOWS), "windows")
    again.destroy()
    later = shared.written(later, "later")
    shared.discard(placed)
    # Written for the same reason.
    twice = each.groupBy("h1", "h2").agg(F.min("id").alias("holder"), F.max("id").alias("last")).where("last > holder").select("h1", "h2", "holder")
    twice = shared.written(twice, "twice")
    apart = shared.written(each.join(twice, ["h1", "h2"]).where("id > holder").select("id", "key", "at", F.lit(1).alias("n")), "apart")
    shared.discard(each)
    shared.discard(twice)
    return later.unionAll(apart)


def _cut(text: pa.Array, runs: pa.Array, width: int) -> pa.Array:
    """struct(kept, n_words, n_removed) for each row."""
    data, offsets = textnum.buffers(text)
    runs = runs.combine_chunks() if isinstance(runs, pa.ChunkedArray) else runs
    length = np.diff(runs.offsets.to_numpy()) if len(runs) else np.zeros(0, np.int64)
    length = np.where(runs.is_valid().to_numpy(zero_copy_only=False), length, 0) if len(runs) else length
    flat = runs.flatten()
    at, n = flat.field("at").to_numpy(), flat.field("n").to_numpy()
    edge = np.r_[0, np.cumsum(length)]
    kept_text, n_words, n_removed = [], [], []
    for a, b in textnum.pieces(offsets):
        d, o = data[offsets[a] : offsets[b]].copy(), offsets[a : b + 1] - offsets[a]
        start, end, first = textnum.words(d, o)
        lo, hi = edge[a], edge[b]
        base = np.repeat(first[:-1], length[a:b]) + at[lo:hi]
        cover = np.zeros(len(start) + 1, dtype=np.int64)
        np.add.at(cover, base, 1)
        np.add.at(cover, base + n[lo:hi] + width - 1, -1)
        keep = np.cumsum(cover[:-1]) == 0
        words = np.diff(first)
        total = np.r_[0, np.cumsum(keep)]
        left = np.diff(total[first])
        # One separator byte after each kept word but the last kept of its text.
        owner = np.repeat(np.arange(b - a), words)
        rank = total[1:] - total[first[:-1]][owner]
        inner = keep & (rank < left[owner])
        mark = np.zeros(len(d) + 1, dtype=np.int8)
        mark[start[keep]] += 1
        mark[end[keep]] -= 1
        mask = np.cumsum(mark[:-1], dtype=np.int8) > 0
        d[end[inner]] = 32
        mask[end[inner]] = True
        out = d[mask]
        cuts = np.r_[0, np.cumsum(mask)][o]
        kept_text.append(pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())).cast(pa.string()))
        n_words.append(words)
        n_removed.append(words - left)
    names = ["kept", "n_words", "n_removed"]
    if not kept_text:
        return pa.StructArray.from_arrays([pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.int64())], names)
    return pa.StructArray.from_arrays([pa.concat_arrays(kept_text), pa.array(np.concatenate(n_words), pa.int64()), pa.array(np.concatenate(n_removed), pa.int64())], names)


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, into: str = "dedup") -> DataFrame:
    """``docs`` with a column ``into``: struct(kept, n_words, n_removed).

    ``kept`` has the words that stay, joined by one space.
    """
    found = repeated_windows(docs, doc_id=doc_id, text=text, width=width)
    by_text = found.groupBy("id", "key").agg(F.collect_list(F.struct("at", "n")).alias("runs"))

    @F.arrow_udf("struct<kept: string, n_words: bigint, n_removed: bigint>")
    def cut_words(texts: pa.Array, runs: pa.Array) -> pa.Array:
        return _cut(texts, runs, width)

    ours = [shared.unused(f"own_{n}", docs.columns) for n in ("id", "key")]
    by_text = by_text.withColumnsRenamed(dict(zip(("id", "key", "runs"), (*ours, runs_name := shared.unused("own_runs", docs.columns)), strict=True)))
    joined = docs.join(by_text, (docs[doc_id].cast("long") == by_text[ours[0]]) & (shared.text_key(docs[text]) == by_text[ours[1]]), "left")
    return joined.withColumn(into, cut_words(docs[text], F.coalesce(F.col(runs_name), F.array().cast("array<struct<at:int,n:int>>")))).select(*docs.columns, into)
