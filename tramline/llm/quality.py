"""Quality classifier: random Fourier features, ridge, isotonic calibration.

Twenty-odd statistics of a text are mapped to random Fourier features, whose
inner products approximate a Gaussian kernel.  Each partition adds up its own
normal equations, one set per cross-fitting fold; the sums give the ridge
weights.  Out-of-fold scores are gathered in fixed bins and a
pool-adjacent-violators pass over the bins turns scores into probabilities.

Defined cases: a null text counts as an empty one and gets a score like any
other; a null id is never learned from and is held out = null; a document with several label rows
takes their mean; rows whose label is null teach nothing; very long texts count whole; rows with equal ids teach once each; an empty table gives
an empty result; without any label rows every score is 0.5.  Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared, textnum

STATS = 21
FEATURES = 224
FOLDS = 4
BINS = 2048
RIDGE = 1e-3
GAMMA = 0.035
#: The random features weigh this much beside the plain statistics.
KERNEL_SCALE = 8
BLOCKS = 8
#: Labelled rows behind one task's sums, and the sums that one task adds up.
ROWS_PER_SUM, SUMS = 1 << 14, 64

_CLASS = {
    "alpha": bytes([*range(65, 91), *range(97, 123), *range(128, 256)]),
    "upper": bytes(range(65, 91)),
    "digit": b"0123456789",
    "space": b" \t",
    "line": b"\n\r",
    "plain": b".,;:?'\"-()",
    "odd": b"%$#@&*|<>{}[]\\/^~_=+`",
    "bar": b"|",
    "shout": b"!",
    "wide": bytes(range(128, 256)),
}
_MASK = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in _CLASS.items()}


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets]).astype(np.float64)


def _group_stats(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each owner: number of distinct keys, and count of its commonest key."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    # The owner takes the high bits, so one sort groups owners and keys.
    code = (owner.astype(np.uint64) << np.uint64(40)) | (keys >> np.uint64(24))
    code.sort()
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    count = np.diff(np.r_[first, len(code)])
    of = (code[first] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, of, count)
    return np.bincount(of, minlength=n).astype(np.float64), most


def _piece_stats(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    per_byte = 1.0 / np.maximum(size, 1)
    counts = {k: _per_text(m[data], offsets) for k, m in _MASK.items()}
    start, end, first = textnum.words(data, offsets)
    words = np.diff(first).astype(np.float64)
    per_word = 1.0 / np.maximum(words, 1)
    owner = np.repeat(np.arange(n), np.diff(first))
    length = (end - start).astype(np.float64)
    mean = np.bincount(owner, length, n) * per_word
    square = np.bincount(owner, length * length, n) * per_word
    hashes = textnum.span_hashes(data, start, end)
    distinct, most = _group_stats(hashes, owner, n)
    same = np.zeros(len(hashes))
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    again = np.bincount(owner, same, n) * per_word
    capital = np.bincount(owner, _MASK["upper"][data[start]] if len(start) else None, n) * per_word if len(start) else np.zeros(n)
    odd_end = np.bincount(owner, _MASK["odd"][data[end - 1]], n) * per_word if len(start) else np.zeros(n)
    stop_end = np.bincount(owner, data[end - 1] == ord("."), n) * per_word if len(start) else np.zeros(n)
    # Lines: spans between line ends.
    cut = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([offsets, cut, cut + 1]))
    lo, hi = edges[:-1], edges[1:]
    keep = (hi > lo) & (data[lo] != 10) if len(lo) else np.zeros(0, bool)
    lo, hi = lo[keep], hi[keep]
    line_owner = np.searchsorted(offsets, lo, "right") - 1
    line_hash = textnum.span_hashes(data, lo, hi)
    lines = np.bincount(line_owner, minlength=n).astype(np.float64)
    line_kinds, _ = _group_stats(line_hash, line_owner, n)
    repeated = 1 - line_kinds / np.maximum(lines, 1)
    repeated[lines == 0] = 0
    rows = [
        np.log1p(size), np.log1p(words), counts["alpha"] * per_byte, counts["upper"] * per_byte, counts["digit"] * per_byte, counts["space"] * per_byte,
        counts["line"] * per_byte * 10, counts["plain"] * per_byte * 5, np.sqrt(counts["odd"] * per_byte), np.sqrt(counts["bar"] * per_byte), np.sqrt(counts["shout"] * per_byte),
        counts["wide"] * per_byte, mean / 10, np.sqrt(np.maximum(square - mean * mean, 0)) / 10, distinct * per_word, most * per_word, repeated, capital, odd_end, stop_end, again,
    ]
    return np.stack(rows, axis=1)


def stats_of(texts: pa.Array) -> np.ndarray:
    """The statistics of whole texts, one row each."""
    data, offsets = textnum.buffers(texts)
    parts = [_piece_stats(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in textnum.pieces(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, STATS))


@dataclass(frozen=True)
class QualityModel:
    """All of it is of fixed size: a few hundred kilobytes at most."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return _features(stats, self.centre, self.scale) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.values)


def _features(stats: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(6)
    x = np.clip((stats - centre) / scale, -6, 6)
    turn = rng.normal(0, np.sqrt(2 * GAMMA), (STATS, FEATURES))
    shift = rng.uniform(0, 2 * np.pi, FEATURES)
    return np.concatenate([np.ones((len(x), 1)), x, np.sqrt(2 / FEATURES) * KERNEL_SCALE * np.cos(x @ turn + shift)], axis=1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATS).astype(np.float64)


def stats_column(text: str | Column) -> Column:
    """The statistics of each whole text as an array column."""

    @F.arrow_udf("array<float>")
    def quality_stats(texts: pa.Array) -> pa.Array:
        got = stats_of(texts).astype(np.float32)
        return pa.ListArray.from_arrays(np.arange(0, got.size + 1, STATS, dtype=np.int32), pa.array(got.ravel(), pa.float32()))

    return quality_stats(text)


def fit(stats: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", label: str = "quality", modulus: int = 4, held_out: int = 2) -> QualityModel:
    """Learn from ``stats(doc_id, stats)`` and the rows of ``labels`` not held out.

    All labelled rows count; what reaches the driver is sums of fixed size.
    """
    marks = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y")).where("id is not null and y is not null and not isnan(y)")
    marks = marks.where(shared.remainder("id", modulus) != held_out).groupBy("id").agg(F.avg("y").alias("y"))
    rows = stats.select(F.col(doc_id).alias("id"), "stats").join(marks, "id").select("id", "stats", "y", F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int").alias("fold"))
    rows = shared.written(rows, "quality-rows")
    sums = rows.select("stats", "y").mapInArrow(_moments, "n double, s array<double>, q array<double>").toPandas()
    n = sums["n"].sum() if len(sums) else 0
    if not n:
        return QualityModel(np.zeros(STATS), np.ones(STATS), np.zeros(1 + STATS + FEATURES), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    centre = np.sum(sums["s"].tolist(), axis=0) / n
    scale = np.sqrt(np.maximum(np.sum(sums["q"].tolist(), axis=0) / n - centre**2, 0)) + 1e-3
    dim = 1 + STATS + FEATURES

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, dim, dim + 1))
        for batch in batches:
            z, y, fold = _features(_matrix(batch["stats"]), centre, scale), batch["y"].to_numpy(), batch["fold"].to_numpy()
            for k in range(FOLDS):
                own = fold == k
                total[k] += z[own].T @ np.concatenate([z[own], y[own, None]], axis=1)
        parts = [(k, b, x.tobytes()) for k in range(FOLDS) for b, x in enumerate(np.array_split(total[k], BLOCKS))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["fold", "block", "part"])

    def added(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer()) for x in table["part"])
        return pa.table({"fold": [key[0].as_py()], "block": [key[1].as_py()], "part": [total.tobytes()]}, schema=table.schema)

    # As many sums as the labelled rows need, added by groups of at most SUMS.
    tasks, wide = 1 + int(n) // ROWS_PER_SUM, "fold int, block int, part binary"
    parts = rows.coalesce(tasks).mapInArrow(equations, wide)
    while tasks > SUMS:
        tasks = -(-tasks // SUMS)
        parts = parts.groupBy("fold", "block", F.pmod(F.spark_partition_id(), F.lit(tasks)).alias("salt")).applyInArrow(lambda key, table: added(key[:2], table), wide)
    parts = parts.groupBy("fold", "block").applyInArrow(added, wide).collect()
    each = np.zeros((FOLDS, dim, dim + 1))
    split = np.array_split(np.arange(dim), BLOCKS)
    for p in parts:
        each[p["fold"], split[p["block"]]] = np.frombuffer(p["part"]).reshape(-1, dim + 1)
    total = each.sum(axis=0)
    penalty = np.eye(dim) * RIDGE * max(n, 1)
    penalty[0, 0] = 0

    def solve(sums: np.ndarray) -> np.ndarray:
        return np.linalg.lstsq(sums[:, :dim] + penalty, sums[:, dim], rcond=None)[0]

    weights, apart = solve(total), [solve(total - each[k]) for k in range(FOLDS)]
    edges = np.linspace(-0.5, 1.5, BINS - 1)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros((BINS, 2))
        for batch in batches:
            z, y, fold = _features(_matrix(batch["stats"]), centre, scale), batch["y"].to_numpy(), batch["fold"].to_numpy()
            score = np.zeros(len(y))
            for k in range(FOLDS):
                score[fold == k] = z[fold == k] @ apart[k]
            at = np.searchsorted(edges, score)
            got += np.stack([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)], axis=1)
        seen = np.flatnonzero(got[:, 0])
        yield pa.RecordBatch.from_pydict({"bin": pa.array(seen, pa.int32()), "n": pa.array(got[seen, 0]), "y": pa.array(got[seen, 1])})

    bins = rows.mapInArrow(binned, "bin int, n double, y double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).orderBy("bin").toPandas()
    knots, values = isotonic(np.r_[edges[0], (edges[1:] + edges[:-1]) / 2, edges[-1]][bins["bin"]], bins["y"].to_numpy() / bins["n"].to_numpy(), bins["n"].to_numpy())
    return QualityModel(centre, scale, weights, knots, values)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, s, q = 0, np.zeros(STATS), np.zeros(STATS)
    for batch in batches:
        x = _matrix(batch["stats"])
        n, s, q = n + len(x), s + x.sum(axis=0), q + (x * x).sum(axis=0)
    if n:
        yield pa.RecordBatch.from_pydict({"n": [float(n)], "s": [s.tolist()], "q": [q.tolist()]})


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the non-decreasing step fit, as (knots, values)."""
    level: list[list[float]] = []
    for a, b, w in zip(x, y, weight, strict=True):
        level.append([b, w, a, a])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            v, u, _, last = level.pop()
            p = level[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + v * u) / (p[1] + u), p[1] + u, last
    knots = np.array([k for v in level for k in (v[2], v[3] + 1e-9)])
    return knots, np.clip(np.repeat([v[0] for v in level], 2), 0, 1)


def score_column(model: QualityModel, text: str | Column) -> Column:
    """Probability of quality 1 for each whole text."""

    @F.arrow_udf("double")
    def quality_score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(stats_of(texts)), pa.float64())

    return quality_score(text)


def score_stats_column(model: QualityModel, stats: str | Column) -> Column:
    """The same from statistics that are already there."""

    @F.arrow_udf("double")
    def quality_stats_score(rows: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(rows)), pa.float64())

    return quality_stats_score(stats)


def statistics(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, stats) of every document, written to the shared folder: one pass over the texts."""
    return shared.written(docs.select(F.col(doc_id).alias("doc_id"), stats_column(text).alias("stats")), "quality-stats")
