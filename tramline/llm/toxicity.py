"""Toxicity: FTRL-proximal logistic regression over hashed word features.

Features are the presence of hashed words, word pairs and skip-grams (a word
and the one after next), over words of letters and digits in lower case (ASCII
folding only).  A longer word also counts as its stems of four to seven bytes,
so that an inflected insult shares a feature with its other forms.  FTRL-proximal with per-coordinate rates and L1 sparsity runs over a bounded
sample of labelled rows in the order of their ids' hashes.  The result has at most ``2 ** BITS`` weights, most of them
zero, and is what the scoring tasks receive.

Defined cases: a null or empty text has no features and scores by the bias
alone; a null id is never learned from; a document with several label rows
takes the largest, one with several texts teaches by the smallest; null labels teach nothing; without labels every score is
0.5; very long texts count whole; ties in the sample's order go to the smaller id;
an empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared, textnum

BITS = 21
#: Most labelled rows that are learned from, taken by the smallest hash of the id.
SAMPLE_ROWS = 12_000
STEMS = (4, 5, 6, 7)
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.25, 1.0, 4.0, 0.2
#: A toxic row counts this often, for toxic rows are the fewer.
POSITIVE = 3.0

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_GAP = np.ones(256, dtype=bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _piece_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, feature) of every word, pair and skip-gram; repeats included."""
    start, end, first = textnum.words(data, offsets, _GAP)
    folded = _FOLD[data]
    one = textnum.span_hashes(folded, start, end)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    feature, whose = [one], [owner]
    for size in STEMS:
        longer = end - start > size
        feature.append(textnum.span_hashes(folded, start[longer], start[longer] + size) + np.uint64(size))
        whose.append(owner[longer])
    for gap, salt in ((1, 0x51ED270B), (2, 0xC2B2AE35)):
        if len(one) > gap:
            same = owner[gap:] == owner[:-gap]
            feature.append(textnum.mix(one[:-gap][same] * np.uint64(3) + one[gap:][same] * np.uint64(7) + np.uint64(salt)))
            whose.append(owner[gap:][same])
    return np.concatenate(whose), (np.concatenate(feature) & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclass(frozen=True)
class ToxicityModel:
    """``index`` and ``weight`` of the non-zero coordinates, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        table = np.zeros(1 << BITS)
        table[self.index] = self.weight
        used = table != 0
        data, offsets = textnum.buffers(texts)
        out = np.full(len(offsets) - 1, self.bias)
        for a, b in textnum.pieces(offsets):
            owner, feature = _piece_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            hit = used[feature]
            code = np.unique(owner[hit] << BITS | feature[hit])  # presence, not count
            out[a:b] += np.bincount(code >> BITS, table[code & ((1 << BITS) - 1)], b - a)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def ftrl(features: list[np.ndarray], y: np.ndarray, *, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes over the rows in the given order."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    for _ in range(epochs):
        for own, label in zip(features, y, strict=True):
            at = np.append(own, size)
            za, na = z[at], n[at]
            root = np.sqrt(na)
            limit = np.full(len(at), L1)
            limit[-1] = 0  # the bias is not shrunk
            w = np.where(np.abs(za) > limit, (np.sign(za) * limit - za) / ((BETA + root) / ALPHA + L2), 0)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
            g *= POSITIVE if label > 0.5 else 1.0
            more = na + g * g
            z[at] = za + g - (np.sqrt(more) - root) / ALPHA * w
            n[at] = more
    limit = np.full(size + 1, L1)
    limit[-1] = 0
    w = np.where(np.abs(z) > limit, (np.sign(z) * limit - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0)
    return w[:-1], float(w[-1])


def _sample_fit(table: pa.Table) -> pa.Table:
    order = np.argsort(table["at"].to_numpy(), kind="stable")
    y = table["y"].to_numpy()[order]
    packed = table["features"].combine_chunks()
    features = [np.frombuffer(packed[int(i)].as_buffer(), np.int32) for i in order]
    w, bias = ftrl(features, y)
    seen = np.flatnonzero(w)
    return pa.table({"index": pa.array([seen.astype(np.int32).tobytes()], pa.binary()), "weight": pa.array([w[seen].tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = textnum.buffers(batch["text"])
        rows = []
        for a, b in textnum.pieces(offsets):
            owner, feature = _piece_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            code = np.unique(owner << BITS | feature)
            cut = np.searchsorted(code >> BITS, np.arange(b - a + 1))
            code = (code & ((1 << BITS) - 1)).astype(np.int32)
            rows += [code[cut[i] : cut[i + 1]].tobytes() for i in range(b - a)]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(rows), np.int32)), batch["at"], batch["y"], pa.array(rows, pa.binary())], ["sample", "at", "y", "features"])


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", modulus: int = 5, held_out: int = 0, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn from at most ``sample_rows`` labelled rows that are not held out.

    The sample's ids and labels (bounded by ``sample_rows``) are broadcast, so
    the texts of ``docs`` are filtered where they are read.
    """
    marks = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y")).where("id is not null and y is not null and not isnan(y)")
    marks = marks.where(shared.remainder("id", modulus) != held_out).groupBy("id").agg(F.max("y").alias("y"))
    marks = marks.withColumn("at", F.xxhash64("id")).orderBy("at", "id").limit(sample_rows)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(marks), "id")
    rows = rows.groupBy("id", "at", "y").agg(F.min("text").alias("text")).select("text", "at", "y")
    got = rows.mapInArrow(_feature_rows, "sample int, at long, y double, features binary").groupBy("sample").applyInArrow(_sample_fit, "index binary, weight binary, bias double").collect()
    if not got:
        return ToxicityModel(np.zeros(0, np.int32), np.zeros(0), 0.0)
    return ToxicityModel(np.frombuffer(got[0]["index"], np.int32), np.frombuffer(got[0]["weight"]), got[0]["bias"])


def score_column(model: ToxicityModel, text: str | Column) -> Column:
    """Probability of toxic = 1 for each whole text."""

    @F.arrow_udf("double")
    def toxicity_score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(texts), pa.float64())

    return toxicity_score(text)
