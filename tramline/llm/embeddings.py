"""Embedding near-dedup by randomised-rotation binary codes.

Each unit vector is rotated at random; the signs of the rotated vector are its
code, and the inner product of the vector with its own code vector, the
correction factor f, is stored with it.  For a code x and another unit vector b

    <x, b> = f * cos + sqrt(1 - f^2) * sqrt(1 - cos^2) * r

where r, over the random rotation, is the inner product of two independent
directions: <x, b> / f estimates the cosine without bias, and r stays below
``SIGMAS`` / sqrt(size - 1) but with probability ``2e-9``.  Pairs whose upper
confidence bound reaches the threshold are recomputed in double precision and
link by that value; the others don't link.

Candidates come from bands of code bits, of as many rotations as they need.
The number of bits follows the number of vectors and the number of bands
follows from the bits, so that a pair right at the threshold is missed with
probability ``MISS`` (closer pairs far more rarely).  A pair is counted in the
first band that both share.  Small buckets are searched many in one task;
those of more than ``BLOCK`` vectors are dealt to pairs of blocks, so none is
gathered whole.  Tasks return counts and a spanning star, never pairs.

Defined cases: vectors that are null, empty, zero, or hold a null or
non-finite component, and rows with a null label, link with nothing; vectors of different
length don't link; equal vectors with equal labels link with each other; rows
with equal ids are vectors of their own; an empty table gives an empty result;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, shared

THRESHOLD = 0.98
MISS = 1e-6
SIGMAS = 6.0
BLOCK = 2048
#: Buckets up to this size are searched together, by shifted comparison.
SMALL = 32


def plan(rows: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits, bands) for a table of so many vectors."""
    bits = int(min(28, max(10, math.ceil(math.log2(max(rows, 2))) - 2)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - same))


@lru_cache(maxsize=8)
def rotations(size: int, times: int) -> np.ndarray:
    """``times`` random orthogonal matrices, the same in every task."""
    rng = np.random.default_rng(size * 1009 + 10)
    return np.stack([np.linalg.qr(rng.normal(size=(size, size)))[0] for _ in range(times)])


def codes(unit: np.ndarray, bits: int, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs and factors of the first rotation, band keys) of unit vectors of one length."""
    size = unit.shape[1]
    times = -(-bits * bands // size)
    turned = unit @ rotations(size, times).reshape(times * size, size).T
    flat = (turned > 0)[:, : bits * bands].reshape(len(unit), bands, bits)
    factor = np.abs(turned[:, :size]).sum(axis=1) / np.sqrt(size)
    return np.packbits(turned[:, :size] > 0, axis=1), factor, flat.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def margins(factor: np.ndarray, size: int, threshold: float) -> np.ndarray:
    """How far below the threshold the estimate of a pair at the threshold may lie."""
    sure = np.sqrt(np.maximum(1 - factor**2, 0)) * np.sqrt(1 - threshold**2) / factor
    return sure * min(1.0, SIGMAS / np.sqrt(max(size - 1, 1))) + 1e-5


class Vectors:
    """Vectors of one length in a task: estimates from codes, exact cosines from components."""

    def __init__(self, raw: np.ndarray, code: np.ndarray, factor: np.ndarray, threshold: float) -> None:
        size = raw.shape[1]
        self.raw, self.norm = raw, np.sqrt(np.einsum("ij,ij->i", raw, raw))
        self.sign = (np.unpackbits(code, axis=1, count=size).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(size))
        self.turned = (_unit(raw) @ rotations(size, 1)[0].T).astype(np.float32)
        # <x, b> from which a pair is recomputed.
        self.least = (factor * (threshold - margins(factor, size, threshold))).astype(np.float32)
        self.threshold, self.estimated, self.recomputed = threshold, 0, 0

    def exact(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.recomputed += len(i)
        good = np.einsum("ij,ij->i", self.raw[i], self.raw[j]) / (self.norm[i] * self.norm[j]) >= self.threshold
        return i[good], j[good]

    def of_pairs(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links among the given pairs."""
        self.estimated += len(i)
        near = np.einsum("ij,ij->i", self.sign[i], self.turned[j]) >= self.least[i]
        return self.exact(i[near], j[near])

    def of_blocks(self, left: np.ndarray, right: np.ndarray, keys: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
        """Links between two blocks, or inside one, whose first common band is ``band``."""
        near = self.sign[left] @ self.turned[right].T >= self.least[left][:, None]
        self.estimated += near.size
        i, j = np.nonzero(np.triu(near, 1) if left is right else near)
        i, j = left[i], right[j]
        own = np.argmax(keys[i] == keys[j], axis=1) == band if len(i) else np.zeros(0, bool)
        return self.exact(i[own], j[own])


def small_pairs(place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs inside each run of equal ``place``, one distance at a time."""
    for k in range(1, SMALL):
        i = np.flatnonzero(place[k:] == place[:-k]) if k < len(place) else np.zeros(0, np.int64)
        if not len(i):
            return
        yield i, i + k


def searched(place: np.ndarray, side: np.ndarray, band: np.ndarray, keys: np.ndarray, vectors: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the places of a task, whose rows stand together; ``side`` tells the blocks of a pair apart."""
    cut = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])
    size = np.diff(cut)
    small = np.repeat((size <= SMALL) & ~np.logical_or.reduceat(side > 0, cut[:-1]), size)
    own, found = np.flatnonzero(small), []
    for i, j in small_pairs(place[own]):
        i, j = own[i], own[j]
        first = np.argmax(keys[i] == keys[j], axis=1) == band[i]
        found.append(vectors.of_pairs(i[first], j[first]))
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        if not small[lo]:
            rows = np.arange(lo, hi)
            pair = (rows[side[lo:hi] == 1], rows[side[lo:hi] == 2]) if side[lo] else (rows, rows)
            found.append(vectors.of_blocks(*pair, keys, int(band[lo])))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _star(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n, the smallest index that it reaches through the pairs."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if np.array_equal(new, low):
            return low
        low = new


def near_copies(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors``."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    kinds = rows.where("sound").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))

    bits, bands = plan(rows.where("sound").count(), threshold)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["v"]
            edge, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            length = np.diff(edge)
            for size in np.unique(length):
                own = np.flatnonzero(length == size)
                for at in range(0, len(own), 2048):
                    part = own[at : at + 2048]
                    raw = flat[edge[part][:, None] + np.arange(size)]
                    code, factor, keys = codes(_unit(raw), bits, bands)
                    take = pa.array(part)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(batch[c].take(take) for c in ("rep", "copies", "space")), pa.array([x.tobytes() for x in raw], pa.binary()), pa.array([x.tobytes() for x in code], pa.binary()), pa.array(factor),
                            pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.ravel())),
                        ],
                        ["rep", "copies", "space", "v", "code", "factor", "keys"],
                    )

    kinds = kinds.withColumn("space", F.concat_ws(":", F.size("v").cast("string"), F.col("label").cast("string"))).select("rep", "copies", "space", "v")
    kinds = shared.written(kinds.mapInArrow(coded, "rep long, copies long, space string, v binary, code binary, factor double, keys array<long>"), "vectors")
    keys = kinds.select("rep", "space", F.posexplode("keys").alias("band", "key"))
    bucket = ["space", "band", "key"]
    full = keys.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*bucket, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    member = keys.join(full, bucket).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).otherwise(F.when(F.col("own") < F.col("other"), 1).otherwise(2))
    member = member.select("rep", "space", F.xxhash64(*bucket, F.least("own", "other"), F.greatest("own", "other")).alias("place"), side.alias("side"), "band")
    member = member_table = shared.written(member, "places")
    deals = 1 + member.count() // BLOCK
    # A group has vectors of one length.
    member = member.join(kinds.select("rep", "copies", "v", "code", "factor", "keys"), "rep").withColumn("deal", F.pmod(F.xxhash64("place"), F.lit(deals)))

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending"), ("side", "ascending"), ("rep", "ascending")])
        rep, copies, place, side, band, factor = (table[c].to_numpy() for c in ("rep", "copies", "place", "side", "band", "factor"))
        own_keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        raw, code = (np.frombuffer(b"".join(x.as_buffer() for x in table[c]), t).reshape(len(rep), -1) for c, t in (("v", np.float64), ("code", np.uint8)))
        a, b = searched(place, side, band, own_keys, Vectors(raw, code, factor, threshold))
        links = np.bincount(a, copies[b], len(rep)) + np.bincount(b, copies[a], len(rep))
        hit = np.flatnonzero(links)
        return pa.table({"rep": rep[hit], "links": links[hit].astype(np.int64), "to": rep[_star(len(rep), a, b)[hit]]})

    found = shared.written(member.groupBy("deal", F.octet_length("v").alias("size")).applyInArrow(search, "rep long, links long, to long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components.connected(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    shared.discard(member_table)
    classes = rows.where("sound").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = classes.join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    good = rows.where("sound").join(classes, ["label", "v"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionAll(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
