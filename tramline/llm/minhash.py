"""MinHash near-dedup with BagMinHash signatures of word-shingle multisets.

A text is the multiset of its runs of five words (a shorter text with any word
is one shingle).  Each shingle's count is discretised to whole levels, which
lie in octaves [0,1), [1,2), [2,4), [4,8) ...; every (shingle, octave) is a
Poisson process whose rate is the octave's length.  A point of a process falls
on one of the signature's places and carries a level; points above the count
are thinned out.  Each place keeps its earliest point, and a process ends when
its time passes the latest place.  Two signatures agree at a place with
probability equal to the texts' weighted Jaccard similarity.

Signatures are banded, and texts that share a band are verified by the exact
multiset overlap.  Equal texts are one kind from the start (128-bit hash).

1. Each kind goes to one hub, the smallest id of all its buckets; a hub's kinds
   are dealt to blocks of bounded size, each with the hub's own bag.
2. Buckets whose members are still in different components, and have not all
   been with one hub, are searched whole: a task compares what is in different
   components and in no earlier common bucket, and returns a spanning forest,
   never pairs.
3. Buckets beyond a block's bound are dealt anew by rare members: with members
   ordered by rarity, two texts at the similarity share one of their first
   ``size - ceil(similarity * size) + 1``.  A rare member beyond the bound is
   searched by pairs of blocks.

So no link between buckets' members is lost, and dense groups cost one pass.

Defined cases: a null or empty text, or one without words, is alone; rows with
equal ids are one document, which has the links of each of its texts and stays
or goes whole; ties go to the smallest id; a row with a null id is alone; very
long texts count whole; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import components, shared, textnum

U = np.uint64
SHINGLE = 5
SIMILARITY = 0.8
#: A pair at similarity 0.8 shares no band with probability (1 - 0.8^4)^20 = 3e-5.
BANDS, BAND_ROWS = 20, 4
PLACES = BANDS * BAND_ROWS
#: A task searches at most so many texts, with so many shingles in all, as one place.
BLOCK, BLOCK_MEMBERS = 2048, 1 << 22
#: A text among those of its smallest id.
KIND = ["rep", "key"]
MAP_BITS = 26


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, count) of each text's distinct shingles, sorted by both."""
    start, end, first = textnum.words(data, offsets)
    one = textnum.span_hashes(data, start, end)
    n = np.diff(first)
    room = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), room)
    lo = np.arange(len(owner)) + np.repeat(first[:-1] - (np.cumsum(room) - room), room)
    h = one[lo]
    for k in range(1, SHINGLE):
        own = slice(None) if not len(n) or n.min() >= SHINGLE else n[owner] > k
        h[own] = textnum.joined(h[own], one[lo[own] + k])
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(owner[order].astype(np.int32), kind="stable")]
    owner, h = owner[order], h[order]
    head = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, np.int64)
    return owner[head], h[head], np.diff(np.r_[head, len(h)])


def signatures(owner: np.ndarray, h: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """n x PLACES earliest times; a text without shingles has infinities."""
    low = np.full((n, PLACES), np.inf)
    flat = low.reshape(-1)
    octaves = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1
    at = np.repeat(np.arange(len(h)), octaves)
    octave = np.arange(len(at)) - np.repeat(np.cumsum(octaves) - octaves, octaves)
    owner, weight = owner[at], count[at].astype(np.float64)
    seed = textnum.mix(h[at] + octave.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    floor = np.where(octave > 0, np.exp2(octave - 1.0), 0.0)
    rate = np.where(octave > 0, floor, 1.0)
    time = np.zeros(len(at))
    done = 0
    while len(at):
        # Few processes left: several points of each at once.
        many = max(1, min(64, 30_000 // len(at)))
        step = np.arange(done + 1, done + many + 1, dtype=np.uint64) * U(0xD6E8FEB86659FD93)
        draw = textnum.mix(seed[:, None] + step[None, :])
        gap = -np.log(((draw >> U(11)).astype(np.float64) + 0.5) * 2.0**-53)
        # One gap after the other, so that no time depends on how many are drawn at once.
        times = np.cumsum(np.column_stack([time, gap / rate[:, None]]), axis=1)[:, 1:]
        mark = textnum.mix(draw ^ U(0xA0761D6478BD642F))
        place = (mark >> U(32)) % U(PLACES)
        level = floor[:, None] + (mark & U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * rate[:, None]
        good = level < weight[:, None]
        np.minimum.at(flat, (owner[:, None] * PLACES + place.astype(np.int64))[good], times[good])
        time = times[:, -1]
        go = time < low.max(axis=1)[owner]
        owner, weight, seed, floor, rate, time, at = (x[go] for x in (owner, weight, seed, floor, rate, time, at))
        done += many
    return low


def bands(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have words, their BANDS band hashes)."""
    data, offsets = textnum.buffers(texts)
    rows, keys = [], []
    for a, b in textnum.pieces(offsets):
        owner, h, count = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        own = np.unique(owner)
        sig = signatures(owner, h, count, b - a)[own].view(np.uint64).reshape(len(own), BANDS, BAND_ROWS)
        key = np.zeros((len(own), BANDS), dtype=np.uint64)
        for r in range(BAND_ROWS):
            key = textnum.mix(key * U(31) + sig[:, :, r])
        rows.append(own + a)
        keys.append(key.view(np.int64))
    return (np.concatenate(rows), np.concatenate(keys)) if rows else (np.zeros(0, np.int64), np.zeros((0, BANDS), np.int64))


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, keys = bands(batch["text"])
        take = pa.array(rows)
        lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([batch["id"].take(take), batch["key"].take(take), batch["key2"].take(take), lists], ["id", "key", "key2", "bands"])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's multiset as sorted 64-bit members; the k-th copy of a shingle has a hash of its own."""
    for batch in batches:
        data, offsets = textnum.buffers(batch["text"])
        for a, b in textnum.pieces(offsets):
            owner, h, count = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            copy = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            member = textnum.mix(np.repeat(h, count) + copy.astype(np.uint64) * U(0x9E3779B97F4A7C15))
            edge = np.searchsorted(np.repeat(owner, count), np.arange(b - a + 1))
            body = [member[edge[k] : edge[k + 1]].tobytes() for k in range(b - a)]
            yield pa.RecordBatch.from_arrays([*(batch[c].slice(a, b - a) for c in ("rep", "key")), pa.array(np.diff(edge)), pa.array(body, pa.binary())], ["rep", "key", "size", "bag"])


def forest(bags: list[np.ndarray], part: np.ndarray, similarity: float, bands: np.ndarray | None = None, band: int = 0, block: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Index pairs at the similarity that join different parts, as a spanning forest.

    ``bands`` leaves out pairs that share a band before ``band``; ``block``
    those of one block.
    """
    size = np.array([len(b) for b in bags], dtype=np.int64)
    order = np.argsort(size, kind="stable")
    size, part = size[order], part[order].copy()
    edge = np.r_[0, np.cumsum(size)]
    _, member = np.unique(np.concatenate([bags[k] for k in order]), return_inverse=True)
    seen = np.zeros(len(member) + 1, dtype=np.int8)
    reach = np.searchsorted(size, size / similarity + 1e-9, "right")  # larger texts cannot reach it
    found = []
    for i in range(len(order)):
        j = np.arange(i + 1, reach[i])
        j = j[part[j] != part[i]]
        if block is not None:
            j = j[block[order[j]] != block[order[i]]]
        if bands is not None and len(j):
            j = j[np.argmax(bands[order[j]] == bands[order[i]], axis=1) == band]
        if not len(j):
            continue
        own = member[edge[i] : edge[i + 1]]
        seen[own] = 1
        n = size[j]
        flat = np.arange(n.sum()) + np.repeat(edge[j] - (np.cumsum(n) - n), n)
        both = np.add.reduceat(seen[member[flat]], np.cumsum(n) - n, dtype=np.int64)
        seen[own] = 0
        j = j[both / (n + size[i] - both) >= similarity]
        for k in j:
            if part[k] != part[i]:
                found.append((int(order[i]), int(order[k])))
                part[part == part[k]] = part[i]
    return found


_GROUPED = ["deal", "place", "side", "band", "rep", "part", "bands", "bag"]


def _grouped(similarity: float, masked: bool):  # noqa: ANN202
    """Search each place of a dealt group; ``side`` tells the blocks of a pair apart, 0 is both."""

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending"), ("rep", "ascending")])
        place, rep, part, side, band = (table[c].to_numpy() for c in ("place", "rep", "part", "side", "band"))
        bags = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["bag"]]
        keys = table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS) if masked else None
        cut = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])
        a, b = [], []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            across = side[lo:hi] if (side[lo:hi] != 0).any() else None
            for i, j in forest(bags[lo:hi], part[lo:hi], similarity, keys[lo:hi] if masked else None, int(band[lo]), across):
                a.append(rep[lo + i])
                b.append(rep[lo + j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return search


def _blocks(n: str, size: str) -> Column:
    """Number of blocks that so many texts with so many members fill."""
    return F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK), F.ceil(F.col(size) / BLOCK_MEMBERS)).cast("int")


def _searched(rows: DataFrame, bags: DataFrame, similarity: float, masked: bool, name: str) -> DataFrame:
    """Links of rows(rep, key, place, side, band, part[, bands]), small places grouped to about a block."""
    rows = shared.written(rows, f"{name}-places")
    members = bags.agg(F.coalesce(F.avg("size"), F.lit(0.0))).first()[0]
    groups = 1 + int(rows.count() * max(1 / BLOCK, members / BLOCK_MEMBERS))
    wide = rows.join(bags, KIND).withColumn("deal", F.pmod(F.xxhash64("place"), F.lit(groups)))
    if not masked:
        wide = wide.withColumn("bands", F.array().cast("array<long>"))
    found = shared.written(wide.select(*_GROUPED).groupBy("deal").applyInArrow(_grouped(similarity, masked), "a long, b long"), name)
    shared.discard(rows)
    return found


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [np.frombuffer(x.as_buffer(), np.int64) for x in batch["bag"]]
        size = np.array([len(x) for x in bags], dtype=np.int64)
        take = pa.array(np.repeat(np.arange(len(bags)), size))
        yield pa.RecordBatch.from_arrays([batch["rep"].take(take), batch["key"].take(take), batch["size"].take(take), pa.array(np.concatenate(bags) if bags else np.zeros(0, np.int64))], ["rep", "key", "size", "member"])


def _by_rare_member(wide: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """Places for :func:`_searched` of the kinds of crowded buckets, dealt by their rare members."""
    rows = shared.written(wide.join(bags, KIND).select(*KIND, "size", "bag").mapInArrow(_members, "rep long, key long, size long, member long"), "bag-members")
    often = rows.groupBy("member").agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy(*KIND).orderBy("often", "member")
    first = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1
    rare = rows.join(often, "member").withColumn("k", F.row_number().over(order)).where((F.col("k") <= first) & (F.col("often") > 1)).select(*KIND, "size", "member")
    rare = shared.written(rare, "rare-members")
    full = rare.groupBy("member").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("all")).where("n > 1").select("member", _blocks("n", "all").alias("blocks"))
    met = rare.join(full, "member").withColumn("own", F.pmod(F.xxhash64(*KIND), F.col("blocks")).cast("int"))
    # One block: place 0.  Several: each pair of blocks, and each block by itself, is a place.
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).otherwise(F.when(F.col("own") < F.col("other"), 1).otherwise(2))
    met = met.select(*KIND, F.xxhash64("member", F.least("own", "other"), F.greatest("own", "other")).alias("place"), side.alias("side"), F.lit(0).alias("band"))
    return met.join(wide, KIND).select(*KIND, "place", "side", "band", "part")


def _maybe(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of ``rows`` whose kind may be in ``wanted``: a bitmap of hashed kinds, in words of 64.

    The bitmap has at most 2 ** ``MAP_BITS`` bits whatever the input; fuller, it lets more rows by.
    """
    bits = int(min(MAP_BITS, max(16, np.ceil(np.log2(8 * max(wanted.count(), 1))))))
    cell = F.pmod(F.xxhash64(*KIND), F.lit(1 << bits))
    words = wanted.select(cell.alias("cell")).groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("set"))
    near = rows.withColumn("cell", cell).withColumn("word", F.shiftright("cell", 6)).join(F.broadcast(words), "word")
    return near.where(F.expr("getbit(set, cast(cell & 63 as int)) = 1")).select(*rows.columns)


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, class_id) for every distinct id whose document has words."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), shared.text_key(text).alias("key"), shared.text_key(text, 2).alias("key2"), F.col(text).alias("text"))
    signed = rows.where("id is not null").mapInArrow(_banded, "id long, key long, key2 long, bands array<long>")
    signed = shared.written(signed, "signatures")
    kinds = shared.written(signed.groupBy("key", "key2").agg(F.min("id").alias("rep")), "kinds")
    member = shared.written(signed.join(kinds, ["key", "key2"]).select("id", "key", "rep", F.when(F.col("id") == F.col("rep"), F.col("bands")).alias("bands")), "members")
    shared.discard(signed)
    shared.discard(kinds)
    own = member.where("bands is not null").select(*KIND, "bands")
    keys = own.select(*KIND, F.posexplode("bands").alias("band", "h")).withColumn("h", F.xxhash64("h", "band"))
    # A kind stands in a bucket once, or a few times if rows repeat.
    sizes = keys.groupBy("h").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "low")
    keys = shared.written(keys.join(sizes, "h"), "buckets")
    hubs = shared.written(keys.groupBy(*KIND).agg(F.min("low").alias("hub")), "hubs")
    # Only texts that share a bucket are read again.
    again = _maybe(rows.select(F.col("id").alias("rep"), "key", "text").where("rep is not null"), hubs)
    again = again.join(hubs.select(*KIND), KIND).dropDuplicates(KIND)
    bags = shared.written(again.mapInArrow(_bags, "rep long, key long, size long, bag binary"), "bags")

    # 1. Each kind with its hub.
    sized = hubs.join(bags.select(*KIND, "size"), KIND)
    crowd = sized.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("all")).select("hub", _blocks("n", "all").alias("blocks"))
    crowd = shared.written(crowd, "hub-blocks")
    spokes = shared.written(sized.join(crowd, "hub").select(*KIND, "hub", "blocks"), "spokes")
    middles = hubs.select(*KIND).join(crowd, F.col("rep") == F.col("hub")).select(*KIND, "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
    near = spokes.select(*KIND, "hub", F.pmod(F.xxhash64(*KIND), F.col("blocks")).cast("int").alias("own")).unionAll(middles).distinct()
    links = _searched(near.select(*KIND, F.xxhash64("hub", "own").alias("place"), F.lit(0).alias("side"), F.lit(0).alias("band"), F.col("rep").alias("part")), bags, similarity, False, "hub-links")
    # The texts of one id are one document.
    twice = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("id", "a")
    links = links.unionAll(member.join(twice, "id").select("a", F.col("rep").alias("b")))
    parts = shared.written(components.connected(links), "parts")

    # 2. Buckets that hold several components yet, and more than one whole hub with its kinds.
    placed = keys.join(spokes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").join(bags.select(*KIND, "size"), KIND), KIND)
    placed = shared.written(placed.select(*KIND, "band", "h", F.coalesce("component", "rep").alias("part"), "size", ((F.col("rep") == F.col("low")) | ((F.col("hub") == F.col("low")) & (F.col("blocks") == 1))).alias("done")), "placed")
    split = placed.groupBy("h").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.min("done").alias("done"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("all"))
    split = shared.written(split.where("p < q and not done").select("h", _blocks("n", "all").alias("blocks")), "split-buckets")
    whole = placed.join(split.where("blocks = 1"), "h", "left_semi")
    whole = whole.select(*KIND, F.col("h").alias("place"), F.lit(0).alias("side"), "band", "part").join(own.dropDuplicates(KIND), KIND)
    more = _searched(whole, bags, similarity, True, "bucket-links")
    # 3. Those that no task may hold whole.
    if split.where("blocks > 1").limit(1).count():
        wide = shared.written(placed.join(split.where("blocks > 1"), "h", "left_semi").select(*KIND, "part").distinct(), "wide")
        more = more.unionAll(_searched(_by_rare_member(wide, bags, similarity), bags, similarity, False, "wide-links"))
    parts = components.connected(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more))
    found = member.select("id", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("class_id"))
    found = shared.written(found.groupBy("id").agg(F.min("class_id").alias("class_id")), "classes")
    for table in (member, keys, hubs, bags, crowd, spokes, placed, split):
        shared.discard(table)
    return found


def near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, kept) for every row of ``docs``."""
    found = classes(docs, doc_id=doc_id, text=text, similarity=similarity)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"))
    joined = rows.where("doc_id is not null").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    out = joined.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    out = out.unionAll(rows.where("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its class."""
    found = classes(docs, doc_id=doc_id, text=text, similarity=similarity)
    gone = found.where("id <> class_id").select(F.col("id").alias("gone_id"))
    known = docs.where(docs[doc_id].isNotNull())
    kept = known.join(gone, known[doc_id].cast("long") == gone["gone_id"], "left_anti")
    return kept.unionAll(docs.where(docs[doc_id].isNull()))
