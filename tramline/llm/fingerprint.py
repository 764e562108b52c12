"""Document fingerprints: invertible Bloom lookup sketches, in SQL functions only.

A text's paragraphs are its lines; a line goes on being cut at the sentence
ends that follow every ``PIECE`` characters.  The set of 64-bit paragraph digests is
hashed into the cells of an invertible Bloom lookup table, each digest into
one cell of each of three thirds.  A cell has a count, the xor of its digests
and the xor of their checksums.  Subtracting two texts' cells cancels what
they share; peeling then recovers the digests in which they differ, and
likeness = shared / (shared + differing).

The table written as ``fingerprint`` has a fixed number of cells.  If peeling
it fails, larger tables are made of both texts, sized by an estimate of their
difference and larger each time, until it succeeds; what even the last leaves
is compared directly.  Cells are
rows and peeling is grouped sums over them, so a long document's table is
never handled as one value.

Defined cases: a null text counts as an empty one, which has one empty
paragraph; equal texts have equal fingerprints and likeness 1; the document
after the last is the first, so a single document is its own next; rows with
equal ids follow each other by text; very long texts count whole; null ids come last; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

PIECE = 100
THIRD = 6
CELLS = 3 * THIRD
#: Digests of a pair that its difference is estimated by.
SMALLEST = 32
#: Cells for each digest of the estimated difference in the larger tables, tried in this order.
LOADS = (1.8, 4.0, 12.0)
SWEEPS = 5
FIRST_SWEEPS = 3
#: Rows for each range of ids, and the most ranges: what the driver holds is their bounds.
ROWS_PER_RANGE = 1024
MOST_RANGES = 8192

_EMPTY_CELL = "named_struct('n', 0, 'k', 0L, 'c', 0L)"


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs."""
    found = F.regexp_extract_all(text, F.lit(rf"[^\n]{{{PIECE},}}?[.!?](?=\s|$)|[^\n]+"), F.lit(0))
    return F.array_distinct(F.transform(F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found), lambda p: F.xxhash64(p)))


def _entries(keys: str) -> str:
    """Each digest with its checksum and its cell in each third."""
    cells = ", ".join(f"'i{t}', cast({t * THIRD} + pmod(xxhash64(k, {t + 1}), {THIRD}) as int)" for t in range(3))
    return f"transform({keys}, k -> named_struct('k', k, 'c', xxhash64(k, 97), {cells}))"


def _cells(entries: str) -> str:
    """The table of the given entries."""
    into = "named_struct('n', a.n + 1, 'k', a.k ^ e.k, 'c', a.c ^ e.c)"
    return f"transform(sequence(0, {CELLS - 1}), i -> aggregate(filter({entries}, e -> e.i0 = i or e.i1 = i or e.i2 = i), {_EMPTY_CELL}, (a, e) -> {into}))"


def _subtracted(left: str, right: str) -> str:
    return f"zip_with({left}, {right}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c))"


def _place(t: int, key: Column, third: Column) -> Column:
    return (F.lit(t) * third + F.pmod(F.xxhash64(key, F.lit(t + 1)), third)).cast("int")


def _empty() -> Column:
    return (F.col("n") == 0) & (F.col("k") == 0) & (F.col("c") == 0)


def _sweep_sql(view: str) -> str:
    """The three steps of one sweep as one statement, which is analysed once."""
    steps, before = [], view
    for t in range(3):
        single = f"cell >= {t} * third and cell < {t + 1} * third and abs(n) = 1 and c = xxhash64(k, 97)"
        out = ", ".join(f"struct(cast({u} * third + pmod(xxhash64(k, {u + 1}), third) as int) as cell, -n as n, k as k, c as c)" for u in range(3) if u != t)
        spread = f"if({single}, array(struct(-1 as cell, 1L as n, 0L as k, 0L as c), {out}), array(struct(cell as cell, n as n, k as k, c as c)))"
        each = f"select uid, pair, third, inline({spread}) from {before}"
        steps.append(f"s{t} as (select uid, pair, third, cell, sum(n) as n, bit_xor(k) as k, bit_xor(c) as c from ({each}) group by uid, pair, third, cell having not (sum(n) = 0 and bit_xor(k) = 0 and bit_xor(c) = 0))")
        before = f"s{t}"
    return f"with {', '.join(steps)} select * from {before}"


def _swept(cells: DataFrame) -> DataFrame:
    view = f"cells_{uuid.uuid4().hex}"
    cells.createOrReplaceTempView(view)
    try:
        return cells.sparkSession.sql(_sweep_sql(view))
    finally:
        cells.sparkSession.catalog.dropTempView(view)


def _peel(cells: DataFrame, sweeps: int) -> DataFrame:
    """What ``sweeps`` sweeps, or as many as take anything out, leave of the
    pairs' cells(uid, pair, third, cell, n, k, c), dealt by uid; written.

    A sweep goes through the thirds.  The cells of one third that hold a
    single digest hold different ones; each is taken out of the other thirds,
    and counted in the pair's cell -1.  All grouping is by pair and cell, so
    the steps of a sweep follow each other without another shuffle.  Each sweep
    is written: every step has hash tables, which a task makes all at once.
    """
    table, left = None, None
    for _ in range(sweeps):
        swept = shared.written(_swept(cells if table is None else table.repartition("uid")), "cells")
        if table is not None:
            shared.discard(table)
        # A digest taken out leaves fewer cells.
        table, before, left = swept, left, swept.where("cell >= 0").count()
        if left in (0, before):
            break
    return table


def _found(peeled: DataFrame) -> DataFrame:
    """(uid, pair, d): digests recovered from each pair that has no cells left."""
    found = peeled.groupBy("uid", "pair").agg(F.expr("count_if(cell >= 0) as cells"), F.expr("sum(n) filter (where cell < 0) as d"))
    return found.where("cells = 0").select("uid", "pair", "d")


def _estimated(own: Column, other: Column) -> Column:
    """How many digests two sets probably differ in, by the smallest ``SMALLEST`` of their union."""
    a, b = (F.slice(F.array_sort(c), 1, SMALLEST) for c in (own, other))
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, SMALLEST)
    alike = F.size(F.array_intersect(F.array_intersect(least, a), b)) / F.size(least)
    return (F.size(own) + F.size(other)) * (1 - alike) / (1 + alike)


def _tables(pairs: DataFrame, load: float) -> DataFrame:
    """Subtracted cells of larger tables, ``load`` cells for each digest that the two probably differ in."""
    third = F.ceil((F.col("differ") * 1.25 + 8) * F.lit(load / 3)).cast("int") + 4
    signed = F.concat(F.transform("own", lambda k: F.struct(k.alias("k"), F.lit(1).alias("n"))), F.transform("other", lambda k: F.struct(k.alias("k"), F.lit(-1).alias("n"))))
    rows = pairs.select("uid", "pair", third.alias("third"), F.inline(signed)).withColumn("c", F.xxhash64("k", F.lit(97)))
    rows = rows.select("uid", "pair", "third", "n", "k", "c", F.explode(F.array(*[_place(t, F.col("k"), F.col("third")) for t in range(3)])).alias("cell"))
    return rows.groupBy("uid", "pair", "third", "cell").agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c")).where(~_empty())


def differences(pairs: DataFrame) -> DataFrame:
    """(uid, pair, d): number of digests in one text of a pair but not the other.

    ``pairs(uid, pair, own, other, cells)`` has both digest sets and the subtracted
    cells of the two fingerprints.  Those that hold no single digest, or don't
    peel, are tried again with larger tables.
    """
    hopeful = F.exists("cells", lambda x: (F.abs(x["n"]) == 1) & (x["c"] == F.xxhash64(x["k"], F.lit(97))))
    same = F.forall("cells", lambda x: (x["n"] == 0) & (x["k"] == 0) & (x["c"] == 0))
    known = pairs.where(same).select("uid", "pair", F.lit(0).cast("long").alias("d"))
    first = pairs.where(hopeful).select("uid", "pair", F.lit(THIRD).alias("third"), F.posexplode("cells").alias("cell", "x")).select("uid", "pair", "third", "cell", F.col("x.n").cast("long").alias("n"), "x.k", "x.c").where(~_empty())
    peeled = _peel(first.repartition("uid"), FIRST_SWEEPS)
    solved = shared.written(_found(peeled).unionAll(known), "peeled")
    shared.discard(peeled)
    rest = pairs.select("uid", "pair", "own", "other", _estimated(F.col("own"), F.col("other")).alias("differ")).join(solved, ["uid", "pair"], "left_anti")
    for load in LOADS:
        peeled = _peel(_tables(rest.repartition("uid"), load), SWEEPS)
        got = shared.written(_found(peeled), "peeled")
        shared.discard(peeled)
        solved, rest = solved.unionAll(got), rest.join(got, ["uid", "pair"], "left_anti")
    # Digests that no table could part: compared directly.
    plain = (F.size(F.array_except("own", "other")) + F.size(F.array_except("other", "own"))).cast("long")
    return solved.unionAll(rest.select("uid", "pair", plain.alias("d")))


def _written_cells(cells: str) -> Column:
    return F.expr(f"array_join(transform({cells}, x -> concat(lower(hex(x.n)), '.', lpad(lower(hex(x.k)), 16, '0'), '.', lpad(lower(hex(x.c)), 16, '0'))), ':')")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs(doc_id, key, ...)`` with a row number ``uid`` and ``next_<c>`` of the following row.

    Rows are dealt to ranges of ids, whose bounds are quantiles; the first row
    of each range also stands, as a ghost, at the end of the range before it,
    so each range is ordered alone.  The driver holds at most MOST_RANGES bounds.
    """
    count = docs.count()
    n = max(1, min(MOST_RANGES, count // ROWS_PER_RANGE))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    bounds = sorted(set(cuts or []))
    if bounds:
        steps = [1 << s for s in range(len(bounds).bit_length() - 1, -1, -1)]
        at = f"aggregate(array({', '.join(map(str, steps))}), 0, (p, s) -> if(p + s <= {len(bounds)} and doc_id >= element_at(array({', '.join(f'{b}L' for b in bounds)}), p + s), p + s, p))"
        placed = docs.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(F.expr(at)))
    else:
        placed = docs.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(F.lit(0)))
    firsts = sorted((r[0], r[1]) for r in placed.groupBy("range").agg(F.min("doc_id")).collect())
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    home = F.col("range")
    ghost = F.when(F.col("doc_id").isNull(), F.lit(before[None])) if None in before else None
    known = [k for k in before if k is not None]
    if known:
        ranges = F.create_map(*[F.lit(x) for k in known for x in (k, before[k])])
        hit = F.when(F.col("doc_id").isin(known), ranges[F.col("doc_id")])
        ghost = hit if ghost is None else F.coalesce(hit, ghost)
    stands = F.array(F.struct(home.alias("range"), F.lit(False).alias("ghost")))
    if ghost is not None:
        stands = F.when(ghost.isNotNull(), F.concat(stands, F.array(F.struct(ghost.alias("range"), F.lit(True).alias("ghost"))))).otherwise(stands)
    spread = placed.withColumn("stand", F.explode(stands)).withColumns({"range": F.col("stand.range"), "ghost": F.col("stand.ghost")}).drop("stand")
    following = "partition by range order by ghost, doc_id nulls last, key"
    out = spread.selectExpr("*", f"shiftleft(cast(range as bigint), 40) + row_number() over ({following}) as uid", *[f"lead({c}) over ({following}) as next_{c}" for c in columns])
    return out.where("not ghost").drop("ghost", "range")


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep_edited: bool = False) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, d_edited, d_next (differing digests), and on request the edited text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), shared.text_key(text).alias("key")).withColumn("own", digests(F.col("text")))
    rows = with_next(rows, ["text", "own"])
    size = F.length("text")
    cut = F.floor(size / 4).cast("int")
    rows = rows.select("uid", "doc_id", size.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), size - cut), F.substring("next_text", F.lit(1), cut)).alias("edited"), "own", "next_own")
    rows = rows.select("uid", "doc_id", "n_chars", *(["edited"] if keep_edited else []), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", "next_own", digests(F.col("edited")).alias("after"))
    rows = shared.written(rows, "texts")
    full = rows.select("*", *[F.expr(_cells(_entries(c))).alias(f"{c}_cells") for c in ("own", "after", "next_own")])
    sides = F.array(*[F.struct(F.lit(p).alias("pair"), F.col(c).alias("other"), F.expr(_subtracted("own_cells", f"{c}_cells")).alias("cells")) for p, c in enumerate(("after", "next_own"))])
    d = differences(shared.written(full.select("uid", "own", F.inline(sides)).select("uid", "pair", "own", "other", "cells"), "pairs"))
    d = d.groupBy("uid").agg(*[F.max(F.when(F.col("pair") == p, F.col("d"))).alias(name) for p, name in enumerate(("d_edited", "d_next"))])
    out = rows.select("*", *[_written_cells(_cells(_entries(c))).alias(name) for c, name in (("own", "fingerprint"), ("after", "edited_fingerprint"))]).join(d, "uid")

    def likeness(other: str, differing: str) -> Column:
        common = (F.size("own") + F.size(other) - F.col(differing)) / F.lit(2)
        return (common / (common + F.col(differing))).cast("double")

    return out.select(
        "doc_id", "n_chars", *(["edited"] if keep_edited else []), "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("after", "d_edited").alias("near_edited"), likeness("next_own", "d_next").alias("near_next"), "d_edited", "d_next",
    )
