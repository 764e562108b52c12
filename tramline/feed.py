"""A feed: all-text tables with record numbers, and what is known about them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The number of a record in its file, header = 1; every tie goes by it.
ROW = "csv_row"


@dataclass(frozen=True)
class Feed:
    """``tables``: file name -> DataFrame(csv_row, text columns, "" for absent).

    ``headers`` keeps the raw header cells, which may repeat or be blank;
    ``incomplete`` names the files that were cut short or refused; ``present``
    the files that the archive has at all.
    """

    tables: Mapping[str, DataFrame]
    headers: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    incomplete: frozenset[str] = frozenset()
    present: frozenset[str] | None = None
    notices: DataFrame | None = None
    extras: Mapping[str, bytes] = field(default_factory=dict)

    def names(self, name: str) -> tuple[str, ...]:
        """Header of a table, as written."""
        if name in self.headers:
            return tuple(self.headers[name])
        return tuple(c for c in self.tables[name].columns if c != ROW) if name in self.tables else ()

    def has(self, name: str, column: str | None = None) -> bool:
        return name in self.tables and (column is None or column in self.names(name))

    def col(self, name: str, column: str) -> Column:
        """The column, or "" where the table has none of that name."""
        return F.col(column) if self.has(name, column) else F.lit("")

    def select(self, name: str, *columns: str) -> DataFrame:
        """csv_row and the named columns, "" for the absent ones."""
        return self.tables[name].select(ROW, *[self.col(name, c).alias(c) for c in columns])

    def with_tables(self, **changes: DataFrame) -> Feed:
        return replace(self, tables={**self.tables, **{f"{k}.txt": v for k, v in changes.items()}}, headers={k: v for k, v in self.headers.items() if k.removesuffix(".txt") not in changes})

    def with_table(self, name: str, table: DataFrame) -> Feed:
        return self.with_tables(**{name.removesuffix(".txt"): table})

    def cached(self) -> Feed:
        """Tables kept where they were first computed: every rule reads them again."""
        return replace(self, tables={k: v.persist() for k, v in self.tables.items()})

    def row_counts(self) -> dict[str, int]:
        """Rows of each table that has any, in one job."""
        if not self.tables:
            return {}
        counts = None
        for name, table in self.tables.items():
            one = table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("file"), "n")
            counts = one if counts is None else counts.unionAll(one)
        return {r.file: r.n for r in sorted(counts.collect()) if r.n}


def local_rows(spark: SparkSession, rows: Sequence[Mapping[str, Any]], first: int) -> DataFrame:
    """Text rows held by the driver, numbered from ``first``; absent cells are empty.

    They become a local relation, whose size Spark knows, so joins with it need no shuffle.
    """
    columns = list(dict.fromkeys(c for r in rows for c in r))
    cells = {c: pa.array(["" if r.get(c) is None else str(r[c]) for r in rows], pa.string()) for c in columns}
    return spark.createDataFrame(pa.table({ROW: pa.array(range(first, first + len(rows)), pa.int64()), **cells}))


def from_rows(spark: SparkSession, tables: Mapping[str, list[Mapping[str, str]]]) -> Feed:
    """A small feed from rows held by the driver; csv_row counts from 2."""
    return Feed({name: local_rows(spark, rows, 2) for name, rows in tables.items()})
